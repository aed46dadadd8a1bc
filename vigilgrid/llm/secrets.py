"""Secret scans with multipart linking, in built-in functions only.

Base spans stand alone: assigned credentials, access identifiers, long hex runs. Weak parts (a long
mixed run that may be a secret key, an endpoint) are reported only when complementary parts lie in
the same scope, a stretch of ``REACH`` code points around them: a weak secret needs an access
identifier, an endpoint needs an access identifier and a secret of any kind. Parts meet by an
interval join: each part's interval is dealt into bins of one scope length within its text, so only
parts of neighbouring bins meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.session import cut_lineage

# The base kinds in their order, with the pattern, the least length and the group it holds for.
ASSIGN = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
          r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0))
# Long runs only are looked for where that gives the same spans as dropping short ones afterwards.
_FASTER = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
_HINTS = {"assign": "(contains(lower(t), 'pass') OR contains(lower(t), 'secret') OR contains(lower(t), 'token') OR contains(lower(t), 'key'))"
                    " AND regexp_like(t, '[:=]')",
          "access": "contains(t, 'AKIA')"}
#: Weak kinds and the pattern of each.
WEAK = (("key", r"[A-Za-z0-9+/]{40,}={0,2}"), ("endpoint", r"https?://[A-Za-z0-9][A-Za-z0-9.:/_?&=%~#-]*"))
KINDS = [k for k, *_ in BASE] + [k for k, _ in WEAK]
REACH = 256
_NONE = "CAST(array() AS array<struct<s:int,k:int,e:int>>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str, pattern: str, least: int = 0, group: int = 0) -> str:
    """SQL for an array of spans of ``t``: matches and the gaps between them give every position."""
    p, order = _quoted(pattern), KINDS.index(kind)
    matches = f"regexp_extract_all(t, {p}, 0)"
    held = f"regexp_extract_all(t, {p}, {group})"
    walk = (f"aggregate(arrays_zip(split(t, {p}, -1), {matches}, {held}), "
            "named_struct('at', 0, 'out', " + _NONE + "), "
            "(a, x) -> named_struct('at', a.at + length(x['0']) + coalesce(length(x['1']), 0), 'out', "
            f"IF(x['1'] IS NULL OR length(x['2']) < {least}, a.out, concat(a.out, array(named_struct("
            f"'s', a.at + length(x['0']), 'k', {order}, 'e', a.at + length(x['0']) + length(x['1'])))))), a -> a.out)")
    # Most texts hold no match; a plain search tells most of those sooner than the pattern does.
    hint = _HINTS.get(kind, f"regexp_like(t, {p})")
    return f"IF({hint}, {walk}, {_NONE})"


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)))"


def _bins(start: str, end: str) -> Column:
    return F.explode(F.expr(f"sequence(CAST(greatest({start}, 0) DIV {REACH} AS INT), CAST({end} DIV {REACH} AS INT))"))


def scanned(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (columns of ``docs``), n_assign, n_access, n_hex, ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (s, k, e): start, kind's number in ``KINDS``, end, ordered so;
    code points, end exclusive. Null and empty texts have none; equal texts have equal spans; other
    columns are carried unread.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), text.alias("t"))
    # Weak parts count only beside an access identifier, so most texts need their base spans alone.
    # The two branches part by a cheap test, as a filter is evaluated again wherever it is pushed.
    has_access = F.col("t").contains("AKIA")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    names = ["row", *(f"n_{k}" for k, *_ in BASE), "base"]
    base = "sort_array(concat(assign, access, hex))"
    plain = _base_spans(rows.where(~has_access)).select("row", *counts, F.expr(base).alias("base"))
    plain = plain.select(*names, F.col("base").alias("spans"))
    found = _base_spans(rows.where(has_access)).select("*", F.expr(base).alias("base"))
    found = found.select("*", *(F.expr(_spans(k, p)).alias(f"all_{k}") for k, p in WEAK))
    # A weak part that touches a base span is that span already.
    found = found.select("row", *counts, "base", "access", F.expr("concat(assign, hex)").alias("strong"), *(
        F.expr(f"filter(all_{k}, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e))").alias(k) for k, _ in WEAK),
        F.sha2("t", 256).alias("text_key"))
    # The parts are few beside the texts: written once, as the joins name them several times. Merge joins
    # keep them off the driver.
    linked = _linked(cut_lineage(found.select("text_key", "access", "strong", "key", "endpoint").dropDuplicates(["text_key"])))
    met = found.join(linked.hint("merge"), "text_key", "left").select(
        *names, F.expr(f"sort_array(concat(base, coalesce(extra, {_NONE})))").alias("spans"))
    return plain.union(met)


def _base_spans(rows: DataFrame) -> DataFrame:
    return rows.select("row", "t", *(F.expr(_spans(k, _FASTER.get(k, p), least, group)).alias(k) for k, p, least, group in BASE))


def _linked(parts: DataFrame) -> DataFrame:
    """``text_key, extra``: the weak spans that complementary parts support."""
    def part(column: str) -> DataFrame:
        return parts.select("text_key", F.explode(column).alias("x")).select("text_key", "x")

    def near(what: DataFrame, other: DataFrame) -> DataFrame:
        """Rows of ``what`` whose interval comes within reach of one of ``other``."""
        left = what.withColumn("bin", _bins("x.s", "x.e"))
        right = other.select("text_key", F.col("x").alias("y"), _bins(f"x.s - {REACH}", f"x.e + {REACH}").alias("bin"))
        return left.join(right.hint("merge"), (left.text_key == right.text_key) & (left.bin == right.bin)
                         & F.expr(f"x.s <= y.e + {REACH} AND y.s <= x.e + {REACH}"), "left_semi").drop("bin").distinct()

    keys = near(part("key"), part("access"))
    secrets = part("strong").unionByName(keys)
    ends = near(near(part("endpoint"), part("access")), secrets)
    return keys.unionByName(ends).groupBy("text_key").agg(F.collect_list("x").alias("extra"))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "*") -> DataFrame:
    """The columns of ``docs`` with every reported span of the text masked, its length unchanged."""
    rows = scanned(docs, text_col)
    # Overlapping spans are walked in order; what lies before the furthest end so far is masked once.
    masked = F.expr(
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> IF(x.e <= a.at, a, named_struct('at', x.e, 'out', "
        "concat(a.out, substring(t, a.at + 1, greatest(x.s - a.at, 0)), "
        f"repeat('{mask}', x.e - greatest(x.s, a.at))))), a -> concat(a.out, substring(t, a.at + 1)))")
    inner = rows.select("row", "spans", F.col(f"row.`{text_col}`").alias("t"))
    out = inner.select("row", F.when(F.size("spans") > 0, masked).otherwise(F.col("t")).alias("t"))
    return out.select(*(F.col("t").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def joined(spans: str) -> Column:
    """``kind:start:end`` of an array column of spans, comma-joined."""
    return F.expr(_joined(spans))


def sql(relation: str, columns: str = "doc_id") -> str:
    """The same in DuckDB SQL over texts ``text`` of ``relation``."""
    def parts(kind: str, pattern: str, group: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return (f"string_split_regex(t, {p}) AS gap_{kind}, regexp_extract_all(t, {p}, 0) AS whole_{kind}, "
                f"regexp_extract_all(t, {p}, {group}) AS held_{kind}")

    def lengths(kind: str) -> str:
        """Where each match starts: all gaps so far and all matches before."""
        return (f"list_transform(generate_series(1, len(whole_{kind})), lambda i: CAST(length(array_to_string(gap_{kind}[1:i], '')) "
                f"+ length(array_to_string(whole_{kind}[1:i - 1], '')) AS INT)) AS at_{kind}")

    def spans(kind: str, least: int) -> str:
        return (f"list_transform(list_filter(generate_series(1, len(whole_{kind})), lambda i: length(held_{kind}[i]) >= {least}), "
                f"lambda i: {{'s': at_{kind}[i], 'k': {KINDS.index(kind)}, 'e': CAST(at_{kind}[i] + length(whole_{kind}[i]) AS INT)}})")

    every = [(k, p, group) for k, p, _, group in BASE] + [(k, p, 0) for k, p in WEAK]
    base = ", ".join(f'{spans(k, least)} AS "{k}"' for k, _, least, _ in BASE)
    weak = ", ".join(f"{spans(k, 0)} AS all_{k}" for k, _ in WEAK)
    clear = ", ".join(f"list_filter(all_{k}, lambda x: len(list_filter(base, lambda b: b.s < x.e AND x.s < b.e)) = 0) AS weak_{k}" for k, _ in WEAK)
    near = lambda others: f"len(list_filter({others}, lambda y: x.s <= y.e + {REACH} AND y.s <= x.e + {REACH})) > 0"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = lambda spans: f"array_to_string(list_transform(list_sort({spans}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
SELECT {columns}, len(assign) AS n_assign, len("access") AS n_access, len(hex) AS n_hex,
       sha256({text('base')}) AS base_sha256, {text('list_concat(base, keys, ends)')} AS spans
FROM (SELECT *, list_filter(weak_endpoint, lambda x: {near('"access"')} AND {near('list_concat(assign, hex, keys)')}) AS ends
FROM (SELECT *, list_filter(weak_key, lambda x: {near('"access"')}) AS keys
FROM (SELECT *, {clear}
FROM (SELECT *, list_concat(assign, "access", hex) AS base
FROM (SELECT {columns}, {base}, {weak}
FROM (SELECT *, {", ".join(lengths(k) for k, *_ in every)}
FROM (SELECT {columns}, {", ".join(parts(*e) for e in every)} FROM (SELECT {columns}, coalesce(text, '') AS t FROM {relation}))))))))"""
