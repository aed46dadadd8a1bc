"""Quality rules: a threshold table compiled into one projection of built-in functions.

Everything is counted in whole numbers and thresholds are percentages, so the verdict never depends
on rounding. Nothing is shuffled and no function of the user's runs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Frequent function words of the corpus languages (English, French, Spanish, German); met in lower
#: case or with a capital. Texts of other languages fail the stop-word rule: give them rules without it.
STOP_WORDS = ("a an and are as at be by for from in is it of on or that the this to was with "
              "au des du elle en est et la le les pas pour que qui un une "
              "al con de del el las los no por se su y "
              "das dem den der die ein eine ist mit nicht sich und von zu").split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high``; an open end is None. A whole of 0 passes."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("word length", "word_chars", "n_words", 200, 2000),
    Rule("symbols by word", "n_symbols", "n_words", None, 20),
    Rule("exclamations by word", "n_exclaims", "n_words", None, 30),
    Rule("capitals by letter", "n_capitals", "word_chars", None, 50),
    Rule("stop words by word", "n_stop_words", "n_words", 2, None),
    Rule("repeated lines by word", "n_dup_line_words", "n_words", None, 30),
)
#: Fewest words, and the highest percentage of words in repeated three-word windows.
MIN_WORDS, MAX_REPEATED = 50, 50


def _count(others: str) -> Column:
    """Characters of the text outside a class."""
    return F.length(F.regexp_replace("t", others, "")).cast("long")


def _stops() -> str:
    return ", ".join(f"'{w}'" for w in [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])


def measured(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``) and the counts of each text; null text has no words.

    Repeated, empty and very long texts need no special case: a row's counts depend on its text alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = docs.columns if carry is None else carry
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), text.alias("t"))
    split = base.select(
        "row", "t",
        F.expr("array_remove(split(t, '[ \\t-\\r]+'), '')").alias("w"),
        F.expr("filter(split(t, '\n'), l -> l RLIKE '[^ \\t-\\r]')").alias("lines"))
    # Windows of three words by their hashes. Where all hashes differ no window is repeated; elsewhere
    # hashes, with the window's place in the lowest bits, are sorted so that equal ones are neighbours.
    # Hashes only pick windows to look at; their words decide.
    counted = split.select("*", F.size("w").alias("n"), F.expr("CAST(ceil(log2(size(w) + 2)) AS INT)").alias("b"))
    hashed = counted.withColumn("h", F.expr(
        "IF(n < 3, CAST(array() AS array<bigint>), transform(arrays_zip(slice(w, 1, n - 2), slice(w, 2, n - 2), slice(w, 3, n - 2)), "
        "x -> xxhash64(x)))"))
    placed = hashed.withColumn("h", F.expr(
        "IF(size(array_distinct(h)) = size(h), CAST(array() AS array<bigint>), "
        "sort_array(transform(h, (x, k) -> shiftleft(shiftright(x, b), b) | CAST(k + 1 AS BIGINT))))"))
    alike = placed.withColumn("h", F.expr(
        "transform(filter(h, (x, k) -> shiftright(x, b) = shiftright(get(h, k - 1), b) OR "
        "shiftright(x, b) = shiftright(get(h, k + 1), b)), x -> CAST(x & (shiftleft(1L, b) - 1L) AS INT))"))
    windows = alike.withColumn("z", F.expr(
        "sort_array(transform(h, i -> named_struct('a', w[i - 1], 'b', w[i], 'c', w[i + 1], 'i', i)))"))
    same = "coalesce(x.a = get(z, {0}).a AND x.b = get(z, {0}).b AND x.c = get(z, {0}).c, false)"
    twice = windows.withColumn("starts", F.expr(
        f"sort_array(transform(filter(z, (x, k) -> {same.format('k - 1')} OR {same.format('k + 1')}), x -> x.i))"))
    stops = _stops()
    long = lambda e: F.expr(f"CAST({e} AS BIGINT)")
    return twice.select(
        "row",
        long("n").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count("[^#*$%&|<>]+").alias("n_symbols"),
        long("size(lines) - size(array_distinct(lines))").alias("n_dup_lines"),
        # A repeated window adds three words, or as many as lie behind the window before it.
        long("aggregate(starts, named_struct('last', -3, 'n', 0), (a, p) -> named_struct('last', p, "
             "'n', a.n + least(3, p - a.last)), a -> a.n)").alias("n_repeat_words"),
        # Words of lines met before: all words less those of the distinct lines.
        long("IF(size(array_distinct(lines)) = size(lines), 0, "
             "n - size(array_remove(split(array_join(array_distinct(lines), '\n'), '[ \\t-\\r]+'), '')))").alias("n_dup_line_words"),
        _count("[^!]+").alias("n_exclaims"),
        _count("[^A-Z]+").alias("n_capitals"),
        long(f"size(filter(w, x -> x IN ({stops})))").alias("n_stop_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one condition."""
    verdict = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 100, F.col(r.whole)
        if r.low is not None:
            verdict = verdict & (part >= whole * r.low)
        if r.high is not None:
            verdict = verdict & (part <= whole * r.high)
    return verdict


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
           carry: list[str] | None = None) -> DataFrame:
    """``measured`` plus ``base_failed`` and ``kept``."""
    return measured(docs, text_col, carry).select("*", base_failed().alias("base_failed"), (~base_failed() & passes(rules)).alias("kept"))


def accepted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    # Counting the verdicts keeps the filter above the projections; pushed below, it would evaluate them again.
    verdicts = judged(docs, text_col, rules).observe(
        f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("seen"), F.count_if("kept").alias("kept"))
    return verdicts.where("kept").select("row.*")


def sql(relation: str, text: str = "text", rules: tuple[Rule, ...] = RULES, columns: str = "doc_id") -> str:
    """The same in DuckDB SQL: ``columns`` and every count over ``relation``."""
    stops = _stops()
    conditions = " AND ".join(
        [f"100 * {r.part} >= {r.low} * {r.whole}" for r in rules if r.low is not None]
        + [f"100 * {r.part} <= {r.high} * {r.whole}" for r in rules if r.high is not None])
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)"
    return f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS _r, {columns}, coalesce({text}, '') AS t FROM {relation}),
split AS MATERIALIZED (SELECT *, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS lines FROM numbered),
places AS (SELECT _r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
windows AS (SELECT _r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY _r ORDER BY i)),
again AS (SELECT _r, i, count(*) OVER (PARTITION BY _r, a, b, c) AS c FROM windows WHERE c IS NOT NULL),
gaps AS (SELECT _r, i - lag(i, 1, -9) OVER (PARTITION BY _r ORDER BY i) AS gap FROM again WHERE c > 1),
repeats AS (SELECT _r, CAST(sum(least(3, gap)) AS BIGINT) AS n FROM gaps GROUP BY _r),
counted AS (SELECT {columns}, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(w) - len(list_filter(string_split_regex(array_to_string(list_distinct(lines), chr(10)), '[ \\t-\\r]+'), lambda x: x <> '')) AS n_dup_line_words,
    len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (_r))
SELECT {columns}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND {conditions} AS kept
FROM counted"""
