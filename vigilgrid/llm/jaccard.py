"""Similarity join on word shingles by filters under several global orders.

Two sets of Jaccard similarity t or more share a token in their prefixes under any global order of
tokens: of n tokens the first n - ceil(t n) + 1. The join counts in how many sets each token occurs
and orders tokens by that count; two further orders are hashes. A pair is compared exactly only if
its prefixes meet under all three orders.

Sets without a partner drop out first, under a hash order: similar sets share at least ceil(e n) of
their first n - ceil(t n) + ceil(e n) tokens there, so only those tokens of every set are exchanged,
and a set stays if enough of its own occur in others. Equal sets are one set with several documents.
Groups of near copies are not expanded into pairs (``links``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.llm import links
from vigilgrid.llm.words import distinct_by_row, mixed, shingles, slices, words_of
from vigilgrid.session import cut_lineage

WIDTH, PERCENT = 5, 75
#: Shared tokens, as a percentage of a set, that its part sent out under the hash order has to show.
SHOWN = 15
#: Token occurrences a task gathers before it hands them on; hash ranges at least, and occurrences of one beyond them.
GATHERED, RANGES, MERGED = 4_000_000, 64, 8_000_000
#: Text hashes that are broadcast at most, 16 bytes each.
SENT = 1_000_000


def least_overlap(n: Column, percent: int = PERCENT) -> Column:
    """ceil(t n) in whole numbers."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _shown(n: np.ndarray) -> np.ndarray:
    """How many tokens of a set of n, by hash, are sent out."""
    return n - (n * PERCENT + 99) // 100 + (n * SHOWN + 99) // 100


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, and every row's set size and set fingerprint."""
    tokens, rows = distinct_by_row(*shingles(words_of(column), WIDTH))
    n = np.bincount(rows, minlength=len(column))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(n)
    return tokens, rows, n, mixed(sums[ends] - sums[ends - n] + n.astype(np.uint64))


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        _, _, n, prints = _sets(batch.column("text"))
        yield pa.record_batch([batch.column("id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(prints.view(np.int64))], ["id", "hash", "n", "set"])


def _blocks(parts: int):
    """Tokens sent out of a task's sets, by hash range: sorted tokens and the set of each. A token met in two of
    the task's sets is repeated for certain, so one occurrence stands for all, and its sets are told."""
    def emit(tokens: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sets, tokens))
        tokens, sets = tokens[order], sets[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])  # copies of a set count once
        tokens, sets = tokens[fresh], sets[fresh]
        starts = np.flatnonzero(np.append([True], tokens[1:] != tokens[:-1]))
        count = np.diff(np.append(starts, len(tokens)))
        several = np.repeat(count > 1, count)
        names, told = np.unique(sets[several], return_counts=True)
        tokens, first, several = tokens[starts], sets[starts], count > 1
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                own, where = np.unique(first[a:b], return_inverse=True)
                kind = np.uint16 if len(own) < 1 << 16 else np.uint32
                yield _block(p, tokens[a:b].tobytes(), own.tobytes(), where.astype(kind).tobytes(), np.packbits(several[a:b]).tobytes())
        if len(names):
            yield _block(int(names[0] % np.uint64(parts)), b"", names.tobytes(), told.astype(np.uint32).tobytes(), b"")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            tokens, rows, n, prints = _sets(batch.column("text"))
            place = np.arange(len(tokens)) - (np.cumsum(n) - n)[rows]
            first = place < _shown(n)[rows]
            held.append((tokens[first], prints[rows[first]]))
            size += len(held[-1][0])
            if size >= GATHERED:
                yield from emit(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    return run


_BLOCK = "part int, tokens binary, own binary, place binary, several binary"


def _block(part: int, *fields: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), *(pa.array([f], pa.binary()) for f in fields)],
                           ["part", "tokens", "own", "place", "several"])


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of each set were sent out by another set too, from the blocks of hash ranges, in order."""
    def count(blocks: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        tokens, sets, sure = [], [], []
        for t, own, place, several in blocks:
            names, keys = np.frombuffer(own, np.uint64), np.frombuffer(t, np.uint64)
            if not len(keys):
                yield told(names, np.frombuffer(place, np.uint32))
                continue
            where = np.frombuffer(place, np.uint16 if len(place) == 2 * len(keys) else np.uint32)
            tokens.append(keys)
            sets.append(names[where])
            sure.append(np.unpackbits(np.frombuffer(several, np.uint8), count=len(keys)).astype(bool))
        if not tokens:
            return
        tokens, sets, sure = np.concatenate(tokens), np.concatenate(sets), np.concatenate(sure)
        order = np.lexsort((sets, tokens))
        tokens, sets, sure = tokens[order], sets[order], sure[order]
        starts = np.flatnonzero(np.append([True], tokens[1:] != tokens[:-1]))
        change = np.append([True], (sets[1:] != sets[:-1]) | (tokens[1:] != tokens[:-1]))
        lengths = np.diff(np.append(starts, len(tokens)))
        known = np.logical_or.reduceat(sure, starts)
        hit = np.repeat(known | (np.add.reduceat(change, starts) > 1), lengths)
        # A task told of its own repeated tokens already.
        yield told(*np.unique(sets[hit & ~sure & change], return_counts=True))

    def told(names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64))], ["set", "found"])

    current, blocks = None, []
    for batch in batches:
        for part, *fields in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "own", "place", "several"))):
            if part != current and blocks:
                yield from count(blocks)
                blocks = []
            current = part
            blocks.append(tuple(fields))
    if blocks:
        yield from count(blocks)


def member_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``set, n, bits, tokens`` of every text."""
    for batch in slices(batches, "text"):
        tokens, _, n, prints = _sets(batch.column("text"))
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        bits = links.parities(tokens, n)
        yield pa.record_batch([pa.array(prints.view(np.int64)), pa.array(n, pa.int64()), lists(np.arange(len(n) + 1) * links.WORDS, bits.ravel()),
                               lists(np.concatenate([[0], np.cumsum(n)]), tokens.view(np.int64))], ["set", "n", "bits", "tokens"])


def members(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tokens of the sets ``wanted(set, hash)``, each from the texts with that hash."""
    hashes = wanted.select("hash").distinct()
    # Few hashes go to the texts; beyond that bound both are shuffled.
    texts = rows.join(F.broadcast(hashes) if hashes.count() <= SENT else hashes, "hash", "left_semi").select("text")
    found = texts.mapInArrow(member_rows, "set bigint, n bigint, bits array<bigint>, tokens array<bigint>")
    return cut_lineage(found.join(wanted.select("set"), "set", "left_semi").groupBy("set").agg(
        *(F.first(c).alias(c) for c in ("n", "bits", "tokens"))))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, hash`` of every row."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, hash, n, set, component, component_id`` of every row; ``hash`` is its text's."""
    rows = text_rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    summary = cut_lineage(rows.mapInArrow(_summaries, f"id {kind}, hash bigint, n bigint, set bigint"))
    return links.named(summary, _components(rows, summary))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    A component is named by its smallest id. A text without words links with nothing, null counts as
    empty; rows with a null id link as others do and have the smallest id of their component, null if
    it has none. Rows that repeat an id and a text repeat its result. No rows give no rows.
    """
    return grouped(docs, id_col, text_col).select("id", F.col("n").alias("n_shingles"), "component_id")


def _components(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``set, component`` of the sets that may have partners."""
    total = summary.agg(F.sum("n")).first()[0] or 0
    parts = max(RANGES, -(-int(total) // MERGED))
    blocks = rows.select("text").mapInArrow(_blocks(parts), _BLOCK)
    found = (blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_repeated, "set bigint, found bigint")
             .groupBy("set").agg(F.sum("found").alias("found")))
    sizes = summary.where("n > 0").groupBy("set").agg(F.min("hash").alias("hash"), F.max("n").alias("n"))
    # The partner is no smaller than ceil(t n), and the smaller set decides how many shared tokens show.
    shown = F.floor((least_overlap(F.col("n")) * SHOWN + 99) / 100)
    hopeful = cut_lineage(found.join(sizes, "set").where(F.col("found") >= shown).select("set", "hash"))
    return _joined(_prefixed(members(rows, hopeful)))


def _prefixed(sets: DataFrame) -> DataFrame:
    """``set, n, bits, tokens, p1, p2, p3``: tokens met in several sets and the prefix under each order.

    Tokens of one set come first under every order, so they only shorten the prefix.
    """
    each = sets.select("set", F.explode("tokens").alias("token"))
    often = each.groupBy("token").count().where("count > 1")
    shared = each.join(often, "token").groupBy("set").agg(F.collect_list(F.struct("count", "token")).alias("t"))
    shared = shared.join(sets.drop("tokens"), "set").withColumn("k", F.size("t") - least_overlap(F.col("n")) + 1).where("k > 0")
    by_hash = [F.expr(f"slice(array_sort(transform(t, x -> named_struct('h', xxhash64(x.token, {seed}), 'token', x.token))).token, 1, k)")
               .alias(f"p{seed}") for seed in (2, 3)]
    return cut_lineage(shared.select("set", "n", "bits", F.col("t.token").alias("tokens"), F.expr("slice(array_sort(t).token, 1, k)").alias("p1"), *by_hash))


def _joined(sets: DataFrame) -> DataFrame:
    """``set, component`` after all links."""
    prefix = F.posexplode("p1").alias("place", "key")
    keys = sets.select("set", "n", F.size("tokens").alias("t"), prefix).select(
        "set", "key", "n", (F.col("t") - F.col("place")).cast("bigint").alias("rem"), F.array("key").alias("marks"))
    return links.components(links.crowded(keys, PERCENT), sets.withColumn("orders", F.array("p1")), PERCENT, _orders_meet)


def _orders_meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose prefixes meet under the two further orders as well. Prefixes travel as 32-bit
    hashes, which can only let a pair pass."""
    short = sets.select("set", *(F.expr(f"transform({p}, x -> hash(x))").alias(p) for p in ("p2", "p3")))
    met = pairs.join(short, "set").join(short.toDF("other", "q2", "q3"), "other")
    return met.where(F.arrays_overlap("p2", "q2") & F.arrays_overlap("p3", "q3")).select("set", "other")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: one of each component, with its smallest id (null ids last; of
    several texts with that id the one with the least hash). Rows without words all stay."""
    rows = grouped(docs, id_col, text_col).where("n > 0")
    first = cut_lineage(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("c")))
    named = rows.join(first, "component").select("id", "hash", (F.col("id").eqNullSafe(F.col("c.id")) & (F.col("hash") == F.col("c.hash"))).alias("stays"))
    each = cut_lineage(named.groupBy("id", "hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("c")).where("NOT stays OR c > 1"))
    text = F.xxhash64(docs[f"`{text_col}`"])

    def like(found: DataFrame) -> Column:
        return docs[f"`{id_col}`"].eqNullSafe(found["_id"]) & (text == found["_hash"])

    gone = each.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    alone = docs.join(gone, like(gone), "left_anti")
    repeated = each.where("stays").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    if repeated.isEmpty():
        return alone
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    once = docs.join(repeated, like(repeated)).select("_id", "_hash", row).groupBy("_id", "_hash").agg(F.first("row").alias("row"))
    return alone.unionByName(once.select("row.*"))
