"""Fill-in-the-middle transformation of texts as one pyarrow.compute pipeline per batch.

Every text becomes a list of units, runs of ASCII letters or single other code points. The lists are
flattened with their parents' indices; a unit's ordinal against the row's two cuts decides its role.
Units of one role are filtered, regrouped into lists and joined, and the three pieces are joined in
the row's form. Where the cuts lie and which form a row takes depends on its id alone, so a retried
task or another partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilgrid.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of documents that are transformed, and of those in suffix-prefix-middle order.
TRANSFORMED, SPM = 90, 20
#: One unit as bytes of UTF-8; 0xFF never occurs in UTF-8 and parts the units.
_UNIT, _PART = rb"([A-Za-z]+|[\x00-\x7F]|[\xC0-\xF7][\x80-\xBF]*)", b"\xff"


def _draw(ident: Column, group: int) -> Column:
    """The group-th 8 hex digits of sha256 of ``1:`` and the id, as a number; a null id counts as empty."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(name, 8 * group - 7, 8), 16, 10).cast("long")


def _units(texts: pa.Array) -> pa.LargeListArray:
    """The units of every text, as lists of bytes."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), _UNIT, rb"\1" + _PART)
    parts = pc.split_pattern(marked, _PART)
    # Every unit is followed by a mark, so the last part of a text is empty and no unit.
    offsets = parts.offsets.to_numpy()
    inner = np.ones(int(offsets[-1] - offsets[0]), bool)
    inner[offsets[1:] - offsets[0] - 1] = False
    kept = offsets - offsets[0] - np.arange(len(offsets))
    return pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), pc.list_flatten(parts).filter(pa.array(inner)))


def _joined(units: pa.Array, parents: pa.Array, chosen: pa.Array, rows: int) -> pa.Array:
    """Chosen units regrouped by row and joined."""
    counts = np.bincount(parents.filter(chosen).to_numpy(zero_copy_only=False), minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, units.filter(chosen).cast(pa.binary()))
    return pc.binary_join(lists, b"").cast(pa.string())


def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    rows = batch.num_rows
    lists = _units(texts)
    units, parents, counts = pc.list_flatten(lists), pc.list_parent_indices(lists), pc.list_value_length(lists)
    ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(lists.offsets, parents).cast(pa.int64()))
    places = pc.add(counts, 1)
    modulo = lambda h: pc.subtract(h, pc.multiply(pc.divide(h, places), places))
    cuts = modulo(batch.column("h1")), modulo(batch.column("h2"))
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before, late = pc.less(ordinals, pc.take(first, parents)), pc.greater_equal(ordinals, pc.take(second, parents))
    prefix, suffix = _joined(units, parents, before, rows), _joined(units, parents, late, rows)
    middle = _joined(units, parents, pc.invert(pc.or_(before, late)), rows)
    marked = pc.equal(texts, "")
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    left = lambda h, n: pc.subtract(h, pc.multiply(pc.divide(h, n), n))
    plain = pc.or_(marked, pc.greater_equal(left(batch.column("h3"), 100), TRANSFORMED))
    spm = pc.less(left(batch.column("h4"), 100), SPM)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    join = lambda *parts: pc.binary_join_element_wise(*parts, "")
    output = pc.if_else(plain, texts, pc.if_else(
        spm, join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    size = lambda piece: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece).cast(pa.int64()))
    return pa.record_batch([batch.column("row"), counts.cast(pa.int64()), form, size(prefix), size(middle), output],
                           ["row", "n", "form", "prefix_chars", "middle_chars", "output"])


def _transformed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield _pieces(batch)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs`` or of ``carry``), ``n`` units, ``form``, ``prefix_chars``,
    ``middle_chars`` and ``output`` of every row.

    A null text counts as empty and stays plain, as do texts that spell a marker; sizes of plain rows
    are null. Equal ids draw equal numbers, null ids those of the empty id. No rows give no rows;
    further columns of any name are carried unread.
    """
    ident = F.col(f"`{id_col}`")
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)))
    rows = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), *(_draw(ident, k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    made = T.StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return rows.mapInArrow(_transformed, T.StructType([rows.schema["row"], *made.fields]))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. A text holds no marker, so the first of each kind parts it."""
    s, p, m = (F.instr(output, mark) for mark in (SUFFIX, PREFIX, MIDDLE))
    rest = F.length(output)
    psm = F.concat(F.substring(output, F.lit(4), s - 4), F.substring(output, m + 3, rest), F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), F.substring(output, m + 3, rest), F.substring(output, F.lit(4), p - 4))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def sql(relation: str) -> str:
    """The digests of every row of ``relation`` in DuckDB SQL."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"
    marks = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM (
  SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR {marks} OR {draw(3)} % 100 >= {TRANSFORMED} THEN 'plain' WHEN {draw(4)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT *, len(u) AS n, least({draw(1)} % (len(u) + 1), {draw(2)} % (len(u) + 1)) AS a,
          greatest({draw(1)} % (len(u) + 1), {draw(2)} % (len(u) + 1)) AS b
        FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {relation})))"""
