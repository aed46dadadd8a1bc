"""Bounded-space online packing of tokenised texts into sequences of fixed length.

Every partition keeps a fixed number of open windows. A document's full sequences leave at once, its
rest goes to the open window it fits best; when it fits none, the fullest window is closed and an
empty one opened. Windows still open at the end of their partitions are merged afterwards: they are
few (a fixed number per partition) and move as whole windows, so only their numbers are exchanged.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vigilgrid.session import cut_lineage

OPEN_WINDOWS = 64
#: Open windows merged by one task.
MERGED = 4096
PIECES = ("doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level vocabulary file of ``tokenizers``, without special tokens.

    Texts of Latin letters, digits, punctuation, blanks and line ends are merged by ``tiktoken`` with
    the file's own ranks, where the two libraries are equal and it is eight times faster; all others,
    and those that spell a special token, go through ``tokenizers`` itself.
    """
    import re

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    special = [t["content"] for t in read.get("added_tokens", [])]
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in read["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    plain = re.compile("[\\n\\r\\t -~¡-ɏ]*").fullmatch

    def encode(text: str) -> np.ndarray:
        if plain(text) and not any(s in text for s in special):
            return np.array(fast.encode_ordinary(text), np.uint32)
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


class Windows:
    """Open windows of one partition: the room left in each and the sequence it will be."""

    def __init__(self, size: int, count: int, number: Iterator[int]):
        self.size, self.number = size, number
        self.room = np.full(count, size, np.int64)
        self.ids = [next(number) for _ in range(count)]

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece shorter than a sequence."""
        fits = self.room >= length
        if not fits.any():
            self.close(int(np.argmin(self.room)))
            fits = self.room >= length
        w = int(np.argmin(np.where(fits, self.room, self.size + 1)))
        at = self.size - int(self.room[w])
        self.room[w] -= length
        placed = self.ids[w], at
        if self.room[w] == 0:
            self.close(w)
        return placed

    def close(self, w: int) -> None:
        self.room[w], self.ids[w] = self.size, next(self.number)


def _packed(batches: Iterable[pa.RecordBatch], make: Callable, size: int, end_id: int, count: int) -> Iterator[pa.RecordBatch]:
    encode = make()
    first = TaskContext.get().partitionId() << 36
    windows = Windows(size, count, iter(range(first, first + (1 << 36))))
    for batch in batches:
        out = []
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), size):
                piece = ids[start:start + size]
                where = (next(windows.number), 0) if len(piece) == size else windows.place(len(piece))
                out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *where))
        columns = list(zip(*out)) or [[]] * 7
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array([False] * len(out), pa.bool_())], _NAMES)
    left = [(None, None, None, None, None, i, size - int(r)) for i, r in zip(windows.ids, windows.room) if r < size]
    columns = list(zip(*left)) or [[]] * 7
    yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array([True] * len(left), pa.bool_())], _NAMES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _merge(windows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Best fit, fullest first, of whole windows into others."""
    order = windows.sort_values(["offset", "sequence_id"], ascending=[False, True])
    room: list[int] = []
    target: list[int] = []
    rows = []
    for sequence, used in zip(order["sequence_id"], order["offset"]):
        by_room = np.asarray(room, np.int64)
        fits = np.flatnonzero(by_room >= used)
        if len(fits):
            w = int(fits[np.argmin(by_room[fits])])
            rows.append((sequence, target[w], size - room[w]))
            room[w] -= int(used)
        else:
            room.append(size - int(used))
            target.append(sequence)
            rows.append((sequence, sequence, 0))
    return pd.DataFrame(rows, columns=["sequence_id", "merged_id", "shift"])


def packed(docs: DataFrame, make_encoder: Callable[[], Callable[[str], np.ndarray]], size: int = 1024, end_id: int = 0,
           open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every row.

    A row gives its tokens and the end id; null text is empty, so it gives the end id alone. Pieces of
    a sequence lie without gaps from offset 0. Repeated rows and ids are packed each for itself; no
    rows give no pieces. Only ``id_col`` and ``text_col`` are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = cut_lineage(rows.mapInArrow(
        partial(_packed, make=make_encoder, size=size, end_id=end_id, count=open_windows), PIECES))
    pieces = placed.where("NOT open").drop("open")
    left = placed.where("open").select("sequence_id", "offset")
    groups = max(1, -(-left.count() // MERGED))
    moved = left.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")).applyInPandas(
        lambda windows: _merge(windows, size), "sequence_id long, merged_id long, shift long")
    return pieces.join(moved, "sequence_id", "left").select(
        "doc", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("merged_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(docs: DataFrame, pieces: DataFrame, make_encoder: Callable, size: int = 1024, end_id: int = 0, pad_id: int = 0,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids of every sequence, padded to ``size``, from documents of distinct ids and their pieces."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                out += [(p["sequence_id"], p["offset"], ids[p["start"]:p["start"] + p["length"]].tolist()) for p in parts]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                   pa.array(columns[2], pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    wanted = pieces.groupBy("doc").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc")
    laid = rows.select("text", "parts").mapInArrow(cut, "sequence_id long, offset long, ids array<long>")
    return laid.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids")).select("sequence_id", F.concat(
            "ids", F.array_repeat(F.lit(pad_id).cast("long"), size - F.size("ids"))).alias("ids"))
