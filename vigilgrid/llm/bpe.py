"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

The split pattern reads classes of code points, so a text becomes an array of classes. Each code
point's transition function (is a token open before it, where does it end) depends on its class and,
composed with those of its two predecessors and its successor, no longer on the state before them.
The scan therefore closes after that many compositions, and the starts of all tokens of a batch come
from shifted class arrays at once; no pattern is run over the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vigilgrid.llm.words import slices

_OTHER, _LETTER, _DIGIT, _SPACE, _EDGE = range(5)
#: Distinct pieces remembered by a task before it starts afresh.
CACHE = 1 << 19


def code_point_classes() -> np.ndarray:
    """Letter, digit, white space or other for every code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            classes[m.start():m.end()] = kind
    return classes


def token_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where tokens start, over code points of texts that lie end to end; text r is offsets[r]:offsets[r + 1]."""
    n = len(points)
    kind = np.full(n + 6, _EDGE, np.uint8)
    char = np.zeros(n + 6, points.dtype)
    kind[3:n + 3], char[3:n + 3] = classes[points], points
    begins, last = np.zeros(n + 6, bool), np.zeros(n + 6, bool)
    begins[3 + offsets[:-1][np.diff(offsets) > 0]] = True
    last[:-1] = begins[1:]
    last[n + 2] = True

    def at(array: np.ndarray, shift: int) -> np.ndarray:
        return array[3 + shift:n + 3 + shift]

    here, first, end = at(kind, 0), at(begins, 0), at(last, 0)
    before = np.where(first, _EDGE, at(kind, -1))
    after = np.where(end, _EDGE, at(kind, 1))
    blank_before = (at(char, -1) == 32) & ~first
    space = here == _SPACE
    # Runs of one class start a token unless a blank in front of them already did; of a run of white
    # space the last character starts another one when text follows.
    starts = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != _EDGE)), (before != here) & ~blank_before)
    # An apostrophe that starts a token takes 's 't 'm 'd 're 've 'll with it.
    quote = np.flatnonzero(starts & (points == 39) & ~end)
    if len(quote):
        nxt = at(char, 1)[quote]
        two = np.where(end[np.minimum(quote + 1, n - 1)], 0, at(char, 2)[quote])
        short = np.isin(nxt, [ord(c) for c in "stmd"])
        long = ((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e"))) | ((nxt == ord("l")) & (two == ord("l")))
        taken, width = quote[short | long], np.where(short, 2, 3)[short | long]
        starts[taken + 1] = False
        follow = taken + width
        ok = follow < n
        follow = follow[ok]
        starts[follow[~first[follow] & (here[follow] == _LETTER)]] = True
    return np.flatnonzero(starts)


class Merger:
    """Merges the bytes of a piece by rank, lowest first, leftmost first; remembers pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.cache: dict[bytes, list[int]] = {}

    def ids(self, piece: bytes) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[piece] = self._merge(piece)
        return found

    def _merge(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        n = len(piece)
        if n <= 32:
            return self._merge_short(piece)
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged into another
        back = list(range(-1, n - 1))
        ranks = self.ranks
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            middle = ends[i]
            if not middle or middle >= n or ranks.get(piece[i:ends[middle]]) != r:
                continue
            end = ends[i] = ends[middle]
            ends[middle] = 0
            if end < n:
                back[end] = i
                if (r := ranks.get(piece[i:ends[end]])) is not None:
                    heapq.heappush(queue, (r, i))
            j = back[i]
            if j >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heapq.heappush(queue, (r, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return out


    def _merge_short(self, piece: bytes) -> list[int]:
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_texts(texts: pa.Array, classes: np.ndarray, merger: Merger) -> Iterator[list[int]]:
    """The ids of each text."""
    strings = pc.fill_null(texts, "").to_pylist()
    whole = "".join(strings)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    raw = whole.encode()
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    starts = token_starts(points, offsets, classes)
    size = np.ones(len(points), np.uint8)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        size += points > limit
    place = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    cuts = np.append(place[starts], len(raw)).tolist()
    first = np.searchsorted(starts, offsets).tolist()
    known, miss = merger.cache.get, merger.ids
    for r in range(len(strings)):
        ids: list[int] = []
        for i in range(first[r], first[r + 1]):
            piece = raw[cuts[i]:cuts[i + 1]]
            ids += known(piece) or miss(piece)
        yield ids


def encoded(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, ends`` of every row: the tokens and, in bytes of the text, where each ends.

    Null and empty texts have no tokens; any text decodes to itself. Repeated rows are encoded each.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, merger = code_point_classes(), Merger(read_ranks(ranks_path))
        for batch in slices(batches, "text"):
            ids = list(encode_texts(batch.column("text"), classes, merger))
            ends = [np.cumsum([len(merger.vocabulary[i]) for i in row], dtype=np.int64).tolist() for row in ids]
            yield pa.record_batch([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int64()))],
                                  ["id", "ids", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, ends array<bigint>")


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``id, bytes`` from ``id, ids``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {i: b for b, i in read_ranks(ranks_path).items()}
        for batch in batches:
            rows = [b"".join(vocabulary[i] for i in row or ()) for row in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(rows, pa.binary())], ["id", "bytes"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, bytes binary")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one task, without moving the ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, merger = code_point_classes(), Merger(read_ranks(ranks_path))
        shown = {i: str(i) for i in merger.vocabulary}
        for batch in slices(batches, "text"):
            count, written, back = [], [], []
            for ids in encode_texts(batch.column("text"), classes, merger):
                count.append(len(ids))
                written.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(merger.vocabulary.__getitem__, ids))).hexdigest())
            yield pa.record_batch([batch.column("id"), pa.array(count, pa.int64()), pa.array(written), pa.array(back)],
                                  ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
