"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is merged on its own.  Its nodes form a doubly linked list; the
queue holds, for each merge rank, a bucket (heap) of left-node positions, and a
two-level bitmap over the ranks tells by find-first-set which bucket is next.
An entry is stale, and skipped, when its node has gone or its pair has another
rank by now.  A merge costs a constant number of word operations, however long
the pre-token, where a scan for the lowest rank would make it quadratic.

Cases: null and empty texts give no tokens and the digest of nothing; a very long
text is worked through in runs of ``RUN`` pre-tokens and ``SPELLED`` ids; equal rows
give equal rows; an empty table an empty table; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Pre-tokens whose ids a worker remembers in each of two generations, and their greatest length (bounds its memory).
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: Texts of more characters are split as they are read, so many pre-tokens at once.
LONG, RUN = 1 << 20, 100_000
#: Ids that are written out at once.
SPELLED = 1 << 18


class RankQueue:
    """Buckets of positions by rank; the lowest rank first, then the lowest position.

    ``low`` has a bit for each rank with a bucket, in words of 2**SHIFT bits, and
    ``top`` one for each word of ``low`` that isn't zero.  A bucket of one is the bare
    position, else a heap.
    """

    SHIFT = 8

    def __init__(self, ranks: int):
        self.buckets: dict[int, int | list[int]] = {}
        self.low = [0] * ((ranks >> self.SHIFT) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = position
            w = rank >> 8
            self.low[w] |= 1 << (rank & 255)
            self.top |= 1 << w
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        w = (top & -top).bit_length() - 1
        low = self.low[w]
        rank = w << 8 | (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            position = heappop(bucket)
            if bucket:
                return rank, position
            bucket = position
        del self.buckets[rank]
        self.low[w] = low = low & (low - 1)
        if not low:
            self.top = top & (top - 1)
        return rank, bucket


class ByteBPE:
    """An encoder and decoder for one file of ranks (base64 bytes and rank a line)."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(self.bytes_of, default=0) + 1)
        self.pairs: list[list[int | None]] = [[self.ranks.get(bytes((x, y))) for y in range(256)] for x in range(256)]
        self.ids = _Memory(lambda token: array("i", self.merge(token.encode())).tobytes())
        self.spelled, self.decimals = Spelling(self.bytes_of), Spelling({i: b",%d" % i for i in self.bytes_of})

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.  Most buckets hold one position, so those steps of the queue are written out here."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, find, queue = len(piece), ranks.get, self.queue
        buckets, low, top, push = queue.buckets, queue.low, 0, queue.push
        after = list(range(1, n + 1))  # the next node's start, which is this node's end
        before = list(range(-1, n - 1))
        pair: list[int | None] = [self.pairs[x][y] for x, y in pairwise(piece)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    push(rank, i)
                else:
                    buckets[rank] = i
                    w = rank >> 8
                    low[w] |= 1 << (rank & 255)
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            word = low[w]
            rank = w << 8 | (word & -word).bit_length() - 1
            i = buckets[rank]
            if type(i) is int or len(i) == 1:
                i = i if type(i) is int else i[0]
                del buckets[rank]
                low[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            else:
                i = heappop(i)
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = None
            changed = (i, before[i]) if before[i] >= 0 else (i,)
            if k < n:
                before[k] = i
            for h in changed:
                new = find(piece[h : after[after[h]]]) if after[h] < n else None
                if new != pair[h] or h == i:
                    pair[h] = new
                    if new is None:
                        continue
                    if new in buckets:
                        push(new, h)
                    else:
                        buckets[new] = h
                        w = new >> 8
                        low[w] |= 1 << (new & 255)
                        top |= 1 << w
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in runs."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(found, RUN)):
            yield run

    def packed(self, text: str) -> bytes:
        """The ids of a text as int32."""
        return b"".join(map(self.ids.__getitem__, chain.from_iterable(self.tokens(text))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(str, ids))

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text: number of ids, SHA-256 of their decimals joined by commas, and of the bytes that they decode to."""
        packed = [self.packed(t) for t in texts]
        size = [len(x) // 4 for x in packed]
        ids = np.frombuffer(b"".join(packed), np.int32)
        del packed
        return size, self.decimals.hashes(ids, size, skip=1), self.spelled.hashes(ids, size)


class Spelling:
    """Bytes of every id, written out for whole vectors of ids."""

    def __init__(self, of: dict[int, bytes]):
        self.size, self.start = np.zeros((2, max(of, default=-1) + 1), np.int64)
        for i, x in of.items():
            self.size[i] = len(x)
        self.start[:] = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, one after the other, and where each one's begin (and the last one's end)."""
        size = self.size[ids]
        begin = np.concatenate(([0], np.cumsum(size)))
        return self.data[np.arange(begin[-1]) + np.repeat(self.start[ids] - begin[:-1], size)], begin

    def hashes(self, ids: np.ndarray, sizes: list[int], skip: int = 0) -> list[str]:
        """SHA-256 of the bytes of so many ids each, without the first ``skip`` bytes of each; SPELLED ids at once."""
        made = [hashlib.sha256() for _ in sizes]
        ends = np.cumsum(sizes)
        for lo in range(0, len(ids), SPELLED):
            data, begin = self.of(ids[lo : lo + SPELLED])
            hi = lo + len(begin) - 1
            for k in range(int(np.searchsorted(ends, lo, side="right")), len(sizes)):
                a = int(ends[k]) - sizes[k]
                if a >= hi:
                    break
                if sizes[k]:
                    made[k].update(data[begin[max(a, lo) - lo] + (skip if a >= lo else 0) : begin[min(int(ends[k]), hi) - lo]])
        return [m.hexdigest() for m in made]


class _Memory(dict):
    """What ``make`` gave for strings met lately: those of this generation, and in ``old`` those of the one before.

    A full generation becomes the old one, so the size is bounded and frequent strings stay.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str) -> ByteBPE:
    """One encoder a worker process; its memory of pre-tokens serves all its tasks."""
    return ByteBPE(rank_file, pattern)


common.remembers("bpe", tokenizer.cache_clear)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) for each document; no special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file, pattern)
        for batch in common.sliced(batches, "_text"):
            ids = [bpe.encode(t or "") for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.id_text(docs, id_col, text_col).mapInArrow(common.task("bpe", run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``bytes`` (binary) from ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file, pattern)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    rows = encoded.select(encoded[id_col].cast("long").alias("_id"), encoded[ids_col].alias("_ids"))
    return rows.mapInArrow(common.task("bpe", run), "doc_id long, bytes binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; return counts and digests instead of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file, pattern)
        for batch in common.sliced(batches, "_text"):
            made = bpe.digests([t or "" for t in batch.column("_text").to_pylist()])
            columns = [pa.array(x, kind) for x, kind in zip(made, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.id_text(docs, id_col, text_col).mapInArrow(
        common.task("bpe", run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
