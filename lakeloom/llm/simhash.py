"""SimHash near-dedup by anchor-point covering.

The anchors are the codewords of a covering code: the binary Golay code [23, 12],
covering radius 3, on each of two 23-bit blocks of the fingerprint, so 2**24
anchors.  A fingerprint's home is its nearest codeword.  Two fingerprints that
differ in e1 and e2 bits of the blocks, e1 + e2 <= 2, lie in each block within
3 + e of each other's home, so each is replicated to every anchor within the
covering radius plus its share of the threshold (about 61), and every anchor
compares those at home with all that were sent to it.  No pair is missed.

An anchor at home to more than ``HOMES`` fingerprints is split by them over several tasks.

Equal fingerprints are one class from the start.  An anchor returns a spanning
forest of its links, never all pairs, so a cluster of near copies costs rows in
proportion to its size.  Components follow by distributed star contraction.

Cases: null and empty texts have fingerprint zero, linked like any other; ties
between bits (exactly half) are 0; repeated rows share a class; a null doc_id
keeps its row and counts as larger than any other id in a component; a very long
text's shingles are hashed at once, some 100 bytes a word; an empty table gives an
empty table; other columns, whatever their names, only pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle, bits of difference that still link.
SHINGLE, THRESHOLD = 3, 2
#: Block length and generator polynomial of the Golay code (fixed values).
BITS, GENERATOR = 23, 0b110001110101
MASK = (1 << BITS) - 1
#: Rows of home and visitors from which on a large anchor is searched by bit flips.
LARGE = 1 << 26
#: Fingerprints at home at one anchor in one task; an anchor with more is split, each part with all visitors.
HOMES = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles; more than half of the hashes set a bit."""
    words = text.lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    n = len(starts)
    hashes = np.fromiter((hash64(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text"):
            fps = np.array([fingerprint(t, shingle) for t in common.blobs(batch.column("_text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return common.id_text(docs, id_col, text_col).mapInArrow(common.task("simhash", run), "doc_id long, fp long")


class Golay:
    """Syndromes, and for each syndrome the error patterns of weight up to 5, lightest first."""

    def __init__(self):
        def syndrome(word: int) -> int:
            for shift in range(BITS - 1, 10, -1):
                if word >> shift & 1:
                    word ^= GENERATOR << shift - 11
            return word

        single = [syndrome(1 << i) for i in range(BITS)]
        self.tables = np.zeros((3, 256), np.int64)
        for part in range(3):
            for byte in range(256):
                s = 0
                for i in range(8):
                    if byte >> i & 1 and part * 8 + i < BITS:
                        s ^= single[part * 8 + i]
                self.tables[part, byte] = s
        words, weights = [], []
        for weight in range(6):
            for places in combinations(range(BITS), weight):
                words.append(sum(1 << i for i in places))
                weights.append(weight)
        words, weights = np.array(words, np.int64), np.array(weights)
        of = self.syndromes(words)
        order = np.lexsort((weights, of))
        self.patterns = words[order]
        self.start = np.searchsorted(of[order], np.arange(2048))
        self.within4 = np.bincount(of[weights <= 4], minlength=2048)  # the first of them is the home's
        self.within5 = np.bincount(of, minlength=2048)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][words & 255] ^ t[1][words >> 8 & 255] ^ t[2][words >> 16 & 127]


@lru_cache(maxsize=1)
def golay() -> Golay:
    return Golay()


def _ramp(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row repeated counts times: its number, and 0, 1, 2... within it."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and at-home of every replica of the fingerprints (uint64)."""
    code = golay()
    low, high = (fps & np.uint64(MASK)).astype(np.int64), (fps >> np.uint64(BITS) & np.uint64(MASK)).astype(np.int64)
    s, t = code.syndromes(low), code.syndromes(high)
    ds, dt = code.start[s], code.start[t]
    r1, i1 = _ramp(code.within5[s])  # up to 5 away in the first block, at home in the second
    j1 = np.zeros_like(i1)
    own, other = code.within4[s], code.within4[t] - 1  # up to 4 away in both
    r2, k2 = _ramp(own * other)
    i2, j2 = k2 // np.maximum(other[r2], 1), k2 % np.maximum(other[r2], 1) + 1
    r3, k3 = _ramp(code.within5[t] - code.within4[t])  # at home in the first, 5 away in the second
    i3, j3 = np.zeros_like(k3), k3 + code.within4[t][r3]
    rows, i, j = np.concatenate((r1, r2, r3)), np.concatenate((i1, i2, i3)), np.concatenate((j1, j2, j3))
    a = low[rows] ^ code.patterns[ds[rows] + i]
    b = high[rows] ^ code.patterns[dt[rows] + j]
    return rows, (a >> 11) << 12 | b >> 11, (i == 0) & (j == 0)


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = golay()
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        nearest = [words ^ code.patterns[code.start[code.syndromes(words)]] for words in ((fps & np.uint64(MASK)).astype(np.int64), (fps >> np.uint64(BITS) & np.uint64(MASK)).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array((nearest[0] >> 11) << 12 | nearest[1] >> 11)], ["anchor"])


def _replicate(hot: np.ndarray, parts: np.ndarray):
    """Replicas of the fingerprints; at a ``hot`` anchor each is at home in one of its ``parts``, and a visitor in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 4096):
                chunk = fps[at : at + 4096]
                rows, anchor, home = anchors(chunk.view(np.uint64))
                part = np.zeros(len(rows), np.int64)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                    number = np.where(hot[i] == anchor, parts[i], 1)
                    copy, part = _ramp(number)
                    own = (common.mix64(chunk[rows].view(np.uint64)) % number.astype(np.uint64)).astype(np.int64)
                    rows, anchor, home = rows[copy], anchor[copy], home[copy] & (part == own[copy])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part), pa.array(chunk[rows]), pa.array(home)], ["anchor", "part", "fp", "home"])

    return run


def _forest_dense(homes: np.ndarray, members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of home-member links, by breadth-first search; each home is compared once."""
    edges: list[tuple[int, int]] = []
    closed = np.zeros(len(members), bool)  # homes that have been compared
    home_at = {int(x): i for i, x in enumerate(homes)}
    waiting = np.ones(len(homes), bool)
    for start in range(len(homes)):
        if not waiting[start]:
            continue
        waiting[start] = False
        stack, free = [start], ~closed
        while stack:
            fp = homes[stack.pop()]
            own = members == fp
            closed |= own
            free &= ~own
            near = np.flatnonzero(free & (np.bitwise_count(members ^ fp) <= threshold))
            free[near] = False
            for other in members[near].tolist():
                edges.append((int(fp), other))
                i = home_at.get(other)
                if i is not None and waiting[i]:
                    waiting[i] = False
                    stack.append(i)
    return edges


def _forest_flips(homes: np.ndarray, members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """The same for an anchor with very many members: every flip of up to ``threshold`` bits is looked up."""
    members = np.unique(np.concatenate((members, homes)))
    root = np.arange(len(members))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges, own = [], np.searchsorted(members, homes)
    for weight in range(1, threshold + 1):
        for places in combinations(range(64), weight):
            flipped = homes ^ np.uint64(sum(1 << p for p in places))
            at = np.minimum(np.searchsorted(members, flipped), len(members) - 1)
            for h in np.flatnonzero(members[at] == flipped):
                i, j = find(int(own[h])), find(int(at[h]))
                if i != j:
                    root[max(i, j)] = min(i, j)
                    edges.append((int(homes[h]), int(flipped[h])))
    return edges


def links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD, large: int = LARGE) -> np.ndarray:
    """Links found at whole anchors (rows sorted by anchor), as rows of two fingerprints."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    work = np.where(sizes > 1, homes * sizes, 0)
    found = []
    small = (work > 0) & (work <= 256)
    group_of = np.repeat(np.arange(len(starts)), sizes)
    at_home = np.flatnonzero(home & small[group_of])
    for at in range(0, len(at_home), 1 << 16):
        h = at_home[at : at + (1 << 16)]
        rows, k = _ramp(sizes[group_of[h]])
        left, right = fps[h][rows], fps[starts[group_of[h]][rows] + k]
        near = (np.bitwise_count(left ^ right) <= threshold) & (left != right)
        found.append(np.stack((left[near], right[near]), axis=1))
    for g in np.flatnonzero(work > 256):
        part = slice(starts[g], starts[g] + sizes[g])
        forest = _forest_flips if work[g] > large else _forest_dense
        edges = forest(fps[part][home[part]], fps[part], threshold)
        if edges:
            found.append(np.array(edges, np.uint64))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def _link(threshold: int, large: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def out(parts):
            edges = links(*(np.concatenate(x) for x in zip(*parts, strict=True)), threshold, large).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a, f, h = batch.column(0).to_numpy() << 32 | batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            if cut or (kept and kept[-1][0][-1] != a[0]):
                kept.append((a[:cut], f[:cut], h[:cut]))
                yield out(kept)
                kept = []
            kept.append((a[cut:], f[cut:], h[cut:]))
        if kept:
            yield out(kept)

    return run


def linked(classes: DataFrame, threshold: int = THRESHOLD, large: int = LARGE) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp``; enough of them to span every component.

    Rows of an anchor come in order, so which links it returns doesn't depend on the run.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the replicas cover up to {THRESHOLD} bits of difference")
    homes = classes.select("fp").mapInArrow(common.task("simhash", _homes), "anchor long").groupBy("anchor").count()
    full = homes.filter(F.col("count") > HOMES).orderBy("anchor").toArrow()  # at most all 2**24 anchors
    hot, parts = full.column("anchor").to_numpy(), -(-full.column("count").to_numpy() // HOMES)
    sent = classes.select("fp").mapInArrow(common.task("simhash", _replicate(hot, parts)), "anchor long, part long, fp long, home boolean")
    return sent.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "fp").mapInArrow(common.task("simhash", _link(threshold, large)), "u long, v long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp (long) and component_id for each document."""
    own = common.written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = common.written(components(linked(classes, threshold)), "labels")
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(least, "label").select("fp", "component_id")
    return own.join(of, "fp")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = grouped(docs, id_col, text_col)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-dedup of documents: words of a shingle, least similarity.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Texts that the order of shingles is learned from, and shingles that it lists; neither touches the result.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 1 << 18
#: How many times its prefix a text must have of shared shingles among its first ones to be looked at any further.
SLACK = 1.25
#: Pairs for each row of texts that are apart, up to which all are checked at once; pairs that one text is checked in by a task's step.
STAR_PAIRS, STEP = 2, 256
#: Keys of a text that are looked back to, so that few pairs are made twice.
LATELY = 8


def shingle_hashes(words: list[int], shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a sequence of word hashes; of fewer words, the whole sequence is one."""
    x = np.array(words, np.uint64)
    n = max(1, len(x) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(x))):
        out = common.mix64(out + x[i : i + n])
    return np.unique(out)


def _hashed(texts: list[bytes], number: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Shingle hashes of each text; ``number`` remembers a bounded number of words."""
    for t in texts:
        if len(number) > 300_000:
            number.clear()
        words = t.lower().split()
        for w in words:
            if w not in number:
                number[w] = xxhash.xxh64_intdigest(w, 7)
        yield shingle_hashes([number[w] for w in words])


def prefix_size(n: int, least: float) -> int:
    """Of n shingles in one order for all texts, so many first ones meet those of every text at ``least`` or above."""
    return n - math.ceil(least * n - 1e-9) + 1


def often(hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each shingle that ``keys`` (sorted) lists, 0 for others."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, counts[at], 0)


def reach(n: int, least: float) -> tuple[int, int]:
    """Of n shingles: how many first ones must hold a prefix that none shares, and how many are looked up for that.

    Let d have a prefix's number of shingles, among its first SLACK prefixes, that no other
    text has among those it looks up.  A near duplicate e of d shares one of them.  In e it
    comes at most as many places later as e has shingles that d hasn't, so e, of up to
    1 / ``least`` times the size, would have looked it up: there is no e.
    """
    own = min(n, math.ceil(SLACK * prefix_size(n, least)))
    return own, min(n, math.ceil(SLACK * prefix_size(int(n / least), least)) + n - math.ceil(least * n - 1e-9))


def _shingles(text: bytes, shingle: int = NEAR_SHINGLE) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def similarity(a: bytes, b: bytes, shingle: int = NEAR_SHINGLE) -> float:
    """Jaccard similarity of two texts' word shingles; of fewer words, the whole sequence is one."""
    left, right = _shingles(a, shingle), _shingles(b, shingle)
    return len(left & right) / len(left | right)


def _shingle_order(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of ORDER_TEXTS texts hold, and how many do.

    They order the shingles of all texts, so that passages held by many texts propose no
    pairs.  Any order finds the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        for batch in common.sliced(batches, "_text"):
            for hashes in _hashed(common.blobs(batch.column("_text")), number):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["key"])

    part = math.ceil(rows.count() / ORDER_TEXTS)
    some = rows.filter(F.pmod("_tid", F.lit(part)) == 0).dropDuplicates(["_tid"]) if part else rows
    held = some.select("_text").mapInArrow(common.task("simhash", run), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = held.filter("n > 1").orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES).toArrow()
    keys, counts = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _suspects(rows: DataFrame, keys: np.ndarray, counts: np.ndarray, least: float) -> DataFrame:
    """(_tid): texts that may have a near duplicate, by ``reach``; no other has one.  Copies in a task are looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        seen: set[int] = set()
        for batch in common.sliced(batches, "_text"):
            tids = batch.column("_tid").to_pylist()
            new = [i for i, t in enumerate(tids) if t not in seen and not seen.add(t)]
            texts = common.blobs(batch.column("_text").take(pa.array(new, pa.int64())))
            firsts, room, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], []
            for hashes in _hashed(texts, number):
                own, looked = reach(len(hashes), least)
                firsts.append(hashes[np.lexsort((hashes, often(hashes, keys, counts)))[:looked]])
                spare = np.full(looked, -1, np.int32)
                spare[:own] = own - prefix_size(len(hashes), least)
                room.append(spare)
                size.append(looked)
            tid = np.repeat(np.array([tids[i] for i in new], np.int64), size)
            # 48 bits of a hash: where two agree, a text more is looked at
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(firsts) >> np.uint64(16)).view(np.int64)), pa.array(tid), pa.array(np.concatenate(room))], ["key", "_tid", "room"])

    of_key = Window.partitionBy("key")
    held = rows.mapInArrow(common.task("simhash", run), "key long, _tid long, room int")
    met = held.select("_tid", "room", F.min("_tid").over(of_key).alias("first"), F.max("_tid").over(of_key).alias("last")).filter("first <> last")
    return met.groupBy("_tid").agg(F.count_if(F.col("room") >= 0).alias("shared"), F.max("room").alias("room")).filter("shared > 0 and shared > room").select("_tid")


def _prefixes(texts: DataFrame, keys: np.ndarray, counts: np.ndarray, least: float) -> DataFrame:
    """(key, tid, n, pos): the prefixes of some texts, of n shingles each, as far as others of them have those shingles.

    ``pos`` is a shingle's place in its text's order, from 0.  Rare ones come first, by how many of the texts hold them; listed ones, which very
    many may hold, come last and aren't counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        for batch in common.sliced(batches, "_text"):
            found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
            size, rare, each = [], [], []
            for hashes in _hashed(common.blobs(batch.column("_text")), number):
                n, listed = len(hashes), often(hashes, keys, counts)
                free = listed == 0
                more = np.lexsort((hashes.view(np.int64), listed))[int(free.sum()) : prefix_size(n, least)]  # as they are ordered below
                found[0] += [hashes[free], hashes[more]]
                found[1] += [listed[free], listed[more]]
                size.append(n)
                rare.append(int(free.sum()))
                each.append(rare[-1] + len(more))
            columns = [np.concatenate(found[0]).view(np.int64), np.repeat(batch.column("_tid").to_numpy(), each), *(np.repeat(x, each).astype(np.int32) for x in (size, rare)), np.concatenate(found[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "tid", "n", "rare", "often"])

    held = texts.mapInArrow(common.task("simhash", run), "key long, tid long, n int, rare int, often long")
    held = held.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("df > 1")
    of_text = Window.partitionBy("tid")
    held = held.withColumn("alone", F.col("rare") - F.count_if(F.col("often") == 0).over(of_text))
    held = held.withColumn("place", F.row_number().over(of_text.orderBy("often", F.when(F.col("often") == 0, F.col("df")), "key")))
    held = held.withColumn("pos", F.col("alone") + F.col("place") - 1)
    return held.filter(F.col("pos") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9)).select("key", "tid", "n", "pos")


def _alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v): the pairs (a, b) of which at least ``least`` of all shingles are shared, by their texts.

    A text ``a`` goes once to each STEP of its pairs, so that a large star doesn't carry it once a pair.
    """
    steps = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STEP).alias("steps"))
    keyed = pairs.join(steps, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("steps")).alias("step"))
    left = keyed.select("a", "step").distinct().join(texts.select(F.col("_tid").alias("a"), "_text"), "a").select("a", "step", F.lit(None).cast("long").alias("b"), "_text")
    right = keyed.join(texts.select(F.col("_tid").alias("b"), "_text"), "b").select("a", "step", "b", "_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in common.sliced(batches, "_text"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            u, v = [], []
            for i, text in enumerate(common.blobs(batch.column("_text"))):
                other = _shingles(text)
                if b[i] is None:
                    own = other
                    continue
                shared = len(own & other)
                if shared >= least * (len(own) + len(other) - shared):
                    u.append(a[i])
                    v.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    both = left.unionByName(right).repartition("a", "step").sortWithinPartitions("a", "step", F.col("b").asc_nulls_first())
    return common.written(both.mapInArrow(common.task("simhash", check), "u long, v long"), "alike")


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """(a, b): texts whose SimHashes are equal or linked, as stars around a fingerprint's least text and links between those."""
    own = common.written(fingerprints(texts, "_tid", "_text", NEAR_SHINGLE), "prints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    same = own.join(classes, "fp").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    near = linked(classes).join(classes.select(F.col("fp").alias("u"), F.col("rep").alias("x")), "u").join(classes.select(F.col("fp").alias("v"), F.col("rep").alias("y")), "v")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(tid, label) of the texts, by XXH64, that have a near duplicate; texts of a group share their label.

    Near duplicates share at least ``least`` of all their five-word shingles.  Links
    between SimHashes are proposed first, and checked on the texts.  What they miss is
    found by a search that is exact: with the shingles of all texts in one order, near
    duplicates share one among their first 1 - ``least`` (``prefix_size``).  The order is by
    how many texts hold a shingle, counted over all texts that can have a near duplicate
    at all (``_suspects``), so texts that meet mostly are near duplicates, and only those
    that meet early enough are checked.  Of texts that meet, each is first checked with one
    of the others (a star); at last, all pairs that the links so far leave apart.  So a
    group of near copies costs about a row a text, and no link is lost with one that fails.
    """
    rows = common.id_text(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_tid"), "_text")
    keys, counts = _shingle_order(rows)
    suspects = common.written(_suspects(rows.select("_tid", "_text"), keys, counts, least), "suspects")
    common.released(docs.sparkSession)
    # one row of each suspect's text, found by its least id, so that copies aren't dealt to one task
    one = rows.groupBy("_tid").agg(F.min("_id").alias("least")).join(suspects, "_tid")
    one = one.select(F.col("_tid").alias("t"), "least")
    texts = rows.join(one.hint("shuffle_hash"), (rows["_tid"] == one["t"]) & rows["_id"].eqNullSafe(one["least"]), "left_semi")
    texts = common.written(texts.select("_tid", "_text").dropDuplicates(["_tid"]), "texts", "size")
    of_key = Window.partitionBy("key")
    common.released(docs.sparkSession)
    shared = common.written(_prefixes(texts, keys, counts, least), "shared", "size")
    common.released(docs.sparkSession)

    # of all that two near duplicates share, the first comes so early in both that enough can follow
    early = F.expr(f"label <> label2 and least(n - pos, n2 - pos2) >= {least / (1 + least)} * (n + n2) - 1e-6")
    other = [F.col("tid").alias("tid2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2")]
    checked = common.written(_by_fingerprint(texts), "pairs")
    alike = _alike(checked, texts, least)
    last, turn = False, 0
    while not last:
        turn += 1
        labels = common.written(components(alike).select(F.col("node").alias("tid"), "label"), "labels")
        named = shared.join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
        named = named.withColumn("least", F.min("label").over(of_key)).withColumn("most", F.max("label").over(of_key)).filter("least <> most")
        named = common.written(named.select("key", "tid", "n", "pos", "label"), "apart", "size")
        met_rows, met_pairs = named.groupBy("key").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()
        if not met_rows:
            break
        # another star saves pairs if there are many, and if the last one had a good part of the rows and linked a good part of its own
        last = met_pairs <= STAR_PAIRS * met_rows or (turn > 1 and (200 * tried < met_rows or 8 * linked_now < tried))
        if last:
            # a pair that met at one of the last few keys before isn't made again
            lately = F.collect_list("key").over(Window.partitionBy("tid").orderBy("pos").rowsBetween(-LATELY, -1))
            named = common.written(named.withColumn("lately", lately), "apart", "size")
            met = named.join(named.select("key", F.col("lately").alias("lately2"), *other), "key")
            met = met.filter(early & (F.col("tid") < F.col("tid2")) & ~F.arrays_overlap("lately", "lately2"))
        else:
            # first the one with fewest shingles of its own, which most others are likest to; then any
            pivot = F.min(F.struct((F.col("pos") if turn == 1 else F.lit(0)).alias("own"), F.xxhash64("tid", F.lit(turn)).alias("at"), *other)).over(of_key)
            met = named.withColumn("pivot", pivot).select("tid", "n", "pos", "label", "pivot.*").filter(early)
        pairs = met.select(F.least("tid", "tid2").alias("a"), F.greatest("tid", "tid2").alias("b")).distinct()
        pairs = common.written(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        tried = pairs.count()
        found = _alike(pairs, texts, least)
        linked_now = found.count()
        checked, alike = checked.unionByName(pairs), alike.unionByName(found)
        common.dropped(docs.sparkSession, shared, labels)
        shared = named.drop("label")  # what is one group by now stays one
    out = components(alike).select(F.col("node").alias("tid"), "label")
    common.dropped(docs.sparkSession, suspects, texts, checked, alike, shared)  # the result stands on its own
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of equal or near-equal texts: that with the least id.

    All columns stay as they are.  A null id counts as larger than any other.
    """
    groups = common.written(near_groups(docs, id_col, text_col, **options), "groups")
    marked = docs.withColumn("_lakeloom_tid", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    ids = marked.groupBy(F.col("_lakeloom_tid").alias("tid")).agg(F.min(F.col(id_col).cast("long")).alias("least"))
    ids = ids.join(groups, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    first = ids.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "tid")).alias("first"))
    keep = first.select(F.col("first.least").alias("_keep_id"), F.col("first.tid").alias("_keep_tid"))
    kept = marked.join(keep.hint("shuffle_hash"), (marked["_lakeloom_tid"] == keep["_keep_tid"]) & marked[id_col].cast("long").eqNullSafe(keep["_keep_id"]), "left_semi")
    if not marked.groupBy("_lakeloom_tid", id_col).count().filter("count > 1").isEmpty():  # else the texts needn't be dealt out again
        kept = kept.dropDuplicates(["_lakeloom_tid"])
    return kept.drop("_lakeloom_tid")
