"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles.  Sets are put into bands
of sizes so that two similar ones lie in the same band or in neighbours, and every set is
signed for its own band and the next.  In a band of largest size r, sets of similarity
``LEAST`` differ in at most k = 2 (100 - LEAST) r / (100 + LEAST) elements.  The domain of
elements is cut into k // 2 + 1 partitions, in one of which such sets differ by at most one
element, and each partition into three; the three ways to leave one of them out are
enumerated, and in one of these the sets are equal.  So a signature is a hash of a set's
elements in two of the three, and similar sets share one: no link is lost.

Equal sets are one class before anything is compared, and a task signs a set once.  What
comes back of the shuffle are signatures that several classes share.  Those groups are
settled in rounds: members are compared with some pivots of their group, few at first and
more from round to round; what a link joins is never compared again, and neither is a pivot
that has met all of its group.  A pair is first held to the counts of its elements in equal
parts of the domain, which bound their intersection.  From the second round on the counts
come with the members, so that a task compares a group in blocks and gives only the pairs
within the bound; whole sets are made and compared for those alone.  As long as many of the
pairs turn out to be links, a round only tries: each class meets the one pivot that looks
most alike, so there is at most one pair a class, and near copies come together by few links
before all pivots meet all of their groups.  A large group is dealt
to several tasks, each with all of its pivots.  A group is settled once all of it is in one
component, or all pivots are through; so pairs within a group of near copies aren't emitted,
and a group of any size is exact.  Signatures that very many documents share (found in a
sample of ``SAMPLE``) are dealt out by class as well, which changes no result.

Elements and classes are known by 64-bit hashes of shingles and of whole sets.

Cases: null and empty texts, and texts without words, have an empty set and are linked with
nothing, not even each other; with fewer words than a shingle the whole sequence is the one
element; equal texts and repeated rows are linked; a null doc_id keeps its row and counts as
larger than any other; a very long text is hashed in parts, its set takes eight bytes a word;
an empty table gives an empty table; other columns, whatever their names, only pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle; percent of the union that the intersection of linked sets has at least.
SHINGLE, LEAST = 4, 85
#: Bytes in one part of a long text; words and classes that a task remembers at most.
PART, REMEMBERED = 1 << 20, 1 << 20
#: Documents that frequent signatures are looked for in, and how many of them share one.
SAMPLE, FREQUENT = 2048, 32
#: Rows of the smaller side of a join that go out with the tasks; beyond, both sides are shuffled.
SMALL = 1 << 18
#: Signatures that one task sorts, about; pivots of a group in the second round, and pairs that a part of it may be compared in.
SORTED, PIVOTS, PAIRS = 1 << 21, 8, 1 << 24
#: Trials in a row, at most, and the share of their pairs that are links below which they end.
TRIALS, WORTH = 8, 0.25
#: Members in one part of a group; the longest sketch that goes with a member; counts of a sketch that are compared.
MEMBERS, SENT, COUNTS = 1 << 12, 1 << 12, 1 << 9
#: Multiplier of hashes of words (a fixed odd number).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = 2**63 - 1  # a null id


class Hashes(dict):
    """Hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def elements(text: bytes, known: Hashes, shingle: int = SHINGLE) -> np.ndarray:
    """The text's set: sorted distinct hashes of its shingles."""
    found, before = [], np.zeros(0, np.uint64)
    for part in common.parts(text.lower(), PART):
        words = part.split()
        row = np.concatenate((before, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
        n = len(row) - shingle + 1
        if n > 0:
            h = row[:n].copy()
            for k in range(1, shingle):
                h *= _STEP
                h += row[k : n + k]
            found.append(common.mix64(h))
        before = row[max(0, n) :]
    if not found and len(before):
        h = before[:1].copy()
        for w in before[1:]:
            h = h * _STEP + w
        found.append(common.mix64(h + np.uint64(len(before))))
    return np.unique(np.concatenate(found)) if found else before


@lru_cache(maxsize=8)
def bands(least: int = LEAST) -> list[int]:
    """The largest size of each band; a set has at most 100 / ``least`` times the elements of one like it."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append((ends[-1] + 1) * 100 // least)
    return ends


def signatures(found: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All signatures of a set, for its own band and the next."""
    ends, out = bands(least), []
    own = int(np.searchsorted(ends, len(found)))
    for band in (own, own + 1) if len(found) else ():
        differ = 2 * (100 - least) * ends[band] // (100 + least)
        if not differ:
            continue  # equal sets only
        groups = differ // 2 + 1
        mixed = common.mix64(found ^ common.mix64(np.array([band + 1], np.uint64)))
        cell = (mixed % np.uint64(3 * groups)).astype(np.int64)
        value = common.mix64(mixed)
        sums = [np.bincount(cell, weights=half.astype(np.float64), minlength=3 * groups).astype(np.uint64) for half in (value & np.uint64(0xFFFFFFFF), value >> np.uint64(32))]
        cells = common.mix64(sums[0] * _STEP + sums[1] + np.arange(3 * groups, dtype=np.uint64)).reshape(groups, 3)
        for a, b in ((0, 1), (0, 2), (1, 2)):
            out.append(common.mix64((cells[:, a] + cells[:, b] * _STEP) ^ np.uint64(band << 48)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(found: np.ndarray) -> bytes:
    """How many elements lie in each of 2**b equal parts of the domain; 255 stands for more too.

    About four elements in one part; up to 128 parts, so few bytes, there are more parts than elements.
    """
    bits = max((len(found) // 4).bit_length(), min(7, len(found).bit_length() + 1))
    return np.minimum(np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def within(a: bytes, b: bytes, least: int = LEAST) -> bool:
    """Whether two sets of these sketches may be similar enough: the sum of the smaller counts bounds their intersection."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    if x.max() == 255 or y.max() == 255:
        return True
    parts = min(len(x), len(y))
    x, y = x.reshape(parts, -1).sum(axis=1), y.reshape(parts, -1).sum(axis=1)
    both = int(np.minimum(x, y).sum())
    return 100 * both >= least * (int(x.sum() + y.sum()) - both)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.id_text(docs, id_col, text_col).select(F.coalesce("_id", F.lit(_LAST)).alias("key"), F.xxhash64("_text").alias("tid"), "_text")


def _class(found: np.ndarray) -> int:
    """A hash of the whole set, as a signed number."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def sets(rows: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(key, tid, n, cls, sketch, sigs) of each row: the size of its set, its class, its sketch and its signatures, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in common.sliced(batches, "_text"):
            n, cls, sketches, sigs = [], [], [], []
            for text in common.blobs(batch.column("_text")):
                found = elements(text, known, shingle)
                n.append(len(found))
                cls.append(_class(found))
                sketches.append(sketch(found))
                sigs.append(signatures(found, least).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tid"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketches, pa.binary()), pa.array(sigs, pa.binary())], ["key", "tid", "n", "cls", "sketch", "sigs"])

    return rows.mapInArrow(common.task("partenum", run), "key long, tid long, n long, cls long, sketch binary, sigs binary")


def _signed(of: DataFrame, parts: int, often: np.ndarray) -> DataFrame:
    """(part, sig, cls): a task gives each class once; those of frequent signatures are dealt out by class too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.sliced(batches, "sigs"):
            fresh = []
            for c in batch.column("cls").to_pylist():
                fresh.append(c not in seen)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
            batch = batch.filter(pa.array(fresh))
            packed = common.blobs(batch.column("sigs"))
            sig = np.frombuffer(b"".join(packed), np.uint64)
            cls = np.repeat(batch.column("cls").to_numpy(), [len(x) // 8 for x in packed])
            deal = np.where(np.isin(sig, often), sig ^ common.mix64(cls.view(np.uint64)), sig) if len(often) else sig
            yield pa.RecordBatch.from_arrays([pa.array((deal % np.uint64(parts)).astype(np.int32)), pa.array(sig.view(np.int64)), pa.array(cls)], ["part", "sig", "cls"])

    return of.select("cls", "sigs").mapInArrow(common.task("partenum", run), "part int, sig long, cls long")


def _shared(often: np.ndarray):
    """Of a partition's rows those of signatures with several classes, or that are dealt out to several tasks; each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("sig").to_numpy(), b.column("cls").to_numpy()) for b in batches]
        if not held:
            return
        sig, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(sig)
        sig, cls = sig[order], cls[order]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        several = np.maximum.reduceat(cls, first) != np.minimum.reduceat(cls, first)
        if len(often):
            several |= np.isin(sig[first].view(np.uint64), often)
        keep = np.repeat(several, np.diff(np.append(first, len(sig))))
        sig, cls = sig[keep], cls[keep]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        for at in range(0, len(sig), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(sig[part][new[part]]), pa.array(cls[part][new[part]])], ["sig", "cls"])

    return run


def shared(of: DataFrame) -> DataFrame:
    """(sig, cls) of all signatures that may belong to several classes, from stored :func:`sets`.

    About as many signatures as half of all elements are dealt out, and so many partitions that a task can sort its own.
    """
    texts, signed = of.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("sigs") / 8), F.lit(0))).first()
    parts = max(2, int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(signed / SORTED))
    drawn = _signed(of.sample(min(1.0, SAMPLE / max(1, texts)), 7), 1, np.zeros(0, np.uint64))
    found = drawn.groupBy("sig").agg(F.count_distinct("cls").alias("n")).filter(F.col("n") >= FREQUENT).select("sig").collect()  # of a bounded sample
    often = np.sort(np.array([r.sig for r in found], np.int64).view(np.uint64))
    return _signed(of, parts, often).repartitionById(parts, "part").select("sig", "cls").mapInArrow(common.task("partenum", _shared(often)), "sig long, cls long")


def _small(df: DataFrame) -> DataFrame:
    """A stored table with the hint to send it out with the tasks, if it is small enough."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _elements(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cls, e): the sets of the ``wanted`` classes (cls, key, tid), each made from the text of one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in common.sliced(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([elements(t, known, shingle).tobytes() for t in common.blobs(batch.column("_text"))], pa.binary())], ["cls", "e"])

    return rows.join(_small(wanted), ["key", "tid"]).select("cls", "_text").mapInArrow(common.task("partenum", run), "cls long, e binary").dropDuplicates(["cls"])


def _compared(pairs: DataFrame, found: DataFrame, value: str, test) -> DataFrame:
    """``pairs`` (u, v) with ``linked``: what ``test`` says of the two classes' ``value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [test(x, y) for x, y in zip(common.blobs(batch.column("x")), common.blobs(batch.column("y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    x, y = (found.select(F.col("cls").alias(c), F.col(value).alias(e)) for c, e in (("u", "x"), ("v", "y")))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(common.task("partenum", run), "u long, v long, linked boolean")


def _alike(least: int):
    def test(x: bytes, y: bytes) -> bool:
        every = np.sort(np.concatenate([np.frombuffer(e, np.uint64) for e in (x, y)]))
        both = int(np.count_nonzero(every[1:] == every[:-1]))
        return 100 * both >= least * (len(every) - both)

    return test


def _blocks(start: np.ndarray, end: np.ndarray, pivot: np.ndarray, label: np.ndarray, first: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pivots and the rows of their groups (``start`` to ``end``) under other labels, about ``most`` pairs at a time.

    Two pivots meet once, and only in the ``first`` part of a group.
    """
    pivots = np.flatnonzero(pivot)
    sizes = (end - start)[pivots]
    total = np.cumsum(sizes)
    at = 0
    while at < len(pivots):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        i = np.repeat(pivots[at:to], sizes[at:to])
        j = np.arange(len(i)) - np.repeat(total[at:to] - sizes[at:to] - base, sizes[at:to]) + start[i]
        keep = (label[i] != label[j]) & (~pivot[j] | (first[i] & (j > i)))
        yield i[keep], j[keep]
        at = to


class Sketches:
    """Sketches of some classes as matrices of counts; an empty one, or one with a count of 255, says nothing."""

    def __init__(self, sketches: list[bytes]):
        self.rows = [np.frombuffer(s, np.uint8) for s in sketches]
        self.total = np.array([int(r.sum(dtype=np.int64)) for r in self.rows], np.int64)
        self.width = np.array([0 if not len(r) or r.max() == 255 else min(len(r), COUNTS) for r in self.rows], np.int64)
        self.long = np.array([len(r) for r in self.rows], np.int64)
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of_width(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts in ``width`` parts of the domain, and the place of each sketch among them."""
        if width not in self.made:
            wide = np.flatnonzero(self.width >= width)
            place = np.zeros(len(self.rows), np.int64)
            place[wide] = np.arange(len(wide))
            self.made[width] = np.array([self.rows[k].reshape(width, -1).sum(axis=1, dtype=np.uint16) for k in wide], np.uint16), place
        return self.made[width]

    def within(self, i: np.ndarray, j: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """:func:`within` for many pairs; and the bound of their similarity, 1 where nothing is known."""
        found, bound = np.ones(len(i), bool), np.ones(len(i))
        narrow = np.minimum(self.width[i], self.width[j])
        for width in np.unique(narrow[narrow > 0]).tolist():
            counts, place = self.of_width(width)
            these = np.flatnonzero(narrow == width)
            for at in range(0, len(these), (1 << 21) // width):
                k = these[at : at + (1 << 21) // width]
                both = np.minimum(counts[place[i[k]]], counts[place[j[k]]]).sum(axis=1, dtype=np.int64)
                union = self.total[i[k]] + self.total[j[k]] - both
                found[k] = 100 * both >= least * union
                bound[k] = both / np.maximum(union, 1)
        return found, bound

    def settled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether :meth:`within` compared all that the sketches of these pairs hold."""
        narrow = np.minimum(self.width[i], self.width[j])
        return (narrow > 0) & (narrow == np.minimum(self.long[i], self.long[j]))


NEAR = "u long, v long, settled boolean, bound double"


def _near(least: int, best: bool = False, detailed: bool = False):
    """Of rows sorted by group and part: pairs (u, v) of a pivot and another class of its group that the sketches allow.

    ``best``: u is a pivot, v another class of its group, and of each v's pairs in a group only the one most alike is given.
    ``detailed``: with ``settled``, whether the whole sketches were compared, and the ``bound`` of their similarity.
    """

    def groups(held: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, part, cls, label = (held.column(c).to_numpy() for c in ("sig", "part", "cls", "label"))
        pivot = held.column("pivot").to_numpy()
        start = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])))
        sizes = np.diff(np.append(start, len(sig)))
        start = np.repeat(start, sizes)
        sketches = Sketches([s for c in held.column("sketch").chunks for s in common.blobs(c)])

        def out(i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
            u, v = (cls[i], cls[j]) if best else (np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]))
            more = {"settled": pa.array(sketches.settled(i, j)), "bound": pa.array(bound)} if detailed else {}
            return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)} | more)

        most, chosen = np.zeros(len(sig)), np.full(len(sig), -1)
        for i, j in _blocks(start, start + np.repeat(sizes, sizes), pivot, label, part == 0):
            close, bound = sketches.within(i, j, least)
            i, j, bound = i[close], j[close], bound[close]
            if not best:
                yield out(i, j, bound)
                continue
            order = np.argsort(bound, kind="stable")  # of those assigned to one place, the last stays
            order = order[bound[order] > most[j[order]]]
            most[j[order]], chosen[j[order]] = bound[order], i[order]
        met = np.flatnonzero(chosen >= 0)
        if len(met):
            yield out(chosen[met], met, most[met])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < MEMBERS:
                continue
            table = pa.Table.from_batches(held)
            sig, part = table.column("sig").to_numpy(), table.column("part").to_numpy()
            whole = int(np.flatnonzero((sig != sig[-1]) | (part != part[-1]))[-1] + 1) if (sig[0], part[0]) != (sig[-1], part[-1]) else 0
            if whole:  # the last group may go on
                yield from groups(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held))

    return run


def _compared_in_groups(rest: DataFrame, classes: DataFrame, least: int, best: bool = False) -> DataFrame:
    """(u, v, settled) of the pivots of ``rest`` (sig, cls, label, pivot, size) and others of their groups, as far as sketches allow.

    ``settled``: the whole sketches were compared.  ``best``: each class comes with one pivot only, the one most alike.
    """
    parts = F.ceil(F.col("size") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    sent = classes.select("cls", F.when(F.length("sketch") <= SENT, F.col("sketch")).alias("sketch"))
    dealt = rest.join(sent, "cls").select("sig", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))).alias("part"), "cls", "label", "pivot", "sketch")
    pairs = dealt.repartition("sig", "part").sortWithinPartitions("sig", "part").mapInArrow(common.task("partenum", _near(least, best, detailed=True)), NEAR)
    if best:
        pairs = pairs.groupBy("v").agg(F.max(F.struct("bound", "u", "settled")).alias("p"))
        pairs = pairs.select(F.least("p.u", "v").alias("u"), F.greatest("p.u", "v").alias("v"), "p.settled")
    return pairs.groupBy("u", "v").agg(F.max("settled").alias("settled"))


def links(rows: DataFrame, of: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(u, v): links between classes that connect all classes that links connect.  ``of``: stored :func:`sets` of the rows."""
    spark = rows.sparkSession
    state = common.written(shared(of), "signatures", "size")
    common.released(spark)
    classes = common.written(of.groupBy("cls").agg(F.min(F.struct("key", "tid")).alias("d"), F.first("sketch").alias("sketch")).select("cls", "d.key", "d.tid", "sketch"), "sketches")
    state, found, good, turn, trials, salt = state.withColumn("label", F.col("cls")), None, [], 0, 0, 0
    while True:
        rest = state
        if turn:
            alone = F.count_if(F.col("label") == F.col("cls")).alias("alone")
            mixed = state.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), alone).filter("lo <> hi").select("sig", "size", "alone")
            rest = common.written(state.join(mixed, "sig"), "groups", "size")
        if rest.isEmpty():
            break
        rank = F.xxhash64("cls", F.lit(salt))
        if turn:
            # classes that nothing is linked to come first: once all of them have met the group, it is one component
            slots = max(PIVOTS, min(PAIRS // MEMBERS, PIVOTS ** min(turn, 16)))
            lone = F.col("label") == F.col("cls")
            among = F.greatest(F.when(lone, F.col("alone")).otherwise(F.col("size") - F.col("alone")), F.lit(1))
            rest = rest.withColumn("pivot", F.pmod(rank, among) < F.when(lone, F.lit(slots)).otherwise(F.lit(slots) - F.col("alone")))
            pairs = common.written(_compared_in_groups(rest, classes, least, best=trials > 0), "allowed")
        else:  # at first each class meets one pivot, the same in most of its groups
            chosen = rest.groupBy("sig").agg(F.min(F.struct(rank.alias("r"), F.col("cls").alias("pivot"))).alias("p"))
            met = rest.join(chosen, "sig").filter("cls <> p.pivot").groupBy("cls").agg(F.min("p").alias("p"))
            pairs = met.select(F.least("cls", "p.pivot").alias("u"), F.greatest("cls", "p.pivot").alias("v")).distinct()
        close = _compared(pairs.filter("NOT settled") if turn else pairs, classes, "sketch", lambda x, y: within(x, y, least)).filter("linked").select("u", "v")
        close = common.written(close.unionByName(pairs.filter("settled").select("u", "v")) if turn else close, "bounded")
        wanted = classes.join(close.select(F.col("u").alias("cls")).union(close.select("v")).distinct(), "cls").select("cls", "key", "tid")
        wanted = common.written(wanted if found is None else wanted.join(found, "cls", "left_anti"), "wanted")
        if found is None or not wanted.isEmpty():
            more = common.written(_elements(rows, wanted, shingle), "sets", "size")
            found = more if found is None else found.unionByName(more)
        good.append(common.written(_compared(close, found, "e", _alike(least)).filter("linked").select("u", "v"), "links"))
        if turn and not trials:  # these have met all of their group
            rest = rest.filter(~F.col("pivot"))
        rest = rest.select("sig", "cls", "label")
        linked = good[-1].count()
        if linked:
            now = rest.select(F.col("cls").alias("c"), F.col("label").alias("l")).distinct()
            edges = good[-1].join(now.withColumnsRenamed({"c": "u", "l": "lu"}), "u", "left").join(now.withColumnsRenamed({"c": "v", "l": "lv"}), "v", "left")
            joined = components(edges.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
            rest = rest.join(joined.withColumnRenamed("label", "to"), rest.label == joined.node, "left").select("sig", "cls", F.coalesce("to", "label").alias("label"))
        turn += not trials
        trials = trials + 1 if trials < TRIALS and linked and linked >= WORTH * close.count() else 0
        state, salt = rest, salt + 1
        common.released(spark)
    every = spark.createDataFrame([], "u long, v long")
    for g in good:
        every = every.unionByName(g)
    return every


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = _keyed(docs, id_col, text_col)
    of = common.written(sets(rows, shingle, least), "classes", "none")
    label = components(links(rows, of, shingle, least))
    full = of.filter("n > 0").join(label, of.cls == label.node, "left").select("key", "n", F.coalesce("label", "cls").alias("label"))
    first = full.groupBy("label").agg(F.min("key").alias("first"))
    alone = of.filter("n = 0").select("key", "n", F.col("key").alias("first"))
    out = full.join(first, "label").select("key", "n", "first").unionByName(alone)
    known = lambda c, name: F.when(F.col(c) < _LAST, F.col(c)).alias(name)
    return out.select(known("key", "doc_id"), F.col("n").alias("n_shingles"), known("first", "component_id"))
