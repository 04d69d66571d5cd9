"""Exact Jaccard join of documents' word shingles by PartEnum signatures.

Sets of similar size fall into bands. Two sets of one band with Jaccard
similarity of at least the threshold differ in at most k elements, where k
follows from the band's largest size. The feature domain (64-bit shingle hashes)
is partitioned on two levels, n1 groups of n2 partitions, and in each group all
subsets of n2 - k2 partitions are enumerated. Of more than k / (k2 + 1) groups
one has at most k2 differing partitions, so that two sets that differ in at most
k places agree on all of one subset; a subset's content is a signature, and sets
that may be similar share one:

* small k: one group of k + 3 partitions, every subset of 3 of them;
* larger k: groups of three partitions, every two of them; where these would be
  more than MOST_SIGNS for each element of the band's smallest sets, each partition
  is a group and a signature of its own.

From there on there are ``slack`` groups more than needed, so subsets without an
element can be left out by a set that has them in at most ``slack`` groups: then one
of the other groups agrees too. That loses no pair, and spares sets that share
nothing from meeting.

A set whose size lies just below the next band also signs for that band.

Sets that are equal are one representative. Each member of a signature's group
meets the group's first member; those met by one first member are its family. Two
sets that meet are compared by sketches first, counts of their elements in 256 cells
or, for large sets, about a quarter of the set's size: the sum of the counts' differences is at
most the number of differing elements, so that it rules out pairs without loss. Whole
sets, from the texts, are compared for the rest. Links merge into components; members
of a family that are then in different components meet as well, unless their
distances to the first member tell them apart (Jaccard distance is a metric): the
members outside the family's largest component so far, BLOCK at a turn, with those of
other components. Components merge after each turn. Only links, and what the sketches
leave, are ever made into rows.

Texts are read twice, for the ids of their sets and for signatures, so that these
go into the one shuffle that needs them and no table holds them.

Two different shingles count as one only if their 64-bit hashes are equal. Sets
are told apart by 128 bits; their ids are 64 of these, and sets whose 64 bits
meet by chance (some hundreds of 10^11) take the other 64.

Defined cases: a null text is empty; an empty set links with nothing, and
component_id is its own doc_id; a row with a null doc_id links like any other, and
its component_id is null where no row of its component has a doc_id; rows that
repeat a doc_id are documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, one_of_each, small_batches, text_key, written
from .graph import components

WORDS, PERCENT = 4, 85
#: Members of a family that are compared with its others in one turn, and members in a slice of it.
BLOCK, SLICE = 2048, 4096
#: Ids up to which a list of documents to read is broadcast (16 bytes each); beyond it, a shuffled join.
BROADCAST_IDS = 1_000_000
_GOLD = 0x9E3779B97F4A7C15
_RATIO = 1.384  # largest over smallest size of a band
#: Differing elements up to which there is one group; (partitions in a group, those that may differ) beyond.
FEW, LEVELS = 4, ((3, 1), (1, 0))
MOST_SIGNS = 0.45


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLD))
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    table[space] = 0
    return table, space


_TABLE, _SPACE = _bytes_table()
_STEP = 0xD1342543DE82EF95  # odd, so that it has an inverse


#: One unrelated odd factor for each place in a shingle (up to 16 words).
_FACTORS = mix(np.arange(1000, 1016, dtype=np.uint64) * np.uint64(_GOLD)) | np.uint64(1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z in lower case."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(1 << 17, 1 << len(b).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[b] * up[: len(b)])])
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, of the whole sequence."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, (words - n) * _GOLD % (1 << 64), np.uint64)
    for i in range(n):
        total += w[i : len(w) - n + 1 + i] * _FACTORS[i]
    return np.unique(mix(total))


@lru_cache(None)
def edge(band: int) -> int:
    """The smallest size of a band; band 0 starts at 1."""
    return 1 if band == 0 else max(edge(band - 1) + 1, int(edge(band - 1) * _RATIO))


@lru_cache(None)
def scheme(band: int, percent: int) -> tuple[int, int, int, int, np.ndarray]:
    """(k, n1, n2, slack, subsets) of a band: groups, partitions in each, groups more
    than needed, and the partitions of each subset of a group."""
    most = edge(band + 1) - 1
    k = 2 * (100 - percent) * most // (100 + percent)
    if k <= FEW:
        return k, 1, k + 3, 0, np.array(list(combinations(range(k + 3), 3)))
    least = max(1, edge(band) * percent // 100)
    for n2, k2 in LEVELS:
        subsets, need, slack = np.array(list(combinations(range(n2), n2 - k2))), k // (k2 + 1) + 1, 0
        while True:  # room for the groups with an empty subset that the smallest sets have, and a deviation
            n1 = need + slack
            none = math.exp(-least / (n2 * n1))
            weak = sum(math.comb(n2, i) * none**i * (1 - none) ** (n2 - i) for i in range(n2 - k2, n2 + 1))
            if slack >= n1 * weak + math.sqrt(n1 * weak * (1 - weak)) or slack >= need:
                break
            slack += 1
        if n1 * len(subsets) <= MOST_SIGNS * edge(band):
            break
    return k, n1, n2, slack, subsets


def band_of(size: int) -> int:
    band = max(0, int(math.log(max(size, 1)) / math.log(_RATIO)) - 3)
    while edge(band + 1) <= size:
        band += 1
    while edge(band) > size:
        band -= 1
    return band


def signatures(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """PartEnum signatures of a set of distinct 64-bit hashes."""
    size, out = len(elements), []
    band = band_of(size)
    spread = mix(elements * np.uint64(_GOLD | 1))
    high, low = (spread >> np.uint64(32)).astype(np.float64), (spread & np.uint64(0xFFFFFFFF)).astype(np.float64)
    for at in (band, band + 1) if 100 * size >= percent * edge(band + 1) else (band,):
        k, n1, n2, slack, subsets = scheme(at, percent)
        if not k:
            continue  # only equal sets are that similar
        n = n1 * n2
        parts = ((elements >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        # sums of 32-bit halves are exact in a double
        sums = (np.bincount(parts, high, n).astype(np.uint64) << np.uint64(32)) + np.bincount(parts, low, n).astype(np.uint64)
        counts = np.bincount(parts, minlength=n).reshape(n1, n2)[:, subsets].sum(axis=2)
        sums = sums.reshape(n1, n2)[:, subsets].sum(axis=2, dtype=np.uint64)
        sums += counts.astype(np.uint64) * np.uint64(_GOLD)
        sums = mix(sums + np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) * np.uint64(_STEP))
        if slack:
            empty = counts == 0
            if empty.any(axis=1).sum() <= slack:
                sums = sums[~empty]
        out.append(mix(sums.ravel() ^ np.uint64((at + 1) * _GOLD % (1 << 64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_ids(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, as two numbers."""
    said = blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(said[:8], "little", signed=True), int.from_bytes(said[8:], "little", signed=True)


def sketch(elements: np.ndarray) -> bytes:
    """Counts of a set's elements in cells, a power of two of them; empty where a count needs more than a byte."""
    bits = max(8, (len(elements) // 4).bit_length())
    counts = np.bincount((mix(elements * np.uint64(_GOLD | 1)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _folded(cells: np.ndarray, n: int) -> np.ndarray:
    """Rows of counts, in the n cells that hold theirs."""
    return cells.reshape(len(cells), n, -1).sum(axis=2, dtype=np.int32) if cells.shape[1] > n else cells.astype(np.int32)


def may_link(size: int, cells: bytes, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of other sets (sizes, rows of cells all of one number) a set may be similar to."""
    able = 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
    if cells and others.shape[1] and able.any():
        n = min(len(cells), others.shape[1])
        own = _folded(np.frombuffer(cells, np.uint8).reshape(1, -1), n)
        apart = np.abs(_folded(others[able], n) - own).sum(axis=1)
        able[able] = (100 + percent) * apart <= (100 - percent) * (sizes[able] + size)
    return able


def _rid(elements: np.ndarray, clashes: set) -> int:
    """A set's id: its first 64 bits, or the others where these are another set's too."""
    x, y = set_ids(elements)
    return y if x in clashes else x


def _sized(words: int):
    def run(batches):
        for b in batches:
            sets = [shingles(text, words) for text in b.column("text").to_pylist()]
            ids = [set_ids(s) if len(s) else (None, None) for s in sets]
            low, high = zip(*ids, strict=True) if ids else ((), ())
            cols = [pa.array(list(map(len, sets)), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            cols.append(pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *cols], names=["doc_id", "text_key", "n_shingles", "low", "high", "cells"])

    return run


def _signed(words: int, percent: int, clashes: set):
    def run(batches):
        for b in batches:
            ids, signs = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, words)
                ids.append(_rid(s, clashes) if len(s) else None)
                signs.append(signatures(s, percent).view(np.int64) if len(s) else np.zeros(0, np.int64))
            at = np.cumsum([0, *map(len, signs)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.int64()), lists], names=["doc_id", "rid", "signs"])

    return run


def _stars(batches):
    """From rows sorted by (sign, rid): each group's first member with every other one."""
    sign, center = None, None
    for b in batches:
        s, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sign", "rid"))
        if not len(s):
            continue
        new = np.concatenate([[sign is None or s[0] != sign], s[1:] != s[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        centers = np.where(at >= 0, r[at], center if center is not None else 0)
        keep = ~new & (centers != r)
        sign, center = s[-1], centers[-1]
        yield pa.RecordBatch.from_arrays([pa.array(centers[keep]), pa.array(r[keep])], names=["a", "b"])


def _sifted(percent: int):
    """For each pair (a, b, with sizes and cells): whether the sketches leave it."""

    def run(batches):
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("a_size", "a_cells", "b_size", "b_cells"))
            able = [
                bool(may_link(m, x, np.array([n]), np.frombuffer(y, np.uint8).reshape(1, -1), percent)[0]) for m, x, n, y in zip(*cols, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(able, pa.bool_())], names=["a", "b", "able"])

    return run


def _sift(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, able) of each pair."""
    for c in "ab":
        pairs = pairs.join(sketches.select(F.col("rid").alias(c), F.col("size").alias(f"{c}_size"), F.col("cells").alias(f"{c}_cells")), c)
    return pairs.mapInArrow(giving_back(_sifted(percent)), "a long, b long, able boolean")


def _compared(words: int, percent: int):
    """From rows sorted by (a, salt, is_member): the first member's text, then the others'."""

    def run(batches):
        a, salt, first = None, None, None
        for batch in batches:
            out = []
            cols = (batch.column(c).to_pylist() for c in ("a", "salt", "b", "text"))
            for x, t, b, text in zip(*cols, strict=True):
                elements = shingles(text, words)
                if b is None:
                    a, salt, first = x, t, elements
                elif (x, t) == (a, salt):
                    both = len(np.intersect1d(first, elements, assume_unique=True))
                    either = len(first) + len(elements) - both
                    out.append((x, b, 100 * both >= percent * either, 1 - both / either))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "linked", "distance"])

    return run


def _compare(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked, distance) of each pair, exactly. A hot first member's pairs are dealt to many tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)))
    first = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("rid", "a"), "a")
    rest = salted.join(texts.withColumnRenamed("rid", "b"), "b")
    rows = first.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").union(rest.select("a", "salt", "b", "text"))
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(giving_back(_compared(words, percent)), "a long, b long, linked boolean, distance double")


def _texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, words: int, clashes: set) -> DataFrame:
    """(rid, text) of the wanted representatives."""
    ids = written(reps.join(wanted, "rid", "left_semi").select("rid", "doc_id"), "wanted")
    small = ids.count() <= BROADCAST_IDS
    keys = ids.select(F.col("doc_id").alias("_id")).distinct()
    some = docs.join(F.broadcast(keys) if small else keys, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            rids = [_rid(shingles(t, words), clashes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), b.column("text")], names=["rid", "text"])

    # a doc_id that repeats may bring texts that no one asked for, or one twice
    met = some.mapInArrow(giving_back(run), "rid long, text string").join(ids.select("rid"), "rid", "left_semi")
    return written(met.dropDuplicates(["rid"]), "texts")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int, clashes: set) -> DataFrame:
    """(a, b, linked, distance) of each pair, from the texts."""
    wanted = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    return _compare(pairs, _texts_of(docs, reps, wanted, words, clashes), words, percent)


def _pairs(docs: DataFrame, sets: DataFrame, reps: DataFrame, words: int, percent: int, clashes: set) -> DataFrame:
    """(a, b): each representative with the first one of each of its signatures."""
    skip = sets.join(reps.withColumnRenamed("doc_id", "_rep"), "rid").filter(~F.col("doc_id").eqNullSafe(F.col("_rep")))
    skip = written(skip.select(F.col("rid").alias("_rid"), F.col("doc_id").alias("_id")).distinct(), "copies")
    small = skip.count() <= BROADCAST_IDS
    signed = docs.mapInArrow(giving_back(_signed(words, percent, clashes)), "doc_id long, rid long, signs array<long>").filter("rid is not null")
    copy = (F.col("rid") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    signed = signed.join(F.broadcast(skip) if small else skip, copy, "left_anti").select("rid", "signs")
    # sets that several rows with the representative's own doc_id have
    again = written(reps.filter("n_own > 1").select(F.col("rid").alias("_rid")), "again")
    if again.head(1):
        again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
        one = signed.join(again, F.col("rid") == F.col("_rid"), "left_semi").groupBy("rid").agg(F.first("signs").alias("signs"))
        signed = signed.join(again, F.col("rid") == F.col("_rid"), "left_anti").union(one)
    rows = signed.select("rid", F.explode("signs").alias("sign"))
    return rows.repartition("sign").sortWithinPartitions("sign", "rid").mapInArrow(giving_back(_stars), "a long, b long").distinct()


def clusters(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, text_key, n_shingles, label (of its
    component; null for an empty set), component_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text")).alias("text_key"))
    sets = written(docs.mapInArrow(giving_back(_sized(words)), "doc_id long, text_key long, n_shingles long, low long, high long, cells binary"), "sets")
    docs = docs.select("doc_id", "text")
    met = sets.filter("low is not null").groupBy("low").agg(F.min("high").alias("x"), F.max("high").alias("y")).filter("x <> y")
    # of n sets, about n * n / 2^65: some hundreds of 10^11
    clashes = {r["low"] for r in met.collect()}
    rid = F.col("low")
    if clashes:
        rid = F.when(F.col("low").isin(*clashes), F.col("high")).otherwise(rid)
    sets = sets.withColumn("rid", rid).drop("low", "high")
    by_row = sets.filter("rid is not null").groupBy("rid", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.first("cells").alias("cells")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "size", "cells")).alias("first")
    # written, so that the join with the rows of a set that many have can be split
    one = by_row.groupBy("rid").agg(first).select("rid", "first.*").drop("none").withColumnRenamed("n", "n_own")
    reps = written(one, "reps")
    sets = sets.drop("cells")
    pairs = written(_sift(written(_pairs(docs, sets, reps.select("rid", "doc_id", "n_own"), words, percent, clashes), "pairs"), reps, percent), "sifted")
    met = written(_verified(docs, reps, pairs.filter("able").select("a", "b"), words, percent, clashes), "compared")
    labels = written(components(met.filter("linked").select("a", "b")), "labels")
    state = met.select("a", "b", "distance").union(pairs.filter("not able").select("a", "b", F.lit(None).cast("double").alias("distance")))
    for turn in range(1 << 20):
        state = written(_apart(state, labels, turn), "apart")
        if not state.head(1):
            break
        found = written(_compare_blocks(state, reps, percent), "found")
        if found.head(1):
            found = written(_verified(docs, reps, found, words, percent, clashes).filter("linked").select("a", "b"), "linked")
            known = labels.filter("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
            labels = written(components(known.union(found)), "labels")
        state = state.filter((F.col("minors") > BLOCK) & ~F.col("chosen")).select("a", "b", "distance")
    named = reps.select("rid", "doc_id").join(labels.withColumnRenamed("id", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "label").select("rid", "label", "component_id")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.join(found, "rid", "left").select("doc_id", "text_key", "n_shingles", "label", component.alias("component_id"))


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach)."""
    return clusters(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component: the
    row of the smallest doc_id (null last), then the smallest hash of the text. Of
    rows that repeat that doc_id and text, one stays. Documents without words all stay."""
    rows = clusters(docs, words, percent).filter("label is not null").select("doc_id", "text_key", "label")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    several = rows.groupBy("label").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    found = rows.join(several, "label").select("doc_id", "text_key", F.col("label").alias("group"), kept.alias("kept"))
    return one_of_each(docs, written(found, "near-copies"))


def _apart(state: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """The families whose members other than the first, a, have several labels: rows
    (a, b, distance, label, minors, size, chosen). Minor members are those outside
    the family's most common label; about BLOCK of them are chosen for this turn."""
    named = state.join(labels.withColumnRenamed("id", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    sizes = named.groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("a").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size")).filter("size > top.n")
    major = major.select("a", F.col("top.label").alias("major"), (F.col("size") - F.col("top.n")).alias("minors"), "size")
    # written, so that the join with a large family's members can be split
    major = written(major, "families")
    met = named.join(major, "a")
    lot = F.pmod(F.xxhash64("b", F.lit(turn)), F.col("minors")) < BLOCK
    return met.select("a", "b", "distance", "label", "minors", "size", ((F.col("label") != F.col("major")) & lot).alias("chosen"))


def _compare_blocks(state: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): what the sketches leave of the pairs of chosen members of a family and
    its members of another label. A family's members are dealt to slices; the chosen
    go to each slice, where one member after the other meets them all."""
    near = 1 - percent / 100 + 1e-9
    slices = F.ceil(F.col("size") / SLICE)
    every = state.filter("chosen").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    each = state.withColumn("slice", F.pmod(F.xxhash64("b"), slices))
    rows = every.select("a", "slice", F.lit(0).alias("kind"), "b", "label", "distance").union(
        each.select("a", "slice", F.lit(1).alias("kind"), "b", "label", "distance")
    )
    rows = rows.join(sketches.select(F.col("rid").alias("b"), F.col("size").alias("n"), "cells"), "b")
    dealt = rows.repartition("a", "slice").sortWithinPartitions("a", "slice", "kind")

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            out = []
            cols = (batch.column(c).to_pylist() for c in ("a", "slice", "kind", "b", "label", "distance", "n", "cells"))
            for a, piece, kind, *member in zip(*cols, strict=True):
                if (a, piece) != at:
                    at, held, block = (a, piece), [], None
                if kind == 0:
                    held.append(member)
                    continue
                if block is None:
                    block = _blocks(held)
                b = member[0]
                out += [(min(b, c), max(b, c)) for part in block for c in part.left(*member, near, percent)]
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(giving_back(run), "a long, b long").distinct()


class _Block:
    """Members whose sketches have as many cells, to be met by one member at a time."""

    def __init__(self, held: list):
        ids, labels, distances, sizes, cells = zip(*held, strict=True)
        self.ids, self.labels, self.sizes = (np.array(x, np.int64) for x in (ids, labels, sizes))
        self.distances = np.array([np.nan if d is None else d for d in distances])
        self.cells = np.frombuffer(b"".join(cells), np.uint8).reshape(len(held), -1)

    def left(self, b, label, distance, size, cells, near, percent) -> list[int]:
        able = (self.labels != label) & (self.ids != b)
        if distance is not None:
            able &= ~(np.abs(self.distances - distance) > near)  # an unknown distance tells nothing
        at = np.flatnonzero(able)
        return self.ids[at[may_link(size, cells, self.sizes[at], self.cells[at], percent)]].tolist() if len(at) else []


def _blocks(held: list) -> list[_Block]:
    by = defaultdict(list)
    for member in held:
        by[len(member[-1])].append(member)
    return [_Block(v) for v in by.values()]
