"""Exact deduplication against a minimal perfect hash of known digests.

The distinct digests of the *history* are dealt into buckets; each bucket gets a
level-wise minimal perfect hash (bit arrays of the keys that are alone at their
place, level by level, ranked). A slot holds the whole 32-byte digest, the
locator of the winning row and the group's size. Arrivals are pre-aggregated to
one row a digest, looked up, and compared byte by byte with the slot's digest:
members join the slot's group, nonmembers form groups of their own.

Defined cases: a null text counts as empty; empty texts are equal to each other;
a null doc_id loses every tie; rows that repeat doc_id and text are one row
counted twice; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, one_of_each, text_key, written

#: Keys a bucket of the index should have on average, and the fewest buckets.
BUCKET_KEYS, MIN_BUCKETS = 16_384, 512
_GROUP = "digest binary, n_chars long, doc_id long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text as it is, n_chars and the SHA-256 of the text without white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.translate(text, SPACE_CHARS, ""), 256)).alias("digest"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: the winner (most code points, then smallest doc_id) and the size."""
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "best.n_chars", (-F.col("best.neg")).alias("doc_id"), "group_size")
    )


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key (rows of four 64-bit words) at a level of that size."""
    salts = _mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(16 * level)) | np.uint64(1)
    return (_mix((_mix(keys ^ salts) * salts).sum(axis=1, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def mph_build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct keys: the sizes of the levels, all levels' bits, and each key's slot."""
    left, sizes, levels, at, base = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64), 0
    while len(left):
        size = max(8, 2 * len(left))
        places = _places(keys[left], len(sizes), size)
        alone = np.bincount(places, minlength=size) == 1
        done = alone[places]
        at[left[done]] = places[done] + base
        levels.append(alone)
        sizes.append(size)
        base, left = base + size, left[~done]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return np.array(sizes, np.int64), bits, np.cumsum(bits)[at] - 1 if len(keys) else at


def mph_slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level knows it. A key outside the set may
    get any slot: whoever asks compares the slot's digest."""
    slots, left, base, rank = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, np.cumsum(bits) - 1
    for level, size in enumerate(sizes.tolist()):
        if not len(left):
            break
        places = _places(keys[left], level, size) + base
        hit = bits[places]
        slots[left[hit]] = rank[places[hit]]
        base, left = base + size, left[~hit]
    return slots


def _keys(column) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<u8").reshape(-1, 4)


def _index_bucket(t: pa.Table) -> pa.Table:
    sizes, bits, slots = mph_build(_keys(t.column("digest")))
    order = pa.array(np.argsort(slots))
    t = t.take(order)
    as_list = lambda c: [t.column(c).to_pylist()]
    return pa.table(
        {
            "bucket": pa.array([t.column("bucket")[0].as_py()], pa.int64()),
            "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "digest": pa.array([b"".join(t.column("digest").to_pylist())], pa.binary()),
            "n_chars": pa.array(as_list("n_chars"), pa.list_(pa.int64())),
            "doc_id": pa.array(as_list("doc_id"), pa.list_(pa.int64())),
            "group_size": pa.array(as_list("group_size"), pa.list_(pa.int64())),
        }
    )


_INDEX = "bucket long, sizes array<long>, bits binary, digest binary, n_chars array<long>, doc_id array<long>, group_size array<long>"


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index of distinct digests, one row a bucket: a table that can be kept and looked up later."""
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_index_bucket, _INDEX)


def _merge_bucket(new: pa.Table, index: pa.Table) -> pa.Table:
    """Arrivals of a bucket against its index: every group of the bucket with its winner and size."""
    out = {c: [] for c in ("digest", "n_chars", "doc_id", "group_size")}
    fresh = np.ones(new.num_rows, bool)
    if index.num_rows:
        row = index.to_pylist()[0]
        sizes = np.array(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        held = [row["digest"][i : i + 32] for i in range(0, len(row["digest"]), 32)]
        chars, ids, counts = row["n_chars"], row["doc_id"], row["group_size"]
        if new.num_rows:
            slots = mph_slots(_keys(new.column("digest")), sizes, bits)
            for i, (slot, r) in enumerate(zip(slots.tolist(), new.to_pylist(), strict=True)):
                if slot < 0 or held[slot] != r["digest"]:
                    continue
                fresh[i] = False
                counts[slot] += r["group_size"]
                rank = lambda n, d: (n, d is not None, -(d or 0))
                if rank(r["n_chars"], r["doc_id"]) > rank(chars[slot], ids[slot]):
                    chars[slot], ids[slot] = r["n_chars"], r["doc_id"]
        out = {"digest": held, "n_chars": chars, "doc_id": ids, "group_size": counts}
    alone = new.filter(pa.array(fresh))
    return pa.table(
        {c: pa.array([*out[c], *alone.column(c).to_pylist()], pa.binary() if c == "digest" else pa.int64()) for c in out}
    )


def lookup(arrivals: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """All groups after the arrivals (one row a digest) have met the index."""
    dealt = arrivals.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return dealt.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_merge_bucket, _GROUP)


def exact_dedup(docs: DataFrame, is_history=None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    ``is_history`` is a condition that tells the rows already known from the
    arrivals (default: half of the rows, by a hash of doc_id); it decides who is
    indexed and who is looked up, never the result. Of the rows that repeat both
    the winner's doc_id and its text, all are marked kept.

    Digests are worked out anew for each of the three uses of the rows: that is one
    scan each, and spares a table of them all. A hot digest's rows meet its one
    group in a join, which adaptive execution splits.
    """
    if is_history is None:
        is_history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    # history and arrivals have no more digests than this
    buckets = max(MIN_BUCKETS, docs.count() // BUCKET_KEYS)
    rows = digests(docs)
    index = build_index(grouped(digests(docs.filter(is_history))), buckets)
    groups = lookup(grouped(digests(docs.filter(~is_history))), index, buckets).select(
        "digest", F.col("doc_id").alias("keep_id"), "group_size", F.col("n_chars").alias("keep_chars")
    )
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_key",
    )


def without_copies(docs: DataFrame, is_history=None) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps; of several that it marks kept in one group, one."""
    found = exact_dedup(docs, is_history).filter("group_size > 1").select("doc_id", "text_key", F.col("text_sha256").alias("group"), "kept")
    return one_of_each(docs, written(found, "copies"))
