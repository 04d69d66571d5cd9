"""Document fingerprints that follow edit distance.

A text is cut at anchors, places where a rolling hash is largest among its
neighbours, so that an edit moves no cut but those beside it. From each anchor a
random walk reads characters: at step t it either stays or moves on, by a coin
that all texts share for that step and character (the edit embedding of
Chakraborty, Goldenberg and Koucky). Walks over texts with few edits between
them soon fall into step again, so edit distance becomes Hamming distance of
what the walks read. Each band of STEPS steps samples SAMPLED of its
characters; a band's sample is a feature, and all features of a text vote on the
BITS bits of its fingerprint.

likeness of two fingerprints: cosine of the angle that their share of different
bits stands for, between 0 and 1; 1 for equal ones, about 0 for unrelated texts.

Defined cases: a null text is empty; the fingerprint of an empty text is all
zeros; a null doc_id comes first in order; rows that repeat a doc_id are ordered
by text; a single document is its own next; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .line_dedup import counts_apart, letter_counts

BITS, VOTES = 512, 1536
STEPS, SAMPLED, BANDS = 16, 5, 48
#: Distance that an anchor keeps from others on each side, and the longest chunk.
REACH, LONGEST = 16, 128
#: Characters worked on at a time, documents in a bucket, and the most buckets.
BLOCK_CHARS, BUCKET_DOCS, MAX_BUCKETS = 1_000_000, 1024, 65_536
#: Documents of a band in a slice of near_pairs.
SLICE = 1024
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_CODES = 1024  # characters are hashed to 1..1023; 0 fills the space between texts
_COIN = _RNG.integers(0, 2, (STEPS * BANDS, _CODES)).astype(np.int32)
_COIN[:, 0] = 0
_GEAR = _RNG.integers(1, 1 << 32, _CODES, dtype=np.uint64).astype(np.uint32)
_SAMPLE = [set(_RNG.choice(STEPS, SAMPLED, replace=False).tolist()) for _ in range(BANDS)]
_TIE = _RNG.integers(0, 2, BITS).astype(bool)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each chunk of a buffer of texts with filler between them."""
    h = _GEAR[codes]
    for step in (1, 2, 4):
        h[step:] += h[:-step] << np.uint32(step)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h[codes == 0] = 0
    high = h.copy()
    for step in (1, 2, 4, 8, 16):  # the largest of 32 places from here on
        high[:-step] = np.maximum(high[:-step], high[step:])
    around = np.zeros_like(h)
    around[REACH:] = high[:-REACH]  # ... from REACH places before
    anchors = np.flatnonzero((h == around) & (h > 0))
    all_starts = np.unique(np.concatenate([starts[ends > starts], anchors]))
    text = np.searchsorted(starts, all_starts, "right") - 1
    all_ends = np.minimum(np.concatenate([all_starts[1:], [len(codes)]]), ends[text])
    pieces = np.maximum(1, -(-(all_ends - all_starts) // LONGEST))
    if (pieces > 1).any():
        n = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s, e = np.repeat(all_starts, pieces), np.repeat(all_ends, pieces)
        all_starts, all_ends, text = s + n * LONGEST, np.minimum(e, s + (n + 1) * LONGEST), np.repeat(text, pieces)
    return all_starts, all_ends, text


def _features(codes, starts, ends, text) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number): the samples of all bands of all walks, which run side by side."""
    features, owners = [], []
    pos = starts.astype(np.int64)
    for band in range(BANDS):
        if not len(pos):
            break
        h = np.full(len(pos), band + 1, np.uint64)
        for i in range(STEPS):
            read = codes.take(pos)
            if i in _SAMPLE[band]:
                h *= _GOLD
                h += read
            pos += _COIN[band * STEPS + i].take(read)
        features.append(_mix(h))
        owners.append(text)
        on = pos < ends
        pos, ends, text = pos[on], ends[on], text[on]
    return np.concatenate(features or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of packed bits for each text."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    arrays = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(arrays[j]) <= BLOCK_CHARS):
            size += len(arrays[j]) + 2 * REACH
            j += 1
        out[i:j] = _block(arrays[i:j])
        i = j
    return out


def _block(arrays: list[np.ndarray]) -> np.ndarray:
    gap = np.zeros(2 * REACH, np.uint32)
    lengths = np.array([len(a) for a in arrays], np.int64)
    starts = np.cumsum(lengths + 2 * REACH) - lengths  # filler before the first text too
    raw = np.concatenate([x for a in arrays for x in (gap, a)] + [gap])
    codes = ((raw * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(_CODES - 1) + np.uint32(1)
    codes = codes.astype(np.uint16)
    ends = starts + lengths
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    codes[np.cumsum(inside[:-1]) == 0] = 0
    features, owners = _features(codes, *_chunks(codes, starts, ends))
    counts = np.bincount(owners, minlength=len(arrays))
    votes = np.minimum(256, -(-VOTES // np.maximum(1, counts)))[owners]
    order = np.argsort(-votes, kind="stable")
    features, owners, votes = features[order], owners[order], votes[order]
    cells, signs, j = [], [], 0
    while len(votes) and votes[0] > j:  # each feature votes as often as its text needs
        n = np.searchsorted(-votes, -j, "left")
        if j % 6 == 0:
            word = _mix(features[:n] + np.uint64(int(_GOLD) * (j // 6 + 1) % (1 << 64)))
        part = (word[:n] >> np.uint64(10 * (j % 6))).astype(np.int64)
        cells.append(owners[:n] * BITS + (part & (BITS - 1)))
        signs.append((part >> 9 & 1) * 2 - 1)
        j += 1
    if not cells:
        return np.zeros((len(arrays), BITS // 8), np.uint8)
    sums = np.bincount(np.concatenate(cells), np.concatenate(signs), len(arrays) * BITS).reshape(-1, BITS)
    bits = (sums > 0) | ((sums == 0) & _TIE)
    bits[counts == 0] = False
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    different = np.unpackbits(a ^ b, axis=-1).sum(axis=-1) / BITS
    return np.clip(np.cos(np.pi * different), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compare_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, next text) of documents."""
    changed = [edited(t, n) for _, t, n in rows]
    own, new, after = (fingerprints(x) for x in ([t for _, t, _ in rows], changed, [rows[-1][2]]))
    same_next = np.concatenate([own[1:], after])
    for i in range(len(rows) - 1):
        if rows[i][2] is not rows[i + 1][1]:  # the last of a bucket has its next from elsewhere
            same_next[i] = fingerprints([rows[i][2]])[0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([x.tobytes().hex() for x in own]),
            pa.array([x.tobytes().hex() for x in new]),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, same_next)),
        ],
        names=[c.split(" ")[0] for c in _COLUMNS.split(", ")],
    )


def _walk(batches):
    """Rows sorted by (bucket, of_next, order): each own row with the row that follows it."""
    held, rows, size = None, [], 0
    for b in batches:
        for bucket, of_next, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "of_next", "doc_id", "text")), strict=True):
            text = text or ""
            if held is not None and held[0] == bucket:
                rows.append((held[1], held[2], text))
                size += 2 * len(held[2])
                if size > 4 * BLOCK_CHARS:
                    yield _compare_rows(rows)
                    rows, size = [], 0
            # of the copies from the next bucket only the first follows a document
            held = None if of_next else (bucket, doc_id, text)
    if rows:
        yield _compare_rows(rows)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, of_next, doc_id, text: documents in buckets of the order of doc_id, and
    into each bucket a copy of the first document of the next (of the first bucket
    into the last)."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("order"))
    n = ids.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_DOCS))
    # at most MAX_BUCKETS numbers come to the driver
    bounds = sorted({int(x) for x in ids.approxQuantile("order", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket_of(v):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, v.to_numpy(), "right").astype(np.int32))

    heads = ids.select("order", bucket_of("order").alias("bucket")).groupBy("bucket").agg(F.min("order").alias("head")).orderBy("bucket").collect()
    before = {h["head"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}
    rows = docs.select(order.alias("order"), F.col("doc_id").cast("long"), "text").withColumn("bucket", bucket_of("order"))
    if not before:
        return rows.select("bucket", F.lit(False).alias("of_next"), "doc_id", "text")
    spark = docs.sparkSession
    # one row for each bucket
    to = F.broadcast(spark.createDataFrame([(int(k), int(v)) for k, v in before.items()], "head long, to_bucket int"))
    copies = rows.join(to, rows["order"] == to["head"], "left")
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("of_next")))
    with_copy = F.array(F.struct(F.col("bucket"), F.lit(False).alias("of_next")), F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("of_next")))
    dealt = copies.withColumn("place", F.explode(F.when(F.col("to_bucket").isNull(), places).otherwise(with_copy)))
    out = dealt.select("place.bucket", "place.of_next", "order", "doc_id", "text").repartition("bucket")
    return out.sortWithinPartitions("bucket", "of_next", "order", "text").select("bucket", "of_next", "doc_id", "text")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    small_batches(docs.sparkSession)
    return with_next(docs).mapInArrow(_walk, _COLUMNS)


def text_classes(docs: DataFrame) -> DataFrame:
    """key (128 bits of a text's SHA-256), doc_id (the smallest), text: one row for each
    different text; a null text is empty, rows without a doc_id are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.filter("doc_id is not null").select(_text_key(text).alias("key"), F.col("doc_id").cast("long"), text.alias("text"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))


def _text_key(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def members(docs: DataFrame) -> DataFrame:
    """doc_id and representative (the smallest doc_id with the same text) of each document
    that has a doc_id: with the pairs of near_pairs, all pairs of documents."""
    firsts = text_classes(docs).select("key", F.col("doc_id").alias("representative"))
    key = _text_key(F.coalesce(F.col("text"), F.lit("")))
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), key.alias("key")).join(firsts, "key").select("doc_id", "representative")


def near_pairs(docs: DataFrame, similarity: float = 0.8, bands: int = 128, band_bits: int = 16) -> DataFrame:
    """(a, b, similarity): representatives (see members) of different texts whose
    fingerprints agree on a band of sampled bits, every two of a band, verified by edit
    distance over the longer text. Copies are one text and make no pairs of their own. A
    band's texts are dealt to slices, and each two slices meet by themselves.

    A search by sampled bands: pairs near the threshold can be missed, above all where
    the edits are scattered over the text, as each spoils the samples around it. More
    bands of fewer bits find more, at the cost of more pairs to verify."""
    rng = np.random.default_rng(7)
    samples = [sorted(rng.choice(BITS, band_bits, replace=False).tolist()) for _ in range(bands)]

    def keys(batches):
        weights = 1 << np.arange(band_bits, dtype=np.int64)
        for b in batches:
            bits = np.unpackbits(fingerprints(b.column("text").to_pylist()), axis=1)
            found = np.stack([(bits[:, s].astype(np.int64) * weights).sum(axis=1) + (k << band_bits) for k, s in enumerate(samples)], axis=1)
            own = b.column("key").take(pa.array(np.repeat(np.arange(b.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([own, pa.array(found.ravel(), pa.int64())], names=["key", "band"])

    small_batches(docs.sparkSession)
    texts = written(text_classes(docs), "texts")
    rows = written(texts.select("key", "text").mapInArrow(keys, "key binary, band long"), "bands")
    hot = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE)
    parts = rows.join(hot.select("band", F.ceil(F.col("n") / SLICE).alias("parts")), "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = parts.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    left = dealt.select("band", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("j"), F.col("key").alias("x"))
    right = dealt.select("band", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"), F.col("key").alias("y"))
    met = left.join(right, ["band", "i", "j"]).filter("x < y or i < j and x <> y")
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    texts = texts.select("key", "doc_id", "text", F.length("text").alias("n"), letter_counts(F.col("text")).alias("letters"))
    # only pairs that so many edits can't join are ruled out before verification
    first, second = (texts.select(*(F.col(c).alias(f"{k}_{c}") for c in texts.columns)) for k in "xy")
    longer = F.greatest("x_n", "y_n", F.lit(1))
    most = F.floor((1 - similarity) * longer).cast("int") + 1
    able = (F.abs(F.col("x_n") - F.col("y_n")) <= most) & (counts_apart(F.col("x_letters"), F.col("y_letters")) <= 2 * most)
    near = pairs.join(first, F.col("x") == F.col("x_key")).join(second, F.col("y") == F.col("y_key")).filter(able)
    near = near.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"), "x_text", "y_text", longer.alias("longer"), most.alias("most"))
    near = near.withColumn("distance", F.expr("levenshtein(x_text, y_text, most)")).filter("distance >= 0")  # -1 beyond most
    return near.withColumn("similarity", 1 - F.col("distance") / F.col("longer")).filter(F.col("similarity") >= similarity).select("a", "b", "similarity")
