"""Token ids in a content-addressed store.

A rolling hash over the last 16 ids cuts each document's id stream into chunks,
so that an edit moves only the cuts near it. A chunk's name is the SHA-256 of its
bytes; each distinct chunk is stored once. Files under ``path``:

* ``chunks``: digest, payload (one byte 2 or 4: the width of an id; then the ids, little-endian)
* ``recipes``, in ascending doc_id order: doc_id, start (ids before it), n_tokens,
  digests and lengths (in ids) of its chunks in order, root (Merkle root of its digests)
* ``manifest``: page (start // PAGE_TOKENS), n_docs, n_tokens, root (Merkle root of its documents' roots)

Reading back re-hashes every stored chunk, so a damaged chunk has no name that a
recipe asks for, and works each page's counts and root out again from its recipes,
so a lost, doubled or replaced recipe is at odds with the manifest. A document's
checksum is combined from its chunks' checksums without moving the chunks.

Chunks stay in the task that made them: names alone are shuffled to find those
that repeat, and of these all but the first are left out by a broadcast list, or
beyond BROADCAST_CHUNKS of them by a shuffle of the chunks.

Defined cases: a null or empty text is the end id alone; a null doc_id comes
first; rows that repeat a doc_id are documents of their own, ordered by their
content; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, removed, running_start, small_batches, written
from .tokens import encoder, tokenizer_path

WINDOW, BITS, LEAST, MOST = 16, 9, 128, 2048
PAGE_TOKENS = 1 << 20
#: Pieces in a generation of a worker's cache: encoding is nearly all of the work here.
CACHE = 700_000
#: Repeated chunks up to which their list is broadcast (48 bytes each).
BROADCAST_CHUNKS = 500_000
_EMPTY_ROOT = sha256(b"").digest()


def _gear() -> np.ndarray:
    """A pseudo-random 32-bit word for each of 2^16 ids; larger ids wrap."""
    x = np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def cut_candidates(ids: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: places after which the rolling hash of the last ids allows a cut."""
    h = _GEAR[ids & 0xFFFF]
    step = 1
    while step < WINDOW:  # h covers ``step`` ids; twice as many after each turn
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1


def cuts(start: int, end: int, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks of the ids start..end, at candidates LEAST to MOST ids apart where there are any."""
    out, at = [], start
    for c in candidates[np.searchsorted(candidates, start) : np.searchsorted(candidates, end, "right")].tolist():
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST:
            at = c
            out.append(at)
    while end - at > MOST:
        at += MOST
        out.append(at)
    if at < end:
        out.append(end)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; a node without a partner moves up as it is."""
    row = digests or [_EMPTY_ROOT]
    while len(row) > 1:
        row = [sha256(b"".join(row[i : i + 2])).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


def payloads(ids: np.ndarray, edges: list[int]) -> list[bytes]:
    """The stored form of the ids between each two edges: two bytes an id where that is enough."""
    if len(ids) and ids.max() > 0xFFFF:
        parts = [ids[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        return [p for q in parts for p in (payloads(q, [0, len(q)]) if q.max() <= 0xFFFF else [b"\x04" + q.astype("<u4").tobytes()])]
    data = ids.astype("<u2").tobytes()
    return [b"\x02" + data[2 * x : 2 * y] for x, y in zip(edges, edges[1:], strict=False)]


def payload_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def _encode_chunks(path: str):
    def run(batches):
        from pyspark import TaskContext

        e, row = encoder(path, CACHE), TaskContext.get().partitionId() << 40
        for b in batches:
            streams = [np.frombuffer(e.ids(t), "<u4") for t in b.column("text").to_pylist()]
            if not streams:
                continue
            flat, at = np.concatenate(streams), 0
            candidates, out = cut_candidates(flat), []
            for ids in streams:
                edges = [0, *(x - at for x in cuts(at, at + len(ids), candidates))]
                pieces = payloads(ids, edges)
                names = [sha256(p).digest() for p in pieces]
                out.append((len(ids), names, [y - x for x, y in zip(edges, edges[1:], strict=False)], merkle_root(names), pieces))
                at += len(ids)
            n, names, lengths, roots, pieces = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(n)), pa.int64()),
                    b.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(names, pa.list_(pa.binary())),
                    pa.array(lengths, pa.list_(pa.int32())),
                    pa.array(roots, pa.binary()),
                    pa.array(pieces, pa.list_(pa.binary())),
                ],
                names=["row", "doc_id", "n_tokens", "digests", "lengths", "root", "pieces"],
            )
            row += len(n)

    return run


def _page_root(t: pa.Table) -> pa.Table:
    t = t.sort_by("start")
    return pa.table(
        {
            "page": pa.array([t.column("page")[0].as_py()], pa.int64()),
            "n_docs": pa.array([t.num_rows], pa.int64()),
            "n_tokens": pa.array([sum(t.column("n_tokens").to_pylist())], pa.int64()),
            "root": pa.array([merkle_root(t.column("root").to_pylist())], pa.binary()),
        }
    )


def _once(staged: DataFrame) -> DataFrame:
    """(digest, payload) of each distinct chunk of the encoded documents."""
    names = staged.select("row", F.posexplode("digests").alias("place", "digest"))
    first = F.min(F.struct("row", "place")).alias("first")
    again = written(names.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").select(F.col("digest").alias("_again"), "first"), "again")
    each = staged.select("row", F.posexplode(F.arrays_zip("digests", "pieces")).alias("place", "c"))
    each = each.select("row", "place", F.col("c.digests").alias("digest"), F.col("c.pieces").alias("payload"))
    if again.count() > BROADCAST_CHUNKS:
        return each.groupBy("digest").agg(F.first("payload").alias("payload"))
    met = each.join(F.broadcast(again), F.col("digest") == F.col("_again"), "left")
    own = F.col("_again").isNull() | (F.col("first") == F.struct("row", "place"))
    return met.filter(own).select("digest", "payload")


def _pages(recipes: DataFrame) -> DataFrame:
    """page, n_docs, n_tokens, root of the documents that start in each page of ids."""
    rows = recipes.select("start", "n_tokens", "root", F.floor(F.col("start") / PAGE_TOKENS).alias("page"))
    return rows.groupBy("page").applyInArrow(_page_root, "page long, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the store's three tables under ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "row long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, pieces array<binary>"
    staged_at = new_path(spark, "encoded")
    source = docs.select(F.col("doc_id").cast("long"), "text")
    staged = written(source.mapInArrow(_encode_chunks(tokenizer or tokenizer_path()), schema), "encoded", staged_at)
    _once(staged).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = running_start(staged.drop("row", "pieces"), ["doc_id", "root"], "n_tokens", "start", "recipes")
    recipes.orderBy("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    removed(spark, staged_at)
    _pages(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _zero_byte_operators() -> list[np.ndarray]:
    """For b = 0, 1, ...: four tables of 256 that shift a CRC-32 over 2^b zero bytes."""

    def tables(op):
        return np.stack([op(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])

    # CRC-32's own step for a zero byte, from the library's checksum of single bytes
    base = np.array([zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32)
    ops = [tables(lambda x: (x >> np.uint32(8)) ^ base[x & np.uint32(255)])]
    for _ in range(40):
        ops.append(tables(lambda x, t=ops[-1]: _apply(t, _apply(t, x))))
    return ops


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]


_OPERATORS = _zero_byte_operators()


def crc_shift(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each checksum contributes to that of a stream in which n_bytes more bytes follow:
    a stream's CRC-32 is the exclusive or of its pieces' contributions."""
    out = crcs.astype(np.uint32)
    for b, t in enumerate(_OPERATORS):
        on = (n_bytes >> b) & 1 == 1
        if on.any():
            out[on] = _apply(t, out[on])
        elif not (n_bytes >> b).any():
            break
    return out


def _checked_chunks(batches):
    """Of each stored chunk: the name that its bytes have now, its length and the checksum of its ids."""
    for b in batches:
        data = b.column("payload").to_pylist()
        ids = [payload_ids(p) for p in data]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([sha256(p).digest() for p in data], pa.binary()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
            ],
            names=["digest", "n_ids", "crc"],
        )


def _references(batches):
    """A row for each chunk of each recipe, with the ids that follow it in the document."""
    for b in batches:
        out = []
        for doc_id, start, names, lengths, root in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "digests", "lengths", "root")), strict=True):
            sizes = np.array(lengths, np.int64)
            whole = merkle_root(names) == root
            after = sizes.sum() - sizes.cumsum()
            out += [(doc_id, start, d, a, s, whole) for d, a, s in zip(names, after.tolist(), sizes.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "digest", "after", "said", "whole"])


def _contributions(batches):
    for b in batches:
        crc = b.column("crc").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
        after = b.column("after").to_numpy(zero_copy_only=False)
        shifted = crc_shift(crc, after * 4).astype(np.int64)
        sound = pa.compute.and_kleene(b.column("whole"), pa.compute.equal(b.column("n_ids"), b.column("said"))).fill_null(False)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), b.column("n_ids"), pa.array(shifted), sound], names=["doc_id", "start", "n_ids", "part", "sound"]
        )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified
    (every chunk is there and sound, the recipe has its Merkle root, and the recipes
    of its page are those of the manifest)."""
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_checked_chunks, "digest binary, n_ids long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("doc_id", "start", "digests", "lengths", "root").mapInArrow(
        _references, "doc_id long, start long, digest binary, after long, said long, whole boolean"
    )
    met = refs.join(chunks, "digest", "left").select("doc_id", "start", "after", "said", "whole", "n_ids", "crc")
    parts = met.mapInArrow(_contributions, "doc_id long, start long, n_ids long, part long, sound boolean")
    each = parts.groupBy("doc_id", "start").agg(
        F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n_tokens"), F.expr("bit_xor(part)").alias("ids_crc32"), F.min("sound").alias("sound")
    )
    said = spark.read.parquet(f"{path}/manifest").withColumn("known", F.lit(True))
    pages = _pages(recipes).join(said, ["page", "n_docs", "n_tokens", "root"], "left").select("page", F.coalesce("known", F.lit(False)).alias("known"))
    met = each.withColumn("page", F.floor(F.col("start") / PAGE_TOKENS)).join(pages, "page")
    return met.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("sound") & F.col("known")).alias("verified"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The id streams themselves: doc_id, start, ids (little-endian unsigned 32-bit), rebuilt from the chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("doc_id", "start", "digests", "lengths", "root").mapInArrow(
        _references, "doc_id long, start long, digest binary, after long, said long, whole boolean"
    )
    met = refs.join(spark.read.parquet(f"{path}/chunks"), "digest")

    def rebuild(t: pa.Table) -> pa.Table:
        t = t.sort_by([("after", "descending")])
        ids = b"".join(payload_ids(p).tobytes() for p in t.column("payload").to_pylist())
        return pa.table({"doc_id": t.column("doc_id")[:1], "start": t.column("start")[:1], "ids": pa.array([ids], pa.binary())})

    return met.groupBy("doc_id", "start").applyInArrow(rebuild, "doc_id long, start long, ids binary")
