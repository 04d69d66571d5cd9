"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document longer than a sequence is cut into whole sequences, the remainder
first. What is left to place are lengths below the capacity, so the plan is made
on their histogram, which has at most ``capacity`` cells whatever the corpus:

1. Large-item matching. Of pieces above a third of the capacity at most two fit
   one sequence; from the longest down, each is matched with the longest other
   that still fits.
2. Smaller pieces, from the longest down, go to the open sequence with the
   smallest gap that takes them; where none does, new sequences are opened.

The plan lists patterns (lengths in one sequence) with how often each is used.
The k-th piece of a length then finds its place by its number among the pieces
of that length: numbers are counted inside each task and shifted by the counts
of earlier tasks, so no length, however common, meets in one task.

``pack_in_order`` packs documents that stand in training order: the order is cut
into ranges of RANGE_ROWS documents, each range has a plan of its own, and sequences
are numbered range by range, so that training on them in order follows it.

Defined cases: a null or empty text is the end id alone; a null doc_id and rows
that repeat a doc_id are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import encoder, tokenizer_path

CAPACITY = 1024
#: Documents of a file of the training order that are packed together, at most.
RANGE_ROWS = 16_384


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each. Every step ends a
    length or moves all sequences of a pattern, so there are at most about two
    patterns for each length, whatever the counts."""
    left = {k: n for k, n in counts.items() if n > 0}
    gaps: dict[int, list[list]] = defaultdict(list)  # gap: [pattern, count]
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        big = large[-1]
        fits = bisect.bisect_right(large, capacity - big)
        mate = large[fits - 1] if fits else None
        if mate == big and left[big] < 2:
            mate = large[fits - 2] if fits > 1 else None
        if mate is None:
            n = left[big] if mate is None and not (fits and large[fits - 1] == big) else 1
            pattern = (big,)
        elif mate == big:
            n, pattern = left[big] // 2, (big, big)
        else:
            n, pattern = min(left[big], left[mate]), (big, mate)
        gaps[capacity - sum(pattern)].append([pattern, n])
        for k in pattern:
            left[k] -= n
        large = [k for k in large if left[k] > 0]
    open_gaps = sorted(g for g in gaps if g)
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            i = bisect.bisect_left(open_gaps, size)
            if i == len(open_gaps):
                each = capacity // size
                n = left[size] // each
                if n:
                    _put(gaps, open_gaps, capacity - each * size, (size,) * each, n)
                    left[size] -= n * each
                if rest := left[size]:
                    _put(gaps, open_gaps, capacity - rest * size, (size,) * rest, 1)
                    left[size] = 0
                continue
            gap = open_gaps[i]
            group = gaps[gap][-1]
            n = min(left[size], group[1])
            left[size] -= n
            group[1] -= n
            pattern = group[0] + (size,)
            if not group[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(i)
            _put(gaps, open_gaps, gap - size, pattern, n)
    return [(pattern, n) for groups in gaps.values() for pattern, n in groups if n]


def _put(gaps, open_gaps, gap, pattern, n) -> None:
    if gap and not gaps[gap]:
        bisect.insort(open_gaps, gap)
    for group in gaps[gap]:
        if group[0] == pattern:
            group[1] += n
            return
    gaps[gap].append([pattern, n])


def plan_slots(patterns) -> dict[str, np.ndarray]:
    """For each length, which numbers go where: arrays sorted by (length, first number)."""
    taken, rows, base = Counter(), [], 0
    for pattern, n in patterns:
        offset = 0
        for k in pattern:
            rows.append((k, taken[k], base, offset))
            taken[k] += n
            offset += k
        base += n
    a = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def piece_starts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n tokens: the remainder first, then whole sequences."""
    return list(range(-(-n % capacity), n, capacity)) if n > capacity else [0]


def _cut(path: str, capacity: int, with_ids: bool, kept: tuple[str, ...] = ()):
    def run(batches):
        from pyspark import TaskContext

        e, task, ranks = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows, ids, owners = [], [], []
            for k, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                data = e.ids(text)
                n = len(data) // 4
                starts = piece_starts(n, capacity)
                for i, (x, y) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    x = max(x, 0)
                    part = data[4 * x : 4 * y]
                    rows.append((doc_id, i, x, y - x, zlib.crc32(part), task, ranks[y - x]))
                    ranks[y - x] += 1
                    owners.append(k)
                    if with_ids:
                        ids.append(part)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
            for c in kept:
                arrays, names = [*arrays, b.column(c).take(pa.array(owners, pa.int64()))], [*names, c]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _place(slots):
    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            number = b.column("number").to_numpy(zero_copy_only=False)
            i = np.searchsorted(slots["key"], (length << 44) + number, "right") - 1
            sequence = slots["sequence"][i] + number - slots["first"][i]
            keep = [n for n in b.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(sequence, pa.int64()), pa.array(slots["offset"][i], pa.int64())],
                names=[*keep, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the ids (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * with_ids
    source = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = written(source.mapInArrow(_cut(tokenizer or tokenizer_path(), capacity, with_ids), schema), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows come to the driver
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(pack_histogram(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    numbered = pieces.join(shifts, ["length", "task"]).withColumn("number", F.col("number") + F.col("shift"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long," + " ids binary," * with_ids + " sequence_id long, offset long"
    return numbered.select(*cols, "number").mapInArrow(_place(slots), out)


def _pack_range(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("piece", "ascending")])
        length = t.column("length").to_numpy()
        sizes, counts = np.unique(length, return_counts=True)
        slots = plan_slots(pack_histogram(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity))
        order = np.argsort(length, kind="stable")
        number = np.empty(len(length), np.int64)  # among the range's pieces of that length
        number[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
        i = np.searchsorted(slots["key"], (length << 44) + number, "right") - 1
        sequence = (t.column("range")[0].as_py() << 27) + slots["sequence"][i] + number - slots["first"][i]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
        return pa.table([*(t.column(n) for n in names), pa.array(sequence), pa.array(slots["offset"][i])], names=[*names, "sequence_id", "offset"])

    return run


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """As ``pack``, for documents whose files hold them in training order, part after
    part: also ``place``, a row's number in that order (copies of a document differ in
    it). Sequences of earlier ranges have smaller ids. Documents that come from no
    files have no order; they are packed as one range for each of their tasks."""
    small_batches(docs.sparkSession)
    if docs.inputFiles():
        said = docs.metadataColumn("_metadata")
        file, row = F.coalesce(F.regexp_extract(said["file_name"], r"part-(\d+)", 1).try_cast("long"), F.lit(0)), said["row_index"]
    else:
        file, row = F.spark_partition_id().cast("long"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # files, blocks of RANGE_ROWS and sequences of a range share 63 bits
    block = F.shiftleft(file, 16) + F.floor(row / RANGE_ROWS)
    source = docs.select(F.col("doc_id").cast("long"), "text", block.alias("range"), (F.shiftleft(file, 43) + row).alias("place"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long, range long, place long"
    pieces = source.mapInArrow(_cut(tokenizer or tokenizer_path(), capacity, False, ("range", "place")), schema).drop("task", "number")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, place long, sequence_id long, offset long"
    return pieces.groupBy("range").applyInArrow(_pack_range(capacity), out)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", ids.alias("ids"))
