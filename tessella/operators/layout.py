"""Packing a directory's images into one rectangle: rows and columns by window
functions, weighted bisection by a grouped map, and the choice between them.

Images are rows (dir, pos, w, h, bytes). Cells are rows (dir, pos, x, y, w, h).
One directory is one window partition or one group: its size bounds the work of a
task, directories are independent.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a row or column before scaling, and how many sizes are tried.
SPAN, TRIES = 1024, 6


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def ratio(x: Column, y: Column) -> Column:
    return F.greatest(x / y, y / x)


def line_candidates(images: DataFrame) -> DataFrame:
    """Cells of all twelve candidates: dir, pos, cand, x, y, cw, ch. Even candidates are
    rows, odd ones columns; lines of candidate 2i and 2i+1 have k + i + 1 images."""
    size = F.count(F.lit(1)).over(Window.partitionBy("dir"))
    least = F.greatest(F.lit(1), F.floor(F.sqrt(size.cast("double"))).cast("int") - 3)
    each = images.withColumn("_k", least).withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(2 * TRIES - 1))))
    each = each.withColumn("line", F.floor(F.col("pos") / (F.col("_k") + F.floor(F.col("cand") / 2) + 1)))
    rows = F.col("cand") % 2 == 0
    # along a line, images have one height (rows) or one width (columns)
    along = F.when(rows, F.col("w") / F.col("h")).otherwise(F.col("h") / F.col("w"))
    by_line = Window.partitionBy("dir", "cand", "line").orderBy("pos")
    whole = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    count = F.count(F.lit(1)).over(whole)
    span = F.when(rows, F.lit(float(SPAN))).otherwise(F.lit(float(SPAN)) - (count - 1))
    each = each.withColumn("_along", along).withColumn("thick", span / F.sum("_along").over(whole))
    long_side = F.when(rows, F.col("w") * F.col("thick") / F.col("h")).otherwise(F.col("h") * F.col("thick") / F.col("w"))
    each = each.withColumn("long", long_side)
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    by_dir = Window.partitionBy("dir", "cand").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(by_line) == 1
    each = each.withColumn("_first", F.when(first, F.col("thick")).otherwise(0.0)).withColumn("_at", F.coalesce(F.sum("long").over(before), F.lit(0.0)))
    across = F.sum("_first").over(by_dir) - F.col("thick")
    each = each.withColumn("_across", across)
    pick = lambda a, b: F.when(rows, F.col(a)).otherwise(F.col(b))
    return each.select(
        "dir", "pos", "cand", pick("_at", "_across").alias("x"), pick("_across", "_at").alias("y"), pick("long", "thick").alias("cw"), pick("thick", "long").alias("ch")
    )


def _line_fitness(over=lambda c: c) -> Column:
    """How near 1.2 the shape is, and how even the areas are; ``over`` says over which rows."""
    shape = over(F.max(F.col("x") + F.col("cw"))) / over(F.max(F.col("y") + F.col("ch")))
    area = over(F.max(F.col("cw") * F.col("ch"))) / over(F.min(F.col("cw") * F.col("ch")))
    away = F.greatest(1.2 / shape, shape / 1.2)
    return -2 * away * away - area * area


def line_fitness(cells: DataFrame) -> DataFrame:
    """dir, cand, fitness of each candidate."""
    return cells.groupBy("dir", "cand").agg(_line_fitness().alias("fitness"))


def lines_layout(images: DataFrame) -> DataFrame:
    """Unscaled cells (dir, pos, x, y, w, h) of the fittest candidate; the earlier wins ties.

    Candidates are rated and chosen by windows, so that they are worked out once."""
    one = Window.partitionBy("dir", "cand")
    rated = line_candidates(images).withColumn("_fitness", _line_fitness(lambda c: c.over(one)))
    best = F.max_by("cand", F.struct("_fitness", -F.col("cand"))).over(Window.partitionBy("dir"))
    chosen = rated.withColumn("_best", best).filter("cand = _best")
    return chosen.select("dir", "pos", "x", "y", F.col("cw").alias("w"), F.col("ch").alias("h"))


def squished(cells: DataFrame, width: int = 1280, height: int = 800) -> DataFrame:
    """Cells scaled down into the box, with space between them, and rounded to whole pixels."""
    d = Window.partitionBy("dir")
    x, y, w, h = (F.col(c) for c in "xywh")
    each = cells.withColumn("_x0", F.min("x").over(d)).withColumn("_y0", F.min("y").over(d))
    each = each.withColumn("_iw", F.max(x + w).over(d) - F.col("_x0")).withColumn("_ih", F.max(y + h).over(d) - F.col("_y0"))
    each = each.withColumn("_s", F.least(F.lit(1.0), F.lit(float(width)) / F.col("_iw"), F.lit(float(height)) / F.col("_ih")))
    least = F.min(F.least(w, h) * F.col("_s")).over(d)
    space = F.when(least >= 13, 4).when(least >= 9, 3).when(least >= 6, 2).when(least >= 4, 1).otherwise(0)
    each = each.withColumn("_g", space)
    each = each.withColumn("_sx", (F.col("_iw") * F.col("_s") + F.col("_g")) / F.col("_iw")).withColumn(
        "_sy", (F.col("_ih") * F.col("_s") + F.col("_g")) / F.col("_ih")
    )
    left, top = (x - F.col("_x0")) * F.col("_sx"), (y - F.col("_y0")) * F.col("_sy")
    wide, high = w * F.col("_sx") - F.col("_g"), h * F.col("_sy") - F.col("_g")
    sides = [half_up(left), half_up(top), F.greatest(F.lit(1), half_up(left + wide) - half_up(left)), F.greatest(F.lit(1), half_up(top + high) - half_up(top))]
    keep = [c for c in cells.columns if c not in ("x", "y", "w", "h")]
    return each.select(*keep, *(s.cast("int").alias(c) for s, c in zip(sides, "xywh", strict=True)))


def in_box(cells: DataFrame, width: int = 1280, height: int = 800) -> DataFrame:
    """The cells that break a promise: outside the box, or without extent. Empty if all is well."""
    return cells.filter((F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") < 1) | (F.col("h") < 1) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height))


# --- weighted bisection: one directory at a time, in single precision ---

_F = np.float32
#: (weight function, share of the middle by count, share of the middle by weight) of
#: each way to split (fixed values; ways that split alike stand once, as the first wins ties).
SPLITTERS = (
    ("root", 0, 1), ("root", 1, 2), ("root", 2, 2), ("root", 2, 1), ("root", 1, 0),
    ("plain", 0, 1), ("plain", 2, 2), ("plain", 2, 1),
    ("square", 0, 1), ("square", 2, 2), ("square", 2, 1),
)


def _weights(nbytes: np.ndarray, kind: str) -> np.ndarray:
    w = nbytes.astype(_F)
    return np.sqrt(w.astype(np.float64)).astype(_F) if kind == "root" else w if kind == "plain" else w * w


def _ratio(x: float, y: float) -> float:
    if not y or not x:
        return float("inf")
    return _F(x) / _F(y) if x > y else _F(y) / _F(x)


def _middle(weights: np.ndarray) -> int:
    """The image that half of a run's weight lies before."""
    after = np.cumsum(weights, dtype=_F)
    half, before = after[-1] / _F(2), np.concatenate([[_F(0)], after[:-1]])
    beyond = half - before < after - half
    return int(beyond.argmax()) if beyond.any() else len(weights) - 1


def _cut(n: int, middle: int, a: int, b: int) -> int:
    at = math.floor(_F(a * _F(n / 2) + b * middle) / _F(a + b) + _F(0.5))
    return min(max(at, 1), n - 1)


def split_point(weights: np.ndarray, a: int, b: int) -> int:
    """Where a run of images is cut: between the middle by count (a) and by weight (b), never at an end."""
    return _cut(len(weights), _middle(weights), a, b)


def split_tree(weights: np.ndarray, low: int, high: int, a: int, b: int, nodes: dict, middles: dict):
    """A tree of places: a leaf is a number, a node a tuple of two trees. Equal trees are
    one object, kept in ``nodes``; ``middles`` holds the middles of runs under these weights."""
    if high - low == 1:
        return low
    at = low + 1
    if high - low > 2:
        if (low, high) not in middles:
            middles[low, high] = _middle(weights[low:high])
        at = low + _cut(high - low, middles[low, high], a, b)
    parts = (split_tree(weights, low, at, a, b, nodes, middles), split_tree(weights, at, high, a, b, nodes, middles))
    return nodes.setdefault((low, at, high, *map(id, (p for p in parts if isinstance(p, tuple)))), parts)


def tree_fitness(tree, nbytes, known: dict) -> tuple[float, float, int]:
    """(fitness, weight, depth): even splits and shallow trees are fitter. ``known`` holds what was found for a tree, by its id."""
    if not isinstance(tree, tuple):
        return _F(0), _F(nbytes[tree]), 0
    if id(tree) not in known:
        parts = [tree_fitness(t, nbytes, known) for t in tree]
        weight, n = _F(sum((p[1] for p in parts), _F(0))), _F(len(parts))
        fit = _F(0)
        for f, w, _ in parts:
            fit = fit - _F(_ratio(weight / n, w)) / n
            fit = fit + f / n
        depth = 1 + max(p[2] for p in parts)
        known[id(tree)] = fit / _F(2) - _F(depth), weight, depth
    return known[id(tree)]


def _arranged(tree, w, h):
    """(width, height, parts): a node's parts side by side or one above the other, whichever is nearer a square."""
    if not isinstance(tree, tuple):
        return int(w[tree]), int(h[tree]), tree
    subs = [_arranged(t, w, h) for t in tree]
    stacked, row, at = [], [], 0
    width = max(s[1] for s in subs)  # a stack is as wide as the tallest part is tall
    for s in subs:
        tall = int(_F(s[1]) * (_F(width) / _F(s[0])))
        stacked.append((0, at, width, tall, s))
        at += tall
    stack = (width, at, stacked)
    height, at = max(s[0] for s in subs), 0
    for s in subs:
        wide = int(_F(s[0]) * (_F(height) / _F(s[1])))
        row.append((at, 0, wide, height, s))
        at += wide
    line = (at, height, row)
    return stack if _ratio(stack[0], stack[1]) < _ratio(line[0], line[1]) else line


def _cells(node, x, y, w, h, out) -> None:
    if not isinstance(node[2], list):
        out[node[2]] = (x, y, w, h)
        return
    sx, sy = _F(w) / _F(max(node[0], 1)), _F(h) / _F(max(node[1], 1))
    for px, py, pw, ph, part in node[2]:
        _cells(part, x + sx * _F(px), y + sy * _F(py), sx * _F(pw), sy * _F(ph), out)


def bisect(w: np.ndarray, h: np.ndarray, nbytes: np.ndarray) -> list[tuple]:
    """Cells of one directory's images, in order. Weights that no split can balance
    (all zero, or one that dwarfs the rest) are cut next to an end."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(w) + 1000))  # a tree can be as deep as it has leaves
    best, best_fit = None, None
    weights, middles = {k: _weights(nbytes, k) for k in ("root", "plain", "square")}, {"root": {}, "plain": {}, "square": {}}
    nodes, known, seen = {}, {}, set()
    for kind, a, b in SPLITTERS:
        tree = split_tree(weights[kind], 0, len(w), a, b, nodes, middles[kind])
        if id(tree) in seen:
            continue
        seen.add(id(tree))
        fit = tree_fitness(tree, nbytes, known)[0]
        if best is None or fit > best_fit:
            best, best_fit = tree, fit
    node = _arranged(best, w, h)
    out: list = [None] * len(w)
    _cells(node, _F(0), _F(0), _F(node[0]), _F(node[1]), out)
    return out


def _bisected(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    cells = bisect(*(rows.column(c).to_numpy() for c in ("w", "h", "bytes")))
    sides = [pa.array(np.array(side, np.float64)) for side in zip(*cells, strict=True)]
    return pa.table([rows.column("dir"), rows.column("pos"), *sides], names=["dir", "pos", "x", "y", "w", "h"])


def bisection_layout(images: DataFrame) -> DataFrame:
    """Unscaled cells (dir, pos, x, y, w, h) by weighted bisection, a grouped map over directories."""
    kind = dict(images.dtypes)["dir"]
    rows = images.select("dir", F.col("pos").cast("int"), F.col("w").cast("int"), F.col("h").cast("int"), F.col("bytes").cast("long"))
    # A directory takes far longer than its bytes suggest, so tasks aren't merged by size.
    # Twice the session's number: a shuffle to that number itself would be taken for
    # one that the images may have behind them, and dropped.
    rows = rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dir")
    return rows.groupBy("dir").applyInArrow(_bisected, f"dir {kind}, pos int, x double, y double, w double, h double")


def overall_fitness(by: list[str]) -> Column:
    """Fitness of the whole-pixel cells that agree on ``by``, in each of them: large
    differences of area, tiny cells and long shapes count against it."""
    one, area = Window.partitionBy(*by), F.col("w") * F.col("h")
    big, small, least = F.max(area).over(one), F.min(area).over(one), F.min(F.least("w", "h")).over(one)
    width = F.max(F.col("x") + F.col("w")).over(one) - F.min("x").over(one)
    height = F.max(F.col("y") + F.col("h")).over(one) - F.min("y").over(one)
    long = ratio(width, height)
    fit = -F.when(big / small > 12, 1.0).otherwise(0.0) - F.when(least < 16, 2.0).otherwise(0.0) - long
    return fit - F.when(long > 2, 1.0).otherwise(0.0)


@lru_cache(1)
def layouters() -> dict:
    """Named layouts: images to unscaled cells. Others can be added."""
    return {"rowly": lines_layout, "borce": bisection_layout}


def parse_layouter(spec: str) -> tuple[list[str], int, int]:
    """'name' or 'name:WxH'; multifit stands for all layouts."""
    name, _, size = spec.partition(":")
    width, height = (int(v) for v in size.split("x")) if size else (1280, 800)
    if name == "multifit":
        return list(layouters()), width, height
    if name not in layouters():
        raise ValueError(f"no such layout: {name}")
    return [name], width, height


def layout(images: DataFrame, spec: str = "multifit:1280x800") -> DataFrame:
    """dir, layouter, pos, x, y, w, h in whole pixels, by the fittest of the layouts asked for; the first wins ties."""
    names, width, height = parse_layouter(spec)
    tried = None
    for rank, name in enumerate(names):
        cells = squished(layouters()[name](images), width, height).withColumn("layouter", F.lit(name)).withColumn("_rank", F.lit(rank))
        tried = cells if tried is None else tried.unionByName(cells)
    if len(names) > 1:
        # rated and chosen by windows, so that each layout is worked out once
        tried = tried.withColumn("_fitness", overall_fitness(["dir", "_rank"]))
        best = F.max_by("_rank", F.struct("_fitness", -F.col("_rank"))).over(Window.partitionBy("dir"))
        tried = tried.withColumn("_best", best).filter("_rank = _best")
    return tried.select("dir", "layouter", "pos", "x", "y", "w", "h")
