"""Mixing sources to target weights under a time-varying curriculum.

Each source has a weight schedule over training time 0..1, a piecewise-linear
curve. Its integral is the source's weight, which decides its target of words;
the curve's shape decides when those words come. A source's documents stand in
a fixed pseudo-random order; the words they take, one pass after the other, are
its cumulative demand. Inverting the integrated curve at a copy's middle word
gives the copy's training position, and documents are range-sorted by position.

Targets: the sources share ``share`` times all words by weight; a target stops
at ``most`` times its source's size, and the excess is shared again by weight
until none is above. Whole passes are whole documents; in the last, partial
pass, documents are taken from the front of the order, and the one document
that straddles the end gives only its first words up to the target.

Defined cases: null texts and texts of white space have size 0 and take 0
words; null is a source of its own, last in order; a null doc_id has a place in
the order like any other; rows that repeat a doc_id are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key, words, written

#: (weight, shape) by the source's place in code point order, repeating. A shape
#: lists knots (time, height); heights are scaled so that the integral is the weight.
CYCLE = (
    (3.0, ((0.0, 1.5), (1.0, 0.5))),  # early on, then less and less
    (1.0, ((0.0, 1.0), (1.0, 1.0))),  # evenly
    (2.0, ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))),  # mostly late
)
SHARE, MOST = 1.5, 2.0
#: Rows that one slice of a source's order should have, and the fewest slices.
SLICE_ROWS, MIN_SLICES = 65_536, 64


def integral(shape) -> list[float]:
    """Integrated height at each knot."""
    out = [0.0]
    for (t0, a), (t1, b) in zip(shape, shape[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (a + b) / 2)
    return out


def targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, place, target: one row a source (a small table).

    The final water level is the one at which the sources below their cap, by
    growing cap over weight, use up what the capped ones leave.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source: what stands in the single partition is the list of sources.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    weight = F.element_at(F.array(*(F.lit(w) for w, _ in cycle)), F.col("place") + 1)
    one = by_source.withColumn("place", place.cast("int")).withColumn("weight", weight)
    up = Window.orderBy((F.col("source_size") / F.col("weight")), "place", F.col("source").isNull(), "source")
    done = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(done), F.lit(0))) / F.sum(
        "weight"
    ).over(rest)
    capped = F.lit(most) * F.col("source_size") <= F.col("level") * F.col("weight")
    found = one.withColumn("level", level).withColumn("capped", capped)
    # From the first source that isn't capped on, the level only falls.
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return (
        found.withColumn("water", water)
        .withColumn("target", F.when(F.col("capped"), F.lit(most) * F.col("source_size")).otherwise(F.col("water") * F.col("weight")))
        .select("source", "source_size", "place", "target")
    )


def _position(fraction, place, cycle):
    """The time at which a source's integrated schedule reaches a fraction of its whole."""
    out = F.lit(None).cast("double")
    for k, (_, shape) in enumerate(cycle):
        area = integral(shape)
        want = fraction * F.lit(area[-1])
        at = F.lit(1.0)
        for i in reversed(range(len(shape) - 1)):
            (t0, a), (t1, b) = shape[i], shape[i + 1]
            slope = (b - a) / (t1 - t0)
            over = want - F.lit(area[i])
            x = over / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * over)) - a) / slope
            at = F.when(want <= F.lit(area[i + 1]), F.lit(t0) + x).otherwise(at)
        out = F.when(place == k, at).otherwise(out)
    return out


def curriculum(docs: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each document, range-sorted by its first training position:
    doc_id, source, size, source_size, target, taken, copies (whole or begun),
    position and second_position (null where there is no such copy), text_key.

    The last pass takes a document's first words where it straddles the target.
    ``most`` over 2 gives more passes; the first two positions are returned.
    """
    sizes = written(docs.select("doc_id", "source", text_key(F.col("text")).alias("text_key"), words(F.col("text")).cast("long").alias("size")), "sizes")
    # The order inside a source: by hash, then doc_id. The hash's range is cut into
    # slices, so that no window holds a whole source however hot it is.
    slices = max(MIN_SLICES, sizes.count() // SLICE_ROWS)
    # rows without a doc_id are spread by their texts
    said = F.coalesce(F.col("doc_id").cast("string"), F.col("text_key").cast("string"))
    rank = F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")
    dealt = sizes.withColumn("rank", rank).withColumn("slice", F.floor(F.col("rank") * slices / (1 << 32)))
    sums = dealt.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    goals = targets(sizes, cycle, share, most)
    plan = sums.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    plan = plan.select("s.source", "s.slice", "s.before", "g.source_size", "g.place", "g.target")
    inside = Window.partitionBy("source", "slice").orderBy("rank", F.col("doc_id").isNull(), "doc_id", "size", "text_key")
    here = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = dealt.withColumn("here", here).alias("d")
    met = rows.join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slice") == F.col("p.slice")))
    met = met.select("d.doc_id", "d.source", "d.text_key", "d.size", "p.source_size", "p.place", "p.target", (F.col("p.before") + F.col("d.here")).alias("start"))
    goal = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    met = met.withColumn("passes", passes).withColumn("rest", rest).withColumn("part", part)
    copies = F.col("passes") + (F.col("part") > 0).cast("int")

    def at(k: int):
        whole = F.col("passes") > k
        middle = k * F.col("source_size") + F.col("start") + F.when(whole, F.col("size")).otherwise(F.col("part")) / 2
        there = (F.col("copies") > k) & (F.col("target") > 0)
        return F.when(there, F.round(_position(F.least(F.lit(1.0), middle / F.col("target")), F.col("place"), cycle), 9))

    out = met.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int")).withColumn(
        "taken", (F.col("passes") * F.col("size") + F.col("part")).cast("long")
    )
    out = out.withColumn("position", at(0)).withColumn("second_position", at(1))
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "second_position", "text_key")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def first_words(text, n):
    """The text up to the end of its n-th word."""
    space = "[\\x20\\x09-\\x0D]"
    return F.array_join(F.slice(F.split(text, f"(?<!{space})(?={space})"), 1, n), "")


#: What identifies a row of documents for the mix: rows alike in all three stand for each other.
_SAME = ("__mix_id", "__mix_key", "__mix_source")


def mixed(docs: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents as the mix takes them, all columns, range-sorted by training
    position: a row for each copy; the last copy of the document that straddles its
    source's target has its first words only (and n_chars, where there is such a
    column, their length). Of rows that repeat doc_id, text and source, each stands
    for its own; null texts and texts without words are taken no words of, and go.
    """
    names = docs.columns
    plan = curriculum(docs, cycle, share, most).filter("copies > 0")
    plan = plan.select(
        *(F.col(c).alias(k) for c, k in zip(("doc_id", "text_key", "source"), _SAME, strict=True)),
        *(F.col(c).alias(f"__mix_{c}") for c in ("size", "taken", "copies", "position", "second_position")),
    )
    plan = written(plan, "curriculum")
    own = [F.col("doc_id"), text_key(F.col("text")), F.col("source")]
    met = F.lit(True)
    for c, k in zip(own, _SAME, strict=True):
        met = met & c.eqNullSafe(F.col(k))
    if plan.groupBy(*_SAME).count().filter("count > 1").head(1):
        # rows that are alike take the plan's rows in turn
        turn = lambda cols, order: F.row_number().over(Window.partitionBy(*cols).orderBy(*order))
        plan = plan.withColumn("__mix_turn", turn(_SAME, ("__mix_position", "__mix_second_position")))
        docs = docs.withColumn("__mix_own", turn(own, (F.lit(0),)))
        met = met & (F.col("__mix_own") == F.col("__mix_turn"))
    each = docs.join(plan, met).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    size, copy = F.col("__mix_size"), F.col("__mix_copy")
    left = F.col("__mix_taken") - (copy - 1) * size
    cut = (left < size) & (left > 0)
    at = F.when(copy == 1, F.col("__mix_position")).when(copy == 2, F.col("__mix_second_position")).otherwise(F.lit(1.0))
    text = F.when(cut, first_words(F.col("text"), left.cast("int"))).otherwise(F.col("text"))
    each = each.withColumn("__mix_at", at).withColumn("__mix_cut", cut).withColumn("text", text)
    if "n_chars" in names:
        each = each.withColumn("n_chars", F.when(F.col("__mix_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return each.orderBy("__mix_at", "doc_id", "__mix_copy").select(*names)
