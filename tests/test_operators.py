import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import compound, layout, render, store


def images(spark, dirs):
    rows = [(d, i, w, h, b) for d, sizes in dirs.items() for i, (w, h, b) in enumerate(sizes)]
    return spark.createDataFrame(rows, "dir string, pos int, w int, h int, bytes long")


def random_dirs(seed, n=25, most=60):
    rng = random.Random(seed)
    one = lambda: (rng.randint(20, 900), rng.randint(20, 900), rng.randint(1, 10**6))
    return {f"d{k}": [one() for _ in range(rng.randint(2, most))] for k in range(n)}


def in_rows(sizes, per):
    """Cells of one candidate in rows, one after the other."""
    out, y = [], 0.0
    for i in range(0, len(sizes), per):
        line = sizes[i : i + per]
        height, x = 1024 / sum(w / h for w, h, _ in line), 0.0
        for w, h, _ in line:
            out.append((x, y, w * height / h, height))
            x += w * height / h
        y += height
    return out


def test_row_candidates(spark):
    dirs = random_dirs(1, 6)
    got = {}
    for r in layout.line_candidates(images(spark, dirs)).filter("cand % 2 = 0").collect():
        got.setdefault((r["dir"], r["cand"] // 2), {})[r["pos"]] = (r["x"], r["y"], r["cw"], r["ch"])
    for (d, i), cells in got.items():
        k = max(1, int(len(dirs[d]) ** 0.5) - 3) + i
        want = in_rows(dirs[d], k + 1)
        assert np.allclose([cells[p] for p in range(len(want))], want)


@pytest.mark.parametrize("spec", ["rowly", "borce", "multifit:640x480"])
def test_layouts_keep_their_promises(spark, spec):
    dirs = random_dirs(2)
    cells = layout.layout(images(spark, dirs), spec).cache()
    _, width, height = layout.parse_layouter(spec)
    assert layout.in_box(cells, width, height).count() == 0
    counts = {r["dir"]: r["count"] for r in cells.groupBy("dir").count().collect()}
    assert counts == {d: len(v) for d, v in dirs.items()}
    assert cells.select("dir", "pos").distinct().count() == sum(map(len, dirs.values()))


def test_bisection_edge_cases():
    ones = np.array([100, 100, 100])
    for weights in ([0, 0, 5], [1, 1, 10**12], [0, 0, 0], [5, 0, 0]):
        cells = layout.bisect(ones, ones, np.array(weights))
        assert len(cells) == 3 and all(np.isfinite(c).all() for c in map(np.array, cells))
    assert layout.bisect(ones[:1], ones[:1], ones[:1]) == [(0, 0, 100, 100)]


def test_split_point():
    even = np.ones(8, np.float32)
    assert layout.split_point(even, 0, 1) == 4 and layout.split_point(even, 1, 0) == 4
    assert layout.split_point(np.array([100, 1, 1, 1], np.float32), 0, 1) == 1


def test_parse_layouter():
    assert layout.parse_layouter("rowly:10x20") == (["rowly"], 10, 20)
    assert layout.parse_layouter("multifit") == (["rowly", "borce"], 1280, 800)
    with pytest.raises(ValueError):
        layout.parse_layouter("other")


def test_compound_round_trip(spark):
    parts = [(0, 0, 5, 6, "urn:a", "it's \"x\"\n\\"), (5, 0, 5, 6, "urn:b", None)]
    schema = "width int, height int, components array<struct<x int, y int, w int, h int, uri string, name string>>, title string, image_count long, byte_count long, source_uri string, generator string"
    c = spark.createDataFrame([(10, 6, parts, "t'", 2, 9, "x-dir:1", "rowly"), (1, 1, [], None, None, None, None, None)], schema)
    rows = c.select(compound.serialised(c).alias("text"), compound.graphic_text(c).alias("graphic")).collect()
    assert rows[1]["text"] == "COMPOUND-IMAGE 1,1\n"
    assert rows[0]["graphic"].count("\n") == 3 and "TITLE" not in rows[0]["graphic"]
    back = compound.parsed(spark.createDataFrame([(r["text"],) for r in rows], "text string")).collect()
    assert [tuple(p) for p in back[0]["components"]] == parts
    assert (back[0]["title"], back[0]["image_count"], back[0]["byte_count"], back[0]["source_uri"], back[0]["generator"]) == ("t'", 2, 9, "x-dir:1", "rowly")
    assert back[1]["components"] == [] and back[1]["title"] is None and back[1]["image_count"] is None


def test_parse_odd_lines(spark):
    text = "GENERATOR-INFO old-v1\nWHAT is this\nTOTAL-IMAGE-COUNT 1\r\nTOTAL-IMAGE-COUNT 2\nCOMPOUND-IMAGE 3,4\nCOMPONENT -1,0,1,1 u\n"
    row = compound.parsed(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["generator"], row["image_count"], row["width"], row["height"], row["components"]) == ("old-v1", 2, 3, 4, [])
    assert row["unknown_lines"] == ["WHAT is this", "COMPONENT -1,0,1,1 u"]


def test_equivalent(spark):
    schema = "width int, height int, components array<struct<x int, y int, w int, h int, uri string, name string>>"
    c = spark.createDataFrame([(5, 6, [(0, 0, 5, 6, "u", None)]), (5, 6, [(0, 0, 5, 5, "u", None)]), (5, 6, [])], schema)
    assert [r[0] for r in c.select(compound.equivalent_uri()).collect()] == ["u", None, None]


def test_compose_tree(spark):
    entries = spark.createDataFrame(
        [
            ("root", 0, "sub", "sub", "Directory"), ("root", 1, "c.png", "u:c", "Blob"), ("root", 2, "notes.txt", "u:t", "Blob"),
            ("root", 3, "empty", "empty", "Directory"), ("root", 4, "lone", "lone", "Directory"),
            ("sub", 0, "a.jpg", "u:a", "Blob"), ("sub", 1, "b.gif", "u:b", "Blob"), ("lone", 0, "d.bmp", "u:d", "Blob"),
        ],
        "dir_uri string, pos int, name string, target_uri string, target_class string",
    )
    info = spark.createDataFrame([(f"u:{c}", 100 + i, 90, 10 * (i + 1)) for i, c in enumerate("abcd")], "uri string, width int, height int, size long")
    done, texts = compound.compose(entries, info)
    rows = {r["dir_uri"]: r for r in done.collect()}
    assert set(rows) == {"root", "sub", "lone"}
    assert (rows["root"]["image_count"], rows["root"]["byte_count"]) == (4, 100)
    assert rows["lone"]["uri"] == "u:d" and rows["lone"]["name"] == "d.bmp"
    found = {r["uri"]: r["text"] for r in texts.collect()}
    assert "name='lone/d.bmp'" in found[rows["root"]["uri"]] and "notes" not in found[rows["root"]["uri"]]


def test_cycle_is_refused(spark):
    entries = spark.createDataFrame([("a", 0, "b", "b", "Directory"), ("b", 0, "a", "a", "Directory")], "dir_uri string, pos int, name string, target_uri string, target_class string")
    info = spark.createDataFrame([], "uri string, width int, height int, size long")
    with pytest.raises(ValueError):
        compound.compose(entries, info)


def test_unknown_image_is_refused(spark):
    entries = spark.createDataFrame([("a", 0, "x.png", "u:x", "Blob"), ("a", 1, "y.png", "u:y", "Blob")], "dir_uri string, pos int, name string, target_uri string, target_class string")
    info = spark.createDataFrame([("u:x", 5, 5, 1)], "uri string, width int, height int, size long")
    with pytest.raises(ValueError):
        compound.compose(entries, info)
    done, texts = compound.compose(entries, info, strict=False)
    assert [r["uri"] for r in done.collect()] == ["u:x"] and texts.count() == 0


def test_store_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    assert store.store(first, path).count() == 2
    assert store.store(spark.createDataFrame([("b",), ("c",)], "content string"), path).count() == 3


def test_latest_and_read_through(spark):
    log = spark.createDataFrame([("k", "two dozen", 1), ("k", "cats", 2), ("j", None, 1)], "key string, value string, seq int")
    assert {r["key"]: r["value"] for r in store.latest(log, ["key"], ["seq"]).collect()} == {"k": "cats", "j": None}
    new = spark.createDataFrame([("a", 1)], "key string, value int")
    old = spark.createDataFrame([("a", 2), ("b", 3)], "key string, value int")
    both, copied = store.read_through(new, old, "key", "value")
    assert {r["key"]: r["value"] for r in both.collect()} == {"a": 1, "b": 3}
    assert [r["key"] for r in copied.collect()] == ["b"]


def test_memo_keeps_nulls(spark):
    memo = spark.createDataFrame([("a", None)], "key string, value int")
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    found, fresh = store.memoised(rows, memo, "key", "value", lambda m: m.withColumn("value", F.lit(7)))
    assert sorted((r["key"], r["value"] or 0) for r in found.collect()) == [("a", 0), ("b", 7), ("b", 7)]
    assert [tuple(r) for r in fresh.collect()] == [("b", 7)]


def test_batches(spark):
    rows = spark.createDataFrame([([5, 5, 5, 1, 20, 1],), ([],)], "c array<long>")
    assert [r[0] for r in rows.select(store.greedy_batches(F.col("c"), 10)).collect()] == [[0, 0, 1, 1, 1, 2], []]
    assert [r[0] for r in rows.select(store.greedy_batches(F.col("c"), 100, 0, 2)).collect()][0] == [0, 0, 1, 1, 2, 2]


def test_draw_and_crop(spark):
    schema = "dir int, width int, height int, components array<struct<x int, y int, w int, h int, uri string, name string>>"
    c = spark.createDataFrame([(1, 100, 50, [(i, 0, 1, 2, "u" * 200, "n<") for i in range(60)])], schema)
    plan = render.draw_plan(c).collect()
    assert [r["ordinal"] for r in plan] == list(range(60)) and plan[-1]["batch"] == 2
    page = c.select(render.page(F.lit("urn:r"), F.lit("x"), True)).first()[0]
    assert page.count("<a ") == 60 and "n&lt;" in page
    one = spark.createDataFrame([(400, 100, 50, 50)], "a int, b int, w int, h int")
    sides = [F.col(x) for x in ("a", "b", "w", "h")]
    row = one.select(render.needs_resize(*sides).alias("n"), render.crop(*sides).alias("c"), *render.fit_box(F.col("a"), F.col("b"), 100, 100)).first()
    assert row["n"] and tuple(row["c"]) == (150, 0, 100, 100) and tuple(row)[2:] == (100, 25)
    assert render.resource_log(c).count() == 1
