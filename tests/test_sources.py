import struct

import pytest
from pyspark.sql import functions as F

from tessella.sources import blobs, directories

LISTING = """<RDF><Directory><entries>
<DirectoryEntry><name>a b.jpg</name><target><Blob rdf:about="urn:sha1:A"><length>3</length></Blob></target></DirectoryEntry>
<DirectoryEntry>
  <name>old</name><name>sub</name>
  <target><Directory rdf:about="x-rdf-subject:urn:sha1:B"/></target>
</DirectoryEntry>
<DirectoryEntry><name>odd</name><target><Other rdf:about="z"/></target></DirectoryEntry>
</entries></Directory></RDF>"""


def test_parse(spark):
    rows = directories.parse(spark.createDataFrame([("d", LISTING), ("e", "<RDF/>"), ("n", None)], "dir_uri string, rdf string")).collect()
    assert [(r["pos"], r["name"], r["target_uri"], r["target_class"]) for r in rows] == [
        (0, "a b.jpg", "urn:sha1:A", "Blob"),
        (1, "sub", "x-rdf-subject:urn:sha1:B", "Directory"),
        (2, "odd", None, "Other"),
    ]


def test_parse_strict(spark):
    rows = directories.parse(spark.createDataFrame([("d", LISTING)], "dir_uri string, rdf string"), strict=True)
    with pytest.raises(Exception, match="unknown class"):
        rows.collect()


def test_build_then_parse(spark):
    entries = spark.createDataFrame(
        [("d", 1, "y", "u2", "Directory"), ("d", 0, "x", "u1", "Blob")], "dir_uri string, pos int, name string, target_uri string, target_class string"
    )
    back = directories.parse(directories.build(entries))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 9


def test_sniff_and_dimensions(spark):
    cases = {
        "PNG": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480), 640, 480),
        "GIF": (b"GIF89a" + struct.pack("<HH", 300, 200), 300, 200),
        "BMP": (b"BM" + b"\0" * 16 + struct.pack("<ii", 70, 60), 70, 60),
        "JPEG": (jpeg(1000, 700), 1000, 700),
        "COMPOSITE": (b"COMPOUND-IMAGE 1,1\n", 0, 0),
        "HTML": (b"<html>", 0, 0),
        None: (b"<!DOCTYPE html>", None, None),
    }
    rows = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "k string, c binary")
    w, h = blobs.dimensions(F.col("c"))
    for r in rows.select("k", blobs.sniff(F.col("c")).alias("f"), w.alias("w"), h.alias("h"), blobs.is_raster(blobs.sniff(F.col("c"))).alias("r")).collect():
        assert (r["f"], r["w"], r["h"]) == (r["k"], *cases[r["k"]][1:])
        assert r["r"] == (r["k"] in ("PNG", "GIF", "BMP", "JPEG"))


def test_sectors_and_ranked_lookup(spark, tmp_path):
    for sector, names in (("one", {"a": b"same", "b": b"only"}), ("two", {"c": b"same"})):
        (tmp_path / sector / "x").mkdir(parents=True)
        for name, content in names.items():
            (tmp_path / sector / "x" / name).write_bytes(content)
    rows = blobs.read_sectors(spark, [str(tmp_path / "two"), str(tmp_path / "one")])
    assert rows.count() == 3
    found = blobs.first_in_rank(rows, "sha1_b32", "sector_rank", "path")
    assert sorted(r["path"][-1] for r in found.collect()) == ["b", "c"]
