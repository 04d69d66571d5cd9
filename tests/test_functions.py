import random
from base64 import b32encode
from hashlib import sha1
from urllib.parse import quote

from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.functions.tiger import bitprint, bitprint_names


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


def test_sha1_vector(spark):
    assert one(spark, "Hello, world!", text.sha1_base32) == "SQ5HALIG6NCZTLXB7DNI56PXFFQDDVUZ"


def test_base32_round_trip(spark):
    digest = sha1(b"x").digest()
    name = b32encode(digest).decode()
    assert one(spark, "x", text.sha1_base32) == name
    assert bytes(one(spark, name.lower() + "-", text.unbase32)) == digest
    assert bytes(one(spark, "", text.unbase32)) == b""


def test_bitprint_vector(spark):
    want = "urn:bitprint:SQ5HALIG6NCZTLXB7DNI56PXFFQDDVUZ.276TET7NAXG7FVCDQWOENOX4VABJSZ4GBV7QATQ"
    assert bitprint_names([b"Hello, world!"]) == [want]
    rows = spark.createDataFrame([(bytearray(b"Hello, world!"),), (None,)], "c binary").select(bitprint(F.col("c")).alias("u")).collect()
    assert [r["u"] for r in rows] == [want, None]


def test_tree_sizes_do_not_interfere():
    contents = [b"", b"a" * 1024, b"a" * 1025, b"b" * 5000]
    assert bitprint_names(contents) == [bitprint_names([c])[0] for c in contents]
    # published tree hash of the empty file
    assert bitprint_names([b""])[0].endswith(".LWPNACQDBZRYXW3VHJVCJ64QBZNGHOHHHZWCLNQ")


def test_escape_vector(spark):
    raw, escaped = "Hello'\"\r\n\t\\Goodbye", "Hello\\'\\\"\\r\\n\\t\\\\Goodbye"
    assert one(spark, raw, text.escape) == escaped
    assert one(spark, escaped, text.unescape) == raw
    assert one(spark, "a\\qb\\", text.unescape) == "aqb\\"


def test_escape_round_trips(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("ab\\'\"\n\r\t nrt") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.unescape(text.escape(F.col("v"))).alias("o")).collect()
    assert all(r["v"] == r["o"] for r in rows)


def test_segments_and_links(spark):
    value = "a b/c:é!$'()*,-._~&?#[]%"
    assert one(spark, value, text.uri_segment) == quote(value, safe="-._~:!$'()*,")
    assert one(spark, "x/y", lambda c: text.page_link(F.lit("urn:sha1:A"), c)) == "../urn:sha1:A/x-y"
    assert one(spark, None, lambda c: text.page_link(F.lit("urn:sha1:A"), c)) == "../urn:sha1:A/urn:sha1:A"
    assert one(spark, "<a&b>", text.html_escape) == "&lt;a&amp;b&gt;"


def test_names(spark):
    sha = "SQ5HALIG6NCZTLXB7DNI56PXFFQDDVUZ"
    assert one(spark, "urn:sha1:" + sha, text.urn_sha1) == sha
    assert one(spark, f"urn:bitprint:{sha}." + "A" * 39, text.urn_sha1) == sha
    assert one(spark, "urn:sha1:abc", text.urn_sha1) is None
    assert one(spark, sha, text.sector_path) == f"SQ/{sha}"
    assert one(spark, "x-parse-rdf:q", text.source_kind) == "directory"
    assert one(spark, "urn:sha1:q", text.source_kind) == "compound-image"
    assert one(spark, "/raw/urn:x/name", text.raw_path_urn) == "urn:x"
    assert one(spark, "/other", text.raw_path_urn) is None


def wrapped(x):
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def test_bucket_hashes(spark):
    keys = [b"", b"a", "some-cache:some-value".encode(), bytes(range(256)), b"\xff" * 40]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    got = rows.select("k", hashing.polynomial_bucket(F.col("k")).alias("p"), hashing.rolling_bucket(F.col("k")).alias("r")).collect()
    for r in got:
        h, g, a = 1, 0, 63689
        for b in bytes(r["k"]):
            s = b - 256 if b > 127 else b
            h, g, a = wrapped(31 * h + s), wrapped(g * a + s), wrapped(a * 378551)
        assert r["p"] == h & 0x7FFF
        assert r["r"] == (g & 0x7FFFFFFF) % 65536


def test_unescape_of_a_private_character(spark):
    from tessella.functions.text import escape, unescape

    texts = ["\ue000 a\\b\ue000", "\\\\n", "tab\t'q'\\", "", "\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(unescape(escape("t")).alias("t")).collect()
    assert [r["t"] for r in rows] == texts
