"""Directories of images, derived from the star-schema tables, and the same in SQL.

An order or a customer is a directory, a line item an image in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sha1_urn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _image_columns(rows: DataFrame, key: str, *order: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy(key).orderBy(*order, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    kind = F.element_at(F.array(*map(F.lit, ("jpg", "png", "GIF", "txt"))), (F.col("l_partkey") % 4).cast("int") + 1)
    rows = rows.withColumn("pos", pos)
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("pos").cast("string"), F.lit("."), kind)
    return rows.select(
        F.col(key).alias("dir"),
        "pos",
        name.alias("name"),
        sha1_urn(name).alias("uri"),
        (100 + (F.col("l_partkey") * 37) % 900).cast("int").alias("w"),
        (100 + (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 17) % 700).cast("int").alias("h"),
        (1 + F.floor("l_extendedprice")).cast("long").alias("bytes"),
    )


def order_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dir (order), pos, name, uri, w, h, bytes."""
    return _image_columns(table(spark, sf_dir, "lineitem"), "l_orderkey")


def customer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of all of a customer's orders in one directory."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _image_columns(table(spark, sf_dir, "lineitem").join(orders, "l_orderkey"), "o_custkey", "l_orderkey")


_B32 = "translate(concat({parts}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


def b32_sql(hex_sql: str) -> str:
    """DuckDB SQL of the base-32 form of a 40-digit hexadecimal string."""
    return _B32.format(parts=", ".join(f"to_base(('0x' || substr({hex_sql}, {1 + 5 * i}, 5))::BIGINT, 32, 4)" for i in range(8)))


def urn_sql(text_sql: str) -> str:
    return f"('urn:sha1:' || {b32_sql(f'sha1({text_sql})')})"


def images_sql(name: str, by_customer: bool) -> str:
    """A common table expression of ``order_images`` or ``customer_images``."""
    rows = "lineitem JOIN orders ON o_orderkey = l_orderkey" if by_customer else "lineitem"
    key, order = ("o_custkey", "l_orderkey, ") if by_customer else ("l_orderkey", "")
    label = "'p' || l_partkey || '-' || pos || '.' || ['jpg', 'png', 'GIF', 'txt'][(l_partkey % 4) + 1]"
    return f"""{name} AS (
  SELECT dir, pos, name, {urn_sql("name")} AS uri, w, h, bytes FROM (
    SELECT {key} AS dir, CAST(pos AS INTEGER) AS pos, {label} AS name,
           CAST(100 + (l_partkey * 37) % 900 AS INTEGER) AS w,
           CAST(100 + (l_suppkey * 53 + l_linenumber * 17) % 700 AS INTEGER) AS h,
           1 + CAST(floor(l_extendedprice) AS BIGINT) AS bytes
    FROM (SELECT *, row_number() OVER (PARTITION BY {key}
            ORDER BY {order}l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos
          FROM {rows}) s) t)"""


def lines_sql(images: str) -> str:
    """Common table expressions from the images to ``cand`` (cells of all candidates),
    ``fit``, ``best`` (cells of the fittest) and ``cells`` (whole pixels, 1280 by 800)."""
    return f"""sized AS (
  SELECT *, greatest(1, CAST(floor(sqrt(count(*) OVER (PARTITION BY dir))) AS INTEGER) - 3) AS k FROM {images}),
tried AS (
  SELECT s.*, c.cand, s.pos // (s.k + c.cand // 2 + 1) AS line
  FROM sized s CROSS JOIN (SELECT unnest(range(12)) AS cand) c),
thick AS (
  SELECT *, CASE WHEN cand % 2 = 0 THEN 1024.0::DOUBLE ELSE 1024.0::DOUBLE - (count(*) OVER l - 1) END
            / sum(CASE WHEN cand % 2 = 0 THEN w::DOUBLE / h ELSE h::DOUBLE / w END) OVER l AS thick
  FROM tried WINDOW l AS (PARTITION BY dir, cand, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
stretched AS (
  SELECT *, CASE WHEN cand % 2 = 0 THEN w * thick / h ELSE h * thick / w END AS extent,
         CASE WHEN row_number() OVER (PARTITION BY dir, cand, line ORDER BY pos) = 1 THEN thick ELSE 0 END AS opening
  FROM thick),
placed AS (
  SELECT *, coalesce(sum(extent) OVER (PARTITION BY dir, cand, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
         sum(opening) OVER (PARTITION BY dir, cand ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - thick AS across
  FROM stretched),
cand AS (
  SELECT dir, pos, cand, CASE WHEN cand % 2 = 0 THEN begins ELSE across END AS x, CASE WHEN cand % 2 = 0 THEN across ELSE begins END AS y,
         CASE WHEN cand % 2 = 0 THEN extent ELSE thick END AS cw, CASE WHEN cand % 2 = 0 THEN thick ELSE extent END AS ch
  FROM placed),
fit AS (
  SELECT dir, cand, -2 * power(greatest(1.2 / shape, shape / 1.2), 2) - power(even, 2) AS fitness
  FROM (SELECT dir, cand, max(x + cw) / max(y + ch) AS shape, max(cw * ch) / min(cw * ch) AS even FROM cand GROUP BY dir, cand) f),
best AS (
  SELECT c.dir, c.pos, c.cand, c.x, c.y, c.cw AS w, c.ch AS h
  FROM cand c JOIN (SELECT dir, arg_max(cand, (fitness, -cand)) AS cand FROM fit GROUP BY dir) b USING (dir, cand)),
frame AS (
  SELECT dir, min(x) AS x0, min(y) AS y0, max(x + w) - min(x) AS iw, max(y + h) - min(y) AS ih FROM best GROUP BY dir),
scaled AS (SELECT *, least(1.0::DOUBLE, 1280.0::DOUBLE / iw, 800.0::DOUBLE / ih) AS s FROM frame),
spaced AS (
  SELECT s.*, CASE WHEN m >= 13 THEN 4 WHEN m >= 9 THEN 3 WHEN m >= 6 THEN 2 WHEN m >= 4 THEN 1 ELSE 0 END AS g
  FROM scaled s JOIN (SELECT b.dir, min(least(b.w, b.h) * c.s) AS m FROM best b JOIN scaled c USING (dir) GROUP BY b.dir) q USING (dir)),
moved AS (
  SELECT b.dir, b.pos, (x - x0) * ((iw * s + g) / iw) AS x, (y - y0) * ((ih * s + g) / ih) AS y,
         w * ((iw * s + g) / iw) - g AS w, h * ((ih * s + g) / ih) - g AS h
  FROM best b JOIN spaced USING (dir)),
cells AS (
  SELECT dir, pos, CAST(floor(x + 0.5) AS INTEGER) AS x, CAST(floor(y + 0.5) AS INTEGER) AS y,
         CAST(greatest(1, floor(x + w + 0.5) - floor(x + 0.5)) AS INTEGER) AS w,
         CAST(greatest(1, floor(y + h + 0.5) - floor(y + 0.5)) AS INTEGER) AS h FROM moved)"""


def compounds_sql(images: str) -> str:
    """``compound``: dir, width, height, components (text of all lines), n, image_count, byte_count, from ``cells``."""
    part = "'COMPONENT ' || c.x || ',' || c.y || ',' || c.w || ',' || c.h || ' ' || i.uri || ' name=''' || i.name || ''''"
    return f"""compound AS (
  SELECT dir, max(c.x + c.w) AS width, max(c.y + c.h) AS height, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS byte_count,
         string_agg({part}, chr(10) ORDER BY pos) AS lines,
         string_agg('image over ' || c.x || ',' || c.y || ' ' || c.w || ',' || c.h || ' ''' || i.uri || '''', chr(10) ORDER BY pos) AS ops
  FROM cells c JOIN {images} i USING (dir, pos) GROUP BY dir),
texts AS (
  SELECT *, 'COMPOUND-IMAGE ' || width || ',' || height || chr(10) || lines || chr(10) AS graphic,
         'COMPOUND-IMAGE ' || width || ',' || height || chr(10) || lines || chr(10) || 'TOTAL-IMAGE-COUNT ' || n || chr(10)
           || 'TOTAL-BYTE-COUNT ' || byte_count || chr(10) || 'GENERATED-FROM x-dir:' || dir || chr(10)
           || 'GENERATOR-INFO ''rowly''' || chr(10) AS text
  FROM compound)"""
