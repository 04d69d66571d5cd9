"""One query for each operator over the driver's tables, and its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..functions.tiger import bitprint
from ..operators import compound, layout, render, store, tree
from ..session import saved
from ..sources import blobs, directories
from .fixtures import b32_sql, compounds_sql, customer_images, images_sql, lines_sql, order_images, table, urn_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- content-addressed store ---


@_query(f"SELECT doc_id, {urn_sql('text')} AS urn, octet_length(encode(text)) AS size FROM documents")
def cas_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.identified(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", "urn", F.octet_length("text").cast("long").alias("size"))


@_query(f"""
SELECT {b32_sql('sha1(text)')} AS sha1_b32, any_value(octet_length(encode(text))) AS size, count(*) AS copies
FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY 1""")
def cas_store_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "benchmark").select(text.sha1_base32(F.col("text")).alias("sha1_b32"))
    return store.new_blobs(table(spark, sf_dir, "documents"), existing, "text").select("sha1_b32", "size", "copies")


@_query(f"""
SELECT sha1_b32, source, doc_id FROM (
  SELECT {b32_sql('sha1(text)')} AS sha1_b32, source, doc_id,
         row_number() OVER (PARTITION BY sha1(text) ORDER BY source, doc_id) AS turn FROM documents) t WHERE turn = 1""")
def cas_ranked_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(text.sha1_base32(F.col("text")).alias("sha1_b32"), "source", "doc_id")
    return blobs.first_in_rank(named, "sha1_b32", "source", "doc_id")


@_query(f"""
SELECT doc_id, sha AS sha1_b32, substr(sha, 1, 2) || '/' || sha AS path,
       CASE doc_id % 3 WHEN 0 THEN 'directory' ELSE 'compound-image' END AS kind, raw_urn
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE {b32_sql('sha1(text)')} END AS sha, {urn_sql('text')} AS raw_urn FROM documents) t""")
def urn_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain, sha = text.sha1_urn(F.col("text")), text.sha1_base32(F.col("text"))
    whole = F.concat(F.lit("urn:bitprint:"), sha, F.lit("." + "A" * 39))
    urn = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, whole).otherwise(F.concat(F.lit("urn:md5:"), sha))
    named = docs.select("doc_id", urn.alias("urn"), F.concat(F.lit("/raw/"), plain, F.lit("/a name.jpg")).alias("web"))
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x-rdf-subject:"), "urn")).otherwise(F.col("urn"))
    found = named.withColumn("sha1_b32", text.urn_sha1(F.col("urn")))
    return found.select(
        "doc_id", "sha1_b32", text.sector_path(F.col("sha1_b32")).alias("path"), text.source_kind(source).alias("kind"), text.raw_path_urn(F.col("web")).alias("raw_urn")
    )


@_query()
def bitprint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bitprint(F.encode("text", "UTF-8")).alias("urn"))


# --- directories and images ---


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = order_images(spark, sf_dir)
    return images.select(F.col("dir").alias("dir_uri"), "pos", "name", F.col("uri").alias("target_uri"), F.lit("Blob").alias("target_class"))


@_query(f"WITH {images_sql('i', False)} SELECT dir AS dir_uri, pos, name, uri AS target_uri, 'Blob' AS target_class FROM i")
def dir_build_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directories.parse(directories.build(_entries(spark, sf_dir)))


@_query(r"""
SELECT page_id, CAST(u.i - 1 AS INTEGER) AS pos, links[u.i] AS href FROM (
  SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages) p, unnest(range(1, len(links) + 1)) u(i)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


@_query(f"WITH {images_sql('i', False)} SELECT dir, pos, name FROM i WHERE regexp_full_match(name, '.*\\.(png|jpe?g|gif|bmp)', 'i')")
def image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_images(spark, sf_dir).filter(F.col("name").rlike(blobs.IMAGE_NAME)).select("dir", "pos", "name")


_SIZE = {"w": "(100 + (p_partkey * 37) % 900)", "h": "(100 + p_size * 7)"}


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image headers whose kind and size follow from the part."""
    part = table(spark, sf_dir, "part")
    w, h = (F.expr(_SIZE[k]).cast("int") for k in "wh")
    big = lambda v: F.lpad(F.hex(v), 8, "0")
    two = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256).cast("int")), 2, "0"))
    four = lambda v: F.concat(two(v), F.lit("0000"))
    kinds = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(h)),
        F.concat(F.lit("474946383961"), two(w), two(h)),
        F.concat(F.lit("424D" + "00" * 16), four(w), four(h)),
        F.lit("434F4D504F554E442D494D414745"),
        F.lit("3C68746D6C3E"),
        F.lit("3C21444F4354595045"),
    ]
    data = F.element_at(F.array(*kinds), (F.col("p_partkey") % 6).cast("int") + 1)
    return part.select("p_partkey", F.unhex(data).alias("content"))


@_query(f"""
SELECT p_partkey, k AS format, CAST(CASE WHEN k IN ('PNG', 'GIF', 'BMP') THEN w WHEN k IS NULL THEN -1 ELSE 0 END AS INTEGER) AS width,
       CAST(CASE WHEN k IN ('PNG', 'GIF', 'BMP') THEN h WHEN k IS NULL THEN -1 ELSE 0 END AS INTEGER) AS height,
       k IN ('PNG', 'GIF', 'BMP') AND k IS NOT NULL AS is_raster
FROM (SELECT p_partkey, ['PNG', 'GIF', 'BMP', 'COMPOSITE', 'HTML', NULL][(p_partkey % 6) + 1] AS k, {_SIZE['w']} AS w, {_SIZE['h']} AS h FROM part) t""")
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headers(spark, sf_dir).withColumn("format", blobs.sniff(F.col("content")))
    w, h = blobs.fixed_dimensions(F.col("content"))
    side = lambda v: F.coalesce(v.cast("int"), F.lit(-1))
    return rows.select("p_partkey", "format", side(w).alias("width"), side(h).alias("height"), blobs.is_raster(F.col("format")).alias("is_raster"))


@_query("SELECT page_id, CASE WHEN starts_with(html, '<htm') THEN 'HTML' END AS format FROM pages")
def page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", blobs.sniff(F.encode("html", "UTF-8")).alias("format"))


@_query("""
WITH o AS (SELECT o_custkey AS parent, count(*) AS n, sum(1 + CAST(floor(l_extendedprice) AS BIGINT)) AS b, o_orderkey AS key
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey),
c AS (SELECT c_custkey AS key, c_nationkey AS parent, sum(n) AS n, sum(b) AS b FROM o JOIN customer ON c_custkey = o.parent GROUP BY 1, 2),
a AS (SELECT n_nationkey AS key, n_regionkey AS parent, sum(c.n) AS n, sum(b) AS b FROM c JOIN nation ON n_nationkey = c.parent GROUP BY 1, 2),
r AS (SELECT r_regionkey AS key, sum(a.n) AS n, sum(b) AS b FROM a JOIN region ON r_regionkey = a.parent GROUP BY 1)
SELECT 1 AS level, CAST(key AS BIGINT) AS key, CAST(n AS BIGINT) AS image_count, CAST(b AS BIGINT) AS byte_count FROM o
UNION ALL SELECT 2, key, CAST(n AS BIGINT), CAST(b AS BIGINT) FROM c
UNION ALL SELECT 3, key, CAST(n AS BIGINT), CAST(b AS BIGINT) FROM a
UNION ALL SELECT 4, key, CAST(n AS BIGINT), CAST(b AS BIGINT) FROM r""")
def dir_rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("parent"), F.lit(1).cast("long").alias("image_count"), (1 + F.floor("l_extendedprice")).cast("long").alias("byte_count")
    )
    levels = [("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "n_regionkey"), ("region", "r_regionkey", None)]
    out = None
    for depth, (name, key, parent) in enumerate(levels, 1):
        up = F.col(parent).cast("long") if parent else F.lit(None).cast("long")
        parents = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), up.alias("parent"))
        level = compound.rolled_up(leaves, parents)
        leaves = level.select("parent", "image_count", "byte_count")
        rows = level.select(F.lit(depth).alias("level"), "key", "image_count", "byte_count")
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"""
WITH {images_sql('i', False)}, f AS (SELECT * FROM i WHERE name NOT LIKE '%.txt'),
s AS (SELECT dir, count(*) AS n, arg_min(name, pos) AS sole, arg_min(uri, pos) AS uri FROM f GROUP BY dir)
SELECT o_orderkey AS dir, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN o_orderkey || '/' || sole END AS name, CASE WHEN n = 1 THEN uri END AS uri
FROM orders LEFT JOIN s ON dir = o_orderkey""")
def singleton_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = order_images(spark, sf_dir).filter(F.col("name").rlike(blobs.IMAGE_NAME))
    sums = images.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "pos").alias("only"), F.min_by("uri", "pos").alias("uri"))
    dirs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dir"))
    one = F.col("n") == 1
    return dirs.join(sums, "dir", "left").select(
        "dir", F.coalesce("n", F.lit(0)).alias("n"), F.when(one, F.concat_ws("/", F.col("dir").cast("string"), "only")).alias("name"), F.when(one, F.col("uri")).alias("uri")
    )


# --- layout ---

_CUSTOMERS = f"WITH {images_sql('i', True)}, {lines_sql('i')}"
_ORDERS = f"WITH {images_sql('i', False)}, {lines_sql('i')}, {compounds_sql('i')}"


@_query(_CUSTOMERS + """
SELECT dir, pos, CAST(cand AS INTEGER) AS cand, CAST(floor(x + 0.5) AS BIGINT) AS x, CAST(floor(y + 0.5) AS BIGINT) AS y,
       CAST(floor(cw + 0.5) AS BIGINT) AS w, CAST(floor(ch + 0.5) AS BIGINT) AS h FROM cand""")
def rowly_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout.line_candidates(customer_images(spark, sf_dir))
    return cells.select("dir", "pos", "cand", *(layout.half_up(F.col(c)).alias(n) for c, n in (("x", "x"), ("y", "y"), ("cw", "w"), ("ch", "h"))))


@_query(_CUSTOMERS + """
SELECT dir, CAST(arg_max(cand, (fitness, -cand)) AS INTEGER) AS cand, round(max(fitness), 3) AS fitness FROM fit GROUP BY dir""")
def rowly_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = layout.line_fitness(layout.line_candidates(customer_images(spark, sf_dir)))
    return fit.groupBy("dir").agg(F.max_by("cand", F.struct("fitness", -F.col("cand"))).alias("cand"), F.round(F.max("fitness"), 3).alias("fitness"))


@_query(_CUSTOMERS + "SELECT dir, pos, x, y, w, h FROM cells")
def squish_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.squished(layout.lines_layout(customer_images(spark, sf_dir)))


@_query(_CUSTOMERS + """
SELECT count(*) AS cells, count(*) FILTER (WHERE x < 0 OR y < 0 OR w < 1 OR h < 1 OR x + w > 1280 OR y + h > 800) AS outside FROM cells""")
def cells_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout.squished(layout.lines_layout(customer_images(spark, sf_dir)))
    outside = layout.in_box(cells).agg(F.count(F.lit(1)).alias("outside"))
    return cells.agg(F.count(F.lit(1)).alias("cells")).crossJoin(outside)  # one row each


@_query()
def borce_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.squished(layout.bisection_layout(customer_images(spark, sf_dir)))


@_query()
def multifit_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout(customer_images(spark, sf_dir))


# --- compound images ---


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = order_images(spark, sf_dir)
    named = images.withColumn("image_count", F.lit(1).cast("long")).withColumn("byte_count", F.col("bytes"))
    made = compound.compounds(named, layout.layout(images, "rowly"))
    return made.withColumn("source_uri", F.concat(F.lit("x-dir:"), F.col("dir").cast("string")))


@_query(_ORDERS + "SELECT dir, text FROM texts")
def compound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _compounds(spark, sf_dir)
    return made.select("dir", compound.serialised(made).alias("text"))


@_query(_ORDERS + """
SELECT dir, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(n AS INTEGER) AS parts, n AS image_count, byte_count,
       'x-dir:' || dir AS source_uri, 'rowly' AS generator, string_split(lines, ' name=''')[2] AS first_name FROM
  (SELECT * REPLACE (replace(lines, '''' || chr(10), ' name=''') AS lines) FROM
    (SELECT * REPLACE (lines || chr(10) AS lines) FROM texts) a) b""")
def compound_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _compounds(spark, sf_dir)
    back = compound.parsed(made.select("dir", compound.serialised(made).alias("text")))
    return back.select(
        "dir", "width", "height", F.size("components").alias("parts"), "image_count", "byte_count", "source_uri", "generator",
        F.get("components", F.lit(0))["name"].alias("first_name"),
    )


@_query(_ORDERS + f"SELECT dir, {urn_sql('graphic')} AS graphic_urn, {urn_sql('text')} AS uri FROM texts")
def graphic_urn(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _compounds(spark, sf_dir)
    texts = made.select("dir", compound.graphic_text(made).alias("g"), compound.serialised(made).alias("t"))
    return texts.select("dir", text.sha1_urn(F.col("g")).alias("graphic_urn"), text.sha1_urn(F.col("t")).alias("uri"))


@_query(_ORDERS + """
SELECT c.dir, CASE WHEN n = 1 AND x = 0 AND y = 0 AND w = width AND h = height THEN uri END AS equivalent_uri
FROM compound c JOIN (SELECT cells.dir, cells.x, cells.y, cells.w, cells.h, i.uri FROM cells JOIN i USING (dir, pos) WHERE pos = 0) f USING (dir)""")
def equivalent_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compounds(spark, sf_dir).select("dir", compound.equivalent_uri().alias("equivalent_uri"))


@_query(_CUSTOMERS + """
, j AS (SELECT c.dir, c.pos, c.w, c.h, i.w AS sw, i.h AS sh FROM cells c JOIN i USING (dir, pos)),
k AS (SELECT *, (sw::DOUBLE / sh) / (w::DOUBLE / h) AS r, sw * h > sh * w AS wide FROM j)
SELECT dir, pos, NOT (r BETWEEN 0.95 AND 1.05) AS resize,
       CAST(CASE WHEN wide THEN floor(sh::DOUBLE * w / h) ELSE sw END AS INTEGER) AS crop_w,
       CAST(CASE WHEN wide THEN sh ELSE floor(sw::DOUBLE * h / w) END AS INTEGER) AS crop_h FROM k""")
def crop_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = customer_images(spark, sf_dir)
    cells = layout.squished(layout.lines_layout(images))
    met = cells.join(images.select("dir", "pos", F.col("w").alias("sw"), F.col("h").alias("sh")), ["dir", "pos"])
    sides = [F.col(c) for c in ("sw", "sh", "w", "h")]
    cut = render.crop(*sides)
    return met.select("dir", "pos", render.needs_resize(*sides).alias("resize"), cut["w"].alias("crop_w"), cut["h"].alias("crop_h"))


_CUSTOMER_OPS = f"WITH RECURSIVE {images_sql('i', True)}, {lines_sql('i')}, {compounds_sql('i')}"


@_query(_CUSTOMER_OPS + """
, op AS (SELECT dir, CAST(u.k - 1 AS INTEGER) AS ordinal, list[u.k] AS op FROM (SELECT dir, string_split(ops, chr(10)) AS list FROM compound) c, unnest(range(1, len(list) + 1)) u(k)),
walk AS (
  SELECT dir, ordinal, op, 0 AS batch, 256 + length(op) + 10 AS used FROM op WHERE ordinal = 0
  UNION ALL
  SELECT o.dir, o.ordinal, o.op, CASE WHEN w.used >= 6144 THEN w.batch + 1 ELSE w.batch END,
         CASE WHEN w.used >= 6144 THEN 256 ELSE w.used END + length(o.op) + 10
  FROM walk w JOIN op o ON o.dir = w.dir AND o.ordinal = w.ordinal + 1)
SELECT dir, batch, ordinal, op FROM walk""")
def draw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = customer_images(spark, sf_dir)
    named = images.withColumn("image_count", F.lit(1).cast("long")).withColumn("byte_count", F.col("bytes"))
    return render.draw_plan(compound.compounds(named, layout.layout(images, "rowly")))


def _segment_sql(value: str) -> str:
    keep = {c: f"%{ord(c):02X}" for c in "!$'()*,:~"}
    out = f"replace(url_encode({value}), '+', '%20')"
    for c, code in keep.items():
        out = f"replace({out}, '{code}', '{c if c != chr(39) else chr(39) * 2}')"
    return out


_ESCAPED = "replace(" * 6 + "text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '''', '\\'''), '\"', '\\\"')"


@_query(f"""
SELECT doc_id, md5({_ESCAPED}) AS escaped, md5(text) AS back, md5(replace(replace(replace(text, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')) AS html FROM documents""")
def escape_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", text.escape(F.col("text")).alias("e"))
    return rows.select("doc_id", F.md5("e").alias("escaped"), F.md5(text.unescape(F.col("e"))).alias("back"), F.md5(text.html_escape(F.col("text"))).alias("html"))


@_query(f"SELECT page_id, {_segment_sql('url')} AS segment, '../' || {_segment_sql('url')} || '/' || {_segment_sql(chr(39) + 'a b/c' + chr(39)).replace('a b/c', 'a b-c')} AS link FROM pages")
def uri_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.uri_segment(F.col("url")).alias("segment"), text.page_link(F.col("url"), F.lit("a b/c")).alias("link"))


def _page_sql(hover: bool) -> str:
    name = "hover-page-v1" if hover else "simple-page-v1"
    label = "replace(replace(replace(i.name, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')" if hover else "''"
    kind = ' class="hover"' if hover else ""
    raster = f"'../' || {_segment_sql(urn_sql('graphic'))} || '/compound.jpg'"
    return f"""{_ORDERS}, raster AS (SELECT dir, width, height, {raster} AS r FROM texts),
links AS (
  SELECT dir, string_agg('<a href="../' || {_segment_sql('i.uri')} || '/' || {_segment_sql('i.name')} || '"{kind} style="position:absolute; left:' || c.x
    || 'px; top:' || c.y || 'px; width:' || c.w || 'px; height:' || c.h || 'px; background:url(''' || r || ''') ' || -c.x || 'px ' || -c.y || 'px">'
    || {label} || '</a>' || chr(10), '' ORDER BY pos) AS links
  FROM cells c JOIN i USING (dir, pos) JOIN raster USING (dir) GROUP BY dir)
SELECT dir, md5('<html><head><title>Image grid for x-dir:' || dir || '</title><meta name="source" content="x-dir:' || dir
  || '"/><meta name="generator" content="{name}"/></head>' || chr(10) || '<body><div style="position:relative; width:' || width || 'px; height:'
  || height || 'px">' || chr(10) || links || '</div></body></html>' || chr(10)) AS html_md5 FROM links JOIN raster USING (dir)"""


def _pages(spark: SparkSession, sf_dir: str, hover: bool) -> DataFrame:
    made = _compounds(spark, sf_dir)
    named = made.withColumn("raster", text.sha1_urn(compound.graphic_text(made)))
    return named.select("dir", F.md5(render.page(F.col("raster"), F.col("source_uri"), hover)).alias("html_md5"))


@_query(_page_sql(False))
def html_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, False)


@_query(_page_sql(True))
def html_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, True)


@_query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS uri FROM pages")
def resource_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda u: F.struct(u.alias("uri")))
    return render.resource_log(table(spark, sf_dir, "pages").select("page_id", part.alias("components")), "page_id")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Region to line item as one tree of listings, laid out level by level: entries, texts of compound images, names of the images."""
    images = order_images(spark, sf_dir)
    uri = lambda kind, c: F.concat(F.lit(f"x-{kind}:"), F.col(c).cast("string"))
    leaf = images.select(uri("order", "dir").alias("dir_uri"), "pos", "name", F.col("uri").alias("target_uri"), F.lit("Blob").alias("target_class"))
    steps = [("orders", "customer", "o_custkey", "order", "o_orderkey"), ("customer", "nation", "c_nationkey", "customer", "c_custkey"), ("nation", "region", "n_regionkey", "nation", "n_nationkey")]
    entries = leaf
    for name, up, parent, down, key in steps:
        pos = (F.row_number().over(Window.partitionBy(parent).orderBy(key)) - 1).cast("int")
        rows = table(spark, sf_dir, name).select(
            uri(up, parent).alias("dir_uri"), pos.alias("pos"), F.col(key).cast("string").alias("name"), uri(down, key).alias("target_uri"), F.lit("Directory").alias("target_class")
        )
        entries = entries.unionByName(rows)
    # of images that share a name, the same one in every run
    info = images.groupBy("uri").agg(F.min(F.struct(F.col("w").alias("width"), F.col("h").alias("height"), F.col("bytes").alias("size"))).alias("i")).select("uri", "i.*")
    done, texts = compound.compose(entries, info, "rowly")
    return done, texts, info.select("uri")


def _made(texts: DataFrame) -> DataFrame:
    """The compound images of the texts, which are parsed once."""
    return saved(compound.parsed(texts).select("uri", "width", "height", "components", "title", "source_uri", "generator"))


@_query()
def compose_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0]


@_query()
def raster_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each picture of the tree is drawn, the components' pictures first."""
    _, texts, images = _tree(spark, sf_dir)
    made = _made(texts)
    return tree.draw_plans(made, tree.rasters(made, images)[0], images)


@_query()
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's pages, each linked to those of its compound parts."""
    _, texts, images = _tree(spark, sf_dir)
    made = _made(texts)
    return tree.pages(made, tree.rasters(made, images)[0], kept=F.md5)[0].select("uri", "page_uri", F.col("html").alias("html_md5"), "level")


# --- key-value log and memo ---

_LOG = "SELECT user_id || ':' || event_type AS key, value, event_id AS seq FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "value", F.col("event_id").alias("seq"))


@_query(f"SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS turn FROM ({_LOG}) l) t WHERE turn = 1")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_log(spark, sf_dir), ["key"], ["seq"])


_HALVES = f"WITH l AS ({_LOG}), m AS (SELECT avg(seq) AS m FROM l), o AS (SELECT key, arg_max(value, seq) AS value FROM l, m WHERE seq < m GROUP BY key), n AS (SELECT key, arg_max(value, seq) AS value FROM l, m WHERE seq >= m GROUP BY key)"


@_query(_HALVES + " SELECT key, coalesce(n.value, o.value) AS value, n.key IS NULL AS copied FROM n FULL JOIN o USING (key)")
def memo_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    middle = F.broadcast(log.agg(F.avg("seq").alias("m")))  # one row
    dated = log.crossJoin(middle)
    pick = lambda c: dated.filter(c).groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    both, copied = store.read_through(pick("seq >= m"), pick("seq < m"), "key", "value")
    return both.join(copied.select("key", F.lit(True).alias("copied")), "key", "left").select("key", "value", F.coalesce("copied", F.lit(False)).alias("copied"))


@_query(_HALVES + " SELECT key, round(coalesce(o.value, length(key)), 6) AS value FROM (SELECT DISTINCT key FROM l) k LEFT JOIN o USING (key)")
def memo_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    middle = F.broadcast(log.agg(F.avg("seq").alias("m")))  # one row
    memo = log.crossJoin(middle).filter("seq < m").groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    found, _ = store.memoised(log.select("key").distinct(), memo, "key", "value", lambda keys: keys.withColumn("value", F.length("key").cast("double")))
    return found.select("key", F.round("value", 6).alias("value"))


_BYTES = "list_transform(range(1, length(hex(encode(p_name))) + 1, 2), lambda i: ('0x' || substr(hex(encode(p_name)), i, 2))::HUGEINT)"
_SIGNED = "CASE WHEN b > 127 THEN b - 256 ELSE b END"


@_query(f"""
SELECT p_partkey,
  CAST(list_reduce(list_prepend(1::HUGEINT, {_BYTES}), lambda h, b: ((h * 31 + {_SIGNED}) % 4294967296 + 4294967296) % 4294967296) % 32768 AS BIGINT) AS polynomial,
  CAST(list_reduce(list_prepend(0::HUGEINT, list_transform({_BYTES}, lambda b, k: b + 256 * k)),
    lambda h, c: ((h * f[CAST(c // 256 AS BIGINT)] + CASE WHEN c % 256 > 127 THEN c % 256 - 256 ELSE c % 256 END) % 4294967296 + 4294967296) % 4294967296) % 2147483648 % 65536 AS BIGINT) AS rolling
FROM part, (WITH RECURSIVE p(k, a) AS (SELECT 1, 63689::HUGEINT UNION ALL SELECT k + 1, (a * 378551) % 4294967296 FROM p WHERE k < 200) SELECT list(a ORDER BY k) AS f FROM p) q""")
def kv_bucket_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.encode("p_name", "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", hashing.polynomial_bucket(key).alias("polynomial"), hashing.rolling_bucket(key).alias("rolling"))


@_query(f"""
WITH RECURSIVE l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 16 + length(props) * 200 AS cost FROM events),
walk AS (
  SELECT user_id, event_id, k, 0 AS batch, cost AS used, 1 AS n FROM l WHERE k = 1
  UNION ALL
  SELECT l.user_id, l.event_id, l.k, CASE WHEN w.used >= 262144 OR w.n >= 256 THEN w.batch + 1 ELSE w.batch END,
         CASE WHEN w.used >= 262144 OR w.n >= 256 THEN 0 ELSE w.used END + l.cost, CASE WHEN w.used >= 262144 OR w.n >= 256 THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN l ON l.user_id = w.user_id AND l.k = w.k + 1)
SELECT user_id, event_id, batch FROM walk""")
def write_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = (16 + F.length("props") * 200).cast("long")
    puts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", cost.alias("cost")))).alias("puts"))
    batch = store.greedy_batches(F.col("puts.cost"), 262_144, 0, 256)
    each = puts.withColumn("batch", batch).select("user_id", F.explode(F.arrays_zip(F.col("puts.event_id").alias("event_id"), "batch")).alias("p"))
    return each.select("user_id", "p.event_id", "p.batch")
