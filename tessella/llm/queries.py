"""The queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_path
    from .token_store import read_documents, write_store

    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_fingerprint import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import curriculum

    never = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)  # noqa: E731  a copy that the mix doesn't take
    return curriculum(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", never("position"), never("second_position")
    )


QUERIES = {f.__name__: f for f in (op1_token_store, op2_pii, op3_toxicity, op4_best_fit_packing, op5_line_dedup, op6_exact_dedup, op7_jaccard_join, op8_edit_fingerprint, op9_license_scan, op10_mixing)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _position_sql(fraction: str) -> str:
    """Where each schedule of the mix reaches a fraction of its integral."""
    from .mixing import CYCLE, integral

    out = "CASE place"
    for k, (_, shape) in enumerate(CYCLE):
        area = integral(shape)
        case = "CASE"
        for i in range(len(shape) - 1):
            (t0, a), (t1, b) = shape[i], shape[i + 1]
            slope, over = (b - a) / (t1 - t0), f"({fraction} * {area[-1]}::DOUBLE - {area[i]}::DOUBLE)"
            x = f"{over} / {a}::DOUBLE" if slope == 0 else f"(sqrt(greatest(0::DOUBLE, {a * a}::DOUBLE + {2 * slope}::DOUBLE * {over})) - {a}::DOUBLE) / {slope}::DOUBLE"
            case += f" WHEN {fraction} * {area[-1]}::DOUBLE <= {area[i + 1]}::DOUBLE THEN {t0}::DOUBLE + {x}"
        out += f" WHEN {k} THEN {case} ELSE 1 END"
    return out + " END"


def _copy_sql(k: int) -> str:
    middle = f"({k} * source_size + start + CASE WHEN passes > {k} THEN size ELSE part END / 2::DOUBLE)"
    return f"CASE WHEN copies > {k} AND target > 0 THEN round({_position_sql(f'least(1::DOUBLE, {middle} / target)')}, 9) END"


ORACLES = {
    "op7_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS e FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS rank FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS place FROM g),
v AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][place + 1] AS weight FROM o),
u AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER up_to, 0)) / sum(weight) OVER onward AS level
  FROM v WINDOW up_to AS (ORDER BY source_size / weight, place, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    onward AS (ORDER BY source_size / weight, place, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT source, source_size, place, CASE WHEN 2.0::DOUBLE * source_size <= level * weight THEN 2.0::DOUBLE * source_size
    ELSE max(CASE WHEN 2.0::DOUBLE * source_size > level * weight THEN level END) OVER () * weight END AS target FROM u),
a AS (
  SELECT d.doc_id, d.size, t.source_size, t.place, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY rank, d.doc_id IS NULL, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
b AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM a),
c AS (SELECT *, greatest(0, least(size, goal - passes * source_size - start)) AS part FROM b),
e AS (SELECT *, CAST(CASE WHEN size > 0 THEN passes + CAST(part > 0 AS INTEGER) ELSE 0 END AS INTEGER) AS copies FROM c)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken, copies,
       coalesce({_copy_sql(0)}, -1) AS position, coalesce({_copy_sql(1)}, -1) AS second_position FROM e""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""",
}
