"""Engine inputs as deterministic projections of the driver's tables.

``SQL`` has the same relations for DuckDB; the two are written independently of
each other's functions (bits, for one, are 64 comparisons in both).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import box_geometry
from ..functions.hashing import sign_bits

SIDE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def condition(i) -> F.Column:
    return F.when(i % 3 == 0, "clean").when(i % 3 == 1, "shear").otherwise("radiation")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    labels = F.when(F.col("doc_id") % 50 == 7, F.array().cast("array<string>")).otherwise(F.array(F.lit("YES"), F.lit("NO")))
    return d.select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("request_id"), F.col("lang").alias("task_id"), condition(F.col("doc_id")).alias("condition_id"),
        F.col("source").alias("group_id"), labels.alias("allowed_answers"), F.concat(F.lit("Is "), F.col("source"), F.lit(" good?")).alias("prompt"), F.lit(8).alias("max_new_tokens"), F.lit(False).alias("do_sample"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("request_id"),
        F.when(F.col("quality") == 1, "YES").when(F.col("quality") == 0, "NO").alias("answer"), F.when(F.col("toxic") == 1, "pending").alias("review_status"),
    )


def predictions(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    k = (F.col("doc_id") * 7 + run) % 10
    right = F.coalesce("quality", F.lit(1)) == 1
    said = F.when(right == ((F.col("doc_id") * 13 + run * 5) % 4 != 0), "YES").otherwise("NO")
    noisy = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit(" \t"), F.lower(said), F.lit("\n"))).when(F.col("n_chars") % 3 == 1, said).otherwise(F.initcap(said))
    return d.where(k != 0).select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("request_id"), F.when(k == 1, "error").otherwise("ok").alias("status"),
        F.when(k == 2, "I think the answer is YES.").otherwise(noisy).alias("raw_response"), ((F.col("n_chars") % 97) / 10).alias("elapsed_seconds"),
        F.lit(f"run{run}").alias("run_id"), F.lit("mock").alias("model_id"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 5 == 3, "val").when(F.col("doc_id") % 5 == 4, "test").otherwise("train")
    stem = F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("_x"), (F.col("n_chars") % 7).cast("string"))
    return d.select(F.col("doc_id").alias("id"), split.alias("split"), F.col("source").alias("group_id"), F.col("lang").alias("planet"), F.sha2("text", 256).alias("content"), stem.alias("stem"), "n_chars")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 64-bit hashes, and as copies with up to three bits flipped."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", sign_bits(F.col("embedding")).alias("bits"))
    own = e.select(F.col("vec_id").alias("id"), F.lit("train").alias("split"), "label", "bits")
    flip = F.col("bits").bitwiseXOR(F.expr("shiftleft(1L, cast(vec_id % 4 as int)) - 1L"))
    return own.unionByName(e.select((F.col("vec_id") + 1_000_000_000).alias("id"), F.lit("test").alias("split"), "label", flip.alias("bits")))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 masks: target from the vector, prediction from the vector ten on; small values are ignored."""
    e = table(spark, sf_dir, "embeddings")
    total = e.agg(F.count("*").alias("n"))
    far = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("q"))
    both = e.crossJoin(F.broadcast(total)).withColumn("other", (F.col("vec_id") + 10) % F.col("n")).join(far, "other")
    target = F.transform("embedding", lambda v: F.when(F.abs(v) < F.lit(0.02).cast("float"), 255).when((v > 0) & ~(F.col("vec_id") % 10).isin(0, 1), 1).otherwise(0))
    predicted = F.transform("q", lambda v: F.when((v > 0) & ~(F.col("vec_id") % 10).isin(1, 2), 1).otherwise(0))
    return both.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("scene"), target.alias("target"), predicted.alias("predicted"), F.transform("embedding", lambda v: v.cast("double")).alias("height"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as an image of 512 x 512, its lines as boxes."""
    li = table(spark, sf_dir, "lineitem")
    order = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    x1, y1, size = (F.col("l_partkey") * 37 % 460).cast("double"), (F.col("l_suppkey") * 53 % 460).cast("double"), 4 + F.col("l_quantity")
    out = li.select(F.col("l_orderkey").alias("image"), n.alias("instance"), F.array(x1, y1, x1 + size, y1 + size).alias("box"), (F.col("l_returnflag") == "R").alias("truncated"), (F.col("l_linestatus") == "F").alias("human"))
    return out.withColumn("g", box_geometry(F.col("box"), F.col("truncated"), F.lit(SIDE), F.lit(SIDE))).select("*", "g.*").drop("g")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 11 == 0, "unsupported").otherwise("ok")
    return e.select(F.col("event_id").alias("result_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("condition_id"), status.alias("status"), F.col("value").alias("elapsed_seconds"), "ts")


SQL = {
    "requests": """SELECT 'r' || doc_id AS request_id, lang AS task_id, CASE doc_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'shear' ELSE 'radiation' END AS condition_id, source AS group_id,
        CASE WHEN doc_id % 50 = 7 THEN 0 ELSE 2 END AS n_labels, doc_id FROM documents""",
    "targets": "SELECT 'r' || d.doc_id AS request_id, CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END AS answer, toxic = 1 AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "manifest": """SELECT doc_id AS id, CASE doc_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, source AS group_id, lang AS planet, sha256(text) AS content,
        'm' || doc_id || '_x' || (n_chars % 7) AS stem, n_chars FROM documents""",
    "results": "SELECT event_id AS result_id, user_id AS run_id, event_type AS condition_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'unsupported' ELSE 'ok' END AS status, value AS elapsed_seconds, ts FROM events",
    "bits0": """SELECT vec_id, label, list_transform(range(0, 64), lambda i: CASE WHEN embedding[((i + 1) % 64) + 1] > embedding[i + 1] THEN 1 ELSE 0 END) AS b FROM embeddings""",
    "rasters": """SELECT e.vec_id AS sample_id, e.label AS scene, list_transform(e.embedding, lambda v: CASE WHEN abs(v) < 0.02::FLOAT THEN 255 WHEN v > 0 AND e.vec_id % 10 NOT IN (0, 1) THEN 1 ELSE 0 END) AS target,
        list_transform(q.embedding, lambda v: CASE WHEN v > 0 AND e.vec_id % 10 NOT IN (1, 2) THEN 1 ELSE 0 END) AS predicted, e.embedding AS height
        FROM embeddings e JOIN embeddings q ON q.vec_id = (e.vec_id + 10) % (SELECT count(*) FROM embeddings)""",
    "boxes0": """SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS instance,
        (l_partkey * 37 % 460)::DOUBLE AS x1, (l_suppkey * 53 % 460)::DOUBLE AS y1, 4 + l_quantity AS size, l_returnflag = 'R' AS truncated, l_linestatus = 'F' AS human FROM lineitem""",
}
SQL["predictions"] = """SELECT 'r' || doc_id AS request_id, CASE k WHEN 1 THEN 'error' ELSE 'ok' END AS status, (n_chars % 97) / 10.0::DOUBLE AS elapsed_seconds,
        CASE WHEN k = 2 THEN 'I think the answer is YES.' WHEN n_chars % 3 = 0 THEN ' ' || chr(9) || lower(said) || chr(10) WHEN n_chars % 3 = 1 THEN said ELSE upper(said[1]) || lower(said[2:]) END AS raw_response
        FROM (SELECT *, CASE WHEN (coalesce(quality, 1) = 1) = ((doc_id * 13 + {run} * 5) % 4 <> 0) THEN 'YES' ELSE 'NO' END AS said, (doc_id * 7 + {run}) % 10 AS k
              FROM (SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)) WHERE k <> 0"""
SQL["boxes"] = f"""SELECT *, NOT truncated AND size >= ceil(0.04 * {SIDE}) AND x1 >= 1 AND y1 >= 1 AND x1 + size <= {SIDE - 1} AND y1 + size <= {SIDE - 1} AS eligible,
        1 + (x1 + size / 2 >= 170)::INT + (x1 + size / 2 >= 341)::INT + 3 * ((y1 + size / 2 >= 170)::INT + (y1 + size / 2 >= 341)::INT) AS cell,
        CASE WHEN x1 + size / 2 < {SIDE // 2} THEN 'LEFT' ELSE 'RIGHT' END AS half, size::DOUBLE AS size_proxy FROM ({SQL["boxes0"]})"""
SQL["fact"] = """SELECT *, CASE WHEN scoring_status IN ('valid', 'invalid', 'failure') THEN scoring_status = 'valid' AND coalesce(parsed_answer = answer, false) END AS correct FROM (
        SELECT request_id, task_id, condition_id, group_id, doc_id, n_labels, CASE WHEN ref = 'REFERENCE_READY' THEN answer END AS answer, ref AS reference_status, reason AS reference_reason,
          CASE WHEN n_labels = 0 THEN 'unsupported_scoring' WHEN ref <> 'REFERENCE_READY' THEN 'unscored_reference' WHEN coalesce(status, 'missing') <> 'ok' THEN 'failure' WHEN parsed IS NULL THEN 'invalid' ELSE 'valid' END AS scoring_status,
          coalesce(status, 'missing') AS response_status, parsed AS parsed_answer, elapsed_seconds
        FROM (SELECT r.*, t.answer, CASE WHEN coalesce(t.pending, false) THEN CASE WHEN t.answer IS NULL THEN 'UNKNOWN_REFERENCE' ELSE 'CANDIDATE_REFERENCE' END WHEN t.answer IS NULL THEN 'UNKNOWN_REFERENCE' ELSE 'REFERENCE_READY' END AS ref,
                CASE WHEN coalesce(t.pending, false) THEN 'reference_review_pending_or_withheld' WHEN t.answer IS NULL THEN 'reference_missing' ELSE 'declared_reference' END AS reason,
                p.status, p.elapsed_seconds, CASE WHEN p.status = 'ok' AND n_labels > 0 THEN CASE lower(trim(regexp_replace(p.raw_response, '\\s+', ' ', 'g'))) WHEN 'yes' THEN 'YES' WHEN 'no' THEN 'NO' END END AS parsed
              FROM (""" + SQL["requests"] + ") r JOIN (" + SQL["targets"] + ") t ON r.request_id = t.request_id LEFT JOIN (" + SQL["predictions"] + ") p ON r.request_id = p.request_id)) x"  # fmt: skip


def sql(name: str, run: int = 0) -> str:
    return SQL[name].replace("{run}", str(run))
