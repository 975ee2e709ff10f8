"""Registered queries of data-set assembly, pixel values and picks, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions import text as X
from ..operators import assembly as A
from ..operators import audit, scenes, segment, stats, validate
from . import relations as R
from .catalogue import C, fact, query, sql

def docs(s, d):
    return R.table(s, d, "documents")


# --- projections and joins ----------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS answer FROM documents")
def io_split(s, d):
    inputs, targets = A.split_io(docs(s, d).withColumn("answer", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text"), "doc_id", ["answer"])
    return A.strict_join(inputs, targets, "doc_id")


@query(
    """WITH a AS (SELECT doc_id AS k FROM documents WHERE doc_id % 9 <> 4 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 3), b AS (SELECT doc_id AS k FROM documents WHERE doc_id % 11 <> 4),
      g AS (SELECT coalesce(a.k, b.k) AS k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT k, count(*) AS na FROM a GROUP BY k) a FULL JOIN (SELECT k, count(*) AS nb FROM b GROUP BY k) b ON a.k = b.k)
    SELECT rule, k::VARCHAR AS key, na || '/' || nb AS detail FROM (SELECT k, na, nb, unnest([CASE WHEN na = 0 THEN 'left_missing' END, CASE WHEN nb = 0 THEN 'right_missing' END, CASE WHEN na > 1 THEN 'left_repeated' END]) AS rule FROM g) WHERE rule IS NOT NULL"""
)
def strict_join_rules(s, d):
    k = docs(s, d).select(C("doc_id").alias("k"))
    return A.strict_violations(k.where("k % 9 <> 4").union(k.where("k % 50 = 3")), k.where("k % 11 <> 4"), "k")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/new/place/' || lang || '/x.png' ELSE '/other/' || lang END AS path FROM documents")
def rebase_paths(s, d):
    path = F.when(C("doc_id") % 3 == 0, F.concat(F.lit("/old/"), "lang", F.lit("/x.png"))).otherwise(F.concat(F.lit("/other/"), "lang"))
    rows = docs(s, d).select(C("doc_id"), F.array(F.struct(F.lit("rgb").alias("name"), path.alias("path"))).alias("paths"))
    return A.rebase(rows, "paths", "/old", "/new/place").select("doc_id", F.col("paths")[0]["path"].alias("path"))


@query("SELECT o_orderkey AS parent, l_linenumber AS variant, o_orderpriority AS answer FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def variant_targets(s, d):
    targets = R.table(s, d, "orders").select(C("o_orderkey").alias("parent"), C("o_orderpriority").alias("answer"))
    return R.table(s, d, "lineitem").select(C("l_orderkey").alias("parent"), C("l_linenumber").alias("variant")).join(targets, "parent")


@query(
    """SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'depth_missing' WHEN a.n_chars % 5 <> b.n_chars % 5 OR a.doc_id % 8 = 1 THEN 'shape_differs' WHEN a.n_chars % 100 < 50 THEN 'coverage_low' END AS reason
    FROM documents a LEFT JOIN (SELECT * FROM documents WHERE doc_id % 6 <> 2) b ON a.doc_id = b.doc_id"""
)
def depth_coverage(s, d):
    rows = docs(s, d).select(C("doc_id"), (C("n_chars") % 5).alias("height"), F.lit(8).alias("width"), "n_chars")
    depth = rows.where("doc_id % 6 <> 2").select(C("doc_id"), "height", F.when(C("doc_id") % 8 == 1, 7).otherwise(8).alias("width"), (C("n_chars") % 100 / 100).alias("valid_share"))
    return A.coverage_with_depth(rows.drop("n_chars"), depth, "doc_id")


@query(
    """SELECT doc_id AS id, 'c' || doc_id % 4 AS container, doc_id // 4 AS row_index, CASE WHEN doc_id % 10 = 9 THEN 'row_missing' WHEN doc_id % 7 = 3 THEN 'hash_differs' ELSE 'verified' END AS state FROM documents"""
)
def locator_join(s, d):
    at = (F.concat(F.lit("c"), (C("doc_id") % 4).cast("string")).alias("container"), F.floor(C("doc_id") / 4).cast("long").alias("row_index"))
    rows = docs(s, d).where("doc_id % 10 <> 9").select(*at, F.coalesce("text", F.lit("")).alias("content"))
    sha = F.sha2(F.when(C("doc_id") % 7 == 3, "other").otherwise(F.coalesce("text", F.lit(""))), 256)
    return A.by_locator(docs(s, d).select(C("doc_id").alias("id"), *at, sha.alias("sha256")), rows)


BOXES = f"SELECT *, (instance * 13 + image * 7) % 10 AS score10 FROM ({sql('boxes')})"


@query(
    f"""WITH k AS (SELECT * FROM ({BOXES}) WHERE eligible AND score10 >= 5), q AS (SELECT image, CASE WHEN max((cell = 5)::INT) = 1 THEN 'YES' ELSE 'NO' END AS q2,
      CASE WHEN sum(CASE half WHEN 'LEFT' THEN 1 ELSE -1 END) > 0 THEN 'LEFT' WHEN sum(CASE half WHEN 'LEFT' THEN 1 ELSE -1 END) < 0 THEN 'RIGHT' ELSE 'TIE' END AS q4 FROM k GROUP BY image),
      a AS (SELECT image, 'q2' AS task, q2 AS v FROM q UNION ALL SELECT image, 'q4', q4 FROM q)
    SELECT image, task, v AS computed, CASE WHEN image % 3 = 0 THEN 'YES' END AS stored FROM a WHERE image % 3 = 0 AND v <> 'YES' OR image % 5 = 0 AND image % 3 <> 0
    """
)
def detections_replay(s, d):
    boxes = R.boxes(s, d).withColumn("score", (C("instance") * 13 + C("image") * 7) % 10 / 10)
    q = scenes.definite_answers(A.readout(boxes, "image"))
    answers = q.select("image", F.explode(F.array(*(F.struct(F.lit(k).alias("task"), C(k).alias("answer")) for k in ("q2", "q4")))).alias("x")).select("image", "x.*")
    stored = answers.where("image % 3 = 0 or image % 5 <> 0").withColumn("answer", F.when(C("image") % 3 == 0, "YES").otherwise(C("answer")))
    return A.replayed(answers, stored, ["image", "task"])


@query(
    """SELECT 'group_size' AS rule, user_id::VARCHAR AS key, count(*) || '/' || count(DISTINCT event_type) AS detail FROM events GROUP BY user_id HAVING count(*) <> 4 OR count(DISTINCT event_type) <> 2"""
)
def control_checks(s, d):
    return A.group_sizes(R.table(s, d, "events"), "user_id", 4, "event_type", 2)


@query(
    f"""WITH l AS ({sql('fact')}), r AS (SELECT request_id, task_id, CASE WHEN doc_id % 9 = 4 THEN 'other' ELSE condition_id END AS condition_id, answer FROM ({sql('fact', 1)}) WHERE doc_id % 12 <> 5)
    SELECT 'right_missing' AS rule, request_id AS key, '' AS detail FROM l WHERE doc_id % 12 = 5 UNION ALL SELECT 'condition_id_differs', l.request_id, '' FROM l JOIN r ON l.request_id = r.request_id WHERE l.condition_id IS DISTINCT FROM r.condition_id"""
)
def pairing_rules(s, d):
    number = F.substring("request_id", 2, 20).cast("long")
    right = fact(s, d, 1).where(number % 12 != 5).withColumn("condition_id", F.when(number % 9 == 4, "other").otherwise(C("condition_id")))
    return validate.pairing_violations(fact(s, d), right)


@query(
    f"""WITH p AS (SELECT request_id FROM ({sql('predictions')}) UNION ALL SELECT 'r' || doc_id FROM documents WHERE doc_id % 51 = 5 UNION ALL SELECT 'gone' || doc_id FROM documents WHERE doc_id % 80 = 2)
    SELECT 'done_twice' AS rule, request_id AS key, 'n=' || count(*) AS detail FROM p GROUP BY request_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'done_foreign', request_id, '' FROM p WHERE request_id NOT IN (SELECT request_id FROM ({sql('requests')}))"""
)
def resume_rules(s, d):
    named = lambda lead, some: docs(s, d).where(some).select(F.concat(F.lit(lead), C("doc_id").cast("string")).alias("request_id"))
    done = R.predictions(s, d).select("request_id").unionByName(named("r", "doc_id % 51 = 5")).unionByName(named("gone", "doc_id % 80 = 2"))
    return validate.resume_violations(R.requests(s, d), done)


@query(
    f"""WITH m AS ({sql('manifest')}), h AS (SELECT vec_id, vec_id % 3 = 0 AS tr, ('0x' || substr(md5(label::VARCHAR), 1, 6))::BIGINT + vec_id % 2 AS bits FROM embeddings),
      g AS (SELECT content FROM m GROUP BY content HAVING count(*) > 1 AND count(DISTINCT split) > 1), near AS (SELECT count(*) AS n FROM h a JOIN h b ON a.tr AND NOT b.tr AND bit_count(xor(a.bits, b.bits)) <= 2)
    SELECT (SELECT count(*) FROM g) AS n_cross_duplicates, (SELECT n FROM near) AS n_near, (SELECT count(*) FROM m WHERE n_chars % 41 = 0) AS n_constant, (SELECT count(*) FROM (SELECT group_id FROM m GROUP BY group_id HAVING count(DISTINCT split) > 1)) AS n_cross_groups, 'review_required' AS verdict"""
)
def audit_verdict_full(s, d):
    m = R.manifest(s, d)
    stats_ = audit.split_statistics(m.select("split", "group_id", C("n_chars").alias("foreground"), F.lit(1).alias("background"), (C("n_chars") % 41 == 0).alias("constant")))
    bits = (F.conv(F.substring(F.md5(C("label").cast("string")), 1, 6), 16, 10).cast("long") + C("vec_id") % 2).alias("bits")
    h = R.table(s, d, "embeddings").select(C("vec_id").alias("id"), (C("vec_id") % 3 == 0).alias("tr"), bits)
    near = audit.near_count(h.where("tr"), h.where("not tr"))
    crossing = m.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return audit.verdict(audit.duplicate_groups(m, "content"), near, stats_, crossing)


# --- masks and intervals ------------------------------------------------------------------------


SCENE_PAIRS = f"SELECT scene, sample_id, len(list_filter(list_zip(target, predicted), lambda x: x[1] <> 255 AND x[1] = x[2])) AS good, len(list_filter(target, lambda x: x <> 255)) AS n FROM ({sql('rasters')})"


@query(f"WITH p AS (SELECT scene, good / n::DOUBLE AS a, CASE WHEN sample_id % 2 = 0 THEN 0.5 ELSE 0.25 END AS b FROM ({SCENE_PAIRS}) WHERE n > 0), q AS (SELECT scene, avg(a - b) AS v FROM p GROUP BY scene) SELECT round(avg(v), 6) AS mean, count(*) AS n_scenes FROM q")
def paired_scene_difference(s, d):
    return stats.scene_interval(scene_differences(s, d)).select(F.round("mean", 6).alias("mean"), "n_scenes")


def scene_differences(s, d):
    c = segment.per_image(R.rasters(s, d))
    rows = c.where("valid > 0").select("scene", ((C("valid") - C("fp") - C("fn")) / C("valid")).alias("left"), F.when(C("sample_id") % 2 == 0, 0.5).otherwise(0.25).alias("right"))
    return stats.scene_differences(rows, "left", "right")


@query()
def paired_scene_interval(s, d):
    return stats.scene_interval(scene_differences(s, d))


COUNTS = "SELECT kind, scene, len(list_filter(target, lambda x: x = 1)) AS pos, len(list_filter(target, lambda x: x = 0)) AS neg FROM ({}), (VALUES ('background'), ('foreground')) k(kind)"


@query(
    f"""WITH c AS ({COUNTS.format(sql('rasters'))}), m AS (SELECT kind, scene, CASE WHEN kind = 'foreground' THEN CASE WHEN pos + neg = 0 THEN 1 ELSE pos / (pos + neg)::DOUBLE END ELSE CASE WHEN pos = 0 THEN 1 ELSE 0 END END AS iou,
      CASE WHEN kind = 'foreground' THEN CASE WHEN pos + neg = 0 THEN 1 ELSE 2 * pos / (2 * pos + neg)::DOUBLE END ELSE CASE WHEN pos = 0 THEN 1 ELSE 0 END END AS dice FROM c), i AS (SELECT kind, scene, avg(iou) AS i, avg(dice) AS d, sum(iou) AS s, count(*) AS n FROM m GROUP BY kind, scene)
    SELECT kind, round(avg(i), 6) AS scene_iou, round(avg(d), 6) AS scene_dice, round(sum(s) / sum(n), 6) AS image_iou, count(*) AS n_scenes FROM i GROUP BY kind"""
)
def trivial_baselines(s, d):
    return segment.scene_macro(segment.per_image(segment.trivial(R.rasters(s, d))), "scene", "kind")


@query(
    f"""WITH p AS (SELECT unnest(list_zip(target, predicted)) AS x FROM ({sql('rasters')})), q AS (SELECT x[1] AS t, x[2] AS p FROM p WHERE x[1] <> 255),
      c AS (SELECT k, count(*) FILTER (t = k AND p = k) AS i, count(*) FILTER (t = k OR p = k) AS u FROM q, (VALUES (0), (1)) c(k) GROUP BY k)
    SELECT round((SELECT avg(i / u::DOUBLE) FROM c WHERE u > 0), 6) AS mean_iou, round(count(*) FILTER (t = p) / count(*)::DOUBLE, 6) AS pixel_accuracy, count(*) AS n_pixels FROM q"""
)
def pixel_summary(s, d):
    return segment.pixel_summary(R.rasters(s, d))


@query(f"SELECT x AS value, count(*) AS pixels, count(DISTINCT sample_id) AS images FROM (SELECT sample_id, unnest(target) AS x FROM ({sql('rasters')})) GROUP BY x")
def mask_class_support(s, d):
    return A.class_support(R.rasters(s, d), "sample_id", "target")


@query(
    """WITH e AS (SELECT user_id, (event_id % 3)::INT AS h, abs(value - 50) AS e FROM events), g AS (SELECT user_id, h, avg(e) AS mae, quantile_cont(e, 0.5) AS m, quantile_cont(e, 0.9) AS p, count(*) AS n FROM e GROUP BY user_id, h)
    SELECT user_id, h, round(mae, 6) AS mae, round(m, 6) AS median, round(p, 6) AS p90, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mae, h) = 1"""
)
def registration_errors(s, d):
    e = R.table(s, d, "events").select("user_id", (C("event_id") % 3).cast("int").alias("h"), (C("value") - 50).alias("e"))
    return A.registration_errors(e, "user_id", "h", "e").select("user_id", "h", *(F.round(c, 6).alias(c) for c in ("mae", "median", "p90")), "n")


@query("SELECT lang || ':' || CASE doc_id % 4 WHEN 1 THEN 'small' WHEN 2 THEN 'blank' ELSE 'twice' END AS reason, count(*) AS n FROM documents WHERE doc_id % 4 > 0 GROUP BY 1")
def rejection_counts(s, d):
    reason = F.when(C("doc_id") % 4 == 1, "small").when(C("doc_id") % 4 == 2, "blank").when(C("doc_id") % 4 == 3, "twice")
    return A.rejections(docs(s, d).withColumn("reason", reason), "lang")


# --- picks --------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 THEN 'both' WHEN doc_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS pool FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, pool ORDER BY sha256('7:' || doc_id)) AS place FROM p)
    SELECT source, pool, place::INT AS place, doc_id FROM r WHERE place <= CASE pool WHEN 'both' THEN 1 WHEN 'positive' THEN 3 ELSE 2 END"""
)
def stratified_selection(s, d):
    pool = F.when(C("doc_id") % 6 == 0, "both").when(C("doc_id") % 2 == 0, "positive").otherwise("negative")
    return A.stratified(docs(s, d).select("doc_id", "source"), "source", pool, {"both": 1, "positive": 3, "negative": 2}, F.sha2(F.concat(F.lit("7:"), C("doc_id").cast("string")), 256)).select("source", "pool", "place", "doc_id")


@query("WITH r AS (SELECT source, abs(n_chars - 1000) AS delta, doc_id % 90 AS angle, doc_id FROM documents), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY delta, angle, doc_id) = 1) SELECT * FROM b ORDER BY delta, angle, doc_id LIMIT 6")
def nearest_of_groups(s, d):
    rows = docs(s, d).select("source", F.abs(C("n_chars") - 1000).alias("delta"), (C("doc_id") % 90).alias("angle"), "doc_id")
    return A.best_of_groups(rows, "source", ["delta", "angle"], "doc_id", 6)


@query("SELECT doc_id, (('0x' || sha256('w' || doc_id)[1:16])::UBIGINT % 37)::BIGINT AS window_index FROM documents")
def window_pick(s, d):
    return docs(s, d).select("doc_id", A.hash_pick(F.concat(F.lit("w"), C("doc_id").cast("string")), F.lit(37)).alias("window_index"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('z' || doc_id)) AS turn FROM documents WHERE source IS NOT NULL) SELECT doc_id, source, turn::INT AS turn FROM r ORDER BY turn, source LIMIT 40")
def fewest_first(s, d):
    rows = docs(s, d).where("source is not null").select("doc_id", "source")
    return A.fewest_first(rows, "source", F.sha2(F.concat(F.lit("z"), C("doc_id").cast("string")), 256), 40)


# --- values -------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'M' || (doc_id + 100) || '_r' || doc_id % 9 WHEN 1 THEN 'thm_dir_N' || doc_id ELSE NULL END AS group_name FROM documents"""
)
def image_groups(s, d):
    n = C("doc_id").cast("string")
    name = F.when(C("doc_id") % 4 == 0, F.concat(F.lit("M"), (C("doc_id") + 100).cast("string"), F.lit("_r"), (C("doc_id") % 9).cast("string"), F.lit("_c3"))).when(C("doc_id") % 4 == 1, F.concat(F.lit("thm_dir_N"), n, F.lit("_0012"))).otherwise(F.concat(F.lit("img"), n))
    return docs(s, d).select("doc_id", X.image_group(name).alias("group_name"))


@query("SELECT p_partkey, trunc(p_retailprice)::INT AS cx, trunc(p_retailprice / 3)::INT AS cy, trunc(p_size * 2.161::DOUBLE)::INT AS a, trunc(p_size * 0.5 * 2.161::DOUBLE)::INT AS b, 90 - p_size AS angle FROM part")
def ellipse_parameters(s, d):
    p = R.table(s, d, "part")
    price, size = C("p_retailprice").cast("double"), C("p_size")
    return p.select("p_partkey", P.ellipse(price, price / 3, size, size * 0.5, size).alias("e")).select("p_partkey", "e.*")


@query("SELECT doc_id, round((n_chars % 256) * 0.12 / 255, 9) AS reflectance, n_chars % 5 <> 0 AND n_chars % 256 > 0 AND n_chars % 256 <> 7 AS valid FROM documents")
def pixel_values(s, d):
    px = (C("n_chars") % 256).cast("double")
    return docs(s, d).select("doc_id", F.round(P.reflectance(px), 9).alias("reflectance"), P.is_valid(F.when(C("n_chars") % 5 == 0, float("nan")).otherwise(px), 7.0).alias("valid"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(range(0, len(embedding)), lambda i: CASE WHEN (vec_id + i) % 9 = 0 THEN NULL ELSE embedding[i + 1]::DOUBLE END) AS b FROM embeddings), s AS (SELECT vec_id, b, list_sort(list_filter(b, lambda x: x IS NOT NULL)) AS o FROM v),
      q AS (SELECT vec_id, b, o, (len(o) - 1) * 0.02::DOUBLE AS pa, (len(o) - 1) * 0.98::DOUBLE AS pb FROM s),
      r AS (SELECT vec_id, b, o[floor(pa)::INT + 1] + (o[ceil(pa)::INT + 1] - o[floor(pa)::INT + 1]) * (pa - floor(pa)) AS lo, o[floor(pb)::INT + 1] + (o[ceil(pb)::INT + 1] - o[floor(pb)::INT + 1]) * (pb - floor(pb)) AS hi FROM q)
    SELECT vec_id, list_sum(list_transform(b, lambda x: CASE WHEN x IS NULL OR hi <= lo THEN 0 ELSE floor(least(greatest((x - lo) / (hi - lo), 0), 1) * 255)::INT END))::BIGINT AS total FROM r"""
)
def band_stretch(s, d):
    v = F.transform("embedding", lambda x, i: F.when((C("vec_id") + i) % 9 == 0, float("nan")).otherwise(x.cast("double")))
    return R.table(s, d, "embeddings").select("vec_id", F.aggregate(P.stretch(v), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


PALETTE = {(1, 2, 3): 0, (10, 20, 30): 1, (200, 100, 50): 2}


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS class FROM documents")
def palette_classes(s, d):
    rgb = F.when(C("doc_id") % 4 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).when(C("doc_id") % 4 == 1, F.array(F.lit(10), F.lit(20), F.lit(30))).when(C("doc_id") % 4 == 2, F.array(F.lit(200), F.lit(100), F.lit(50))).otherwise(F.array(F.lit(9), F.lit(9), F.lit(9)))
    return docs(s, d).select("doc_id", P.palette_class(rgb, PALETTE).alias("class"))


@query("SELECT doc_id, 'some-pack-age-' || doc_id AS name, '1.' || doc_id % 7 AS version FROM documents")
def package_names(s, d):
    text = F.concat(F.lit("Some__Pack.-Age_"), C("doc_id").cast("string"), F.lit("==1."), (C("doc_id") % 7).cast("string"))
    return docs(s, d).select("doc_id", X.package(text).alias("p")).select("doc_id", "p.*")


@query(f"SELECT sample_id, len(list_filter(list_concat(target[2 * 8 + 3 : 2 * 8 + 6], target[3 * 8 + 3 : 3 * 8 + 6], target[4 * 8 + 3 : 4 * 8 + 6]), lambda x: x = 1)) AS foreground FROM ({sql('rasters')})")
def crop_roi(s, d):
    box = P.pixel_box(F.array(F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.6)), 8, 8)
    part = P.crop(C("target"), 8, box["top"], box["left"], box["bottom"], box["right"])
    return R.rasters(s, d).select("sample_id", F.size(F.filter(part, lambda x: x == 1)).cast("long").alias("foreground"))


# --- checks and gates ---------------------------------------------------------------------------


@query("SELECT doc_id, 3 AS prefix, doc_id % 3 = 0 AS ended, doc_id % 3 <> 0 AND doc_id % 5 >= 4 AS hit_budget FROM documents")
def sequence_states(s, d):
    steps = (C("doc_id") % 5 + 1).cast("int")
    ids = F.concat(F.array(F.lit(2), F.lit(5), F.lit(6)), F.transform(F.sequence(F.lit(1), steps), lambda k: F.when((k == steps) & (C("doc_id") % 3 == 0), 2).otherwise(7)))
    return docs(s, d).select("doc_id", A.sequence_state(ids, steps, 2, F.lit(5)).alias("x")).select("doc_id", "x.*")


@query("SELECT CASE WHEN doc_id % 21 = 5 THEN 'right_missing' ELSE 'left_missing' END AS rule, lang || '/' || doc_id AS key, CASE WHEN doc_id % 21 = 5 THEN '1/0' ELSE '0/1' END AS detail FROM documents WHERE doc_id % 21 IN (5, 6)")
def key_bijection(s, d):
    flat = docs(s, d).where("doc_id % 21 <> 6").select(F.concat(F.lit("encoder."), "lang", F.lit("."), C("doc_id").cast("string")).alias("name"))
    nested = docs(s, d).where("doc_id % 21 <> 5").select(F.concat(F.lit("model/encoder/"), "lang", F.lit("/"), C("doc_id").cast("string")).alias("name"))
    return A.bijection(flat, F.replace(F.expr("substring(name, 9)"), F.lit("."), F.lit("/")), nested, F.expr("substring(name, 15)"))


TRACKS = "SELECT doc_id AS id, doc_id % 6 AS track, lang AS group_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, sha256(coalesce(text, '')) AS sha FROM documents"


@query(
    f"""WITH t AS ({TRACKS}) SELECT 'track_size' AS rule, track::VARCHAR AS key, 'n=' || count(*) AS detail FROM t GROUP BY track HAVING count(*) <> 34 UNION ALL SELECT 'hash_twice', sha, 'n=' || count(*) FROM t GROUP BY sha HAVING count(*) > 1
    UNION ALL SELECT 'group_crosses', group_id, '' FROM t GROUP BY group_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'total', 'all', 'n=' || count(*) FROM t HAVING count(*) <> 200"""
)
def collection_gates(s, d):
    split = F.when(C("doc_id") % 5 == 0, "test").otherwise("train")
    tracks = docs(s, d).select(C("doc_id").alias("id"), (C("doc_id") % 6).alias("track"), C("lang").alias("group_id"), split.alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return A.collection_gates(tracks, 34, 200)


@query(
    f"""WITH m AS ({sql('manifest')}), e AS (SELECT 'old' AS source, id, group_id, content FROM m WHERE id % 3 = 0 UNION ALL SELECT 'training', id, group_id, content FROM m WHERE split = 'train'),
      l AS (SELECT 'id' AS kind, id::VARCHAR AS value, source FROM e UNION ALL SELECT 'group_id', group_id, source FROM e UNION ALL SELECT 'content', content, source FROM e)
    SELECT kind, value, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM l WHERE value IS NOT NULL GROUP BY kind, value"""
)
def exclusion_sets(s, d):
    m = R.manifest(s, d).select("id", "group_id", "content", "split")
    return A.exclusions({"old": m.where("id % 3 = 0")}, m.where("split = 'train'"))


@query(f"SELECT sample_id, len(list_filter(target, lambda x: x = 1)) AS n_pixels FROM ({sql('rasters')}) WHERE sample_id % 4 <> 1")
def class_presence(s, d):
    """Pixels of a class in the frames that a checkpoint lacks."""
    frames = R.rasters(s, d)
    done = frames.where("sample_id % 4 = 1").select("sample_id")
    return frames.join(done, "sample_id", "left_anti").select("sample_id", F.size(F.filter("target", lambda x: x == 1)).cast("long").alias("n_pixels"))


@query(f"SELECT m.id AS sample_id, m.split AS subset, m.stem AS image, l.quality AS answer FROM ({sql('manifest')}) m JOIN labels l ON l.doc_id = m.id WHERE m.split IN ('val', 'test')")
def evaluation_manifest(s, d):
    kept = R.manifest(s, d).where(C("split").isin("val", "test")).withColumnsRenamed({"id": "sample_id", "split": "subset", "stem": "image"})
    labels = R.table(s, d, "labels").withColumnsRenamed({"doc_id": "sample_id", "quality": "answer"})
    return kept.join(labels, "sample_id").select("sample_id", "subset", "image", "answer")


@query(
    f"""WITH m AS ({sql('manifest')}) SELECT 'feature_missing' AS rule, id::VARCHAR AS key, '' AS detail FROM m WHERE id % 13 = 2 UNION ALL SELECT 'feature_unknown', (-id - 1)::VARCHAR, '' FROM m WHERE id % 17 = 2
    UNION ALL SELECT 'split_or_group_differs', id::VARCHAR, '' FROM m WHERE id % 13 <> 2 AND id % 19 = 2 UNION ALL SELECT 'channels_differ', 'all', '16-32'"""
)
def cache_completeness(s, d):
    m = R.manifest(s, d).select("id", "split", "group_id")
    f = m.where("id % 13 <> 2").withColumn("split", F.when(C("id") % 19 == 2, "lost").otherwise(C("split"))).unionByName(m.where("id % 17 = 2").withColumn("id", -C("id") - 1))
    return A.cache_complete(f.withColumn("channels", F.when(C("id") % 5 == 0, 32).otherwise(16)), m)


@query(
    f"""SELECT image AS sample, instance, CASE WHEN instance % 5 = 4 THEN 'object_missing' WHEN instance % 5 = 3 THEN 'other_build' WHEN image % 3 = 0 THEN 'object_changed' ELSE 'bound' END AS state FROM ({sql('boxes0')})"""
)
def hash_bound_confirmations(s, d):
    b = R.boxes(s, d).select(C("image").alias("sample"), "instance", "box", "human")
    objects = b.where("instance % 5 <> 4").withColumn("build_sha", F.when(C("instance") % 5 == 3, "b").otherwise("a"))
    reviews = b.withColumn("build_sha", F.lit("a")).withColumn("human", F.when(C("sample") % 3 == 0, ~C("human")).otherwise(C("human")))
    return A.confirmations(reviews, objects)


@query(f"SELECT sample_id, true AS same_size, len(list_filter(target, lambda x: x = 255)) = 0 AS binary, len(list_filter(target, lambda x: x = 1)) AS foreground, round(len(list_filter(target, lambda x: x = 1)) / 64.0::DOUBLE, 6) AS fraction FROM ({sql('rasters')})")
def pair_quality(s, d):
    return A.pair_quality(R.rasters(s, d), "sample_id", "height", "target")


@query(
    """SELECT user_id AS control, max(value) FILTER (event_id % 3 = 0) AS base, max(value) FILTER (event_id % 3 = 1) AS cache_off, max(value) FILTER (event_id % 3 = 2) AS template,
      coalesce(max(value) FILTER (event_id % 3 = 0) = max(value) FILTER (event_id % 3 = 1), false) AS verified FROM events GROUP BY user_id"""
)
def pilot_variants(s, d):
    i = C("event_id") % 3
    at = lambda k: F.max(F.when(i == k, C("value")))
    return R.table(s, d, "events").groupBy(C("user_id").alias("control")).agg(at(0).alias("base"), at(1).alias("cache_off"), at(2).alias("template"), F.coalesce(at(0) == at(1), F.lit(False)).alias("verified"))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'binary' WHEN vec_id % 4 = 1 THEN 'classes' END AS contract FROM embeddings"""
)
def artifact_contract(s, d):
    """Which of two contracts, of classes, shape and decision rule, a map keeps."""
    i = C("vec_id")
    shape, rule = F.array(F.when(i % 4 == 2, 2).when(i % 4 == 1, 5).otherwise(1), F.lit(8), F.lit(8)), F.when(i % 4 == 3, "sigmoid").when(i % 4 == 1, "argmax").otherwise("threshold")
    classes = F.when(i % 4 == 1, 5).otherwise(1)
    binary = (classes == 1) & (F.get(shape, 0) == 1) & (rule == "threshold")
    several = (classes > 1) & (F.get(shape, 0) == classes) & (rule == "argmax")
    return R.table(s, d, "embeddings").select("vec_id", F.when(binary, "binary").when(several, "classes").alias("contract"))


@query(f"""WITH f AS ({sql('fact')}), g AS (SELECT task_id, count(*)::DOUBLE AS n_total, count(*) FILTER (correct)::DOUBLE AS n_correct FROM f GROUP BY task_id)
    SELECT task_id, 'n_correct' AS column, n_correct + 1 AS stored, n_correct AS fresh FROM g WHERE task_id = 'en'""")  # fmt: skip
def cached_metrics(s, d):
    fresh = fact(s, d).groupBy("task_id").agg(F.count("*").alias("n_total"), F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"))
    stored = fresh.withColumn("n_correct", C("n_correct") + F.when(C("task_id") == "en", 1).otherwise(0))
    return A.recomputed(stored, fresh, ["task_id"], ["n_total", "n_correct"])


@query("SELECT c.c_custkey AS image, count(o.o_orderkey) AS n_objects, count(o.o_orderkey) = 0 AS empty FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def annotation_counts(s, d):
    """Annotations of each image of a source, images without any included."""
    n = R.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    images = R.table(s, d, "customer").select(C("c_custkey").alias("image"))
    k = F.coalesce("n", F.lit(0))
    return images.join(n, images["image"] == n["o_custkey"], "left").select("image", k.alias("n_objects"), (k == 0).alias("empty"))


@query(
    """SELECT CASE WHEN doc_id % 14 = 3 THEN 'extra/' ELSE 'd/' END || doc_id AS path, CASE WHEN doc_id % 14 = 3 THEN 'extra' WHEN doc_id % 14 = 4 THEN 'missing' WHEN doc_id % 14 = 5 THEN 'changed' ELSE 'verified' END AS state FROM documents"""
)
def bundle_verify(s, d):
    path = lambda p: F.concat(F.lit(p), C("doc_id").cast("string")).alias("path")
    text = F.coalesce("text", F.lit(""))
    sealed = A.hash_manifest(docs(s, d).where("doc_id % 14 <> 3").select(path("d/"), text.alias("content")))
    now = docs(s, d).where("doc_id % 14 not in (3, 4)").select(path("d/"), F.when(C("doc_id") % 14 == 5, F.concat(text, F.lit("!"))).otherwise(text).alias("content"))
    return A.verify_manifest(sealed, now.unionByName(docs(s, d).where("doc_id % 14 = 3").select(path("extra/"), text.alias("content"))))


@query(
    f"""WITH m AS (SELECT *, id % 31 AS n FROM ({sql('manifest')})) SELECT 'stem_blank' AS rule, id::VARCHAR AS key, '' AS detail FROM m WHERE n = 4 UNION ALL SELECT 'few_chars', id::VARCHAR, '' FROM m WHERE n_chars < 10
    UNION ALL SELECT 'group_unlisted', planet, '' FROM m WHERE planet NOT IN ('en', 'de') GROUP BY planet UNION ALL SELECT 'row_count', 'all', 'n=' || count(*) FROM m HAVING count(*) <> 12"""
)
def sealed_build(s, d):
    rows = R.manifest(s, d).select("id", F.when(C("id") % 31 == 4, "").otherwise(C("stem")).alias("stem"), "planet", "n_chars")
    return A.sealed(rows, "id", {"stem_blank": C("stem") != "", "few_chars": C("n_chars") >= 10}, 12, s.createDataFrame([("en",), ("de",)], "planet string"), "planet")


CLAIMS = "SELECT user_id AS job, event_id AS k, CASE WHEN event_id % 4 = 3 THEN 'release' ELSE 'claim' END AS event, event_id % 5 AS worker FROM events"


@query(
    f"""WITH e AS ({CLAIMS}), w AS (SELECT *, event = 'claim' AND coalesce(lag(event) OVER (PARTITION BY job ORDER BY k), 'release') = 'release' AS won FROM e)
    SELECT job, arg_max(event, k) AS state, CASE WHEN arg_max(event, k) <> 'release' THEN arg_max(worker, k) FILTER (won) END AS owner, count(*) FILTER (event = 'claim' AND NOT won) AS n_lost FROM w GROUP BY job"""
)
def queue_claims(s, d):
    i = C("event_id")
    events = R.table(s, d, "events").select(C("user_id").alias("job"), i.alias("k"), F.when(i % 4 == 3, "release").otherwise("claim").alias("event"), (i % 5).alias("worker"))
    return A.claims(events, "job", ["k"])


@query("SELECT status, sum(n) OVER (PARTITION BY status ORDER BY day)::BIGINT AS done, day FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL)")
def progress_counters(s, d):
    """Rows done by day and state, added up: the counters that a run reports on its way."""
    rows = R.table(s, d, "events").groupBy(F.when(C("event_type") == "error", "error").otherwise("ok").alias("status"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rows.select("status", "day", F.sum("n").over(W.partitionBy("status").orderBy("day")).alias("done"))
