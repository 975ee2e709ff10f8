"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashing as H
from ..functions import text as X
from ..operators import audit, evaluate, rasters, runs, scenes, segment, select, stats, validate
from ..sources import manifests
from . import relations as R
from .relations import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
C = F.col


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def fact(s: SparkSession, d: str, run: int = 0) -> DataFrame:
    return evaluate.per_request(R.requests(s, d), R.targets(s, d), R.predictions(s, d, run))


FACT = f"WITH f AS ({sql('fact')}) "
MEASURES = """count(*) AS n_total, count(*) FILTER (correct IS NOT NULL) AS n_scored, count(*) FILTER (correct) AS n_correct, count(*) FILTER (scoring_status = 'valid') AS n_valid,
    count(*) FILTER (scoring_status = 'invalid') AS n_invalid, count(*) FILTER (scoring_status = 'failure') AS n_failure, count(*) FILTER (scoring_status = 'unscored_reference') AS n_unscored,
    round(count(*) FILTER (correct) / nullif(count(*) FILTER (correct IS NOT NULL), 0)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (correct) / nullif(count(*) FILTER (scoring_status = 'valid'), 0)::DOUBLE, 6) AS valid_only_accuracy,
    round(count(*) FILTER (scoring_status = 'valid') / nullif(count(*) FILTER (correct IS NOT NULL), 0)::DOUBLE, 6) AS coverage, round(count(*) FILTER (correct IS NOT NULL) / count(*)::DOUBLE, 6) AS scoring_coverage,
    round(count(*) FILTER (reference_status = 'REFERENCE_READY') / count(*)::DOUBLE, 6) AS reference_coverage"""


# --- evaluation -------------------------------------------------------------------------------


@query(FACT + f"SELECT task_id, condition_id, {MEASURES} FROM f GROUP BY task_id, condition_id")
def eval_slices(s, d):
    return evaluate.slices(fact(s, d), "task_id", "condition_id")


@query(FACT + f"SELECT coalesce(task_id, 'ALL') AS task_id, coalesce(condition_id, 'ALL') AS condition_id, {MEASURES} FROM f GROUP BY GROUPING SETS ((), (task_id, condition_id))")
def eval_overall_and_slices(s, d):
    return evaluate.overall_and_slices(fact(s, d))


@query(FACT + "SELECT request_id, task_id, condition_id, group_id, answer, CASE WHEN scoring_status <> 'invalid' THEN parsed_answer END AS parsed_answer, reference_status, reference_reason, scoring_status, response_status, correct FROM f")
def eval_per_request(s, d):
    return fact(s, d).select("request_id", "task_id", "condition_id", "group_id", "answer", "parsed_answer", "reference_status", "reference_reason", "scoring_status", "response_status", "correct")


CLASSES = FACT + """, e AS (SELECT f.*, l.label FROM f, (VALUES ('YES'), ('NO')) l(label) WHERE correct IS NOT NULL),
    k AS (SELECT task_id, label, count(*) FILTER (answer = label) AS support, count(*) FILTER (answer = label AND coalesce(parsed_answer = label AND scoring_status = 'valid', false)) AS tp,
      count(*) FILTER (answer <> label AND coalesce(parsed_answer = label AND scoring_status = 'valid', false)) AS fp FROM e GROUP BY task_id, label), m AS (SELECT *, support - tp AS fn FROM k) """


@query(CLASSES + "SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM m")
def eval_per_class(s, d):
    return evaluate.per_class(fact(s, d), "task_id")


@query(CLASSES + "SELECT task_id, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE), 6) AS macro_f1, count(*) AS n_classes FROM m WHERE support > 0 GROUP BY task_id")
def eval_macro_f1(s, d):
    return evaluate.macro_f1(evaluate.per_class(fact(s, d), "task_id"), "task_id")


@query(FACT + "SELECT task_id, answer AS truth, CASE WHEN scoring_status = 'valid' THEN parsed_answer ELSE scoring_status END AS predicted, count(*) AS n FROM f WHERE correct IS NOT NULL GROUP BY ALL")
def eval_confusion(s, d):
    return evaluate.confusion(fact(s, d), "task_id")


@query(
    FACT + """, b AS (SELECT condition_id, count(*) FILTER (v AND y AND p) AS tp, count(*) FILTER (v AND NOT y AND p) AS fp, count(*) FILTER (v AND NOT y AND NOT p) AS tn, count(*) FILTER (v AND y AND NOT p) AS fn,
      count(*) FILTER (y) AS n_positive, count(*) FILTER (y AND v) AS n_positive_valid, count(*) FILTER (NOT y) AS n_negative
      FROM (SELECT condition_id, scoring_status = 'valid' AS v, answer = 'YES' AS y, coalesce(parsed_answer = 'YES', false) AS p FROM f WHERE correct IS NOT NULL) GROUP BY condition_id)
    SELECT *, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr, round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS fnr, round(n_positive_valid / nullif(n_positive, 0)::DOUBLE, 6) AS positive_coverage,
      round((n_positive - tp) / nullif(n_positive, 0)::DOUBLE, 6) AS miss_rate_with_failures FROM b"""
)
def eval_binary(s, d):
    return evaluate.binary(fact(s, d), "condition_id")


@query(FACT + """SELECT group_id, CASE WHEN count(*) FILTER (correct IS NOT NULL) = 0 THEN CASE WHEN count(*) FILTER (scoring_status = 'unscored_reference') > 0 THEN 'unscored_reference' ELSE 'unsupported_scoring' END
    WHEN count(DISTINCT task_id) > 1 THEN 'multiple_tasks_use_slices' ELSE 'scored' END AS classification_status, count(*) FILTER (correct IS NOT NULL) AS n_scored FROM f GROUP BY group_id""")  # fmt: skip
def eval_classification_gate(s, d):
    return evaluate.classification_gate(fact(s, d), "group_id")


@query(FACT + "SELECT concat_ws('/', coalesce(group_id, 'unknown'), coalesce(task_id, 'unknown')) AS slice, count(*) AS n_total, count(correct) AS n_scored, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / nullif(count(correct), 0)::DOUBLE, 6) AS accuracy FROM f GROUP BY 1")
def eval_descriptive_slices(s, d):
    key = F.concat_ws("/", F.coalesce("group_id", F.lit("unknown")), F.coalesce("task_id", F.lit("unknown")))
    return fact(s, d).groupBy(key.alias("slice")).agg(F.count("*").alias("n_total"), F.count("correct").alias("n_scored"), F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"), F.round(F.try_divide(F.count_if(F.coalesce("correct", F.lit(False))), F.count("correct")), 6).alias("accuracy"))


@query(
    f"""WITH p AS (SELECT request_id, elapsed_seconds AS sec, status AS st FROM ({sql('predictions')}) UNION ALL SELECT 'r' || doc_id, 1.0, 'ok' FROM documents WHERE doc_id % 61 = 5 UNION ALL SELECT 'x' || doc_id, 1.0, 'ok' FROM documents WHERE doc_id % 90 = 1
      UNION ALL SELECT 'r' || doc_id, -1.0, 'ok' FROM documents WHERE doc_id % 70 = 10 UNION ALL SELECT 'r' || doc_id, 1.0, 'lost' FROM documents WHERE doc_id % 110 = 20)
    SELECT 'prediction_twice' AS rule, request_id AS key, 'n=' || count(*) AS detail FROM p GROUP BY request_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'prediction_unknown', request_id, '' FROM p WHERE request_id NOT IN (SELECT request_id FROM ({sql('requests')}))
    UNION ALL SELECT 'seconds_not_finite', request_id, '' FROM p WHERE sec < 0 UNION ALL SELECT 'status_unknown', request_id, '' FROM p WHERE st = 'lost'"""
)
def eval_violations(s, d):
    """All predictions of a run, with faults planted among them."""
    p = R.predictions(s, d).select("request_id", "elapsed_seconds", "status", "raw_response")
    docs = R.table(s, d, "documents").select("doc_id")
    for fault, lead, seconds, status in (("doc_id % 61 = 5", "r", 1.0, "ok"), ("doc_id % 90 = 1", "x", 1.0, "ok"), ("doc_id % 70 = 10", "r", -1.0, "ok"), ("doc_id % 110 = 20", "r", 1.0, "lost")):
        p = p.union(docs.where(fault).select(F.concat(F.lit(lead), C("doc_id").cast("string")), F.lit(seconds), F.lit(status), F.lit("YES")))
    found = validate.duplicates(p, "request_id", "prediction_twice").union(validate.unmatched(p, R.requests(s, d), "request_id", "prediction_unknown"))
    return found.union(validate.broken(p, "request_id", validate.prediction_rules()))


@query(f"SELECT * FROM (SELECT 'single_valued' AS rule, 'condition_id' AS key, 'n=' || count(DISTINCT condition_id) AS detail, count(DISTINCT condition_id) AS n FROM ({sql('results')}) UNION ALL SELECT 'single_valued', 'status', 'n=' || count(DISTINCT status), count(DISTINCT status) FROM ({sql('results')})) WHERE n > 1".replace("SELECT * FROM (SELECT 'single", "SELECT rule, key, detail FROM (SELECT 'single"))
def metadata_single_valued(s, d):
    return validate.single_valued(R.results(s, d), ["condition_id", "status"])


EVIDENCE_TEXT = "CASE doc_id % 6 WHEN 0 THEN 'ANSWER: yes' || chr(10) || 'EVIDENCE: rim' WHEN 1 THEN 'ANSWER: NO' WHEN 2 THEN '  ANSWER: No' || chr(13) || chr(10) || 'EVIDENCE: ' WHEN 3 THEN 'ANSWER: unsure' || chr(10) || 'EVIDENCE: dark' WHEN 4 THEN 'I say yes' ELSE 'ANSWER:   Maybe so' END"


@query(
    f"""WITH t AS (SELECT doc_id, {EVIDENCE_TEXT} AS x FROM documents), m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'No' WHEN 3 THEN 'unsure' WHEN 5 THEN 'Maybe so' END AS a,
      CASE doc_id % 6 WHEN 0 THEN 'rim' WHEN 2 THEN '' WHEN 3 THEN 'dark' END AS e FROM t)
    SELECT doc_id, CASE upper(a) WHEN 'YES' THEN 'YES' WHEN 'NO' THEN 'NO' END AS parsed_answer, coalesce(upper(a) IN ('YES', 'NO'), false) AS label_valid, coalesce(upper(a) IN ('YES', 'NO') AND e <> '', false) AS format_valid, e AS evidence, coalesce(upper(a) = 'UNSURE', false) AS abstained FROM m"""
)
def label_evidence_parse(s, d):
    text = F.expr(EVIDENCE_TEXT.replace("chr(13) ||", "char(13) ||").replace("chr(10)", "char(10)"))
    docs = R.table(s, d, "documents").select("doc_id", text.alias("x"))
    return docs.select("doc_id", X.label_evidence(C("x"), F.array(F.lit("YES"), F.lit("NO"))).alias("r")).select("doc_id", "r.*")


@query(
    """WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'REFERENCE_READY' WHEN 2 THEN 'CANDIDATE_REFERENCE' END AS declared, CASE doc_id % 5 WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' END AS review, CASE doc_id % 7 WHEN 1 THEN true WHEN 2 THEN false END AS eligible, doc_id % 3 > 0 AS has FROM documents),
    b AS (SELECT *, coalesce(review = 'rejected', false) OR coalesce(NOT eligible, false) AS withheld, coalesce(declared = 'REFERENCE_READY', false) OR coalesce(review = 'accepted', false) OR coalesce(eligible, false) AS admitted FROM a)
    SELECT doc_id, CASE WHEN declared = 'CANDIDATE_REFERENCE' THEN declared WHEN withheld THEN CASE WHEN has THEN 'CANDIDATE_REFERENCE' ELSE 'UNKNOWN_REFERENCE' END WHEN NOT has THEN 'UNKNOWN_REFERENCE' WHEN NOT admitted THEN 'CANDIDATE_REFERENCE' ELSE 'REFERENCE_READY' END AS status,
      CASE WHEN declared = 'CANDIDATE_REFERENCE' THEN 'reference_not_admitted' WHEN withheld THEN 'reference_review_pending_or_withheld' WHEN NOT has THEN 'reference_missing' WHEN NOT admitted THEN 'explicit_crater_reference_admission_required' ELSE 'declared_reference' END AS reason,
      coalesce(declared = 'REFERENCE_READY', false) AND (withheld OR NOT has) AS contradiction FROM b"""
)
def reference_admission(s, d):
    i = C("doc_id")
    declared = F.when(i % 4 == 1, evaluate.READY).when(i % 4 == 2, evaluate.CANDIDATE)
    review, eligible = F.when(i % 5 == 1, "accepted").when(i % 5 == 2, "rejected"), F.when(i % 7 == 1, True).when(i % 7 == 2, False)
    return R.table(s, d, "documents").select(i, evaluate.admission(declared, review, eligible, i % 3 > 0, explicit=True).alias("a")).select("doc_id", "a.*")


# --- variants, runs, experiments --------------------------------------------------------------

CONDITIONS = [("clean", ""), ("shear", "shear"), ("shear+flare", "shear+flare"), ("radiation", "radiation")]


@query(
    """SELECT 's' || doc_id AS sample_id, c AS condition_id, sha256('s' || doc_id || ':' || c) AS child_id, ('0x' || sha256('20261021:s' || doc_id || ':' || split_part(c, '+', 1))[1:8])::BIGINT AS effect_seed
    FROM documents, (VALUES ('clean'), ('shear'), ('shear+flare'), ('radiation')) t(c)"""
)
def condition_variants(s, d):
    sources = R.table(s, d, "documents").select(F.concat(F.lit("s"), C("doc_id").cast("string")).alias("sample_id"))
    conditions = s.createDataFrame(CONDITIONS, "condition_id string, effects string")
    return runs.variants(sources, conditions, 20261021).select("sample_id", "condition_id", "child_id", "effect_seed")


@query(
    """SELECT doc_id, c AS condition_id, CASE WHEN c = 'radiation' AND doc_id % 4 = 0 THEN 'NO' WHEN c = 'radiation' AND doc_id % 4 = 1 THEN NULL WHEN doc_id % 2 = 0 AND list_contains(string_split(c, '+'), 'shear') THEN NULL ELSE 'YES' END AS answer,
      CASE WHEN c = 'radiation' AND doc_id % 4 = 0 THEN true WHEN c = 'radiation' AND doc_id % 4 = 1 THEN false WHEN doc_id % 2 = 0 AND list_contains(string_split(c, '+'), 'shear') THEN false ELSE true END AS known
    FROM documents, (VALUES ('clean'), ('shear'), ('shear+flare'), ('radiation')) t(c)"""
)
def condition_answer_override(s, d):
    i = C("doc_id")
    own = F.when(i % 4 < 2, F.create_map(F.lit("radiation"), F.when(i % 4 == 0, "NO"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = R.table(s, d, "documents").select(i, own.alias("answers")).crossJoin(F.broadcast(s.createDataFrame(CONDITIONS, "condition_id string, effects string")))
    return rows.select(i, "condition_id", runs.condition_answer(C("answers"), C("condition_id"), F.lit("YES"), i % 2 == 0, X.has_effect(C("condition_id"), "shear")).alias("a")).select("doc_id", "condition_id", "a.*")


@query(
    f"""SELECT condition_id, count(*) AS n_responses, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'unsupported') AS n_unsupported,
      round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 6) AS success_rate, round(avg(elapsed_seconds) FILTER (status = 'ok'), 6) AS mean_seconds, round(median(elapsed_seconds) FILTER (status = 'ok'), 6) AS median_seconds
    FROM ({sql('results')}) GROUP BY condition_id"""
)
def run_runtime_stats(s, d):
    return evaluate.runtime_stats(R.results(s, d), "condition_id")


REFERENCES = "SELECT condition_id, count(*) AS n_expected, count(*) FILTER (reference_status = 'REFERENCE_READY') AS n_reference_ready, count(*) FILTER (reference_status <> 'REFERENCE_READY') AS n_unscored_reference, CASE WHEN count(correct) = 0 THEN 'unavailable' WHEN count(*) FILTER (reference_status = 'REFERENCE_READY') < count(*) THEN 'partial' ELSE 'available' END AS quality_status FROM f GROUP BY condition_id"


@query(FACT + REFERENCES)
def run_reference_counts(s, d):
    return evaluate.reference_counts(fact(s, d), "condition_id")


@query(FACT + f", c AS ({REFERENCES}) SELECT CASE condition_id WHEN 'clean' THEN 'E1' ELSE 'E2' END AS experiment, CASE WHEN bool_and(quality_status = 'available') THEN 'available' WHEN bool_or(quality_status IN ('available', 'partial')) THEN 'partial' ELSE 'unavailable' END AS status, count(*) AS n_conditions FROM c GROUP BY 1")
def experiment_status(s, d):
    return evaluate.experiment_status(evaluate.reference_counts(fact(s, d), "condition_id"))


@query(FACT + """, a AS (SELECT condition_id, avg(correct::INT) AS acc, list_sort(list(DISTINCT doc_id // 3)) AS cohort FROM f WHERE correct IS NOT NULL GROUP BY condition_id), b AS (SELECT acc, cohort FROM a WHERE condition_id = 'clean')
    SELECT a.condition_id, round(a.acc, 6) AS accuracy, coalesce(a.cohort = b.cohort, false) AS same_cohort, round(CASE WHEN a.cohort = b.cohort THEN a.acc - b.acc END, 6) AS change_from_clean FROM a LEFT JOIN b ON true""")  # fmt: skip
def change_from_clean(s, d):
    return evaluate.change_from_clean(fact(s, d), F.floor(F.substring("request_id", 2, 20).cast("long") / 3))


SEEDS = "SELECT (event_id % 3)::INT AS seed, CASE event_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'shear' ELSE 'radiation' END AS condition_id, (user_id % 4)::INT AS method, avg(value) AS v FROM events GROUP BY 1, 2, 3"


def seed_reports(s: SparkSession, d: str) -> DataFrame:
    i = C("event_id")
    name = F.when(i % 4 == 0, "clean").when(i % 4 == 1, "shear").otherwise("radiation")
    return R.table(s, d, "events").groupBy((i % 3).cast("int").alias("seed"), name.alias("condition_id"), (C("user_id") % 4).cast("int").alias("method")).agg(F.avg("value").alias("v"))


@query(f"WITH r AS ({SEEDS}) SELECT method, condition_id, count(*) AS n_seeds, round(CASE WHEN count(*) = count(v) THEN avg(v) END, 6) AS mean, round(CASE WHEN count(*) = count(v) THEN stddev_samp(v) END, 6) AS std FROM r GROUP BY method, condition_id")
def seed_mean_std(s, d):
    return segment.mean_std(seed_reports(s, d), "v", "method", "condition_id")


@query(f"WITH r AS ({SEEDS}), x AS (SELECT r.method, r.condition_id, c.v - r.v AS v FROM r LEFT JOIN r c ON c.method = r.method AND c.seed = r.seed AND c.condition_id = 'clean' WHERE r.condition_id <> 'clean') SELECT method, condition_id, count(*) AS n_seeds, round(CASE WHEN count(*) = count(v) THEN avg(v) END, 6) AS mean, round(CASE WHEN count(*) = count(v) THEN stddev_samp(v) END, 6) AS std FROM x GROUP BY method, condition_id")
def clean_minus_condition(s, d):
    return segment.clean_minus_condition(seed_reports(s, d), "v", "method")


@query(f"SELECT run_id, count(DISTINCT condition_id) AS n_keys, (SELECT count(DISTINCT k) <= 1 FROM (SELECT run_id, list_sort(list(DISTINCT condition_id)) AS k FROM ({sql('results')}) GROUP BY run_id)) AS same_cohort FROM ({sql('results')}) GROUP BY run_id")
def cohorts_equal(s, d):
    return audit.cohorts_equal(R.results(s, d), "run_id", "condition_id")


@query(
    f"""WITH l AS ({sql('fact')}), r AS ({sql('fact', 1)}), b AS (SELECT l.group_id, r.correct::INT - l.correct::INT AS x FROM l JOIN r ON l.request_id = r.request_id WHERE l.correct IS NOT NULL AND r.correct IS NOT NULL)
    SELECT group_id, sum(x)::BIGINT AS total, count(*) AS n FROM b GROUP BY group_id"""
)
def paired_group_totals(s, d):
    return stats.paired_totals(fact(s, d), fact(s, d, 1))


@query()
def paired_bootstrap(s, d):
    return stats.paired_bootstrap(stats.paired_totals(fact(s, d), fact(s, d, 1)), seed=7)


@query(f"WITH l AS ({sql('fact')}), r AS ({sql('fact', 1)}) SELECT l.request_id, l.response_status = r.response_status AS same_response_status, l.correct IS NOT DISTINCT FROM r.correct AS same_correct FROM l JOIN r ON l.request_id = r.request_id")
def run_diff(s, d):
    return runs.compare_runs(fact(s, d), fact(s, d, 1), "request_id", ["response_status", "correct"])


@query(f"WITH l AS ({sql('predictions')}), r AS ({sql('predictions', 1)}), a AS (UNPIVOT (SELECT request_id, status, raw_response FROM l) ON status, raw_response INTO NAME path VALUE value), b AS (UNPIVOT (SELECT request_id, status, raw_response FROM r) ON status, raw_response INTO NAME path VALUE value) SELECT request_id, path, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'missing' ELSE 'changed' END AS change FROM a FULL JOIN b USING (request_id, path) WHERE a.value IS DISTINCT FROM b.value")
def structural_diff(s, d):
    flat = lambda run: runs.flatten(R.predictions(s, d, run), "request_id", ["status", "raw_response"])
    return runs.structural_diff(flat(0), flat(1), "request_id")


@query(f"SELECT request_id FROM ({sql('requests')}) WHERE request_id NOT IN (SELECT request_id FROM ({sql('predictions')}))")
def resume_pending(s, d):
    return runs.pending(R.requests(s, d), R.predictions(s, d)).select("request_id")


@query(f"WITH i AS ({sql('predictions', 1)}), t AS (SELECT * FROM ({sql('predictions')}) WHERE substr(request_id, 2)::BIGINT % 2 = 0) SELECT i.request_id, CASE WHEN t.request_id IS NULL THEN 'insert' WHEN i.status = t.status AND i.raw_response = t.raw_response THEN 'skip' ELSE 'mismatch' END AS action FROM i LEFT JOIN t ON i.request_id = t.request_id")
def import_upsert(s, d):
    store = R.predictions(s, d).where(F.substring("request_id", 2, 20).cast("long") % 2 == 0)
    return runs.import_rows(R.predictions(s, d, 1), store, "request_id", ["status", "raw_response"])


@query()
def mock_adapter_run(s, d):
    return runs.run_adapter(R.requests(s, d), lambda: runs.Mock({"r1": "YES"}, "NO"))


# --- audit ------------------------------------------------------------------------------------


@query(f"SELECT content, count(*) AS n, min(id) AS first_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS cross_split FROM ({sql('manifest')}) GROUP BY content HAVING count(*) > 1")
def duplicate_groups(s, d):
    return audit.duplicate_groups(R.manifest(s, d), "content")


@query(f"SELECT a.split, b.split AS other, count(*) AS n_shared FROM (SELECT DISTINCT content, split FROM ({sql('manifest')})) a JOIN (SELECT DISTINCT content, split FROM ({sql('manifest')})) b ON a.content = b.content AND a.split < b.split GROUP BY 1, 2")
def cross_split_groups(s, d):
    return audit.split_intersections(R.manifest(s, d), "content")


RASTER_ROWS = f"SELECT sample_id, scene, CASE sample_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, len(list_filter(target, lambda x: x = 1)) AS foreground, len(list_filter(target, lambda x: x = 0)) AS background FROM ({sql('rasters')})"


def raster_rows(s: SparkSession, d: str) -> DataFrame:
    """Pixels of masks by sample; an image is constant if its own pixels are, whatever its mask is."""
    r = R.rasters(s, d)
    n = lambda k: F.size(F.filter("target", lambda x: x == k)).cast("long")
    i = C("sample_id")
    return r.select(i, C("scene").alias("group_id"), F.when(i % 5 == 3, "val").when(i % 5 == 4, "test").otherwise("train").alias("split"), n(1).alias("foreground"), n(0).alias("background"), (F.array_min("height") == F.array_max("height")).alias("constant"))


@query(f"SELECT split, count(*) AS n_images, sum(foreground)::BIGINT AS foreground, sum(background)::BIGINT AS background, round(sum(foreground) / nullif(sum(foreground) + sum(background), 0)::DOUBLE, 6) AS foreground_fraction, count(*) FILTER (foreground = 0) AS n_empty, 0::BIGINT AS n_constant, count(DISTINCT scene) AS n_groups FROM ({RASTER_ROWS}) GROUP BY split")
def split_audit(s, d):
    return audit.split_statistics(raster_rows(s, d))


@query(
    f"""WITH m AS ({sql('manifest')}), c AS (SELECT count(*) AS n FROM (SELECT content FROM m GROUP BY content HAVING count(DISTINCT split) > 1)), g AS (SELECT count(*) AS n FROM (SELECT group_id FROM m GROUP BY group_id HAVING count(DISTINCT split) > 1))
    SELECT c.n AS cross_split_duplicates, g.n AS cross_split_groups, CASE WHEN c.n > 0 OR g.n > 0 THEN 'review_required' ELSE 'passed' END AS verdict FROM c, g"""
)
def audit_verdict(s, d):
    m = R.manifest(s, d)
    crossed = lambda key, name: m.groupBy(key).agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias(name))
    both = crossed("content", "cross_split_duplicates").crossJoin(F.broadcast(crossed("group_id", "cross_split_groups")))
    return both.withColumn("verdict", F.when((C("cross_split_duplicates") > 0) | (C("cross_split_groups") > 0), "review_required").otherwise("passed"))


BITS = f"""WITH o AS ({sql('bits0')}), h AS (SELECT vec_id AS id, 'train' AS split, b, label FROM o UNION ALL SELECT vec_id + 1000000000, 'test', list_transform(range(0, 64), lambda i: CASE WHEN i < vec_id % 4 THEN 1 - b[i + 1] ELSE b[i + 1] END), label FROM o),
    t AS (SELECT id, split, label, list_aggregate(b[1:22], 'string_agg', '') AS p0, list_aggregate(b[23:43], 'string_agg', '') AS p1, list_aggregate(b[44:64], 'string_agg', '') AS p2, list_aggregate(b, 'string_agg', '') AS whole FROM h),
    k AS (SELECT *, 0 AS n, p0 AS part FROM t UNION ALL SELECT *, 1, p1 FROM t UNION ALL SELECT *, 2, p2 FROM t) """


@query(BITS + "SELECT DISTINCT a.id AS a, b.id AS b, hamming(a.whole, b.whole)::INT AS distance FROM k a JOIN k b ON a.n = b.n AND a.part = b.part AND a.id < b.id WHERE hamming(a.whole, b.whole) BETWEEN 1 AND 2")
def near_duplicates(s, d):
    return audit.near_pairs(R.hashes(s, d))


PRIOR = "SELECT *, 's' || (id % 1000000000 % 300) AS stem, whole AS content FROM t"


def hashed_cohorts(s: SparkSession, d: str, number: str = "id % 1000000000 div 2") -> tuple[DataFrame, DataFrame]:
    """Current and prior rows; stems have the ``number`` of a row, moved by fifty for current ones."""
    h = R.hashes(s, d).select("id", "split", C("label").cast("string").alias("group_id"), "bits", F.concat(F.lit("s"), (F.expr(number) + F.when(C("split") == "train", 0).otherwise(50)).cast("string")).alias("stem"), C("bits").alias("content"), (C("id") % 1_000_000_000 % 400).alias("file"))
    return h.where("split = 'test'"), h.where("split = 'train'")


COHORTS = BITS + ", c AS (SELECT id, split, label::VARCHAR AS group_id, whole, n, part, 's' || (id % 1000000000 // 2 + CASE split WHEN 'train' THEN 0 ELSE 50 END) AS stem, id % 1000000000 % 400 AS file FROM k), cur AS (SELECT * FROM c WHERE split = 'test'), old AS (SELECT * FROM c WHERE split = 'train')"


@query(
    COHORTS.replace("// 2 +", "% 300 +") + """, j AS (SELECT DISTINCT a.id, b.id AS prior_id, 'source_id_overlap' AS reason FROM cur a JOIN old b ON a.stem = b.stem AND a.n = b.n UNION SELECT DISTINCT a.id, b.id, 'decoded_pixels_overlap' FROM cur a JOIN old b ON a.whole = b.whole AND a.n = b.n
      UNION SELECT DISTINCT a.id, b.id, 'near_duplicate_review' FROM cur a JOIN old b ON a.n = b.n AND a.part = b.part WHERE a.whole <> b.whole AND hamming(a.whole, b.whole) <= 2)
    SELECT id, prior_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM j GROUP BY id, prior_id"""
)
def prior_overlap(s, d):
    current, prior = hashed_cohorts(s, d, "id % 1000000000 % 300")  # three hundred stems, however many rows
    return audit.prior_overlap(current, prior)


@query(
    COHORTS + """, x AS (SELECT DISTINCT a.id, b.id AS prior, a.stem = b.stem AS st, a.whole = b.whole AS co, hamming(a.whole, b.whole) <= 2 AND a.whole <> b.whole AS ne FROM cur a JOIN old b ON a.n = b.n AND (a.stem = b.stem OR a.part = b.part))
    SELECT c.id, count(*) FILTER (st) AS n_stem, count(*) FILTER (co) AS n_content, count(*) FILTER (ne) AS n_near FROM (SELECT DISTINCT id FROM cur) c LEFT JOIN x ON x.id = c.id GROUP BY c.id"""
)
def prior_overlap_counts(s, d):
    return audit.overlap_counts(*hashed_cohorts(s, d))


@query(
    COHORTS + """, e AS (SELECT * FROM old WHERE id % 3 = 0) SELECT DISTINCT a.id, CASE WHEN a.stem IN (SELECT stem FROM e) THEN 'source_id_overlap' WHEN a.group_id IN (SELECT group_id FROM e WHERE id % 400 = 0) THEN 'scene_group_overlap' WHEN a.file IN (SELECT file FROM e) THEN 'file_hash_overlap' WHEN a.whole IN (SELECT whole FROM e) THEN 'decoded_pixels_overlap'
      WHEN a.id IN (SELECT x.id FROM cur x JOIN e y ON x.n = y.n AND x.part = y.part WHERE hamming(x.whole, y.whole) <= 2) THEN 'near_duplicate_dhash' END AS reason FROM cur a"""
)
def exclusion_reason(s, d):
    current, prior = hashed_cohorts(s, d)
    e = prior.where("id % 3 = 0").withColumn("group_id", F.when(C("id") % 400 == 0, C("group_id")))
    return audit.exclusion_reason(current, e)


@query(f"WITH m AS ({sql('manifest')}), t AS (SELECT * FROM m WHERE split = 'train') SELECT id FROM m WHERE split <> 'train' AND (content IN (SELECT content FROM t) OR stem IN (SELECT stem FROM t))")
def train_overlap(s, d):
    m = R.manifest(s, d)
    return audit.overlap_any(m.where("split <> 'train'"), m.where("split = 'train'"), ("content", "stem"))


@query(f"WITH m AS ({sql('manifest')}) SELECT id, EXISTS (SELECT 1 FROM m t WHERE t.split = 'train' AND t.planet = m.planet AND t.group_id = m.group_id) AS in_training FROM m WHERE split <> 'train'")
def train_group_flag(s, d):
    m = R.manifest(s, d)
    return audit.flag_groups(m.where("split <> 'train'"), m.where("split = 'train'"), ["planet", "group_id"]).select("id", "in_training")


@query(f"WITH m AS ({sql('manifest')}) SELECT DISTINCT content FROM m WHERE split = 'test' AND content NOT IN (SELECT content FROM m WHERE split <> 'test')")
def test_not_exposed(s, d):
    m = R.manifest(s, d)
    return audit.keys_missing(m.where("split = 'test'"), m.where("split <> 'test'"), "content")


@query(f"WITH m AS ({sql('manifest')}) SELECT content FROM m WHERE split = 'train' INTERSECT SELECT content FROM m WHERE split = 'test'")
def keys_in_both_splits(s, d):
    m = R.manifest(s, d)
    return audit.keys_in_both(m.where("split = 'train'"), m.where("split = 'test'"), "content")


@query("SELECT 0::BIGINT AS n_twice, count(*) FILTER (doc_id % 10 = 9) AS n_missing, 0::BIGINT AS n_extra FROM documents")
def exact_partition(s, d):
    docs = R.table(s, d, "documents").select("doc_id")
    parts = docs.where("doc_id % 10 < 5").union(docs.where("doc_id % 10 between 5 and 8"))
    return audit.exact_partition(parts, docs, "doc_id")


@query("SELECT concat_ws('/', lang, source, CASE doc_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END) AS key, count(*) AS n FROM documents GROUP BY 1")
def composite_counts(s, d):
    return R.manifest(s, d).groupBy(F.concat_ws("/", "planet", "group_id", "split").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH m AS ({sql('manifest')}) SELECT split, count(*) AS n, count(DISTINCT content) AS n_contents, count(DISTINCT group_id) AS n_groups, round(avg(n_chars), 6) AS mean_chars FROM m GROUP BY split")
def cohort_audit(s, d):
    return R.manifest(s, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("content").alias("n_contents"), F.count_distinct("group_id").alias("n_groups"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query()
def manifest_fingerprint(s, d):
    return manifests.fingerprint(R.targets(s, d))


# --- selection --------------------------------------------------------------------------------


@query(f"SELECT id, group_id FROM ({sql('manifest')}) ORDER BY sha256('study:' || id), id LIMIT 100")
def hash_topk(s, d):
    m = R.manifest(s, d).withColumn("key", C("id").cast("string"))
    return select.hash_topk(m, 100, "study", "key").select("id", "group_id")


@query(f"SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY sha256('study:' || id), id)::INT AS turn, sha256('study:' || group_id) AS group_key FROM ({sql('manifest')})")
def spread_round_robin(s, d):
    return select.round_robin(R.manifest(s, d), "group_id", [H.hash_order("study", C("id").cast("string")), C("id")], H.hash_order("study", C("group_id"))).select("id", "group_id", "turn", "group_key")


@query(f"WITH m AS ({sql('manifest')}), k AS (SELECT * FROM m WHERE split = 'train' AND content NOT IN (SELECT content FROM m WHERE split <> 'train')) SELECT id, planet, turn FROM (SELECT id, planet, row_number() OVER (PARTITION BY planet ORDER BY n_chars, id)::INT AS turn FROM k) WHERE turn <= 20")
def zone_round_robin(s, d):
    m = R.manifest(s, d)
    kept = m.where("split = 'train'").join(m.where("split <> 'train'").select("content"), "content", "left_anti")
    return select.round_robin(kept, "planet", [C("n_chars"), C("id")], C("planet"), taken=20).select("id", "planet", "turn")


@query(f"WITH m AS (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n FROM ({sql('manifest')})) SELECT id, group_id, i::INT AS i FROM m WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda j: round_even(j * (n - 1) / 6.0::DOUBLE, 0)::BIGINT), i)")
def evenly_spaced(s, d):
    return select.evenly_spaced(R.manifest(s, d), "group_id", "id", 7).select("id", "group_id", C("i").cast("int").alias("i"))


@query("WITH c AS (SELECT l_orderkey AS anchor, l_partkey AS candidate, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY anchor, candidate % 50 ORDER BY score DESC, candidate) AS r FROM c), g AS (SELECT anchor, candidate, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, candidate)::INT AS rank FROM f WHERE r = 1) SELECT * FROM g WHERE rank <= 3")
def top3_distinct(s, d):
    c = R.table(s, d, "lineitem").groupBy(C("l_orderkey").alias("anchor"), C("l_partkey").alias("candidate")).agg(F.max("l_quantity").alias("score"))
    return select.top_distinct(c, "anchor", C("candidate") % 50, [C("score").desc(), C("candidate")])


@query(f"SELECT run_id, max(result_id) AS result_id, arg_max(status, result_id) AS status FROM ({sql('results')}) GROUP BY run_id")
def latest_analysis(s, d):
    return select.latest(R.results(s, d).select("run_id", "result_id", "status"), "run_id", "result_id")


@query(f"SELECT result_id, run_id FROM ({sql('results')}) WHERE status = 'ok' ORDER BY ts, result_id LIMIT 1")
def queue_head(s, d):
    return R.results(s, d).where("status = 'ok'").orderBy("ts", "result_id").limit(1).select("result_id", "run_id")


@query(f"SELECT result_id, run_id, status FROM ({sql('results')}) WHERE status = 'ok' ORDER BY result_id LIMIT 50 OFFSET 100")
def page(s, d):
    return select.page(R.results(s, d).where("status = 'ok'"), ["result_id"], 50, 100).select("result_id", "run_id", "status")


@query(f"SELECT group_id, id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, id) AS r FROM ({sql('manifest')})) WHERE r = 1")
def priority_dedupe(s, d):
    p = F.when(C("split") == "test", 0).when(C("split") == "val", 1).otherwise(2)
    return select.priority_first(R.manifest(s, d), "group_id", p, [C("id")]).select("group_id", "id", "n_chars")


@query(f"SELECT group_id, id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n_chars, id) AS r, count(*) OVER (PARTITION BY group_id) AS n FROM ({sql('manifest')})) WHERE r = n // 2 + 1")
def group_middle(s, d):
    return select.middle(R.manifest(s, d), "group_id", ["n_chars", "id"]).select("group_id", "id")


@query("WITH c AS (SELECT l_returnflag AS flag, l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY flag ORDER BY v) AS cum, sum(c) OVER (PARTITION BY flag) AS total FROM c) SELECT flag, min(v) AS median, max(total)::BIGINT AS n FROM r WHERE 2 * cum >= total GROUP BY flag")
def histogram_median(s, d):
    return select.histogram_median(R.table(s, d, "lineitem").select(C("l_returnflag").alias("flag"), C("l_quantity").alias("v")), "flag", "v")


@query(
    """WITH e AS (SELECT user_id AS run, event_id AS step, value AS v FROM events), b AS (SELECT *, max(v) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM e),
    i AS (SELECT *, best IS NULL OR v > best + 1e-8 AS improved FROM b), w AS (SELECT *, k - max(CASE WHEN improved THEN k END) OVER (PARTITION BY run ORDER BY step) AS wait FROM i) SELECT run, step, improved, wait::INT AS wait, wait >= 8 AS stop FROM w"""
)
def early_stopping(s, d):
    e = R.table(s, d, "events").select(C("user_id").alias("run"), C("event_id").alias("step"), C("value").alias("v"))
    return select.early_stopping(e, "run", "step", "v").select("run", "step", "improved", "wait", "stop")


@query("WITH s AS (SELECT (event_id % 9)::INT AS threshold, round(avg(value), 6) AS score FROM events GROUP BY 1) SELECT threshold, score FROM s ORDER BY score DESC, threshold LIMIT 1")
def threshold_select(s, d):
    grid = R.table(s, d, "events").groupBy((C("event_id") % 9).cast("int").alias("threshold")).agg(F.round(F.avg("value"), 6).alias("score"))
    return segment.threshold_select(grid)


@query("SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || sha256('q' || doc_id)[i * 8 + 1 : i * 8 + 8])::BIGINT)), lambda a, w: (a * 4294967296 + w) % 7)::BIGINT AS question FROM documents")
def question_policy(s, d):
    return R.table(s, d, "documents").select("doc_id", H.digest_modulo(F.concat(F.lit("q"), C("doc_id").cast("string")), F.lit(7).cast("long")).alias("question"))


@query()
def proportional_quotas(s, d):
    sizes = R.manifest(s, d).groupBy("group_id").agg(F.count("*").alias("n"))
    return select.proportional_quotas(sizes, "group_id", "n", 200, 12)


# --- masks ------------------------------------------------------------------------------------

MASKS = f"""WITH r AS ({sql('rasters')}), z AS (SELECT sample_id, scene, list_zip(target, predicted) AS p FROM r),
    c AS (SELECT sample_id, scene, len(list_filter(p, lambda x: x[1] = 1 AND x[2] = 1)) AS tp, len(list_filter(p, lambda x: x[1] = 0 AND x[2] = 1)) AS fp, len(list_filter(p, lambda x: x[1] = 1 AND x[2] = 0)) AS fn, len(list_filter(p, lambda x: x[1] <> 255)) AS valid, len(list_filter(p, lambda x: x[1] = 255)) AS ignored FROM z),
    m AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp + fn)::DOUBLE END AS iou, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS dice, tp + fn = 0 AS empty_target FROM c) """


def masks(s: SparkSession, d: str) -> DataFrame:
    return segment.per_image(R.rasters(s, d)).drop("height")


@query(MASKS + "SELECT sample_id, scene, tp, fp, fn, valid, ignored, round(iou, 6) AS iou, round(dice, 6) AS dice, empty_target FROM m")
def mask_counts(s, d):
    return masks(s, d).withColumns({"iou": F.round("iou", 6), "dice": F.round("dice", 6)})


@query(MASKS + ", i AS (SELECT scene, avg(iou) AS i, avg(dice) AS d, sum(iou) AS s, count(*) AS n FROM m GROUP BY scene) SELECT round(avg(i), 6) AS scene_iou, round(avg(d), 6) AS scene_dice, round(sum(s) / sum(n), 6) AS image_iou, count(*) AS n_scenes FROM i")
def scene_macro(s, d):
    return segment.scene_macro(masks(s, d))


@query(MASKS + "SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / sum(tp + fp + fn)::DOUBLE, 6) AS iou, round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS recall FROM m")
def pooled_iou(s, d):
    return segment.pooled(masks(s, d))


@query(f"WITH z AS (SELECT unnest(target) AS t, unnest(predicted) AS p FROM ({sql('rasters')})), k AS (SELECT c AS class, count(*) FILTER (t = c AND p = c) AS x, count(*) FILTER (t = c OR p = c) AS y, count(*) FILTER (t = c) + count(*) FILTER (p = c) AS w FROM z, (VALUES (0), (1)) v(c) WHERE t <> 255 GROUP BY c) SELECT class, x AS both, y AS either, round(x / nullif(y, 0)::DOUBLE, 6) AS iou, round(2 * x / nullif(w, 0)::DOUBLE, 6) AS dice FROM k")
def pixel_confusion(s, d):
    return segment.pixel_confusion(R.rasters(s, d))


@query(MASKS + "SELECT scene, count(*) AS n_images, round(avg(iou), 6) AS mean_iou, round(sum(tp) / nullif(sum(tp + fp + fn), 0)::DOUBLE, 6) AS pooled_iou, count(*) FILTER (empty_target) AS n_empty FROM m GROUP BY scene")
def scene_breakdown(s, d):
    return segment.scene_breakdown(masks(s, d))


@query(MASKS + "SELECT scene::VARCHAR AS scene, round(avg(iou), 6) AS value FROM m GROUP BY scene")
def scene_means(s, d):
    return masks(s, d).groupBy(C("scene").cast("string").alias("scene")).agg(F.round(F.avg("iou"), 6).alias("value"))


@query()
def scene_bootstrap(s, d):
    return stats.scene_bootstrap(masks(s, d).groupBy("scene").agg(F.avg("iou").alias("value")))


@query()
def seed_then_scene(s, d):
    """Mean over seeds of an image first, then scenes."""
    m = masks(s, d).withColumn("image", C("sample_id") % 100)
    return stats.scene_bootstrap(m.groupBy("scene", "image").agg(F.avg("iou").alias("v")).groupBy("scene").agg(F.avg("v").alias("value")))


@query("WITH x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(avg(x * x) - avg(x) * avg(x)), 6) AS std, round(least(20.0, (count(*) - count(*) FILTER (x > 0)) / nullif(count(*) FILTER (x > 0), 0)::DOUBLE), 6) AS positive_weight FROM x")
def train_norm(s, d):
    return segment.train_normalisation(R.table(s, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("v")), "v")


@query(f"WITH g AS (SELECT group_id, count(*) AS n FROM ({sql('manifest')}) GROUP BY group_id) SELECT group_id, n, round((SELECT sum(n) FROM g) / ((SELECT count(*) FROM g) * n)::DOUBLE, 6) AS weight FROM g")
def group_weights(s, d):
    return segment.group_weights(R.manifest(s, d), "group_id")


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS class, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS probability FROM embeddings")
def softmax_argmax(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return R.table(s, d, "embeddings").select("vec_id", segment.argmax(v).alias("class"), F.round(F.array_max(segment.softmax(v)), 6).alias("probability"))


@query("SELECT a.vec_id, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS max_abs, round(sqrt(list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 5) AS rms FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def array_compare(s, d):
    e = R.table(s, d, "embeddings")
    far = e.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("q"))
    diff = F.zip_with("embedding", "q", lambda a, b: a.cast("double") - b.cast("double"))
    rms = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x * x) / F.size(diff))
    return e.join(far, "vec_id").select("vec_id", F.round(F.array_max(F.transform(diff, F.abs)), 6).alias("max_abs"), F.round(rms, 5).alias("rms"))


@query(f"SELECT sample_id, round(len(list_filter(list_zip(target, predicted), lambda x: x[1] <> x[2])) / 64.0::DOUBLE, 6) AS changed, len(list_filter(list_zip(target, predicted), lambda x: x[1] <> x[2])) / 64.0 <= 0.001 AS repeatable FROM ({sql('rasters')})")
def repeatability(s, d):
    r = R.rasters(s, d)
    n = F.size(F.filter(F.zip_with("target", "predicted", lambda a, b: a != b), lambda x: x)) / F.size("target")
    return r.select("sample_id", F.round(n, 6).alias("changed"), (n <= 0.001).alias("repeatable"))


# --- scenes -----------------------------------------------------------------------------------


@query(f"SELECT image, instance, eligible, cell, half, size_proxy FROM ({sql('boxes')})")
def box_geometry(s, d):
    return R.boxes(s, d).select("image", C("instance").cast("long").alias("instance"), "eligible", "cell", "half", "size_proxy")


@query(
    f"""WITH b AS (SELECT * FROM ({sql('boxes')}) WHERE eligible), p AS (SELECT a.image, a.instance AS i, b.instance AS j, greatest(least(a.x1 + a.size, b.x1 + b.size) - greatest(a.x1, b.x1), 0) * greatest(least(a.y1 + a.size, b.y1 + b.size) - greatest(a.y1, b.y1), 0) AS x, a.size * a.size + b.size * b.size AS y
      FROM b a JOIN b ON a.image = b.image AND a.instance < b.instance AND NOT (a.human AND b.human)) SELECT image, i::INT AS i, j::INT AS j, round(x / (y - x), 6) AS iou FROM p WHERE x / (y - x) >= 0.5"""
)
def box_overlaps(s, d):
    return scenes.overlaps(R.boxes(s, d))


@query(
    f"""WITH b AS (SELECT * FROM ({sql('boxes')}) WHERE eligible), m AS (SELECT *, size_proxy >= 0.95 * max(size_proxy) OVER (PARTITION BY image) AS near FROM b)
    SELECT image, 'YES' AS q1, CASE WHEN bool_or(cell = 5) THEN 'YES' ELSE 'NO' END AS q2, CASE WHEN count(DISTINCT cell) FILTER (near) = 1 THEN (min(cell) FILTER (near))::VARCHAR ELSE 'TIE' END AS q3,
      CASE WHEN sum(CASE half WHEN 'LEFT' THEN 1 ELSE -1 END) > 0 THEN 'LEFT' WHEN sum(CASE half WHEN 'LEFT' THEN 1 ELSE -1 END) < 0 THEN 'RIGHT' ELSE 'TIE' END AS q4 FROM m GROUP BY image"""
)
def q1_q4_answers(s, d):
    return scenes.definite_answers(R.boxes(s, d).where("eligible"))


@query()
def world_invariance(s, d):
    return scenes.world_invariance(R.boxes(s, d).where("eligible").withColumn("uncertain", C("human")))


HEIGHT_CELL = "CASE WHEN k // 8 >= 5 THEN 2 WHEN k // 8 >= 2 THEN 1 ELSE 0 END * 3 + CASE WHEN k % 8 >= 5 THEN 2 WHEN k % 8 >= 2 THEN 1 ELSE 0 END"


@query(
    f"""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS h, unnest(range(0, 64)) AS k FROM embeddings), v AS (SELECT *, NOT (vec_id % 7 = 0 AND k = 0) AS ok, {HEIGHT_CELL} AS cell FROM p),
    c AS (SELECT vec_id, cell, avg(h) FILTER (ok) AS mean, avg(ok::INT) AS cover, min(h) FILTER (ok) AS lo, max(h) FILTER (ok) AS hi FROM v GROUP BY 1, 2),
    g AS (SELECT vec_id, max(mean) FILTER (cell = 0) AS a, max(mean) FILTER (cell = 8) AS b, max(cover) FILTER (cell = 0) AS ca, max(cover) FILTER (cell = 8) AS cb, min(cover) AS cv, min(mean) AS low, max(hi) - min(lo) AS span FROM c GROUP BY 1),
    l AS (SELECT c.vec_id, count(*) AS n, min(c.cell) AS cell FROM c JOIN g ON c.vec_id = g.vec_id WHERE c.mean - g.low <= 1e-6 * g.span GROUP BY 1)
    SELECT g.vec_id, CASE WHEN ca >= 0.95 AND cb >= 0.95 THEN CASE WHEN abs(a - b) <= 1e-6 * span THEN 'TIE' WHEN a > b THEN 'A' ELSE 'B' END END AS height_pair, CASE WHEN cv >= 0.95 THEN CASE WHEN n = 1 THEN (l.cell + 1)::VARCHAR ELSE 'TIE' END END AS height_lowest FROM g JOIN l ON g.vec_id = l.vec_id"""
)
def height_grid(s, d):
    e = R.table(s, d, "embeddings")
    valid = F.transform("embedding", lambda v, k: F.when((C("vec_id") % 7 == 0) & (k == 0), 0).otherwise(1))
    return scenes.height_answers(e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("height"), valid.alias("valid")), "vec_id", 8, 8)


@query("WITH c AS (SELECT o_custkey AS k, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY k) AS m, sum(n) OVER (PARTITION BY k) AS total FROM c) SELECT k AS image, CASE WHEN count(*) FILTER (n = m) = 1 AND max(m) >= 0.5 * max(total) THEN max(v) FILTER (n = m) ELSE 'MIXED' END AS answer, max(total)::BIGINT AS total FROM m GROUP BY k")
def dominant_class(s, d):
    return scenes.dominant_class(R.table(s, d, "orders").select(C("o_custkey").alias("image"), C("o_orderstatus").alias("v")), "image", "v")


# --- joins and shapes -------------------------------------------------------------------------


@query("SELECT l_orderkey AS stem, count(*) FILTER (l_returnflag = 'A') AS rgb, count(*) FILTER (l_returnflag = 'N') AS depth FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0")
def modality_match(s, d):
    li = R.table(s, d, "lineitem").select(C("l_orderkey").alias("stem"), "l_returnflag")
    return li.groupBy("stem").pivot("l_returnflag", ["A", "N"]).count().where("A is not null and N is not null").select("stem", C("A").alias("rgb"), C("N").alias("depth"))


@query("WITH p AS (SELECT user_id, event_id // 20 AS seq, min(ts) FILTER (event_id % 2 = 0) AS l, min(ts) FILTER (event_id % 2 = 1) AS r FROM events GROUP BY 1, 2) SELECT user_id, seq::BIGINT AS seq, abs(epoch_us(r) - epoch_us(l)) / 1000000.0::DOUBLE AS delta_seconds FROM p WHERE l IS NOT NULL AND r IS NOT NULL")
def pair_pivot(s, d):
    e = R.table(s, d, "events").select("user_id", F.expr("event_id div 20").alias("seq"), F.when(C("event_id") % 2 == 0, "L").otherwise("R").alias("eye"), F.unix_micros(C("ts").cast("timestamp")).alias("us"))
    p = e.groupBy("user_id", "seq").pivot("eye", ["L", "R"]).min("us").where("L is not null and R is not null")
    return p.select("user_id", "seq", (F.abs(C("R") - C("L")) / 1000000).alias("delta_seconds"))


@query("SELECT conv_id, string_agg(t || '=' || r, ';' ORDER BY t, r) AS tasks, count(DISTINCT t) = 4 AND count(*) = 4 AS complete FROM (SELECT DISTINCT conv_id, turn::VARCHAR AS t, role AS r FROM conversations) GROUP BY conv_id")
def task_map(s, d):
    c = R.table(s, d, "conversations").select("conv_id", C("turn").cast("string").alias("t"), C("role").alias("r"))
    return runs.task_maps(c, "conv_id", "t", "r", 4)


@query("WITH j AS (SELECT doc_id, sha256(text) AS l FROM documents WHERE doc_id % 10 <> 0), f AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE sha256(text) END AS r FROM documents WHERE doc_id % 10 <> 1) SELECT doc_id, CASE WHEN l IS NULL THEN 'not_in_journal' WHEN r IS NULL THEN 'file_missing' ELSE 'hash_differs' END AS problem FROM j FULL JOIN f USING (doc_id) WHERE l IS DISTINCT FROM r")
def journal_check(s, d):
    docs = R.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    found = docs.where("doc_id % 10 <> 1").withColumn("sha", F.when(C("doc_id") % 13 == 0, "x").otherwise(C("sha")))
    return runs.journal_check(docs.where("doc_id % 10 <> 0"), found, "doc_id")


@query("WITH c AS (SELECT o_orderkey AS anchor, unnest([o_custkey, o_custkey + 1, o_custkey * 2]) AS candidate, unnest([1, 2, 3]) AS rank FROM orders) SELECT anchor, candidate, rank, c_acctbal AS size FROM c JOIN customer ON candidate = c_custkey WHERE c_acctbal > 0")
def candidate_flatten(s, d):
    o = R.table(s, d, "orders").select(C("o_orderkey").alias("anchor"), F.posexplode(F.array(C("o_custkey"), C("o_custkey") + 1, C("o_custkey") * 2)).alias("k", "candidate"))
    c = R.table(s, d, "customer").select(C("c_custkey").alias("candidate"), C("c_acctbal").alias("size")).where("size > 0")
    return o.join(c, "candidate").select("anchor", "candidate", (C("k") + 1).alias("rank"), "size")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, lang) AS image FROM documents")
def field_fallback(s, d):
    return R.table(s, d, "documents").select("doc_id", F.coalesce(F.when(C("doc_id") % 3 == 0, C("source")), C("lang")).alias("image"))


REVIEW = f"WITH b AS (SELECT image, instance, size FROM ({sql('boxes0')})), k AS (SELECT image, instance, CASE WHEN image % 9 = 0 AND instance = 2 THEN 99.0 ELSE size END AS size, 'source' AS origin FROM b WHERE NOT (image % 5 = 0 AND instance = 1) UNION ALL SELECT image, 1000, 10.0, 'review' FROM b WHERE image % 100 = 0 AND instance = 1) "


@query(REVIEW + "SELECT image, instance::BIGINT AS instance, size::DOUBLE AS size, origin FROM k")
def review_apply(s, d):
    """Reviewed boxes in one pass: what a review drops, changes or adds beside a box."""
    b = R.boxes(s, d).select("image", C("instance").cast("long").alias("instance"), (F.get("box", 2) - F.get("box", 0)).alias("size"))
    row = lambda instance, size, origin: F.struct(instance.alias("instance"), size.alias("size"), F.lit(origin).alias("origin"))
    image, one = C("image"), C("instance") == 1
    size = F.when((image % 9 == 0) & (C("instance") == 2), 99.0).otherwise(C("size"))
    both = F.array(F.when(~((image % 5 == 0) & one), row(C("instance"), size, "source")), F.when((image % 100 == 0) & one, row(F.lit(1000).cast("long"), F.lit(10.0), "review")))
    return b.select("image", F.explode(F.array_compact(both)).alias("x")).select("image", "x.*")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plain' ELSE 'evidence' END AS first_mode, t AS task_id, 'Question ' || t || ' about ' || source || '.' AS prompt FROM documents, (VALUES ('a'), ('b')) v(t)")
def paired_requests(s, d):
    tasks = s.createDataFrame([("a",), ("b",)], "task_id string")
    docs = R.table(s, d, "documents").select("doc_id", "source").crossJoin(F.broadcast(tasks))
    return docs.select("doc_id", F.when(C("doc_id") % 2 == 0, "plain").otherwise("evidence").alias("first_mode"), "task_id", F.format_string("Question %s about %s.", "task_id", "source").alias("prompt"))


@query("SELECT group_id, id AS best_id FROM (SELECT source AS group_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY (n_chars BETWEEN 1000 AND 3000) DESC, n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def best_in_range(s, d):
    m = R.manifest(s, d)
    inside = C("n_chars").between(1000, 3000)
    best = lambda c: F.max_by("id", F.struct(C("n_chars"), -C("id"))) if c is None else F.max_by("id", F.when(c, F.struct(C("n_chars"), -C("id"))))
    return m.groupBy("group_id").agg(F.coalesce(best(inside), best(None)).alias("best_id"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)/?$', 1), '\\.[^.]*$', ''), '^moon_wac_(train|val|test)_', '')) AS stem FROM pages")
def page_stems(s, d):
    url = F.regexp_replace("url", r"/$", "")
    return R.table(s, d, "pages").select("page_id", X.source_stem(url).alias("stem"))


@query("SELECT doc_id, '\"' || replace(CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN '''' || x ELSE x END, '\"', '\"\"') || '\"' AS cell FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN 'a\"b' WHEN 2 THEN '-' ELSE '' END || text AS x FROM documents)")
def csv_export_cells(s, d):
    i = C("doc_id")
    lead = F.when(i % 4 == 0, "=").when(i % 4 == 1, 'a"b').when(i % 4 == 2, "-").otherwise("")
    return R.table(s, d, "documents").select(i, X.csv_cell(F.concat(lead, "text")).alias("cell"))


@query(f"WITH m AS ({sql('manifest')}) SELECT id, CASE WHEN n_chars < 300 THEN 'insufficient_valid_annotation' WHEN group_id = 'src3' THEN 'excluded_group' WHEN split = 'train' THEN 'split_not_evaluated' END AS reason FROM m")
def coverage_reasons(s, d):
    return validate.reasons(R.manifest(s, d), "id", [("insufficient_valid_annotation", C("n_chars") < 300), ("excluded_group", C("group_id") == "src3"), ("split_not_evaluated", C("split") == "train")])


@query(f"SELECT id, group_id FROM ({sql('manifest')}) WHERE planet = 'en' AND split IN ('val', 'test') AND n_chars BETWEEN 500 AND 5000")
def eligibility_filter(s, d):
    out = R.manifest(s, d)
    for p in (C("planet") == "en", C("split").isin("val", "test"), C("n_chars").between(500, 5000)):
        out = out.where(p)
    return out.select("id", "group_id")


@query("SELECT condition_id, count(*) AS completed, count(*) FILTER (status = 'ok' AND elapsed_seconds > 50) AS budget_hits, round_even(100.0 * count(*) FILTER (status = 'ok') / count(*), 2)::DOUBLE AS percent FROM (" + sql("results") + ") GROUP BY condition_id")
def mode_tallies(s, d):
    ok = C("status") == "ok"
    return R.results(s, d).groupBy("condition_id").agg(F.count("*").alias("completed"), F.count_if(ok & (C("elapsed_seconds") > 50)).alias("budget_hits"), F.bround(100 * F.count_if(ok) / F.count("*"), 2).alias("percent"))


# --- rasters ----------------------------------------------------------------------------------


def _effect(name: str, strength: float) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        grid = R.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v.cast("double") + 1) / 2).alias("g"))
        return rasters.apply_grid(grid, "vec_id", "g", 8, 8, name, strength)

    run.__name__ = f"raster_{name}"
    return run


for _name, _strength in (("shear", 0.8), ("shadow", 0.5), ("flare", 0.6), ("radiation", 0.4)):
    query()(_effect(_name, _strength))


@query("WITH p AS (SELECT vec_id, unnest(embedding) > 0 AS x, unnest(range(0, 64)) AS k FROM embeddings) SELECT a.vec_id, (a.k // 8)::INT AS y, (a.k % 8)::INT AS x, count(*) FILTER (b.x) AS n FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.k // 8 BETWEEN a.k // 8 AND a.k // 8 + 2 AND b.k % 8 BETWEEN a.k % 8 AND a.k % 8 + 2 WHERE a.k // 8 <= 5 AND a.k % 8 <= 5 GROUP BY 1, 2, 3")
def window_counts(s, d):
    """3 x 3 window counts from a double running sum: four corners of the integral image."""
    p = R.table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", F.expr("k div 8").cast("int").alias("y"), (C("k") % 8).alias("x"), (C("v") > 0).cast("long").alias("m"))
    row = W.partitionBy("vec_id", "y").orderBy("x")
    box = W.partitionBy("vec_id", "x").orderBy("y")
    three = p.withColumn("a", F.sum("m").over(row.rowsBetween(0, 2))).withColumn("n", F.sum("a").over(box.rowsBetween(0, 2)))
    return three.where("x <= 5 and y <= 5").select("vec_id", "y", "x", "n")


from . import assembly, rules, surveying  # noqa: E402, F401  register their queries
