"""Registered queries of rules on runs, responses and labelled regions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, runs, scenes, segment, select, validate
from ..operators.hot import ordered
from ..sources.shared import Scratch
from . import relations as R
from .catalogue import FACT, REFERENCES, C, fact, query, sql


@query(
    FACT + f""", c AS ({REFERENCES}), e AS (SELECT 'E1' AS experiment, bool_and(quality_status = 'available') AS a, bool_or(quality_status IN ('available', 'partial')) AS p, count(*) AS n FROM c WHERE condition_id = 'clean')
    SELECT experiment, CASE WHEN a THEN 'available' WHEN p THEN 'partial' ELSE 'unavailable' END AS status, n AS n_conditions FROM e UNION ALL SELECT 'E2', 'not_selected', 0"""
)
def experiment_status_selected(s, d):
    """A run of the clean condition alone: E2 isn't selected."""
    clean = evaluate.reference_counts(fact(s, d).where("condition_id = 'clean'"), "condition_id")
    return evaluate.experiment_status(clean, ("E1", "E2"))


@query(
    f"""WITH l AS ({sql('fact')}), r AS ({sql('fact', 1)}), b AS (SELECT l.request_id, l.response_status = 'ok' AND r.response_status = 'ok' AS ok, l.parsed_answer IS NOT DISTINCT FROM r.parsed_answer AS sa, l.correct IS NOT DISTINCT FROM r.correct AS sc FROM l JOIN r ON l.request_id = r.request_id)
    SELECT request_id, ok AS both_ok, CASE WHEN ok THEN sa END AS same_parsed_answer, CASE WHEN ok THEN sc END AS same_correct FROM b"""
)
def run_diff_ok(s, d):
    return runs.compare_runs(fact(s, d), fact(s, d, 1), "request_id", ["parsed_answer", "correct"], ok="response_status = 'ok'")


ANALYSES = f"SELECT run_id, result_id, 'v' || (result_id % 3) AS signature FROM ({sql('results')})"


@query(f"""WITH a AS ({ANALYSES}), m AS (SELECT run_id, max(result_id) AS result_id, arg_max(signature, result_id) AS signature FROM a GROUP BY run_id), u AS (SELECT DISTINCT user_id AS run_id FROM events UNION SELECT -1)
    SELECT u.run_id, m.result_id, coalesce(m.signature = 'v' || (u.run_id % 3), false) AS valid FROM u LEFT JOIN m ON m.run_id = u.run_id""")  # fmt: skip
def latest_valid_analysis(s, d):
    """Analyses of runs whose results may have changed since: the newest counts if its signature is the run's."""
    analyses = R.results(s, d).select("run_id", "result_id", F.concat(F.lit("v"), (C("result_id") % 3).cast("string")).alias("signature"))
    now = R.table(s, d, "events").select(C("user_id").cast("long").alias("run_id")).union(s.range(1).select(F.lit(-1).cast("long"))).distinct()
    now = now.withColumn("signature", F.concat(F.lit("v"), (C("run_id") % 3).cast("string")))
    return select.latest_valid(analyses, "run_id", "result_id", "signature", now)


@query(
    f"""WITH a AS (SELECT request_id FROM ({sql('requests')}) WHERE doc_id % 45 <> 7), b AS (SELECT request_id FROM ({sql('predictions')}))
    SELECT 'response_missing' AS rule, request_id AS key, '' AS detail FROM a WHERE request_id NOT IN (SELECT request_id FROM b) UNION ALL SELECT 'request_unknown', request_id, '' FROM b WHERE request_id NOT IN (SELECT request_id FROM a)"""
)
def request_response_match(s, d):
    requests = R.requests(s, d).where("cast(substring(request_id, 2) as long) % 45 <> 7")
    return validate.one_to_one(requests, R.predictions(s, d), "request_id", "response_missing", "request_unknown")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT doc_id, t AS task_id, CASE WHEN (i + k) % 2 = m THEN 0 ELSE 1 END AS step, CASE m WHEN 0 THEN 'closed' ELSE 'evidence' END AS mode FROM o, (VALUES ('q1', 0), ('q2', 1), ('q3', 2), ('q4', 3)) v(t, k), (VALUES (0), (1)) w(m)"""
)
def evidence_requests(s, d):
    """Two requests for each sample and task; which goes first alternates with the numbers of sample and task."""
    samples = ordered(R.table(s, d, "documents").select("doc_id"), ["doc_id"], Scratch(s, "evidence"), "samples", "i")
    tasks = F.array(*(F.struct(F.lit(f"q{k + 1}").alias("task_id"), F.lit(k).alias("k")) for k in range(4)))
    each = samples.select("doc_id", "i", F.explode(tasks).alias("t")).select("doc_id", "i", "t.*")
    first = (C("i") + C("k")) % 2 == 0
    modes = F.when(first, F.array(F.lit("closed"), F.lit("evidence"))).otherwise(F.array(F.lit("evidence"), F.lit("closed")))
    return each.select("doc_id", "task_id", F.posexplode(modes).alias("step", "mode"))


@query(
    f"""WITH p AS (SELECT 'closed' AS mode, * FROM ({sql('fact')}) UNION ALL SELECT 'evidence', * FROM ({sql('fact', 1)})),
    r AS (SELECT mode, request_id, response_status = 'ok' AS ok, parsed_answer AS label, scoring_status = 'valid' AS fine, elapsed_seconds > 5 AS hit FROM p WHERE response_status <> 'missing'),
    c AS (SELECT request_id FROM r GROUP BY request_id HAVING bool_and(coalesce(ok AND label IS NOT NULL, false)) AND min(label) <> max(label))
    SELECT mode, count(*) AS completed, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND label IS NOT NULL) AS valid_labels, count(*) FILTER (ok AND fine) AS valid_formats, count(*) FILTER (ok AND hit) AS budget_hits, count(c.request_id) AS changed_pairs
    FROM r LEFT JOIN c ON c.request_id = r.request_id GROUP BY mode"""
)
def format_tallies(s, d):
    one = lambda mode, run: fact(s, d, run).where("response_status <> 'missing'").select(
        F.lit(mode).alias("mode"), "request_id", C("response_status").alias("status"), C("parsed_answer").alias("label"), (C("scoring_status") == "valid").alias("format_valid"), (C("elapsed_seconds") > 5).alias("hit_budget")
    )
    return evaluate.format_tallies(one("closed", 0).unionByName(one("evidence", 1)), "mode", "request_id")


@query(
    """WITH p AS (SELECT o_custkey AS image, (o_orderkey % 7)::INT AS v FROM orders), c AS (SELECT image, v, CASE v WHEN 0 THEN 'sand' WHEN 1 THEN 'sand' WHEN 2 THEN 'rock' WHEN 3 THEN 'bedrock' WHEN 4 THEN 'sky' END AS c FROM p),
    n AS (SELECT image, c, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY image, c), t AS (SELECT image, max(n) AS top, max(c) FILTER (n = m) AS winner, count(*) FILTER (n = m) AS winners FROM (SELECT *, max(n) OVER (PARTITION BY image) AS m FROM n) GROUP BY image),
    q AS (SELECT image, count(c) AS valid, count(*) AS total, bool_or(v = 6 AND image % 4 = 0) AS bad, count(*) FILTER (c IN ('rock', 'bedrock')) AS rocks FROM c GROUP BY image),
    z AS (SELECT q.*, CASE WHEN bad THEN 'unmapped_label' WHEN valid = 0 OR valid < 0.5 * total THEN 'insufficient_valid_annotation' END AS reason, CASE WHEN winners = 1 AND top >= 0.5 * valid THEN winner ELSE 'MIXED' END AS ter FROM q LEFT JOIN t ON t.image = q.image)
    SELECT image, valid, total, CASE WHEN reason IS NULL AND valid = total THEN ter END AS terrain, CASE WHEN reason IS NULL AND rocks >= 2 THEN 'YES' WHEN reason IS NULL AND valid = total THEN 'NO' END AS presence, reason FROM z"""
)
def class_answers(s, d):
    """Labels 5 and 6 are ignored; on every fourth image label 6 is one that nobody knows."""
    v = (C("o_orderkey") % 7).cast("int")
    pixels = R.table(s, d, "orders").select(C("o_custkey").alias("image"), F.when((v == 6) & (C("o_custkey") % 4 == 0), 77).otherwise(v).alias("v"))
    return scenes.class_answers(pixels, "image", "v", {0: "sand", 1: "sand", 2: "rock", 3: "bedrock", 4: "sky"}, (5, 6), ("rock", "bedrock"), 0.5, 0.5, 2)


@query(
    """WITH e AS (SELECT label, embedding::DOUBLE[] AS v, len(list_filter(embedding, lambda x: x > 0.05)) AS fg FROM embeddings), w AS (SELECT least(20.0, sum(b) / sum(f)) AS w FROM (SELECT sum(fg) / count(*)::DOUBLE AS f, sum(64 - fg) / count(*)::DOUBLE AS b FROM e GROUP BY label)),
    x AS (SELECT c, unnest(v[c * 16 + 1 : c * 16 + 16]) AS x FROM (SELECT v, unnest(range(0, 4)) AS c FROM e))
    SELECT c::INT AS channel, count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-12)), 6) AS std, round((SELECT w FROM w), 6) AS positive_weight FROM x GROUP BY c"""
)
def train_channel_norm(s, d):
    """Vectors as four channels of sixteen pixels; labels are the groups."""
    e = R.table(s, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    fg = F.size(F.filter("v", lambda x: x > F.lit(0.05).cast("float").cast("double")))
    per, weight = segment.channel_statistics(e.withColumns({"fg": fg, "bg": 64 - fg}), "v", 4, "label", "fg", "bg")
    return per.crossJoin(F.broadcast(weight)).select("channel", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "positive_weight")))  # one row of weight
