"""Registered queries of stereo partners, bounded picks and image hashes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, images, picks, stereo
from ..sources import annotations
from ..sources.shared import Scratch
from . import relations as R
from .catalogue import C, query, sql

# --- stereo partners ----------------------------------------------------------------------------


#: Pairs of frames whose coverage one task finds.
PAIRS = 1000


def frames(s, d):
    """A camera frame for each vector: places on a grid of 25 cm, axes about one direction."""
    e = lambda i: F.get("embedding", F.lit(i - 1)).cast("double")
    v = R.table(s, d, "embeddings").withColumns({"ay": e(4), "az": e(5), "k": e(6) / 20})
    v = v.withColumn("n", F.sqrt(1 + C("ay") * C("ay") + C("az") * C("az"))).withColumn("m", F.sqrt(1 + C("ay") * C("ay")))
    three = lambda *x: F.array(*(F.lit(i).cast("double") if isinstance(i, int | float) else i for i in x))
    axis = three(1 / C("n"), C("ay") / C("n"), C("az") / C("n"))
    v = v.withColumns({"A": axis, "right": three(-C("ay") / C("m"), 1 / C("m"), 0)})
    a, r = (lambda i: F.get("A", F.lit(i))), (lambda i: F.get("right", F.lit(i)))
    v = v.withColumn("down", three(a(1) * r(2) - a(2) * r(1), a(2) * r(0) - a(0) * r(2), a(0) * r(1) - a(1) * r(0)))
    image = lambda to, centre: F.zip_with(to, "A", lambda x, y: 800 * x + centre * y)
    return v.select(
        C("vec_id").alias("id"), F.expr("vec_id div 100").alias("sol"), F.concat(F.lit("SITE_"), (C("label") % 2).cast("string")).alias("frame"), F.when(C("vec_id") % 2 == 0, "L").otherwise("R").alias("eye"),
        F.timestamp_seconds(F.lit(1_700_000_000) + C("vec_id") * 37).alias("start"), C("label").cast("string").alias("sequence"), three(*(F.floor(e(i) * 8) / 4 for i in (1, 2, 3))).alias("C"),
        "A", image("right", 600).alias("H"), image("down", 500).alias("V"), C("A").alias("O"), three(0, C("k"), 0).alias("R"), F.lit(1200).alias("width"), F.lit(1000).alias("height"),
    )


FRAMES = """WITH f AS (SELECT vec_id AS id, vec_id // 100 AS sol, 'SITE_' || (label % 2) AS frame, vec_id % 2 = 0 AS l, vec_id * 37 AS t, label AS q, floor(embedding[1]::DOUBLE * 8) / 4 AS x, floor(embedding[2]::DOUBLE * 8) / 4 AS y,
      floor(embedding[3]::DOUBLE * 8) / 4 AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v FROM embeddings),
    p AS (SELECT a.sol, a.frame, a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS far, abs(a.t - b.t)::DOUBLE AS dt, a.q = b.q AS same,
      (1 + a.u * b.u + a.v * b.v) / sqrt((1 + a.u * a.u + a.v * a.v) * (1 + b.u * b.u + b.v * b.v)) AS c, a.frame = b.frame AS framed FROM f a JOIN f b ON a.sol = b.sol AND a.l AND NOT b.l) """


@query(FRAMES + """, s AS (SELECT sol, frame, l, x, y, z, min(id) AS station, count(*) AS n FROM f GROUP BY ALL)
    SELECT a.sol, a.frame, a.station AS "left", b.station AS "right", a.n AS n_left, b.n AS n_right, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS baseline_m
    FROM s a JOIN s b ON a.sol = b.sol AND a.frame = b.frame AND a.l AND NOT b.l WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) BETWEEN 0.15 AND 0.4""")  # fmt: skip
def stereo_stations(s, d):
    return stereo.station_pairs(stereo.stations(frames(s, d))).withColumn("baseline_m", F.round("baseline_m", 6))


def judged(s, d):
    rows = frames(s, d)
    places = stereo.stations(rows)
    return stereo.frame_pairs(rows, stereo.station_pairs(places), stereo.members(rows, places))


@query(FRAMES + """SELECT sol, a AS "left", b AS "right", round(far, 6) AS baseline_m, dt AS time_delta_seconds, same AS same_sequence, round(degrees(acos(greatest(-1, least(1, c)))), 4) AS optical_axis_separation_deg
    FROM p WHERE framed AND far BETWEEN 0.15 AND 0.4""")  # fmt: skip
def stereo_pairs(s, d):
    return judged(s, d).withColumns({"baseline_m": F.round("baseline_m", 6), "optical_axis_separation_deg": F.round("optical_axis_separation_deg", 4)})


@query(FRAMES + """SELECT unnest(['coordinate_frame_mismatch', 'baseline_outside_gate', 'baseline_in_gate']) AS reason,
    unnest([count(*) FILTER (NOT framed), count(*) FILTER (framed AND far NOT BETWEEN 0.15 AND 0.4), count(*) FILTER (framed AND far BETWEEN 0.15 AND 0.4)]) AS n FROM p""")  # fmt: skip
def stereo_gate_counts(s, d):
    places = stereo.stations(frames(s, d))
    return stereo.pair_counts(places, stereo.station_pairs(places))


@query(FRAMES + """, e AS (SELECT sol, q, max(id) FILTER (l) AS a, max(id) FILTER (NOT l) AS b FROM f GROUP BY sol, q HAVING count(*) FILTER (l) > 0 AND count(*) FILTER (NOT l) > 0)
    SELECT e.sol, e.q::VARCHAR AS sequence, e.a AS "left", e.b AS "right", abs(x.t - y.t)::DOUBLE AS time_delta_seconds, x.frame = y.frame AS same_frame, CASE WHEN x.frame = y.frame THEN round(far, 6) END AS baseline_m,
      CASE WHEN x.frame = y.frame THEN round(degrees(acos(greatest(-1, least(1, c)))), 4) END AS optical_axis_separation_deg FROM e JOIN f x ON x.id = e.a JOIN f y ON y.id = e.b JOIN p ON p.a = e.a AND p.b = e.b""")  # fmt: skip
def eye_pairs(s, d):
    return stereo.eye_pairs(frames(s, d)).withColumns({"baseline_m": F.round("baseline_m", 6), "optical_axis_separation_deg": F.round("optical_axis_separation_deg", 4)})


@query()
def stereo_partners(s, d):
    rows, scratch = frames(s, d), Scratch(s, "partners")
    pairs = scratch.write(judged(s, d), "pairs")
    covered = stereo.coverage(pairs, rows, pairs.count() // PAIRS + 1).drop("left_by_distance", "right_by_distance")
    return stereo.best_partners(rows, scratch.write(covered, "covered"))  # read by each part of the ranking


PRODUCTS = """WITH n AS (SELECT doc_id AS i, lpad((doc_id % 40)::VARCHAR, 4, '0') || CASE doc_id % 2 WHEN 0 THEN 'ML' ELSE 'MR' END AS h, lpad((doc_id // 3 % 50)::VARCHAR, 4, '0') AS s, lpad((doc_id % 7)::VARCHAR, 3, '0') AS c FROM documents),
    w AS (SELECT DISTINCT h || s || c || '000E' || (i % 3) || '_DXXX' AS name, h || s || c || '000' AS capture, h || '00' || s || c AS legacy FROM n WHERE i % 4 = 0),
    a AS (SELECT DISTINCT CASE WHEN i % 8 = 0 THEN h || s || c || '000E0' || (i % 5) || '_DXXX' ELSE h || '00' || s || c || '12345E01_DXXX' END AS archived, CASE WHEN i % 8 = 0 THEN h || s || c || '000' ELSE h || '00' || s || c || '12345' END AS capture FROM n) """


@query(PRODUCTS + """SELECT name, archived, 'same_capture_other_compression_version' AS hypothesis FROM w JOIN a ON w.capture = a.capture
    UNION SELECT name, archived, 'legacy_short_id_sequence_command_hypothesis' FROM w JOIN a ON a.archived[1:15] = w.legacy AND a.capture <> w.capture""")  # fmt: skip
def product_hypotheses(s, d):
    """Short names as benchmarks give them, lower-cased here, against an archive's long and short ones."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    i = C("doc_id")
    head, seq, command = F.concat(pad(i % 40, 4), F.when(i % 2 == 0, "ml").otherwise("mr")), pad(F.expr("doc_id div 3 % 50"), 4), pad(i % 7, 3)
    docs = R.table(s, d, "documents").select("doc_id")
    wanted = docs.where("doc_id % 4 = 0").select(F.concat(head, seq, command, F.lit("000e"), (i % 3).cast("string"), F.lit("_dxxx")).alias("name")).distinct()
    short, long = F.concat(head, seq, command, F.lit("000E0"), (i % 5).cast("string"), F.lit("_DXXX")), F.concat(head, F.lit("00"), seq, command, F.lit("12345E01_DXXX"))
    archive = docs.select(F.when(i % 8 == 0, short).otherwise(long).alias("name")).distinct()
    return stereo.name_hypotheses(wanted.select(F.upper("name").alias("name")), archive.select(F.upper("name").alias("name")))


# --- bounded picks ------------------------------------------------------------------------------

#: Rounds of a sequential rule: in each, every track takes the row that {order} puts first of those not taken yet.
ROUNDS = """, p(t, k, ids, gs, bs, xs, ys) AS (SELECT DISTINCT t, 0, []::BIGINT[], []::VARCHAR[], []::BIGINT[], []::DOUBLE[], []::DOUBLE[] FROM m UNION ALL
      SELECT t, k + 1, list_append(ids, id), list_append(gs, g), list_append(bs, b), list_append(xs, x), list_append(ys, y)
      FROM (SELECT p.*, m.id, m.g, m.b, m.x, m.y, row_number() OVER (PARTITION BY p.t ORDER BY {order}) AS r FROM p JOIN m ON m.t = p.t WHERE p.k < {k} AND NOT list_contains(p.ids, m.id)) WHERE r = 1),
    w AS (SELECT DISTINCT t, id, pick FROM (SELECT t, unnest(ids) AS id, unnest(range(0, len(ids))) AS pick FROM p)) """

BALANCE = f"""WITH RECURSIVE v AS (SELECT * FROM ({sql("manifest")}) WHERE split = 'test'), q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM v),
    m AS (SELECT planet AS t, id, group_id AS g, ((n_chars >= q.a)::INT + (n_chars >= q.b)::INT + (n_chars >= q.c)::INT)::BIGINT AS b, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, sha256('balance:' || id) AS h FROM v, q)"""
BALANCE += ROUNDS.format(k=12, order="len(list_filter(p.gs, lambda z: z = m.g)), len(list_filter(p.bs, lambda z: z = m.b)), m.h")


@query(BALANCE + "SELECT w.id, m.g AS group_id, m.b AS bin, w.t AS planet, w.pick FROM w JOIN m ON m.t = w.t AND m.id = w.id")
def greedy_balance(s, d):
    m = R.manifest(s, d).where("split = 'test'").select("id", "group_id", "n_chars", F.sha2(F.concat(F.lit("balance:"), C("id").cast("string")), 256).alias("h"), "planet")
    edges = picks.quantile_edges(m, "n_chars", [0.25, 0.5, 0.75], Scratch(s, "balance"))
    return picks.balanced(picks.with_bins(m, "n_chars", edges).drop("n_chars"), "planet", 12).drop("h")


FAR = f"""WITH RECURSIVE v AS (SELECT id, planet AS t, (n_chars % 101)::DOUBLE AS x, (id % 89)::DOUBLE AS y FROM ({sql("manifest")}) WHERE split = 'test'),
    a AS (SELECT t, min(x) AS ax, greatest(max(x) - min(x), 1e-12) AS bx, min(y) AS ay, greatest(max(y) - min(y), 1e-12) AS by_ FROM v GROUP BY t),
    m AS (SELECT v.t, id, '' AS g, 0::BIGINT AS b, (x - ax) / bx AS x, (y - ay) / by_ AS y FROM v JOIN a ON a.t = v.t)"""
FAR += ROUNDS.format(k=8, order="""CASE WHEN p.k = 0 THEN sha256(m.id::VARCHAR) END, list_min(list_transform(range(1, len(p.xs) + 1), lambda j: (m.x - p.xs[j]) * (m.x - p.xs[j]) + (m.y - p.ys[j]) * (m.y - p.ys[j]))) DESC, m.id::VARCHAR DESC""")


@query(FAR + "SELECT t AS planet, id::VARCHAR AS id, pick FROM w")
def farthest_points(s, d):
    m = R.manifest(s, d).where("split = 'test'").select("id", "planet", (C("n_chars") % 101).alias("x"), (C("id") % 89).alias("y"))
    return picks.farthest(m, "planet", "id", "x", "y", 8, Scratch(s, "far"))


CRATERS = """WITH RECURSIVE e AS (SELECT vec_id AS id, vec_id // 40 AS g, 'set' || (vec_id % 2) AS t, embedding::DOUBLE[] AS v FROM embeddings),
    c AS (SELECT *, [len(list_filter(v, lambda z: z > 0.1 AND z <= 0.25)), len(list_filter(v, lambda z: z > 0.25)), len(list_filter(v, lambda z: z < -0.1 AND z >= -0.25)), len(list_filter(v, lambda z: z < -0.25))] AS n FROM e),
    m AS (SELECT t, id, g::VARCHAR AS g, len(list_filter(n, lambda z: z > 0)) AS b, list_min(list_filter(n, lambda z: z > 0))::DOUBLE AS x, 0.0::DOUBLE AS y, n FROM c WHERE list_max(n) > 0)"""
CRATERS += ROUNDS.format(k=12, order="m.b DESC, len(list_filter(p.gs, lambda z: z = m.g)), m.x DESC, sha256(m.id::VARCHAR)")
CRATER_LABELS = ["rim", "floor", "ejecta", "shadow"]


def crater_masks(s, d):
    """Masks of four labels: which of them a vector's entries show, and on how many pixels."""
    e = R.table(s, d, "embeddings")
    value = F.transform("embedding", lambda v: v.cast("double"))
    n = lambda rule: F.size(F.filter("v", rule))
    counts = [n(lambda z: (z > 0.1) & (z <= 0.25)), n(lambda z: z > 0.25), n(lambda z: (z < -0.1) & (z >= -0.25)), n(lambda z: z < -0.25)]
    rows = e.select("vec_id", value.alias("v")).select("vec_id", *(c.alias(name) for c, name in zip(counts, CRATER_LABELS, strict=True)))
    labels = F.filter(F.array(*(F.when(C(name) > 0, F.lit(name)) for name in CRATER_LABELS)), lambda x: x.isNotNull())
    least = F.array_min(F.array(*(F.when(C(name) > 0, C(name)) for name in CRATER_LABELS)))
    track, scene = F.concat(F.lit("set"), (C("vec_id") % 2).cast("string")), F.expr("vec_id div 40")
    return rows.select(C("vec_id").alias("id"), track.alias("track"), scene.alias("scene"), labels.alias("labels"), least.alias("least"), F.sha2(C("vec_id").cast("string"), 256).alias("h"))


@query(CRATERS + "SELECT w.t AS track, w.id, w.pick, m.g::BIGINT AS scene, m.b AS n_labels, m.x::BIGINT AS least FROM w JOIN m ON m.t = w.t AND m.id = w.id")
def best_first_masks(s, d):
    return picks.best_first(crater_masks(s, d), "track").select("track", "id", "pick", "scene", "n_labels", C("least").cast("long").alias("least"))


@query(CRATERS + f""", l AS (SELECT w.t, unnest({CRATER_LABELS}) AS label, unnest(m.n) AS px FROM w JOIN m ON m.t = w.t AND m.id = w.id)
    SELECT t AS track, label, count(*) FILTER (px > 0) AS n, count(*) FILTER (px > 0) >= 10 AS enough FROM l GROUP BY t, label""")  # fmt: skip
def best_first_support(s, d):
    return picks.label_support(picks.best_first(crater_masks(s, d), "track"), "track", CRATER_LABELS)


# --- images -------------------------------------------------------------------------------------

_WEIGHTS = [[int(v) for v in row] for row in images.reduction(8, 9)]
PICTURES = f"""WITH c AS (SELECT vec_id AS id, vec_id, embedding::DOUBLE[] AS e, false AS copy FROM embeddings UNION ALL SELECT vec_id + 1000000000, vec_id, embedding::DOUBLE[], true FROM embeddings),
    v AS (SELECT id, list_transform(range(0, 192), lambda k: CASE WHEN copy AND (k // 3) % 8 = 3 AND k // 24 < vec_id % 4 THEN 0 ELSE greatest(0, least(255, floor(128 + 256 * e[((k // 3 + [0, 7, 13][k % 3 + 1]) % 64) + 1])))::BIGINT END) AS p FROM c),
    l AS (SELECT id, p, list_transform(range(0, 64), lambda i: (19595 * p[3 * i + 1] + 38470 * p[3 * i + 2] + 7471 * p[3 * i + 3] + 32768) >> 16) AS g FROM v),
    s AS (SELECT id, p, list_transform(range(0, 72), lambda k: (list_sum(list_transform(range(0, 8), lambda x: {_WEIGHTS}[k % 9 + 1][x + 1] * g[k // 9 * 8 + x + 1]))::BIGINT + 2097152) >> 22) AS r FROM l),
    b AS (SELECT id, p, list_transform(range(0, 64), lambda i: CASE WHEN r[i // 8 * 9 + i % 8 + 2] > r[i // 8 * 9 + i % 8 + 1] THEN 1 ELSE 0 END) AS bits FROM s) """


def pictures(s, d):
    """8 x 8 pictures of vectors, and copies with up to three pixels made black."""
    e = R.table(s, d, "embeddings")
    both = e.select(C("vec_id").alias("id"), "vec_id", "embedding", F.lit(False).alias("copy")).unionByName(e.select((C("vec_id") + 1_000_000_000).alias("id"), "vec_id", "embedding", F.lit(True).alias("copy")))
    byte = lambda i, shift: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * F.get("embedding", (i + shift) % 64).cast("double"))))), 2, "0")
    pixel = lambda i: F.when(C("copy") & (i % 8 == 3) & (F.floor(i / 8) < C("vec_id") % 4), "000000").otherwise(F.concat(byte(i, 0), byte(i, 7), byte(i, 13)))
    return both.select("id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel), "")).alias("pixels"))


@query(PICTURES + """SELECT id, sha256(unhex('28382C203829' || array_to_string(list_transform(p, lambda z: lpad(hex(z), 2, '0')), ''))) AS pixels_sha256,
    array_to_string(list_transform(range(0, 16), lambda k: substring('0123456789abcdef', (8 * bits[64 - 4 * k] + 4 * bits[63 - 4 * k] + 2 * bits[62 - 4 * k] + bits[61 - 4 * k])::INT + 1, 1)), '') AS dhash FROM b""")  # fmt: skip
def image_signatures(s, d):
    return images.signatures(pictures(s, d)).select("id", "pixels_sha256", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("dhash"))


@query(PICTURES + """, k AS (SELECT list_sum(list_transform(range(0, 64), lambda i: bits[i + 1]::HUGEINT << i))::UBIGINT AS h, id FROM b), q AS (SELECT h, min(id) AS i, count(*) AS n FROM k GROUP BY h)
    SELECT x.i AS a, y.i AS b, x.n AS n_a, y.n AS n_b, bit_count(xor(x.h, y.h))::INT AS distance FROM q x JOIN q y ON x.i < y.i WHERE bit_count(xor(x.h, y.h)) <= 2""")  # fmt: skip
def image_near_duplicates(s, d):
    return audit.near_classes(images.signatures(pictures(s, d)))


CANDIDATES = """WITH m AS (SELECT vec_id AS id, vec_id // 4 AS image, list_transform(embedding::DOUBLE[], lambda v: CASE WHEN v > 0.02 THEN 1 ELSE 0 END) AS m FROM embeddings),
    w AS (SELECT *, list_filter(range(0, 64), lambda i: m[i + 1] = 1) AS px FROM m),
    s AS (SELECT id, image, m, len(px) AS area, list_max(list_transform(px, lambda i: i // 8)) - list_min(list_transform(px, lambda i: i // 8)) + 1 AS bh, list_max(list_transform(px, lambda i: i % 8)) - list_min(list_transform(px, lambda i: i % 8)) + 1 AS bw,
      list_sum(list_transform(px, lambda i: CASE WHEN i >= 8 AND m[greatest(i - 7, 1)] = 1 THEN 0 ELSE 1 END + CASE WHEN i < 56 AND m[least(i + 9, 64)] = 1 THEN 0 ELSE 1 END + CASE WHEN i % 8 > 0 AND m[greatest(i, 1)] = 1 THEN 0 ELSE 1 END + CASE WHEN i % 8 < 7 AND m[least(i + 2, 64)] = 1 THEN 0 ELSE 1 END))::BIGINT AS sides FROM w),
    f AS (SELECT *, least(bh, bw) / greatest(bh, bw)::DOUBLE AS ratio, 4 * pi() * area / (sides * sides)::DOUBLE AS circ FROM s),
    g AS (SELECT *, coalesce(area >= 24 AND area <= 64 * 0.6 AND ratio >= 0.9 AND circ >= 0.06, false) AS accepted FROM f) """


def candidates(s, d):
    mask = F.transform("embedding", lambda v: F.when(v.cast("double") > 0.02, 1).otherwise(0))
    rows = R.table(s, d, "embeddings").select(C("vec_id").alias("id"), F.expr("vec_id div 4").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), mask.alias("mask"))
    return images.filtered_candidates(rows, 24, 0.6, 0.9, 0.06)


@query(CANDIDATES + "SELECT id, area, bh AS box_height, bw AS box_width, sides, round(circ, 6) AS circularity, accepted FROM g")
def candidate_filter(s, d):
    return candidates(s, d).select("id", "area", "box_height", "box_width", "sides", F.round("circularity", 6).alias("circularity"), "accepted")


@query(CANDIDATES + """, u AS (SELECT image, i, max(m[i + 1]) FILTER (accepted) AS x FROM (SELECT *, unnest(range(0, 64)) AS i FROM g) GROUP BY image, i)
    SELECT g.image, n AS n_candidates, k AS n_accepted, coalesce(x, 0)::BIGINT AS union_pixels FROM (SELECT image, count(*) AS n, count(*) FILTER (accepted) AS k FROM g GROUP BY image) g JOIN (SELECT image, sum(x) AS x FROM u GROUP BY image) u ON u.image = g.image""")  # fmt: skip
def candidate_union(s, d):
    return images.united(candidates(s, d), "image")


@query()
def class_regions(s, d):
    classes = F.transform("embedding", lambda v: F.when(v > 0.1, 1).when(v < -0.1, 2).otherwise(0))
    rows = R.table(s, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), classes.alias("classes"))
    return images.class_regions(rows, "vec_id", 1, size_fraction=0.2)


@query(
    """WITH m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS g, 0.7 + (vec_id % 5) / 20.0::DOUBLE AS a, (vec_id % 7) / 20.0::DOUBLE AS b, 1 + (vec_id % 3) / 2.0::DOUBLE AS tx, 0.8::DOUBLE + (vec_id % 4) / 4.0::DOUBLE AS ty FROM embeddings),
    c AS (SELECT *, list_transform([[0, 0], [3, 0], [0, 3], [3, 3]], lambda p: a * p[1] - b * p[2] + tx) AS cx, list_transform([[0, 0], [3, 0], [0, 3], [3, 3]], lambda p: b * p[1] + a * p[2] + ty) AS cy FROM m),
    s AS (SELECT *, list_min(cx) >= 1 AND list_min(cy) >= 1 AND list_max(cx) <= 6 AND list_max(cy) <= 6 AS ok FROM c),
    p AS (SELECT id, g, i, a * (i % 4) - b * (i // 4) + tx AS x, b * (i % 4) + a * (i // 4) + ty AS y FROM (SELECT *, unnest(range(0, 16)) AS i FROM s WHERE ok)),
    q AS (SELECT *, floor(x)::BIGINT AS u, floor(y)::BIGINT AS v FROM p)
    SELECT id, i::INT AS i, round((u + 1 - x) * (v + 1 - y) * g[v * 8 + u + 1] + (x - u) * (v + 1 - y) * g[v * 8 + u + 2] + (u + 1 - x) * (y - v) * g[v * 8 + u + 9] + (x - u) * (y - v) * g[v * 8 + u + 10], 6) AS value FROM q
    UNION ALL SELECT id, NULL, NULL FROM s WHERE NOT ok"""
)
def affine_resample(s, d):
    i = C("vec_id")
    a, b, tx, ty = 0.7 + i % 5 / 20, i % 7 / 20, 1 + i % 3 / 2, 0.8 + i % 4 / 4
    rows = R.table(s, d, "embeddings").select(i.alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("grid"), F.array(a, -b, tx, b, a, ty).alias("matrix"))
    return images.affine_resampled(rows, "id", (8, 8), (4, 4)).select("id", F.posexplode_outer("pixels").alias("i", "value")).withColumn("value", F.round("value", 6))


@query(
    """WITH m AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: CASE WHEN v > 0.12 THEN NULL ELSE v END) AS g, unnest([0, 1, 2, 3]) AS i, unnest([vec_id % 7 + 0.25, 3.5, -0.5, 6.75])::DOUBLE AS x, unnest([1.5, vec_id % 5 + 0.5, 2.25, 7.2])::DOUBLE AS y FROM embeddings),
    c AS (SELECT *, floor(x)::BIGINT + unnest([0, 1, 0, 1]) AS u, floor(y)::BIGINT + unnest([0, 0, 1, 1]) AS v FROM m),
    w AS (SELECT *, CASE WHEN u BETWEEN 0 AND 7 AND v BETWEEN 0 AND 7 THEN g[v * 8 + u + 1] END AS z, (1 - abs(x - u)) * (1 - abs(y - v)) AS part FROM c)
    SELECT id, i::INT AS i, round(sum(z * part) / nullif(sum(part) FILTER (z IS NOT NULL), 0), 6) AS value, coalesce(sum(part) FILTER (z IS NOT NULL), 0) > 0 AS valid FROM w GROUP BY id, i"""
)
def points_resample(s, d):
    """Heights with holes, at points inside, between holes and beyond the border."""
    i = C("vec_id")
    grid = F.transform("embedding", lambda v: F.when(v.cast("double") > 0.12, float("nan")).otherwise(v.cast("double")))
    number = lambda *v: F.array(*(x if not isinstance(x, float) else F.lit(x) for x in v))
    rows = R.table(s, d, "embeddings").select(i.alias("id"), grid.alias("grid"), number(i % 7 + 0.25, 3.5, -0.5, 6.75).alias("xs"), number(1.5, i % 5 + 0.5, 2.25, 7.2).alias("ys"))
    out = images.points_sampled(rows, "id", (8, 8)).select("id", F.posexplode(F.arrays_zip("values", "valid")).alias("i", "p"))
    return out.select("id", "i", F.round("p.values", 6).alias("value"), F.col("p.valid").alias("valid"))


# --- COCO ---------------------------------------------------------------------------------------


#: Customers whose documents one task writes, and annotations that one task judges: larger tables have more tasks, not larger ones.
CUSTOMERS, NOTES = 4_000, 100_000


def coco_documents(s, d, faulty):
    """COCO documents (path, text) of forty customers each: customers as images, orders as annotations, nations as categories.

    Narrow rows go to their document's task before lists are made: a small file may hold millions of orders.
    """
    c, o, n = (R.table(s, d, t) for t in ("customer", "orders", "nation"))
    tasks = c.count() // CUSTOMERS + 1
    path = F.concat(F.lit("part-"), F.expr("c_custkey div 40").cast("string")).alias("path")
    image = F.struct(C("c_custkey").alias("id"), C("c_name").alias("file_name"), F.lit(512).alias("width"), F.lit(512).alias("height"))
    images_ = c.select(path, "c_custkey", "c_name").repartition(tasks, "path").groupBy("path").agg(F.collect_list(image).alias("images"))

    def notes(x):
        k = x["o_orderkey"]
        shape = F.when(faulty & (k % 17 == 3), "{}").when(faulty & (k % 17 == 4), "[[1,2,3,4,5]]").otherwise("[[1,1,9,1,9,9]]")
        box = F.array(F.lit(1.0), F.lit(1.0), F.when(faulty & (k % 19 == 2), 600.0).otherwise(8.0), F.lit(8.0))
        note = F.struct(k.alias("id"), F.when(faulty & (k % 23 == 1), -1).otherwise(x["o_custkey"]).alias("image_id"), F.when(faulty & (k % 29 == 1), 99).otherwise(x["c_nationkey"]).alias("category_id"), box.alias("bbox"), F.when(faulty & (k % 31 == 1), 1).otherwise(0).alias("iscrowd"), F.parse_json(shape).alias("segmentation"))
        return F.when(faulty & (k % 37 == 1), F.array(note, note)).otherwise(F.array(note))

    rows = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey")).select(path, "o_orderkey", "o_custkey", "c_nationkey")
    lists = rows.repartition(tasks, "path").groupBy("path").agg(F.collect_list(F.struct("o_orderkey", "o_custkey", "c_nationkey")).alias("rows"))
    names = n.groupBy().agg(F.collect_list(F.struct(C("n_nationkey").alias("id"), C("n_name").alias("name"))).alias("categories"))  # 25 rows
    whole = images_.join(lists, "path", "left").crossJoin(F.broadcast(names))
    whole = whole.withColumn("annotations", F.coalesce(F.flatten(F.transform("rows", notes)), F.expr("array()")))
    return whole.select("path", F.to_json(F.struct("images", "annotations", "categories")).alias("text"))


def coco_read(s, d, faulty):
    """The tables of those documents, parsed once, and how many tasks its annotations are for."""
    return annotations.coco_tables(coco_documents(s, d, F.lit(faulty)), Scratch(s, "coco")), R.table(s, d, "orders").count() // NOTES + 1


@query("SELECT o_orderkey AS annotation_id, c_name AS file_name, n_name AS category FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def coco_join(s, d):
    """Annotations with their images and categories, read from COCO documents."""
    return annotations.coco_instances(*coco_read(s, d, False)).select("annotation_id", "file_name", C("category_name").alias("category"))


@query(
    """WITH a AS (SELECT o_orderkey AS k, 'part-' || (c_custkey // 40) || '#' || o_orderkey AS key, lower(n_name) AS name, unnest(range(0, CASE WHEN o_orderkey % 37 = 1 THEN 2 ELSE 1 END)) AS i FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT rule, key, n, count(*) AS times FROM (SELECT 'image_id_unknown' AS rule, key, '-1' AS n FROM a WHERE k % 23 = 1 UNION ALL SELECT 'category_id_unknown', key, '99' FROM a WHERE k % 29 = 1 UNION ALL SELECT 'box_outside', key, '[1.0,1.0,600.0,8.0]' FROM a WHERE k % 19 = 2 AND k % 23 <> 1
      UNION ALL SELECT 'crowd_refused', key, '' FROM a WHERE k % 31 = 1 UNION ALL SELECT 'segmentation_refused', key, '' FROM a WHERE k % 17 = 3 UNION ALL SELECT 'polygon_malformed', key, '' FROM a WHERE k % 17 = 4
      UNION ALL SELECT 'category_refused', key, name FROM a WHERE name <> 'nation_7' AND k % 29 <> 1 UNION ALL SELECT 'annotations_id_twice', key, '2' FROM a WHERE i = 1) GROUP BY ALL"""
)
def coco_violations(s, d):
    tables, tasks = coco_read(s, d, True)
    found = annotations.coco_violations(tables, only="Nation_7", tasks=tasks)
    # All rows of a key are dealt before they are counted.
    return found.repartition(tasks, "rule", "key", "detail").groupBy("rule", "key", C("detail").alias("n")).agg(F.count("*").alias("times"))
