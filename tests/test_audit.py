"""Audits of splits and cohorts whose inputs the small tables don't have."""

import pyarrow as pa
import pyarrow.parquet as pq

from orrery.plans import catalogue


def embeddings(tmp_path, vectors):
    ids = pa.array(range(len(vectors)), pa.int64())
    pq.write_table(pa.table({"vec_id": ids, "label": pa.array([v % 2 for v in range(len(vectors))], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_a_constant_mask_is_no_constant_image(spark, duck, tmp_path):
    """Samples 0 and 1 of ten have masks of one value over images that vary: the audit counts no constant image, as its SQL."""
    d = embeddings(tmp_path, [[0.1 + (i + k) % 7 / 10 for k in range(64)] for i in range(20)])
    got = {r.split: r for r in catalogue.QUERIES["split_audit"](spark, d).collect()}
    own = duck.cursor()
    own.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = own.sql(catalogue.ORACLE["split_audit"])
    assert sorted(tuple(got[r[0]][c] for c in want.columns) for r in want.fetchall()) == sorted(want.fetchall())
    assert [r.n_constant for r in got.values()] == [0, 0, 0]


def test_a_constant_image_is_counted_whatever_its_mask(spark, tmp_path):
    d = embeddings(tmp_path, [[0.5] * 64 if i in (4, 5) else [(i + k) % 7 / 10 for k in range(64)] for i in range(20)])
    assert {r.split: r.n_constant for r in catalogue.QUERIES["split_audit"](spark, d).collect()} == {"train": 1, "val": 0, "test": 1}


def test_stems_are_three_hundred_however_many_rows(spark, duck, tmp_path):
    """Every current row meets all prior rows of its stem, two or three of 700 here, and the result equals the SQL's."""
    d = embeddings(tmp_path, [[(i * 31 + k * k * 17) % 101 / 100 for k in range(64)] for i in range(700)])
    got = {(r.id, r.prior_id): r.reasons for r in catalogue.QUERIES["prior_overlap"](spark, d).collect()}
    assert all("source_id_overlap" in got[1_000_000_010, 60 + 300 * k] for k in range(3))
    own = duck.cursor()
    own.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert got == {(a, b): c for a, b, c in own.sql(f"SELECT id, prior_id, reasons FROM ({catalogue.ORACLE['prior_overlap']})").fetchall()}


def test_reasons_of_a_pair(spark):
    """Near hashes count only for other content; reasons are in order; rows that share an id are one."""
    from orrery.operators import audit

    kinds = "id long, stem string, content string, bits long"
    current = spark.createDataFrame([(1, "a", "x", 7), (1, "b", "x", 7), (2, "c", None, None), (3, None, "z", 1 << 40)], kinds)
    prior = spark.createDataFrame([(10, "a", "x", 7), (11, "q", "y", 6), (12, "b", "y", 4), (13, None, None, None), (14, "b", "w", 1 << 50)], kinds)
    got = {(r.id, r.prior_id): r.reasons for r in audit.prior_overlap(current, prior).collect()}
    assert got == {(1, 10): "decoded_pixels_overlap,source_id_overlap", (1, 11): "near_duplicate_review", (1, 12): "near_duplicate_review,source_id_overlap", (1, 14): "source_id_overlap", (3, 12): "near_duplicate_review", (3, 14): "near_duplicate_review"}
