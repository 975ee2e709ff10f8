"""Configuration, exact fingerprints, embedded images, effects in order, components."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import assembly, rasters, validate
from orrery.sources import config, manifests


def test_config(tmp_path):
    at = tmp_path / "c.toml"
    at.write_text('model = "m"\nsteps = 3\ndata = "d/x.jsonl"\n')
    kinds = {"model": str, "steps": int, "data": str}
    got = config.load(str(at), kinds, required=("model",), paths=("data",))
    assert got["data"] == str(tmp_path / "d/x.jsonl") and got["sha256"] == hashlib.sha256(at.read_bytes()).hexdigest()
    for text, said in (('model = "m"\nother = 1\n', "other"), ("steps = 1\n", "no model"), ('model = "m"\nsteps = true\n', "steps is a bool"), ('model = "m"\ndata = "../x"\n', "leaves")):
        at.write_text(text)
        with pytest.raises(ValueError, match=said):
            config.load(str(at), kinds, required=("model",), paths=("data",))


def test_protocol():
    good = [{"id": "clean", "effects": []}, {"id": "shear+flare", "effects": ["shear", "flare"], "parameters": {"shear": {}, "flare": {"s": 1}}}]
    assert config.protocol_violations(good) == []
    bad = [{"id": "clean", "effects": ["shear"], "parameters": {"shear": {}}}, {"id": "clean"}, {"id": "x", "effects": []}, {"id": "y", "effects": ["fog", "fog"]}, {"id": "/z", "effects": ["shear"]}]
    found = config.protocol_violations(bad)
    for part in ("clean: chain is not empty", "clean: twice", "x: chain is empty", "y: unknown effect fog", "y: an effect repeats", "id '/z'", "/z: no parameters of shear"):
        assert part in found
    config.gate({"a": 1, "b": "y"}, {"a": 1, "b": ("x", "y")})
    with pytest.raises(ValueError, match="a: 1; b: None"):
        config.gate({"a": 1}, {"a": 2, "b": "x"})


def test_records_fingerprint_is_the_hash_of_the_sorted_records(spark):
    rows = [{"request_id": f"r{i}", "prompt": f"é {i}", "n": i} for i in range(30)]
    del rows[4]["prompt"]
    df = spark.createDataFrame([(r["request_id"], r.get("prompt"), r["n"]) for r in rows], "request_id string, prompt string, n long")
    want = hashlib.sha256(json.dumps(sorted(rows, key=lambda r: r["request_id"]), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert manifests.records_fingerprint(df) == manifests.records_fingerprint(df.repartition(5)) == want
    assert manifests.records_fingerprint(df.where("false")) == hashlib.sha256(b"[]").hexdigest()


def test_embedded_images(spark, tmp_path):
    rows = [((b"\1\2", "a.png"), (b"\0", "m.png"), 2, 1, ["x"])]
    schema = "image struct<bytes: binary, path: string>, mask struct<bytes: binary, path: string>, width int, height int, class_labels array<string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/p")
    names = manifests.embedded_images(spark, f"{tmp_path}/p")
    assert names.columns == ["image", "mask", "width", "height", "class_labels"] and "bytes" not in names._jdf.queryExecution().executedPlan().toString()
    row = manifests.embedded_images(spark, f"{tmp_path}/p", content=True).first()
    assert row.image == "a.png" and bytes(row.image_bytes) == b"\1\2" and row.mask_sha256 == hashlib.sha256(b"\0").hexdigest()
    manifests.write_sorted(names, f"{tmp_path}/out", "image")
    with pytest.raises(Exception, match="exists"):
        manifests.write_sorted(names, f"{tmp_path}/out", "image")


def test_effects_run_in_their_declared_order():
    image = np.linspace(0, 1, 64).reshape(8, 8)
    seed = {"shear": 3, "flare": 5}.get
    one = rasters.chain(image, [("shear", 0.8), ("flare", 0.6)], seed)
    two = rasters.chain(image, [("flare", 0.6), ("shear", 0.8)], seed)
    assert np.allclose(one, rasters.EFFECTS["flare"](rasters.EFFECTS["shear"](image, 0.8, 3), 0.6, 5)) and not np.allclose(one, two)
    assert (rasters.chain(image, [], seed) == image).all()


def test_components_against_flooding():
    r = np.random.default_rng(3)
    for share in (0.1, 0.4, 0.6, 0.9):
        mask = r.random((17, 23)) < share
        seen, areas = np.zeros(mask.shape, bool), []
        for start in zip(*np.nonzero(mask), strict=True):
            if not seen[start]:
                stack, n, seen[start] = [start], 0, True
                while stack:
                    y, x = stack.pop()
                    n += 1
                    for v in range(max(0, y - 1), min(17, y + 2)):
                        for u in range(max(0, x - 1), min(23, x + 2)):
                            if mask[v, u] and not seen[v, u]:
                                seen[v, u] = True
                                stack.append((v, u))
                areas.append(n)
        assert [c["area"] for c in rasters.components8(mask)] == areas


def test_request_rules_reject_what_is_malformed(spark):
    rows = [
        ("r1", ["A", "B"], "p", 1, False, ["a/b.png"], [("rgb", "x.png")]), (" ", ["A", "a "], " ", 0, None, ["/etc/x"], [("rgb", "x"), ("rgb", "y")]),
        ("r3", ["A"], "p", 1, True, [], [(None, "../x")]),
    ]
    df = spark.createDataFrame(rows, "request_id string, allowed_answers array<string>, prompt string, max_new_tokens int, do_sample boolean, image_paths array<string>, modality_paths array<struct<name: string, path: string>>")
    found = {(r.key, r.rule) for r in validate.broken(df, "request_id", validate.request_rules() | validate.image_rules()).collect()}
    assert found == {(" ", x) for x in ("request_id_blank", "labels_ambiguous", "max_new_tokens", "prompt_blank", "do_sample_null", "path_unsafe", "modality_names")} | {("r3", x) for x in ("images_missing", "path_unsafe", "modality_names")}
    hashes = spark.createDataFrame([("a", None), ("b", "f" * 64), ("c", "F" * 64)], "request_id string, request_manifest_sha256 string")
    assert [r.key for r in validate.broken(hashes, "request_id", validate.fingerprint_rules()).collect()] == ["c"]
    names = spark.createDataFrame([("a-1.b",), ("-a",), ("",)], "n string").select(validate.identifier(F.col("n"))).collect()
    assert [r[0] for r in names] == [True, False, False]


def test_strict_join_and_claims(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "w", "d"), (1, "z", "e")], "k int, u string, note string")
    assert assembly.strict_violations(a, b, "k").isEmpty() and assembly.strict_join(a, b, "k", ("note",)).columns == ["k", "v", "u"]
    events = spark.createDataFrame([("j", 1, "claim", 7), ("j", 2, "claim", 8), ("j", 3, "release", 7), ("j", 4, "claim", 9), ("i", 5, "release", 1)], "job string, at int, event string, worker int")
    assert {tuple(r) for r in assembly.claims(events, "job", ["at"]).collect()} == {("j", "claim", 9, 1), ("i", "release", None, 0)}
