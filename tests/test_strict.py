"""Line numbers, keys and arrays of manifests that many tasks read."""

import json

import pytest

from orrery.sources import manifests, strict


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "64"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def good(i, **more):
    return {"request_id": f"r{i}", "prompt": "é" * (i % 40), "allowed_answers": ["A"], **more}


def write(path, lines, bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines).encode())
    return str(path)


def test_every_line_has_its_number(spark, tmp_path, small_splits):
    lines = [good(i) if i % 5 else "" for i in range(200)]
    write(tmp_path / "a.jsonl", lines)
    write(tmp_path / "b.jsonl", lines[::-1])
    rows = strict.numbered_lines(spark, str(tmp_path))
    assert strict._lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 20
    got = {(r.path[-7:], r.line): r.value for r in rows.collect()}
    want = {(n, i): x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for n, ls in (("a.jsonl", lines), ("b.jsonl", lines[::-1])) for i, x in enumerate(ls, 1)}
    want = {k: v for k, v in want.items() if v or k in got}  # whether a last empty line is one is the reader's affair
    assert got == want


@pytest.mark.parametrize("line,problem", [
    ("{broken", "invalid JSON"), ('{"a": 1} more', "invalid JSON: Extra data"), ("[1]", "expected a JSON object"), ("3", "expected a JSON object"), ("null", "expected a JSON object"), ({"request_id": "x", "answer": "A", "allowed_answers": []}, "unknown fields: answer"),
    ({"request_id": "x", "allowed_answers": "A"}, "allowed_answers must be an array"), ({"request_id": "x"}, "allowed_answers must be an array"), ({"request_id": "x", "allowed_answers": [], "image_paths": None}, "image_paths must be an array"),
    ({"request_id": "x", "allowed_answers": [], "modality_paths": [["rgb"]]}, "modality_paths needs"),
])
def test_rules_of_a_line(line, problem):
    text = line if isinstance(line, str) else json.dumps(line)
    assert problem in strict.problem_of(text, frozenset(strict.REQUEST_FIELDS), strict.REQUEST_ARRAYS, frozenset({"modality_paths"}))


def test_a_fault_in_the_last_split_is_named(spark, tmp_path, small_splits):
    lines = [good(i) for i in range(300)]
    path = write(tmp_path / "m.jsonl", [*lines[:50], "", *lines[50:], "{broken"], bom=True)
    with pytest.raises(ValueError, match=r"m\.jsonl:302: invalid JSON"):
        strict.read_strict(spark, path, manifests.REQUESTS)
    # Of many faults the first is named, and each split tells only one.
    path = write(tmp_path / "n.jsonl", [*lines[:100], *(["[1]"] * 200)])
    with pytest.raises(ValueError, match=r"n\.jsonl:101: expected a JSON object"):
        strict.read_strict(spark, path, manifests.REQUESTS)
    assert strict.faults(spark, path).count() < 200


def test_requests(spark, tmp_path, small_splits):
    path = write(tmp_path / "ok.jsonl", [good(i, image_paths=["x.png", "/y.png"]) for i in range(60)], bom=True)
    rows = strict.read_requests(spark, path, "/root/of")
    assert rows.count() == 60 and rows.orderBy("request_id").first().image_paths == ["/root/of/x.png", "/y.png"]
    path = write(tmp_path / "twice.jsonl", [*(good(i) for i in range(60)), good(7)])
    with pytest.raises(ValueError, match=r"twice\.jsonl:61: request_id r7 is also in line 8"):
        strict.read_requests(spark, path)
    with pytest.raises(ValueError, match="empty"):
        strict.read_requests(spark, write(tmp_path / "none.jsonl", ["", " "]))
    with pytest.raises(ValueError, match="no request_id"):
        strict.read_requests(spark, write(tmp_path / "null.jsonl", [{"allowed_answers": []}]))
    with pytest.raises(ValueError, match=r":2: unknown fields: answer"):
        strict.read_requests(spark, write(tmp_path / "leak.jsonl", [good(1), good(2, answer="A")]))
