import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from orrery import streaming
from orrery.sources import files, manifests, reports


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + b'{"request_id": "r1", "prompt": "p", "allowed_answers": ["A"]}\n\n{"request_id": "r2"}\n')
    assert [r.request_id for r in manifests.read_jsonl(spark, str(tmp_path / "a.jsonl"), manifests.REQUESTS).collect()] == ["r1", "r2"]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        manifests.read_jsonl(spark, str(tmp_path / "b.jsonl"), manifests.REQUESTS).collect()


def test_sinks_never_overwrite(spark, tmp_path):
    rows = spark.range(3)
    manifests.write_once(rows, str(tmp_path / "w"))
    with pytest.raises(Exception, match="(?i)exist"):
        manifests.write_once(rows, str(tmp_path / "w"))
    assert manifests.create_or_verify(rows, str(tmp_path / "v")) == "created"
    assert manifests.create_or_verify(rows, str(tmp_path / "v")) == "verified"
    with pytest.raises(ValueError):
        manifests.create_or_verify(spark.range(4), str(tmp_path / "v"))
    reports.write_json(str(tmp_path / "x.json"), {"a": 1})
    with pytest.raises(FileExistsError):
        reports.write_json(str(tmp_path / "x.json"), {})
    with pytest.raises(ValueError):
        reports.write_json(str(tmp_path / "y.json"), float("nan"))
    reports.replace_text(str(tmp_path / "x.json"), "new")
    assert (tmp_path / "x.json").read_text() == "new"


def test_reports(spark):
    rows = spark.createDataFrame([("=1", 2), ('a"|b', None)], "x string, y int")
    assert reports.markdown(rows).splitlines()[2:] == ["| =1 | 2 |", '| a"\\|b |  |']
    assert [r.line for r in reports.csv_lines(rows).collect()] == ['"\'=1";"2"', '"a""|b";""']


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_archives(spark):
    df = spark.createDataFrame([("z", bytearray(_zip(t_dot_csv="id,v\n1,a\n2,b\n")))], "path string, content binary")
    got = files.parse(df, files.csv_in_zip("t.csv", ["id", "v"], unique="id"), "id string, v string").collect()
    assert [(r.id, r.v) for r in got] == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError, match="repeats"):
        files.csv_in_zip("t.csv", ["id"], unique="id")(_zip(t_dot_csv="id\n1\n1\n"))
    xml = '<annotations><image name="i"><box label="c" xtl="1" ytl="2" xbr="3" ybr="4" occluded="1"/></image></annotations>'
    assert files.boxes_in_zip(_zip(annotations_dot_xml=xml)) == [("i", "c", 1.0, 2.0, 3.0, 4.0, True)]
    with pytest.raises(ValueError, match="document types"):
        files.boxes_in_zip(_zip(annotations_dot_xml="<!DOCTYPE x><annotations/>"))
    listed = {n: p for n, _, p in files.zip_listing(_zip(ok="1", ___dot__dot___x="2"))}
    assert listed["ok"] is None


def test_arrays():
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert np.array_equal(files.npy(files.to_npy(a)), a)
    assert np.array_equal(files.pfm(b"Pf\n3 2\n-1.0\n" + a.astype("<f4").tobytes()), a)
    assert files.bsq(bytes(range(12)), 3, 2, 2)[2, 1, 1] == 11
    with pytest.raises(ValueError):
        files.bsq(b"x", 3, 2, 2)
    assert files.label_values(b"<a xmlns='u'><b> 1 </b></a>") == [("b", "1")]


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    flat, lines, above = image.reshape(5, 12).astype(int), b"", np.zeros(12, int)
    for row in flat:
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines += bytes([kind]) + ((row - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(files.png(data), image)


def test_coco(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 2, "height": 3}], "annotations": [{"id": 5, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 9, "name": "crater"}]}))
    images, annotations, categories = files.coco(spark, str(tmp_path / "c.json"))
    assert images.first().file_name == "a" and annotations.first().bbox == [0, 0, 1, 1] and categories.first().name == "crater"


def test_response_log_adds_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        streaming.append_once(streaming.response_log(spark, str(tmp_path / "in"), "k string, v int"), "k", str(tmp_path / "log"), str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_stream_statistics(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20, 0) as ts, if(id % 3 = 0, 'error', 'ok') as status, double(id) as elapsed_seconds from range(9)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = streaming.runtime_windows(streaming.response_log(spark, str(tmp_path / "e"), "ts timestamp, status string, elapsed_seconds double"))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.n_ok) for r in spark.sql("select * from w").collect()) == [(3, 2), (3, 2), (3, 2)]
