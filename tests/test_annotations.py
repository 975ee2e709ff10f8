"""Each rule of the annotation formats, broken once, and what is left when none is."""

import io
import json
import zipfile

import numpy as np
import pytest

from orrery.operators import stereo
from orrery.sources import annotations as A


def coco(**changes):
    whole = {
        "images": [{"id": 1, "file_name": "a", "width": 10, "height": 9}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 9, "bbox": [0, 0, 10, 9], "segmentation": [[0, 0, 5, 0, 5, 5]]}],
        "categories": [{"id": 9, "name": "Crater"}],
    }
    note = whole["annotations"][0] | changes.pop("note", {})
    return json.dumps(whole | {"annotations": [note]} | changes)


CASES = [
    (coco(), []), ("{broken", ["not_coco"]), (json.dumps({"images": []}), ["not_coco"]), (coco(note={"image_id": 2}), ["image_id_unknown"]), (coco(note={"category_id": 2}), ["category_id_unknown"]),
    (coco(note={"bbox": [0, 0, 11, 9]}), ["box_outside"]), (coco(note={"bbox": [1, 1, 0, 3]}), ["box_outside"]), (coco(note={"bbox": [1, 1, 3]}), ["box_outside"]), (coco(note={"iscrowd": 1}), ["crowd_refused"]),
    (coco(note={"segmentation": {"counts": "x"}}), ["segmentation_refused"]), (coco(note={"segmentation": [[1, 2, 3, 4]]}), ["polygon_malformed"]), (coco(note={"segmentation": [[1, 2, 3, 4, 5, 6, 7]]}), ["polygon_malformed"]),
    (coco(categories=[{"id": 9, "name": "rock"}]), ["category_refused"]), (coco(categories=[{"id": 9, "name": "crater"}] * 2), ["categories_id_twice"]), (coco(images=json.loads(coco())["images"] * 2), ["images_id_twice"]),
    (coco(annotations=json.loads(coco())["annotations"] * 2), ["annotations_id_twice"]), (coco(annotations=[]), []),
]


def test_coco_rules(spark):
    tables = A.coco_tables(spark.createDataFrame([(f"d{i}", text) for i, (text, _) in enumerate(CASES)], "path string, text string"))
    found = A.coco_violations(tables, only="crater")
    by = {}
    for r in found.collect():
        by.setdefault(r.key.split("#")[0], []).append(r.rule)
    assert {k: sorted(v) for k, v in by.items()} == {f"d{i}": rules for i, (_, rules) in enumerate(CASES) if rules}
    with pytest.raises(ValueError, match="not_coco"):
        A.refuse(found.where("rule = 'not_coco'"))
    A.refuse(found.where("false"))
    assert A.coco_violations(tables).where("rule in ('crowd_refused', 'segmentation_refused', 'polygon_malformed', 'category_refused')").isEmpty()


def test_coco_ids_count_within_their_document(spark):
    tables = A.coco_tables(spark.createDataFrame([("a", coco()), ("b", coco()), ("c", None)], "path string, text string"))
    assert sorted((r.path, r.annotation_id, r.file_name, r.category) for r in A.coco_instances(tables).collect()) == [("a", 5, "a", "crater"), ("b", 5, "a", "crater")]
    assert [r.key for r in A.coco_violations(tables).collect()] == ["c"]


BOX = '<box label="crater" xtl="{}" ytl="1" xbr="5" ybr="6"><attribute name="uncertain">{}</attribute><attribute name="truncated">false</attribute></box>'
REVIEW = '<tag label="image_review"><attribute name="result">{}</attribute><attribute name="complete_for_size_rule">{}</attribute></tag>'


def image(name="f1.png", inner=None, width=8):
    return f'<image name="{name}" width="{width}" height="7">{REVIEW.format("ok", "true") + BOX.format(0, "true") if inner is None else inner}</image>'


def export(*images, version="1.1", names=("annotations.xml",), head=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, f"{head}<annotations><version>{version}</version>{''.join(images)}</annotations>")
    return out.getvalue()


GOOD = REVIEW.format("ok", "false")


EXPORTS = [
    (export(image()), []), (b"no archive", ["frame_missing", "unreadable"]), (export(image(), names=("other.xml",)), ["frame_missing", "not_one_annotations_xml"]), (export(image(), version="2"), ["frame_missing", "version"]),
    (export(image(), head="<!DOCTYPE x>"), ["document_type", "frame_missing"]), (export(image(), head="<!doctype x>"), ["document_type", "frame_missing"]), (export("<image"), ["frame_missing", "unreadable"]),
    (export(image("../f1.png")), ["frame_missing", "frame_name"]), (export(image("f1.jpg")), ["frame_missing", "frame_name"]), (export(image(), image()), ["frame_twice"]), (export(image(), image("f2.png")), ["frame_not_expected"]),
    (export(image(width=9)), ["frame_size"]), (export(image(inner=GOOD + "<polygon/>")), ["shape_refused"]), (export(image(inner="")), ["not_one_review_tag"]), (export(image(inner=GOOD * 2)), ["not_one_review_tag"]),
    (export(image(inner=GOOD.replace("image_review", "x"))), ["not_one_review_tag"]), (export(image(inner='<tag label="image_review"/>')), ["tag_attributes"]), (export(image(inner=REVIEW.format("typo", "true"))), ["result_unknown"]),
    (export(image(inner=REVIEW.format("ok", "yes"))), ["not_true_or_false"]), (export(image(inner=GOOD + BOX.format(0, "maybe"))), ["box_attributes"]), (export(image(inner=GOOD + BOX.format(0, "true").replace('"crater"', '"x"'))), ["class_unknown"]),
    (export(image(inner=GOOD + BOX.format(-1, "true"))), ["box_outside"]), (export(image(inner=GOOD + BOX.format("nan", "true"))), ["box_outside"]), (export(image(inner=GOOD + BOX.format(5, "true"))), ["box_outside"]),
    (export(image(inner=GOOD + BOX.format(0, "true") * 2)), ["box_twice"]), (export(image(inner=GOOD + BOX.format(0, "true") + BOX.format(0, "false"))), []),
]
TABLE_RULES = {"frame_missing", "frame_twice", "frame_not_expected", "frame_size"}


@pytest.mark.parametrize("content,rules", EXPORTS)
def test_export_rules(content, rules):
    rows = list(A._export(content, ("ok", "none")))
    assert sorted(r["rule"] for r in rows if r["kind"] == "violation") == sorted({*rules} - TABLE_RULES)


def test_exports_against_the_frames_expected(spark):
    for i in [i for i, (_, rules) in enumerate(EXPORTS) if not rules or {*rules} & TABLE_RULES][::3]:
        content, rules = EXPORTS[i]
        files = spark.createDataFrame([("e.zip", bytearray(content))], "path string, content binary")
        frames, objects, violations = A.export_tables(files, spark.createDataFrame([("f1", 8, 7)], "frame string, width int, height int"), ("ok", "none"))
        assert sorted(r.rule for r in violations.collect()) == rules
        if not rules:
            row = frames.first()
            assert (row.frame, row.width, row.height, row.result) == ("f1", 8, 7, "ok")
            found = objects.collect()
            assert [r.n for r in found] == list(range(1, len(found) + 1)) and len({r.instance_id for r in found}) == len(found) and list(found[0].box) == [0, 1, 5, 6]
    # All four rules at once, over two archives.
    many = spark.createDataFrame([("a.zip", bytearray(export(image(), image("f2.png"), image("f4.png", width=9)))), ("b.zip", bytearray(export(image())))], "path string, content binary")
    want = spark.createDataFrame([("f1", 8, 7), ("f3", 8, 7), ("f4", 8, 7)], "frame string, width int, height int")
    got = sorted((r.rule, r.key) for r in A.export_tables(many, want, ("ok",))[2].collect())
    assert got == [("frame_missing", "f3"), ("frame_not_expected", "f2"), ("frame_size", "f4"), ("frame_twice", "f1")]


def test_large_exports_are_refused(spark, monkeypatch):
    files = spark.createDataFrame([("e.zip", bytearray(export(image())))], "path string, content binary")
    assert [r["rule"] for r in A._export(b"x" * (A.ARCHIVE_LIMIT + 1), ())] == ["archive_too_large"]
    assert [r["rule"] for r in A._export(export(" " * (A.XML_LIMIT + 1)), ())] == ["xml_too_large"]
    none = spark.createDataFrame([], "frame string, width int, height int")
    assert [t.count() for t in A.export_tables(files.where("false"), none, ())] == [0, 0, 0]


def vector(tag, values):
    return f"<{tag}>{''.join(f'<x{i}>{v}</x{i}>' for i, v in enumerate(values))}</{tag}>"


def label(stem="0001ML0000120001E01_DXXX", *, order="Last Index Fastest", kind="UnsignedByte", axes=("Band", "Line", "Sample"), centre=(1, 2, 3), size=30, offset=6):
    axis = "".join(f"<Axis_Array><axis_name>{a}</axis_name><elements>{n}</elements></Axis_Array>" for a, n in zip(axes, (3, 2, 4), strict=True))
    vectors = "".join(vector(t, centre if n == "C" else (0, 1, 0)) for n, t in A._VECTORS.items())
    return f"""<p:Product xmlns:p="urn:p"><alternate_id>{stem}</alternate_id><start_date_time>2024-05-01T10:00:00Z</start_date_time>
      <Camera_Model_Parameters><model_type>CAHVOR</model_type><CAHVOR_Model>{vectors}</CAHVOR_Model><Coordinate_Space_Indexed><coordinate_space_frame_type>ROVER</coordinate_space_frame_type>
      <Coordinate_Space_Index><index_id>SITE</index_id><index_value_number>7</index_value_number></Coordinate_Space_Index><solution_id>s</solution_id></Coordinate_Space_Indexed></Camera_Model_Parameters>
      <File_Area_Observational><File><file_name>i.img</file_name><file_size>{size}</file_size></File><Array_3D_Image><offset>{offset}</offset><axis_index_order>{order}</axis_index_order><data_type>{kind}</data_type>{axis}</Array_3D_Image></File_Area_Observational></p:Product>""".encode()


LABELS = [
    (label(), None), (label("OTHER"), "file's name"), (label(order="First"), "unsigned bytes"), (label(kind="Float"), "unsigned bytes"), (label(axes=("Line", "Sample", "Band")), "axes"), (label(centre=(1, 2)), "three finite"),
    (label(centre=(1, 2, "nan")), "three finite"), (label(centre=(1, 2, "x")), "float"), (label().replace(b"CAHVOR_Model", b"Other"), "0 of CAHVOR_Model"), (b"<a", "ParseError"), (b"<!DOCTYPE a>" + label(), "document types"),
]


def test_label_rules(spark):
    files = spark.createDataFrame([(f"{i}/0001ml0000120001e01_dxxx.xml", bytearray(content)) for i, (content, _) in enumerate(LABELS)], "path string, content binary")
    got = {int(r.path.split("/")[0]): r for r in A.product_labels(files).collect()}
    for i, (_, problem) in enumerate(LABELS):
        row = got[i]
        if problem:
            assert problem in row.problem and row.id is None and row.C is None
        else:
            assert (row.sol, row.eye, row.sequence, row.height, row.width, list(row.C), row.problem) == ("0001", "L", "000012", 2, 4, [1, 2, 3], None)
            assert row.start.isoformat() == "2024-05-01T10:00:00" and json.loads(row.frame) == ["ROVER", [["SITE", "7"]], "s"]


def test_labels_feed_the_partner_search_and_their_images(spark):
    left, right = "0001ML0000120001E01_DXXX", "0001MR0000120002E01_DXXX"
    data = b"header" + bytes(range(24))
    files = [(f"d/{left}.xml", label(left)), (f"d/{right}.xml", label(right, centre=(1.25, 2, 3))), ("d/i.img", data), ("e/i.img", b"short"), (f"e/{left.replace('0001M', '0002M')}.xml", label(left.replace("0001M", "0002M"))), (f"f/{left.replace('0001M', '0003M')}.xml", label(left.replace("0001M", "0003M")))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    labels = A.product_labels(df.where("path like '%.xml'"))
    pair = stereo.eye_pairs(labels).collect()
    assert [(p.left, p.right, p.baseline_m, p.optical_axis_separation_deg) for p in pair] == [(left, right, 0.25, 0.0)]
    got = {r.id: r for r in A.product_images(labels, df).collect()}
    assert np.array_equal(A.band(got[left].pixels, 3, 2, 4), np.arange(24, dtype=np.uint8).reshape(3, 2, 4).transpose(1, 2, 0))
    assert [got[left.replace("0001M", f"000{k}M")].problem for k in (1, 2, 3)] == [None, "file_size", "image_missing"]
    assert A.product_labels(df.where("false")).count() == 0


def test_larger_tables_have_more_tasks_not_larger_ones(spark, monkeypatch):
    """Documents are parsed once, and annotations are dealt over tasks by their number."""
    from helpers import DATA

    from orrery.plans import catalogue, surveying

    monkeypatch.setattr(surveying, "NOTES", 100, raising=False)
    tasks = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").count() // 100 + 1
    plan = catalogue.QUERIES["coco_violations"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and plan.count(f", {tasks}), REPARTITION_BY_NUM") >= 5
