"""Annotation formats, strictly: COCO documents, exports of frames with boxes and tags, labels of products with cameras.

Files come as (path, content) or (path, text) from Spark's own readers, so any
store that Spark reads will do.  What breaks a rule is a row of violations (rule,
key, detail), never a crash of the job; ``refuse`` turns any into an error.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import error as zlib_error

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Fixed values of the export format: sizes in bytes, its version, and the names of tag, attributes and class.
ARCHIVE_LIMIT, XML_LIMIT, VERSION = 10 << 20, 2 << 20, "1.1"
TAG, TAG_ATTRIBUTES, BOX_LABEL, BOX_ATTRIBUTES = "image_review", ("result", "complete_for_size_rule"), "crater", ("uncertain", "truncated")

COCO = (
    "images array<struct<id: long, file_name: string, width: int, height: int>>, categories array<struct<id: long, name: string>>, "
    "annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>, iscrowd: int, segmentation: string>>"
)


def refuse(violations: DataFrame) -> None:
    """ValueError with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.rule}: {r.key} {r.detail}".rstrip() for r in found))


def _rule(name: str, key: Column, detail: Column | str = "") -> Column:
    return F.struct(F.lit(name).alias("rule"), key.cast("string").alias("key"), (F.lit(detail) if isinstance(detail, str) else F.coalesce(detail.cast("string"), F.lit("null"))).alias("detail"))


# --- COCO -------------------------------------------------------------------------------------


def coco_tables(documents: DataFrame, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """images, annotations and categories, each with its document's path, of documents (path, text); and the documents that aren't COCO.

    Ids count within their document.  With ``scratch`` the documents are parsed once and
    written as columns; without it only the table that is asked for is parsed out of
    the text, each time.  A segmentation stays JSON text, for it may be no list.
    """
    parsed = documents.select("path", F.from_json("text", COCO, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("d"))
    if scratch is not None:
        parsed = scratch.write(parsed, "parsed")
    whole = F.col("d.images").isNotNull() & F.col("d.annotations").isNotNull() & F.col("d.categories").isNotNull()
    out = {name: parsed.where(whole).select("path", F.explode(f"d.{name}").alias("x")).select("path", "x.*") for name in ("images", "annotations", "categories")}
    return out | {"broken": parsed.where(~whole).select("path")}


def _dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``rows`` by the columns over so many tasks; as Spark deals them for None."""
    return rows if tasks is None else rows.repartition(tasks, *by)


def coco_instances(tables: dict[str, DataFrame], tasks: int | None = None) -> DataFrame:
    """(path, annotation_id, image_id, file_name, category, bbox, iscrowd, segmentation) of annotations with image and category, joined by ``tasks`` tasks."""
    image = tables["images"].select("path", F.col("id").alias("image_id"), "file_name", "width", "height")
    category = tables["categories"].select("path", F.col("id").alias("category_id"), F.lower("name").alias("category"), F.col("name").alias("category_name"))
    notes = tables["annotations"].withColumnRenamed("id", "annotation_id")
    met = _dealt(notes, tasks, "path", "image_id").join(_dealt(image, tasks, "path", "image_id"), ["path", "image_id"])
    return _dealt(met, tasks, "path", "category_id").join(_dealt(category, tasks, "path", "category_id"), ["path", "category_id"])


def polygons(segmentation: Column) -> Column:
    """The polygons of a segmentation's text, null if it is no list of lists of numbers."""
    return F.when(F.ltrim(segmentation).startswith("["), F.from_json(segmentation, "array<array<double>>"))


def coco_violations(tables: dict[str, DataFrame], only: str | None = None, tasks: int | None = None) -> DataFrame:
    """(rule, key, detail): documents that aren't COCO, repeated ids, unknown images and categories, boxes out of the image.

    With ``only``, a category's name in any case, also annotations of other
    categories, crowds, segmentations that aren't polygons, and polygons of fewer than
    three points or half a point.  Each annotation meets its image, then its
    category, and is judged by all rules in one row; ``tasks`` is the number of tasks that
    judge them, and should grow with their number.
    """
    at = lambda c: F.concat_ws("#", "path", F.col(c).cast("string"))
    found = tables["broken"].select(_rule("not_coco", F.col("path")).alias("v"))
    for name in ("images", "annotations", "categories"):
        twice = _dealt(tables[name].select("path", "id"), tasks, "path", "id").groupBy("path", "id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
        found = found.unionByName(twice.select(_rule(f"{name}_id_twice", at("id"), F.col("n")).alias("v")))
    # One row for each id, however often a document has it.
    image = _dealt(tables["images"].select("path", F.col("id").alias("image_id"), "width", "height"), tasks, "path", "image_id")
    image = image.groupBy("path", "image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.lit(True).alias("_image"))
    names = _dealt(tables["categories"].select("path", F.col("id").alias("category_id"), F.lower("name").alias("name")), tasks, "path", "category_id")
    names = names.groupBy("path", "category_id").agg(F.min("name").alias("name"), F.lit(True).alias("_category"))
    notes = _dealt(tables["annotations"], tasks, "path", "image_id").join(image, ["path", "image_id"], "left")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    inside = (F.size("bbox") == 4) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= F.col("width")) & (y + h <= F.col("height"))
    out = F.col("bbox").isNotNull() & F.col("_image") & ~F.coalesce(inside, F.lit(False))
    rules = [(F.col("_image").isNull(), _rule("image_id_unknown", at("id"), F.col("image_id"))), (out, _rule("box_outside", at("id"), F.to_json("bbox")))]
    if only is not None:
        parts = polygons(F.col("segmentation"))
        bad = F.exists(parts, lambda p: (F.size(p) < 6) | (F.size(p) % 2 == 1) | F.exists(p, lambda v: v.isNull()))
        rules += [(F.col("iscrowd") != 0, _rule("crowd_refused", at("id"))), (parts.isNull(), _rule("segmentation_refused", at("id"))), (bad, _rule("polygon_malformed", at("id")))]
    verdicts = lambda rules: F.array_compact(F.array(*(F.when(broken, rule) for broken, rule in rules)))
    named = _dealt(notes.select("path", "id", "category_id", verdicts(rules).alias("vs")), tasks, "path", "category_id").join(names, ["path", "category_id"], "left")
    last = [(F.col("_category").isNull(), _rule("category_id_unknown", at("id"), F.col("category_id")))]
    if only is not None:
        last.append((F.col("name") != only.lower(), _rule("category_refused", at("id"), F.col("name"))))
    return found.unionByName(named.select(F.explode(F.concat("vs", verdicts(last))).alias("v"))).select("v.*")


# --- exports of frames ------------------------------------------------------------------------

_EXPORT = "path string, kind string, frame string, rule string, detail string, width int, height int, result string, complete boolean, instance_id string, n int, box array<double>, uncertain boolean, truncated boolean"
_FIELDS = [f.split()[0] for f in _EXPORT.split(", ")]


def _truth(text: str | None) -> bool | None:
    return {"true": True, "false": False}.get(text)


def _attributes(node: ET.Element, names: tuple[str, ...]) -> dict[str, str] | None:
    pairs = [(a.get("name"), a.text) for a in node.findall("attribute")]
    return dict(pairs) if Counter(k for k, _ in pairs) == Counter(names) else None


def _number(text: str | None) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        return math.nan


def _export(content: bytes, results: tuple[str, ...]) -> Iterator[dict]:
    """Frames, objects and violations of one export."""
    bad = lambda rule, frame=None, detail="": {"kind": "violation", "rule": rule, "frame": frame, "detail": detail}
    if len(content) > ARCHIVE_LIMIT:
        yield bad("archive_too_large", detail=str(len(content)))
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if archive.namelist().count("annotations.xml") != 1:
                yield bad("not_one_annotations_xml")
                return
            if archive.getinfo("annotations.xml").file_size > XML_LIMIT:
                yield bad("xml_too_large")
                return
            text = archive.read("annotations.xml")
        if any(mark in text.upper() for mark in (b"<!DOCTYPE", b"<!ENTITY")):
            yield bad("document_type")
            return
        root = ET.fromstring(text)
    except (zipfile.BadZipFile, zlib_error, ET.ParseError, NotImplementedError) as error:
        yield bad("unreadable", detail=type(error).__name__)
        return
    if root.tag != "annotations" or root.findtext("version") != VERSION:
        yield bad("version")
        return
    for node in root.findall("image"):
        name = node.get("name") or ""
        frame = name.removesuffix(".png")
        if not name.endswith(".png") or "/" in name or "\\" in name:
            yield bad("frame_name", name)
            continue
        width, height = (_number(node.get(k)) for k in ("width", "height"))
        if any(child.tag not in ("box", "tag") for child in node):
            yield bad("shape_refused", frame)
        tags, tag = node.findall("tag"), None
        if len(tags) != 1 or tags[0].get("label") != TAG:
            yield bad("not_one_review_tag", frame, str(len(tags)))
        elif (tag := _attributes(tags[0], TAG_ATTRIBUTES)) is None:
            yield bad("tag_attributes", frame)
        elif tag["result"] not in results:
            yield bad("result_unknown", frame, str(tag["result"]))
        elif _truth(tag["complete_for_size_rule"]) is None:
            yield bad("not_true_or_false", frame, "complete_for_size_rule")
        tag = tag or {}
        yield {"kind": "frame", "frame": frame, "width": int(width) if width == width else None, "height": int(height) if height == height else None, "result": tag.get("result"), "complete": _truth(tag.get("complete_for_size_rule"))}
        seen = set()
        for n, box in enumerate(node.findall("box"), 1):
            if box.get("label") != BOX_LABEL:
                yield bad("class_unknown", frame, str(box.get("label")))
                continue
            values = _attributes(box, BOX_ATTRIBUTES)
            if values is None or None in (flags := [_truth(values[k]) for k in BOX_ATTRIBUTES]):
                yield bad("box_attributes", frame, str(n))
                continue
            x1, y1, x2, y2 = at = [_number(box.get(k)) for k in ("xtl", "ytl", "xbr", "ybr")]
            if not (0 <= x1 < x2 <= width and 0 <= y1 < y2 <= height):  # also false where one isn't a number
                yield bad("box_outside", frame, str(n))
                continue
            identity = hashlib.sha256(json.dumps({"box": at, "class": BOX_LABEL, "truncated": flags[1], "uncertain": flags[0]}, sort_keys=True).encode()).hexdigest()[:16]
            if identity in seen:
                yield bad("box_twice", frame, str(n))
                continue
            seen.add(identity)
            yield {"kind": "object", "frame": frame, "instance_id": f"{frame}__box_{identity}", "n": n, "box": at, "uncertain": flags[0], "truncated": flags[1]}


def _parsed(files: DataFrame, rows_of: Callable[[str, bytes], Iterator[dict]], schema: str, fields: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [[{"path": path, **row}.get(f) for f in fields] for row in rows_of(path, content)]
                yield pd.DataFrame(rows, columns=fields).astype(object)

    return files.select("path", "content").mapInPandas(run, schema)


def export_tables(files: DataFrame, expected: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, objects, violations) of exports (path, content), held against the ``expected`` frames (frame, width, height).

    Each archive is parsed by itself, and only its annotations.xml is opened.
    Frames must be those expected, each once over all archives, of their sizes.
    """
    rows = _parsed(files, lambda _, content: _export(bytes(content), results), _EXPORT, _FIELDS)
    frames = rows.where("kind = 'frame'").select("path", "frame", "width", "height", "result", "complete")
    objects = rows.where("kind = 'object'").select("path", "frame", "instance_id", "n", "box", "uncertain", "truncated")
    own = rows.where("kind = 'violation'").select("rule", F.coalesce("frame", "path").alias("key"), "detail")
    twice = frames.groupBy("frame").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("frame_twice").alias("rule"), F.col("frame").alias("key"), F.col("n").cast("string").alias("detail"))
    want = expected.select(F.col("frame").alias("_f"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    both = frames.join(want, F.col("frame") == F.col("_f"), "full")
    same = F.col("width").eqNullSafe(F.col("_w")) & F.col("height").eqNullSafe(F.col("_h"))
    rule = F.when(F.col("frame").isNull(), "frame_missing").when(F.col("_f").isNull(), "frame_not_expected").when(~same, "frame_size")
    held = both.select(rule.alias("rule"), F.coalesce("frame", "_f").alias("key"), F.lit("").alias("detail")).where("rule is not null")
    return frames, objects, own.unionByName(twice).unionByName(held)


# --- product labels ---------------------------------------------------------------------------

_VECTORS = {"C": "Vector_Center", "A": "Vector_Axis", "H": "Vector_Horizontal", "V": "Vector_Vertical", "O": "Vector_Optical", "R": "Radial_Terms"}
_LABEL = "path string, id string, problem string, start string, frame string, sol string, eye string, sequence string, C array<double>, A array<double>, H array<double>, V array<double>, O array<double>, R array<double>, bands int, height int, width int, source_image string, file_size long, offset long"
_LABEL_FIELDS = [f.split()[0] for f in _LABEL.split(", ")]


def _one(node: ET.Element, tag: str) -> ET.Element:
    found = [e for e in node.iter() if e.tag.rsplit("}", 1)[-1] == tag]
    if len(found) != 1:
        raise ValueError(f"{len(found)} of {tag}")
    return found[0]


def _children(node: ET.Element, tag: str) -> list[ET.Element]:
    return [e for e in node if e.tag.rsplit("}", 1)[-1] == tag]


def _label(path: str, content: bytes) -> dict:
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper()
    if any(mark in content.upper() for mark in (b"<!DOCTYPE", b"<!ENTITY")):
        raise ValueError("document types are not read")
    root = ET.fromstring(content)
    if _one(root, "alternate_id").text != stem:
        raise ValueError("the label's id isn't its file's name")
    camera = _one(root, "Camera_Model_Parameters")
    model, space = _one(camera, "CAHVOR_Model"), _one(camera, "Coordinate_Space_Indexed")
    vectors = {}
    for name, tag in _VECTORS.items():
        vectors[name] = [float(child.text) for child in _one(model, tag)]
        if len(vectors[name]) != 3 or not all(map(math.isfinite, vectors[name])):
            raise ValueError(f"{tag} isn't three finite numbers")
    image = _one(root, "Array_3D_Image")
    axes = [(_one(a, "axis_name").text, int(_one(a, "elements").text)) for a in _children(image, "Axis_Array")]
    if [name for name, _ in axes] != ["Band", "Line", "Sample"]:
        raise ValueError("the axes aren't band, line and sample")
    if _one(image, "data_type").text != "UnsignedByte" or _one(image, "axis_index_order").text != "Last Index Fastest":
        raise ValueError("only unsigned bytes, band by band, are read")
    file = _one(_one(root, "File_Area_Observational"), "File")
    indices = sorted((_one(i, "index_id").text, _one(i, "index_value_number").text) for i in _children(space, "Coordinate_Space_Index"))
    frame = json.dumps([_one(space, "coordinate_space_frame_type").text, indices, _one(space, "solution_id").text])
    (_, bands), (_, height), (_, width) = axes
    return {
        "id": stem, "start": _one(root, "start_date_time").text, "frame": frame, "sol": stem[:4], "eye": {"ML": "L", "MR": "R"}.get(stem[4:6]), "sequence": stem[6:12], **vectors,
        "bands": bands, "height": height, "width": width, "source_image": _one(file, "file_name").text, "file_size": int(_one(file, "file_size").text), "offset": int(_one(image, "offset").text),
    }


def product_labels(files: DataFrame) -> DataFrame:
    """Labels (path, content) with id, start, coordinate frame, sol, eye, sequence, camera vectors and the image's layout, as ``stereo`` takes them.

    ``problem`` tells what a label breaks; all else is null then.
    """

    def rows(path: str, content: bytes) -> Iterator[dict]:
        try:
            yield _label(path, bytes(content))
        except (ValueError, TypeError, AttributeError, ET.ParseError) as error:
            yield {"problem": f"{type(error).__name__}: {error}"}

    return _parsed(files, rows, _LABEL, _LABEL_FIELDS).withColumn("start", F.try_to_timestamp("start"))


def product_images(labels: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem, bands, height, width, pixels, sha256) of the labels' images: bytes band by band, cut out of the file at its offset.

    The file lies in its label's folder.  Its size must be the label's.
    """
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    want = labels.where("problem is null").select("id", "bands", "height", "width", "file_size", "offset", F.concat(folder("path"), F.col("source_image")).alias("at"))
    both = want.join(files.select(F.col("path").alias("at"), "content"), "at", "left")
    n = F.col("bands").cast("long") * F.col("height") * F.col("width")
    problem = F.when(F.col("content").isNull(), "image_missing").when(F.length("content") != F.col("file_size"), "file_size").when((F.col("offset") < 0) | (F.col("offset") + n > F.length("content")), "beyond_the_file")
    cut = F.when(problem.isNull(), F.expr("substring(content, cast(offset + 1 as int), cast(bands * height * width as int))"))
    return both.select("id", problem.alias("problem"), "bands", "height", "width", cut.alias("pixels"), F.sha2("content", 256).alias("sha256"))


def band(pixels: bytes, bands: int, height: int, width: int) -> np.ndarray:
    """(height, width, bands) of bytes band by band."""
    return np.frombuffer(pixels, np.uint8).reshape(bands, height, width).transpose(1, 2, 0)
