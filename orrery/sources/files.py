"""Binary formats inside tables of (path, content): archives, arrays, images, annotations."""

from __future__ import annotations

import csv
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 64 << 20


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def missing_assets(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Paths named in a manifest that a listing lacks; only names are read."""
    return paths.select("path").distinct().join(files.select("path"), "path", "left_anti")


def parse(files: DataFrame, function: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``function`` finds in each file, with the path in front; one file is in memory at a time."""
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in function(content)], columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > LIMIT:
        raise ValueError(f"{name} is larger than {LIMIT} bytes")
    return archive.read(info)


def csv_in_zip(member: str, columns: list[str], unique: str | None = None) -> Callable[[bytes], list[tuple]]:
    def read(content: bytes) -> list[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            rows = list(csv.DictReader(io.StringIO(_member(z, member).decode("utf-8-sig"))))
        if unique and len({r[unique] for r in rows}) != len(rows):
            raise ValueError(f"{unique} repeats in {member}")
        return [tuple(r[c] for c in columns) for r in rows]

    return read


def boxes_in_zip(content: bytes) -> list[tuple]:
    """(image, label, x1, y1, x2, y2, occluded) of the one annotations.xml of an annotation export; document types are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == "annotations.xml"]
        if len(names) != 1:
            raise ValueError("expected one annotations.xml")
        text = _member(z, names[0])
    if b"<!DOCTYPE" in text or b"<!ENTITY" in text:
        raise ValueError("document types are not read")
    return [(i.get("name"), b.get("label"), *(float(b.get(k)) for k in ("xtl", "ytl", "xbr", "ybr")), b.get("occluded") == "1") for i in ET.fromstring(text).iter("image") for b in i.iter("box")]


def zip_listing(content: bytes) -> list[tuple]:
    """(name, size, problem) of an archive's entries; problem names unsafe ones."""
    out, seen = [], set()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in z.infolist():
            bad = None
            if i.filename.startswith("/") or "\\" in i.filename or ".." in i.filename.split("/"):
                bad = "traversal"
            elif (i.external_attr >> 16) & 0o170000 == 0o120000:
                bad = "symlink"
            elif i.filename in seen:
                bad = "duplicate"
            elif i.file_size > LIMIT:
                bad = "size"
            seen.add(i.filename)
            out.append((i.filename, i.file_size, bad))
    return out


def npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def pfm(content: bytes) -> np.ndarray:
    """A portable float map, rows as stored."""
    kind, size, scale, data = re.match(rb"(PF|Pf)\s+(\d+\s+\d+)\s+(-?[\d.]+)\s(.*)", content, re.DOTALL).groups()
    width, height = map(int, size.split())
    shape = (height, width, 3) if kind == b"PF" else (height, width)
    return np.frombuffer(data, "<f4" if float(scale) < 0 else ">f4", int(np.prod(shape))).reshape(shape).astype(np.float32)


def bsq(content: bytes, bands: int, lines: int, samples: int) -> np.ndarray:
    """Unsigned bytes, band sequential."""
    if len(content) != bands * lines * samples:
        raise ValueError("the size isn't bands x lines x samples")
    return np.frombuffer(content, np.uint8).reshape(bands, lines, samples)


def label_values(content: bytes) -> list[tuple]:
    """(name, value) of all leaf elements of an XML label, without name spaces; document types are refused."""
    if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
        raise ValueError("document types are not read")
    return [(e.tag.rsplit("}", 1)[-1], (e.text or "").strip()) for e in ET.fromstring(content).iter() if not len(e)]


def png(content: bytes) -> np.ndarray:
    """An 8- or 16-bit grey, RGB or RGBA image that isn't interlaced."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data = 8, b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth not in (8, 16) or colour not in (0, 2, 4, 6) or interlace:
                raise ValueError("this kind of PNG is not read")
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind == 1:
            line = line.reshape(width, step).cumsum(axis=0).ravel() & 255
        elif kind in (3, 4):
            for x in range(len(line)):
                a = line[x - step] if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                near = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = line[x] + near & 255
        out[y], above = line, line
    image = out.reshape(height, width, channels) if depth == 8 else out.reshape(height, width, channels, 2).view(">u2").reshape(height, width, channels).astype(np.uint16)
    return image[:, :, 0] if channels == 1 else image


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO file."""
    schema = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>>>, categories array<struct<id: long, name: string>>"
    whole = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return tuple(whole.select(F.explode(c).alias("x")).select("x.*") for c in ("images", "annotations", "categories"))
