"""Scenes in archives: frames whose modalities are all there, picks over a scene's length, members read with their checksums.

Archives come as (path, content) from Spark's binary reader.  The directory at an
archive's end tells its members; only picked members are unpacked, and each
says what is wrong with it instead of ending the job.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.select import evenly_spaced

#: Fixed values of the layout: folder and suffix of each modality below a camera's folder.
MODALITIES = {"rgb": ("color", ".png"), "depth": ("depth", ".pfm"), "label": ("label", ".png")}


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, size, packed, crc, problem) of each archive's directory; an archive that can't be read is one row with a problem."""
    fields = ["path", "member", "size", "packed", "crc", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, i.filename, i.file_size, i.compress_size, i.CRC, None) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, ValueError) as error:
                    rows = [(path, None, None, None, None, str(error))]
                yield pd.DataFrame(rows, columns=fields).astype(object)

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, packed long, crc long, problem string")


def scene_frames(members: DataFrame, camera: str = "image0") -> DataFrame:
    """(path, stem, assets) of the frames of which a camera has all modalities; ``assets`` maps a modality to its member."""
    name = F.concat(F.lit("/"), F.regexp_replace(F.replace(F.col("member"), F.lit("\\"), F.lit("/")), "^/+", ""))
    rows = members.where("member is not null").select("path", "member", name.alias("name"))
    stem: Column = F.lit(None).cast("string")
    kind: Column = F.lit(None).cast("string")
    root: Column = F.lit(None).cast("string")
    for modality, (folder, suffix) in MODALITIES.items():
        pattern = rf"^(.*)/{camera}/{folder}/([^/]+)\{suffix}$"
        fits = F.col("name").rlike(pattern)
        kind = F.when(fits, modality).otherwise(kind)
        stem = F.when(fits, F.regexp_extract("name", pattern, 2)).otherwise(stem)
        root = F.when(fits, F.regexp_extract("name", pattern, 1)).otherwise(root)
    rows = rows.select("path", "member", kind.alias("modality"), stem.alias("stem"), root.alias("root")).where("modality is not null")
    whole = rows.groupBy("path", "root", "stem").agg(F.count_distinct("modality").alias("n"), F.array_sort(F.collect_list(F.struct("modality", "member"))).alias("_a"))
    # A member that an archive names twice makes no frame of it, for which of the two is meant isn't known.
    return whole.where(F.col("n") == len(MODALITIES)).where(F.size("_a") == len(MODALITIES)).select("path", "root", "stem", F.map_from_entries("_a").alias("assets"))


def pick_frames(frames: DataFrame, k: int) -> DataFrame:
    """``k`` frames of each archive, evenly over its frames in the order of their names; archives of fewer frames have all, and ``complete`` is false."""
    picked = evenly_spaced(frames.withColumn("_o", F.struct("stem", "root")), "path", "_o", k).drop("_o").withColumnRenamed("i", "frame_index")
    n = frames.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("n_frames"))
    return picked.join(n, F.col("path") == F.col("_p")).drop("_p").withColumn("complete", F.col("n_frames") >= k)


def _unpacked(archive: zipfile.ZipFile, member: str, limit: int) -> tuple[bytes | None, int | None, str | None]:
    """Bytes, checksum and problem of one member, read piece by piece."""
    try:
        info = archive.getinfo(member)
        if info.file_size > limit:
            return None, info.CRC, "too_large"
        pieces, crc, n = [], 0, 0
        with archive.open(info) as stream:
            while piece := stream.read(1 << 20):
                crc, n = zlib.crc32(piece, crc), n + len(piece)
                if n > info.file_size:
                    return None, crc, "size"
                pieces.append(piece)
        if n != info.file_size:
            return None, crc, "size"
        return (b"".join(pieces), crc, None) if crc == info.CRC else (None, crc, "checksum")
    except KeyError:
        return None, None, "missing"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as error:
        return None, None, "checksum" if "CRC" in str(error) else f"unreadable: {type(error).__name__}"


def extracted(files: DataFrame, picks: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """(path, stem, frame_index, modality, member, size, crc, sha256, content, problem): a row for each picked member.

    An archive meets its picks once, so it is opened once, by one task; ``k`` frames
    bound what is picked of it.  A member whose bytes don't give its checksum, or
    that is larger than ``limit``, has no content and a problem.
    """
    wanted = picks.select("path", F.struct("stem", "frame_index", F.map_entries("assets").alias("assets")).alias("p")).groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("picks"))
    fields = ["path", "stem", "frame_index", "modality", "member", "size", "crc", "sha256", "content", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content, chosen in zip(pdf["path"], pdf["content"], pdf["picks"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for p in chosen:
                        for asset in p["assets"]:
                            data, crc, problem = _unpacked(z, asset["value"], limit)
                            sha = None if data is None else hashlib.sha256(data).hexdigest()
                            yield pd.DataFrame([(path, p["stem"], p["frame_index"], asset["key"], asset["value"], None if data is None else len(data), crc, sha, data, problem)], columns=fields).astype(object)

    both = files.select("path", "content").join(wanted, "path")
    return both.mapInPandas(run, "path string, stem string, frame_index long, modality string, member string, size long, crc long, sha256 string, content binary, problem string")


def scene_index(members: DataFrame) -> DataFrame:
    """(path, stem, frame_index, assets, usable): a record for each frame with what is known of its modalities, without their bytes."""
    asset = F.struct("member", "size", F.lpad(F.lower(F.hex("crc")), 8, "0").alias("crc32"), "sha256", "problem")
    return members.groupBy("path", "stem", "frame_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", asset.alias("asset"))))).alias("assets"), F.bool_and(F.col("problem").isNull()).alias("usable"))
