"""Fill-in-the-middle: texts cut at two units and arranged around sentinels, in built-in expressions alone.

Every row is worked on by itself: no shuffle, no Python, and a lost task is
simply run again with the same result, for all draws come from the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a run of letters, or any other code point.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


def _draw(digest: Column, k: int) -> Column:
    """The ``k``-th of the digest's 32-bit groups, unsigned."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start, length), "")


def arranged(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: str = "1", rate: int = 90, spm: int = 20, into: str = "fim") -> DataFrame:
    """``docs`` with a struct ``into``: n (units), form, prefix, middle, suffix, output.

    Of 100 texts ``rate`` are arranged, of those ``spm`` of 100 suffix first (spm,
    else psm), by the digest of seed and id; the rest, empty texts and texts that
    hold a sentinel are plain: output is the text, the parts are null.

    A null text is empty.  A null id draws as the empty id.  Rows that repeat an id
    draw alike, each over its own text.  Texts of any length are cut whole.  Other
    columns, of any name, go along; one named ``into`` is replaced.  An empty table
    gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    out = docs.select(F.struct(*[docs[c] for c in docs.columns if c != into]).alias("_row"), whole.alias("_text"), digest.alias("_digest"))
    out = out.withColumn("_units", F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)))
    out = out.withColumn("_n", F.size("_units").cast("long"))
    one, two = (_draw(F.col("_digest"), k) % (F.col("_n") + 1) for k in (0, 1))
    bare = (F.col("_n") == 0) | (_draw(F.col("_digest"), 2) % 100 >= rate)
    for sentinel in SENTINELS:
        bare = bare | F.col("_text").contains(sentinel)
    form = F.when(bare, "plain").when(_draw(F.col("_digest"), 3) % 100 < spm, "spm").otherwise("psm")
    out = out.withColumns({"_form": form, "_a": F.least(one, two).cast("int"), "_b": F.greatest(one, two).cast("int")})
    cut = F.when(F.col("_form") != "plain", F.struct(
        _joined(F.col("_units"), F.lit(1), F.col("_a")).alias("p"),
        _joined(F.col("_units"), F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("m"),
        _joined(F.col("_units"), F.col("_b") + 1, F.col("_n").cast("int") - F.col("_b")).alias("s"),
    ))
    out = out.withColumn("_cut", cut)
    psm = F.concat(F.lit(PREFIX), "_cut.p", F.lit(SUFFIX), "_cut.s", F.lit(MIDDLE), "_cut.m")
    spm_ = F.concat(F.lit(SUFFIX), "_cut.s", F.lit(PREFIX), "_cut.p", F.lit(MIDDLE), "_cut.m")
    output = F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", psm).otherwise(spm_)
    fields = {"n": "_n", "form": "_form", "prefix": "_cut.p", "middle": "_cut.m", "suffix": "_cut.s"}
    return out.select("_row.*", F.struct(*[F.col(c).alias(k) for k, c in fields.items()], output.alias("output")).alias(into))


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was written alone: parts between sentinels, put back in order.

    No sentinel can arise where a part meets a sentinel: one that lay across the
    border would need its ``<`` inside the other.  Null outputs give null.
    """
    parts = F.split(output, "|".join(SENTINELS), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
