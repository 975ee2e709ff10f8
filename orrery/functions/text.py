"""Text columns: labels, structured answers, names, exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() sees it (fixed values): Java's \s lacks the separators and the two single bytes.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normalize_label(text: Column) -> Column:
    """Collapse white space, trim, lower-case (full case folding differs for a few letters such as sharp s)."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def parse_answer(text: Column, labels: Column) -> Column:
    """The first label equal to the text after normalisation; prose is never searched."""
    return F.get(F.filter(labels, lambda x: normalize_label(x) == normalize_label(text)), 0)


def labels_distinct(labels: Column) -> Column:
    """Whether labels stay distinct and not blank after normalisation."""
    norm = F.transform(labels, normalize_label)
    return (F.size(F.array_distinct(norm)) == F.size(norm)) & ~F.exists(norm, lambda x: x == "")


#: Answers that say that there is none (fixed values).
ABSTAINED = ("UNSURE", "UNKNOWN", "UNCERTAIN", "CANNOT DETERMINE")


def _after(line: Column, mark: str) -> Column:
    return F.trim(F.regexp_replace(F.substring(line, len(mark) + 1, 1 << 30), r"^[ \t]+", ""))


def label_evidence(text: Column, labels: Column) -> Column:
    """Answers of one line, or two with the evidence, as a struct: parsed_answer, label_valid, format_valid, evidence, abstained."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+\z", ""), r"\r?\n")
    first, second, n = F.get(lines, 0), F.get(lines, 1), F.size(lines)
    shaped = first.startswith("ANSWER:") & (F.length(first) > len("ANSWER:")) & ~F.exists(lines, lambda x: x.contains("\r")) & ((n == 1) | ((n == 2) & second.startswith("EVIDENCE:")))
    said, evidence = F.when(shaped, _after(first, "ANSWER:")), F.when(shaped & (n == 2), _after(second, "EVIDENCE:"))
    label = parse_answer(F.when(said != "", said), labels)
    valid = label.isNotNull()
    return F.struct(
        label.alias("parsed_answer"), valid.alias("label_valid"),
        (valid & F.coalesce(evidence != "", F.lit(False))).alias("format_valid"), evidence.alias("evidence"),
        (~valid & F.coalesce(F.upper(said).isin(*ABSTAINED), F.lit(False))).alias("abstained"),
    )


def source_stem(path: Column) -> Column:
    """Base name without extension and without the lunar archive prefix, lower-cased."""
    base = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(base, r"^moon_wac_(train|val|test)_", ""))


def scene_group(name: Column) -> Column:
    """Sol of a rover frame name as a group, else 'unknown'."""
    sol = F.regexp_extract(name, r"^(?:cr_)?(\d+)_(.+)$", 1)
    return F.when(sol != "", F.concat(F.lit("MSL_sol_"), sol.cast("long").cast("string"))).otherwise("unknown")


def product_name(name: Column) -> Column:
    return F.regexp_replace(name, r"E0*(\d+)_DXXX", "E$1_DXXX")


def frame_timestamp(stem: Column) -> Column:
    """First integer in a stem, else the stem."""
    number = F.regexp_extract(stem, r"(\d+)", 1)
    return F.when(number != "", number).otherwise(stem)


def csv_cell(text: Column) -> Column:
    """A quoted CSV cell whose text no spreadsheet takes for a formula."""
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def chain_label(effects: Column) -> Column:
    return F.concat_ws("+", effects)


def has_effect(condition: Column, effect: str) -> Column:
    return F.array_contains(F.split(condition, r"\+"), effect)


def image_group(name: Column) -> Column:
    """Group of an orbital image tile, from its name; null for a name of no known kind."""
    tile, strip = F.regexp_extract(name, r"^(M\d+_r\d+)_c\d+", 1), F.regexp_extract(name, r"^(thm_dir_N\d+)", 1)
    return F.when(tile != "", tile).when(strip != "", strip)


def package(text: Column) -> Column:
    """Struct name, version of a pinned package; the name in its normal form."""
    return F.struct(F.regexp_replace(F.lower(F.split_part(text, F.lit("=="), F.lit(1))), r"[-_.]+", "-").alias("name"), F.split_part(text, F.lit("=="), F.lit(2)).alias("version"))
