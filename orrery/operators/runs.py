"""Runs against each other and against stores: resume, import, comparison, assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import effect_seed


def pending(requests: DataFrame, done: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a result yet."""
    return requests.join(done.select(key), key, "left_anti")


def import_rows(incoming: DataFrame, store: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): insert new rows, skip equal ones, and tell of rows that differ."""
    far = store.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = incoming.join(far, key, "left")
    return both.select(key, F.when(F.col("_there").isNull(), "insert").when(same, "skip").otherwise("mismatch").alias("action"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, columns: list[str], ok: str | None = None) -> DataFrame:
    """Null-safe equality of each column for the keys of both runs.

    With ``ok``, a condition of a row, ``both_ok`` tells whether both runs meet it,
    and where they don't equality is null: what failed is neither same nor different.
    """
    far = b.select(key, *(F.col(c).alias(f"_{c}") for c in columns), *([F.expr(ok).alias("_ok_b")] if ok else []))
    near = a.withColumn("_ok_a", F.expr(ok)) if ok else a
    both = near.join(far, key)
    good = F.coalesce(F.col("_ok_a") & F.col("_ok_b"), F.lit(False)) if ok else F.lit(True)
    same = [F.when(good, F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"same_{c}") if ok else F.col(c).eqNullSafe(F.col(f"_{c}")).alias(f"same_{c}") for c in columns]
    return both.select(key, *([good.alias("both_ok")] if ok else []), *same)


def structural_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """added, missing or changed entries of two (key, path, value) tables."""
    both = a.select(key, "path", F.col("value").alias("l"), F.lit(1).alias("in_l")).join(b.select(key, "path", F.col("value").alias("r"), F.lit(1).alias("in_r")), [key, "path"], "full")
    change = F.when(F.col("in_l").isNull(), "added").when(F.col("in_r").isNull(), "missing").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "path", "change")


def flatten(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value) of the named columns."""
    each = F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.*")


def variants(sources: DataFrame, conditions: DataFrame, seed: int) -> DataFrame:
    """Every source under every condition, with its child id and effect seed; conditions are a protocol's few rows."""
    both = sources.crossJoin(F.broadcast(conditions))
    first = F.when(F.col("effects") != "", F.split("effects", r"\+")[0]).otherwise("clean")
    return both.withColumns({"child_id": F.sha2(F.concat_ws(":", "sample_id", "condition_id"), 256), "effect_seed": effect_seed(F.lit(str(seed)), F.col("sample_id"), first)})


def condition_answer(answers: Column, condition: Column, original: Column, crater: Column, shear: Column) -> Column:
    """Struct (answer, known): a condition's own answer if it has one; shear voids answers about geometry."""
    own = F.map_contains_key(answers, condition)
    answer = F.when(own, F.element_at(answers, condition)).when(crater & shear, F.lit(None)).otherwise(original)
    return F.struct(answer.alias("answer"), answer.isNotNull().alias("known"))


def task_maps(rows: DataFrame, image: str, task: str, value: str, tasks: int) -> DataFrame:
    """One row for each image with a map of its tasks, and whether it has exactly ``tasks`` different ones."""
    out = rows.groupBy(image).agg(F.array_sort(F.collect_set(F.struct(task, value))).alias("m"), F.count_distinct(task).alias("n"))
    ok = (F.col("n") == tasks) & (F.size("m") == tasks)
    return out.select(image, F.concat_ws(";", F.transform("m", lambda x: F.concat_ws("=", x[task], x[value]))).alias("tasks"), ok.alias("complete"))


def journal_check(journal: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys whose journal entry or file is missing, or whose hashes differ."""
    both = journal.select(key, F.col("sha").alias("l")).join(found.select(key, F.col("sha").alias("r")), key, "full")
    problem = F.when(F.col("l").isNull(), "not_in_journal").when(F.col("r").isNull(), "file_missing").when(F.col("l") != F.col("r"), "hash_differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


class Registry:
    """Named model adapters: factories of objects with ``predict(row)`` and ``close()``."""

    def __init__(self, reserved: tuple[str, ...] = ()):
        self._of: dict[str, Callable[[], object]] = {}
        self._reserved = reserved

    def add(self, name: str, factory: Callable[[], object]) -> None:
        if not name or name in self._of or name in self._reserved:
            raise ValueError(f"adapter name is blank, taken or reserved: {name!r}")
        if not callable(factory):
            raise TypeError("an adapter factory must be callable")
        self._of[name] = factory

    def get(self, name: str) -> Callable[[], object]:
        if name not in self._of:
            raise KeyError(f"unknown adapter {name!r}; known: {sorted(self._of)}")
        return self._of[name]


class Mock:
    """Answers by a lookup with a default."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = "NO"):
        self.answers, self.default = answers or {}, default

    def predict(self, row: dict) -> str:
        if row["prompt"] is None:
            raise ValueError("no prompt")
        return self.answers.get(row["request_id"], self.default)

    def close(self) -> None:
        pass


def run_adapter(requests: DataFrame, factory: Callable[[], object]) -> DataFrame:
    """(request_id, status, raw_response, error_message): an adapter for each task, opened once and always closed.

    An exception of ``predict`` becomes the row's error; no row is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = factory()
        try:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    try:
                        response = adapter.predict(row)
                        if not isinstance(response, str):
                            raise TypeError("a response must be a string")
                        out.append((row["request_id"], "ok", response, None))
                    except Exception as error:  # noqa: BLE001  whatever a model raises
                        out.append((row["request_id"], "error", "", f"{type(error).__name__}: {error}"))
                yield pd.DataFrame(out, columns=["request_id", "status", "raw_response", "error_message"])
        finally:
            adapter.close()

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id string, status string, raw_response string, error_message string")


def response_rules(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that break the contract: unknown or repeated ids, unknown status, an error without message."""
    from .validate import broken, duplicates, unmatched

    rules = {"status_unknown": F.col("status").isin("ok", "error", "unsupported"), "error_without_message": (F.col("status") != "error") | F.col("error_message").isNotNull()}
    return duplicates(responses, "request_id", "response_twice").union(unmatched(responses, requests, "request_id", "request_unknown")).union(broken(responses, "request_id", rules))
