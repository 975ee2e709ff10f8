"""Benchmark decontamination as a prefix-filtered set join.

Method.  Each item of the benchmark gives its windows of ``window`` consecutive
words (an item of fewer words is one window).  A window's set is its word
shingles.  Since a document must hold all of them, the necessary prefix is one
shingle, and the cheapest is the rarest: shingles are ordered by how often they
occur in all documents.  Documents are probed with these prefix shingles alone.
A hit at word ``p`` with a shingle that stands at word ``o`` of its window can
only mean the window at ``p - o``; the length bound drops windows that would
leave the document, and the rest are verified word by word at that place.

Scale.  The benchmark's windows are the query set.  They go to the executors
in blocks of at most about ``block`` (window, item) pairs, each with a pass
over the documents, so memory is bounded whatever the benchmark's size; with
one block nothing is shuffled but the shingle counts.  Documents are never
exploded: each comes out as one row with its hit runs and items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ALNUM, U, Words, lists, mix, slices, trimmed, windows

WINDOW, SHINGLE, BLOCK = 13, 3, 200_000


def _item_windows(size: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"), ALNUM)
            row, found = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                of = words.hash[a:b].view(np.int64)
                for j in range(max(1, b - a - size + 1)) if b > a else ():
                    row.append(i)
                    found.append(of[j : j + size])
            yield pa.record_batch([part.column("item").take(pa.array(row, pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["item", "w"])

    return run


class Probe:
    """A sorted table of 64-bit keys that is looked up through a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = U((1 << max(16, int(len(keys) * 32).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of keys that are here, and which."""
        at = np.flatnonzero(self.bits[h & self.mask])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return at[good], k[good]


class Windows:
    """A block of benchmark windows: word hashes, lengths, the items of each, and shingles by size."""

    def __init__(self, pairs: list[tuple[str | None, tuple[int, ...]]]):
        order = sorted(pairs, key=lambda p: p[1])
        self.names = sorted({item for item, _ in order if item is not None})
        code = {name: k for k, name in enumerate(self.names)}
        unique: list[tuple[int, ...]] = []
        self.owner, self.item = [], []
        for item, w in order:
            if not unique or unique[-1] != w:
                unique.append(w)
            if item is not None:  # a window without an item is looked for all the same
                self.owner.append(len(unique) - 1)
                self.item.append(code[item])
        self.owner, self.item = np.array(self.owner, np.int64), np.array(self.item, np.int64)
        self.length = np.array([len(w) for w in unique], np.int64)
        self.words = np.zeros((len(unique), max(map(len, unique), default=0)), U)
        for i, w in enumerate(unique):
            self.words[i, : len(w)] = np.array(w, np.int64).view(U)
        shingles = {s: [] for s in sorted({min(SHINGLE, len(w)) for w in unique})}
        for i, n in enumerate(self.length.tolist()):
            s = min(SHINGLE, n)
            h = windows(self.words[i, :n], s)
            shingles[s].append(np.stack([h, np.full(len(h), i, U), np.arange(len(h), dtype=U)]))
        #: By shingle size: hash, window and place in the window.
        self.shingles = {s: np.concatenate(x, axis=1) for s, x in shingles.items()}

    def keys(self) -> dict[int, Probe]:
        return {s: Probe(np.unique(x[0])) for s, x in self.shingles.items()}

    def prefix(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple[Probe, np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: the windows' rarest shingles, with the windows that each one stands for and its place there."""
        out = {}
        for s, (h, w, place) in self.shingles.items():
            n = np.array([counts.get((s, k), 0) for k in h.view(np.int64).tolist()], np.int64)
            order = np.lexsort((place, n, w))
            first = order[np.unique(w[order], return_index=True)[1]]
            first = first[np.argsort(h[first], kind="stable")]
            keys, at = np.unique(h[first], return_index=True)
            out[s] = Probe(keys), np.append(at, len(first)), w[first].astype(np.int64), place[first].astype(np.int64)
        return out


def _count(keys):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(p.keys), np.int64) for s, p in keys.value.items()}
        for part in slices(batches, "text"):
            words = Words(part.column("text"), ALNUM)
            for s, p in keys.value.items():
                total[s] += np.bincount(p.find(windows(words.hash, s))[1], minlength=len(p.keys))
        for s, n in total.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), s, np.int32)), pa.array(keys.value[s].keys[some].view(np.int64)), pa.array(n[some])], ["s", "h", "n"])

    return run


def _probe(table):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, prefix = table.value
        names = pa.array(block.names, pa.string())
        pair_at = np.searchsorted(block.owner, np.arange(len(block.length) + 1))
        for part in slices(batches, "text"):
            words = Words(part.column("text"), ALNUM)
            total, starts, found = len(words.hash), [], []
            for s, (probe, span, window, place) in prefix.items():
                at, k = probe.find(windows(words.hash, s))
                many = span[k + 1] - span[k]
                index = np.repeat(span[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
                starts.append(np.repeat(at, many) - place[index])
                found.append(window[index])
            start, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, found))
            doc = np.searchsorted(words.first, start, "right") - 1
            fits = (start >= 0) & (doc >= 0)
            fits[fits] = start[fits] + block.length[w[fits]] <= words.first[np.minimum(doc[fits] + 1, len(words))]
            start, w, doc = start[fits], w[fits], doc[fits]
            for j in range(block.words.shape[1]):
                same = (words.hash[np.minimum(start + j, total - 1)] == block.words[w, j]) | (j >= block.length[w])
                start, w, doc = start[same], w[same], doc[same]
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.length[w], -1)
            hit = np.zeros(total + 2, np.int8)
            hit[1:-1] = np.cumsum(edge[:-1]) > 0
            # Runs end at text ends: a hit never crosses one, but two runs may touch there.
            step = np.diff(hit)
            begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            cuts = words.first[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < total)]
            cuts = np.unique(cuts[(hit[cuts] > 0) & (hit[cuts + 1] > 0)]) if len(cuts) else cuts
            begins, ends = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))
            of = np.searchsorted(words.first, begins, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array(begins - words.first[of]), pa.array(ends - words.first[of])], ["s", "e"])
            runs = lists(np.bincount(of, minlength=len(words)), runs)
            many = pair_at[w + 1] - pair_at[w]
            index = np.repeat(pair_at[w] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs = np.unique(np.repeat(doc, many) * len(block.names) + block.item[index])
            n_items = np.bincount(pairs // len(block.names), minlength=len(words))
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)), names.take(pa.array(pairs % len(block.names))))
            # Of a text's words in their order: rows of one id are told apart by it.
            placed = mix(words.hash + (np.arange(total) - np.repeat(words.first[:-1], words.counts)).astype(U) * U(0xD6E8FEB86659FD93))
            key = mix(np.add.reduceat(np.append(placed, U(0)), words.first[:-1]) * (words.counts > 0) + words.counts.astype(U))
            yield pa.record_batch(
                [part.column("id"), pa.array(words.counts), pa.array(key.view(np.int64)), runs, items],
                ["id", "n_words", "key", "runs", "items"],
            )

    return run


@trimmed
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of several blocks as maximal runs."""
    for batch in batches:
        merged = []
        for runs in batch.column("runs").to_pylist():
            own: list[dict[str, int]] = []
            for run in sorted(runs, key=lambda r: r["s"]):
                if own and run["s"] <= own[-1]["e"]:
                    own[-1]["e"] = max(own[-1]["e"], run["e"])
                else:
                    own.append(dict(run))
            merged.append(own)
        at = batch.schema.get_field_index("runs")
        yield batch.set_column(at, batch.schema.field(at), pa.array(merged, batch.schema.field(at).type))


PROBED = "id long, n_words long, key long, runs array<struct<s: long, e: long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, runs, items) of every row of ``docs``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased (A-Z)
    texts.  ``runs`` are the hit words as (s, e) pairs of word numbers, end
    excluded, ``items`` the items with a window in the document.  A
    document is contaminated if it has a hit and at least ``percent`` of its
    words are hit.

    Null, empty and wordless texts have 0 words and are clean; such items have
    no window.  Rows of the benchmark without an id count for ``runs``, ``n_hit``
    and ``contaminated`` like all others, and are in no list of items.  Items that
    repeat (same id and text) count once, items of equal text and different ids
    each.  Rows of ``docs`` that repeat stay separate
    rows.  An empty benchmark leaves every document clean, an empty ``docs``
    gives an empty result.  Other columns are not read.  Texts are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    pairs = scratch.write(items.mapInArrow(_item_windows(window), "item string, w array<long>").distinct(), "windows")
    blocks = max(1, -(-pairs.count() // block))
    parts = []
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("w", "item"), F.lit(blocks)) == b)
        rows = Windows([(r.item, tuple(r.w)) for r in own.toLocalIterator()])
        keys = spark.sparkContext.broadcast(rows.keys())
        counts = text.select("text").mapInArrow(_count(keys), "s int, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("n"))
        counts = {(r.s, r.h): r.n for r in counts.toLocalIterator()} if rows.shingles else {}
        table = spark.sparkContext.broadcast((rows, rows.prefix(counts)))
        probed = text.mapInArrow(_probe(table), PROBED)
        parts.append(probed if blocks == 1 else scratch.write(probed, f"probed{b}"))
    out = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("id", "n_words", "key").agg((F.count("*") / blocks).cast("int").alias("rows"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = out.select("id", "n_words", "runs", "items", F.explode(F.array_repeat(F.lit(1), F.col("rows")))).drop("col")
        out = out.mapInArrow(_merge, out.schema)
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s)
    return (
        out.withColumn("n_hit", length)
        .withColumn("n_items", F.size("items").cast("long"))
        .select(
            F.col("id").alias(id_col), "n_words", "n_hit", "n_items",
            F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
            "runs", "items",
        )
    )
