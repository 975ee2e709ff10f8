"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Method.  Every feature of a text (a word; the shape of a word, with the byte it
ends in; whether it repeats one of the three words before it, or stood in the
text before) is an entry whose random index vector, sparse and ternary, is a
function of its hash.  A word's context vector sums the index vectors of its neighbours over
the training texts; a text is the mean of its features' index vectors beside
the mean of its words' context vectors.  The pooled vector goes through one
hidden layer, trained with Adam in numpy; a temperature fitted on a part of
the training rows that the weights never saw calibrates the probability.

Scale.  Training reads at most ``sample`` labelled rows, drawn by a hash (the
one bounded sample, a documented parameter).  The model is a few megabytes, its
size set by its parameters and not by the corpus.  Scoring is one pass over
the texts, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, VISIBLE, Words, mix, slices, trimmed

DIM, NONZERO, BUCKETS, HIDDEN, SAMPLE, SEED = 64, 4, 1 << 14, 32, 4_000, 5
THRESHOLD = 0.3
#: Kinds of features, each pooled by itself; "word" also has context vectors.
KINDS = ("word", "shape", "repeat")

#: Classes of bytes for word shapes: other, lower case, upper case, digit, above ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 4


def held_out(id_col: str | Column) -> Column:
    """Whether crc32 of the id, written as text, is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col.cast("string").cast("binary")) % 5 == 0


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIM) sparse ternary random index vectors."""
    random = np.random.Generator(np.random.PCG64(SEED))
    out = np.zeros((BUCKETS, DIM), np.float32)
    at = np.argsort(random.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, random.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    return out / np.sqrt(NONZERO)


def _features(words: Words) -> list[np.ndarray]:
    """Bucket of each word, by kind."""
    n = len(words.start)
    if not n:
        return [np.zeros(0, np.int64)] * len(KINDS)
    size = words.end - words.start
    # A shape: which classes of bytes a word has, how its first and last byte fall, and about how long it is.
    seen = np.zeros(n, np.int64)
    kind = _CLASS[words.data]
    for c in range(5):
        sums = np.concatenate([[0], np.cumsum(kind == c)])
        share = sums[words.end] - sums[words.start]
        seen += (np.minimum(share, 3) if c in (0, 2, 3) else (share > 0)) * (1, 4, 8, 32, 128)[c]
    shape = seen * 512 + words.data[words.end - 1].astype(np.int64) * (kind[words.end - 1] == 0)
    shape = shape * 8 + np.minimum(np.log2(size).astype(np.int64), 7)
    doc = np.repeat(np.arange(len(words)), words.counts)
    same = np.zeros(n, np.int64)
    for back in (1, 2, 3):
        same[back:] += ((words.hash[back:] == words.hash[:-back]) & (doc[back:] == doc[:-back])) * (1 << (back - 1))
    # Whether a word came before in its text: position of the first word of equal text and hash.
    key = mix(words.hash + doc.astype(U) * U(0x9E3779B97F4A7C15))
    first = np.zeros(n, bool)
    first[np.unique(key, return_index=True)[1]] = True
    repeat = same * 2 + ~first
    bucket = lambda x, s: (mix(x.astype(U) * U(0x9FB21C651E98DF25) + U(s)) >> U(40)).astype(np.int64) % BUCKETS
    return [bucket(words.hash, 1), bucket(shape, 2), bucket(repeat, 3)]


def _means(table: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each text's buckets; zero for a text without words."""
    out = np.zeros((len(first) - 1, table.shape[1]), np.float32)
    n = np.diff(first)
    some = n > 0
    # Texts in runs whose gathered rows stay small.
    for a in range(0, len(n), 256):
        lo, hi = first[a], first[min(a + 256, len(n))]
        rows = np.flatnonzero(some[a : a + 256]) + a
        step = 1 << 15
        if hi - lo <= step:
            if len(rows):
                out[rows] = np.add.reduceat(table[buckets[lo:hi]], first[rows] - lo, axis=0)
        else:
            for r in rows.tolist():
                for b in range(first[r], first[r + 1], step):
                    out[r] += table[buckets[b : min(b + step, first[r + 1])]].sum(axis=0)
    return out / np.maximum(n, 1)[:, None]


def _add(sums: np.ndarray, to: np.ndarray, table: np.ndarray, of: np.ndarray) -> None:
    """sums[to] += table[of], entry by entry."""
    for a in range(0, len(to), 1 << 16):
        order = a + np.argsort(to[a : a + (1 << 16)], kind="stable")
        row, first = np.unique(to[order], return_index=True)
        sums[row] += np.add.reduceat(table[of[order]], first, axis=0)


def pooled(kinds: list[np.ndarray], first: np.ndarray, size: np.ndarray, index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """(texts, features) vectors: pooled index and context vectors, and how long the text is.

    ``kinds`` are the buckets of the texts' words, ``first`` the index of each text's first word, ``size`` the texts' bytes.
    """
    parts = [_means(index, k, first) for k in kinds]
    parts.append(_means(context, kinds[0], first))
    n = np.diff(first).astype(np.float64)
    parts.append(np.stack([np.log1p(n), np.log1p(size), size / np.maximum(n, 1), n == 0], axis=1).astype(np.float32))
    return np.concatenate(parts, axis=1)


@dataclass
class Model:
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 30, rate: float = 2e-3, decay: float = 1e-4) -> Model:
    """Train on the texts; the last tenth, in the given order, calibrates and picks the epoch.

    With no text, or one label only, the model gives that label's share.
    """
    index = index_vectors()
    sums, count = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS)
    step = 100
    parts = []  # of each run of texts the buckets alone, two bytes a word
    for a in range(0, len(texts), step):
        words = Words(pa.array(texts[a : a + step], pa.string()), VISIBLE, lower=False)
        kinds = _features(words)
        bucket, doc = kinds[0], np.repeat(np.arange(len(words)), words.counts)
        parts.append(([k.astype(np.uint16) for k in kinds], words.first, np.diff(words.offsets)))
        for back in (1, 2):
            near = doc[back:] == doc[:-back]
            left, right = bucket[:-back][near], bucket[back:][near]
            _add(sums, left, index, right)
            _add(sums, right, np.roll(index, 1, axis=1), left)
            count += np.bincount(left, minlength=BUCKETS) + np.bincount(right, minlength=BUCKETS)
    context = sums / np.maximum(count, 1)[:, None].astype(np.float32)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    width = DIM * (len(KINDS) + 1) + 4
    x = np.concatenate([pooled(*p, index, context) for p in parts]) if parts else np.zeros((0, width), np.float32)
    y = np.asarray(labels, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    random = np.random.Generator(np.random.PCG64(SEED))
    cut = max(1, len(y) // 10)
    tx, ty, vx, vy = x[:-cut], y[:-cut], x[-cut:], y[-cut:]
    model = Model(context, np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros((width, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), float(np.log(share / (1 - share))), 1.0)
    if len(ty) < 2 or ty.min() == ty.max():
        return model
    model.mean, model.scale = tx.mean(axis=0), tx.std(axis=0) + 1e-3
    model.w1 = (random.standard_normal((width, HIDDEN)) * np.sqrt(2 / width)).astype(np.float32)
    model.w2 = (random.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN)).astype(np.float32)
    z = (tx - model.mean) / model.scale
    values = [model.w1, model.b1, model.w2, np.array([model.b2], np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    best, kept, t = np.inf, None, 0
    for _ in range(epochs):
        order = random.permutation(len(ty))
        for a in range(0, len(order), 128):
            rows = order[a : a + 128]
            h = z[rows] @ values[0] + values[1]
            act = np.maximum(h, 0)
            out = act @ values[2] + values[3][0]
            err = ((1 / (1 + np.exp(-np.clip(out, -40, 40))) - ty[rows]) / len(rows)).astype(np.float32)
            back = np.outer(err, values[2]) * (h > 0)
            grads = [z[rows].T @ back + decay * values[0], back.sum(axis=0), act.T @ err + decay * values[2], np.array([err.sum()])]
            t += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] = (values[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        model.w1, model.b1, model.w2, model.b2 = values[0], values[1], values[2], float(values[3][0])
        now = _loss(model.logits(vx), vy)
        if now < best:
            best, kept = now, (model.w1, model.b1, model.w2, model.b2)
    model.w1, model.b1, model.w2, model.b2 = kept
    raw_logits = model.logits(vx)
    grid = np.exp(np.linspace(np.log(0.1), np.log(8), 81))
    model.temperature = float(grid[np.argmin([_loss(raw_logits / g, vy) for g in grid])])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out, drawn by a hash of the id."""
    one = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & ~held_out("_id"))
    one = one.groupBy("_id").agg(F.max("_label").alias("_label"))
    # The draw is made on ids alone; texts are fetched for the rows drawn only.
    drawn = one.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(drawn, "_id").select("_id", "_text", "_label")
    rows = sorted(((r._id, r._text or "", r._label) for r in rows.toLocalIterator()), key=lambda r: (int(mix(np.array([r[0]], np.int64).view(U))[0]), r[1]))
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], np.float64))


def _score(model, keep: bool):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = index_vectors(), model.value
        for part in slices(batches, "text", 1 << 20):
            words = Words(part.column("text"), VISIBLE, lower=False)
            p = own.probability(pooled(_features(words), words.first, np.diff(words.offsets), index, own.context))
            out = (part if keep else part.drop_columns(["text"])).append_column("score", pa.array(p.astype(np.float64)))
            yield out

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    ``score`` (0 to 1, higher: label 1 is likelier) depends on the text alone;
    ``predicted`` is 1 from ``threshold`` on.  Null and empty texts are texts
    without words and get the score of such; very long texts are read whole;
    rows that repeat are scored each; a null id is not held out.  An empty
    table gives an empty result, and other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    flat = docs.select(F.struct(F.col(id_col).alias("id")).alias("rest"), F.col(text_col).alias("text"))
    schema = flat.select("rest", F.lit(0.0).alias("score")).schema
    out = flat.mapInArrow(_score(sent, keep=False), schema)
    ident = F.col("rest")["id"]
    return out.select(ident.alias(id_col), F.coalesce(held_out(ident), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that the model doesn't reject; one pass, nothing shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != text_col]
    flat = docs.select(F.struct(F.lit(0), *others).alias("rest"), F.col(text_col).alias("text"))
    schema = flat.withColumn("score", F.lit(0.0)).schema
    out = flat.mapInArrow(_score(sent, keep=True), schema).where(F.col("score") >= threshold)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))
