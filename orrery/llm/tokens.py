"""Token ids of whole texts, and files of them in the shared folder.

``Tokenizer`` gives exactly the ids of the tokenizers library for whole texts,
but has the library encode each distinct piece once.  Byte-level pre-tokenizers
of this kind never join what stands before white space with what follows it,
nor letters and digits with punctuation (but for an apostrophe and the letters
after it), nor a single line break with what follows it, so a text is cut there, and each piece is encoded by itself.  Texts with other
white space, control bytes or the string of a special token are encoded whole.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codec
from .scratch import Scratch
from .words import U, lists, prefix, raw, slices, span_hash, trimmed

#: Bytes of text that are encoded at once.
TEXT = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes after which a text is encoded whole: control bytes that some white-space classes hold.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), *range(14, 32), 127]] = True


#: ASCII punctuation without the apostrophe, and ASCII letters and digits.
_MARK, _ALNUM = np.zeros((2, 256), bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_ALNUM[33:127]
_MARK[ord("'")] = False


def default_tokenizer() -> str:
    """Path of the 50k byte-level vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that are not cut: those with white space outside ASCII or odd control bytes."""
    bad = np.flatnonzero(_ODD[data])
    for lead, follow in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, ((0x80,), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data[:-2] == lead) if len(data) > 2 else np.zeros(0, np.int64)
        for f in follow:
            hit = at[data[at + 1] == f[0]]
            if f == (0x80,):
                third = data[hit + 2]
                hit = hit[(third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)]
            elif len(f) == 2:
                hit = hit[data[hit + 2] == f[1]]
            bad = np.concatenate([bad, hit])
    # The last two bytes can't be looked at with what follows; a lead byte there ends in the same text anyway.
    if len(data) >= 2 and data[-2] == 0xC2 and data[-1] in (0x85, 0xA0):
        bad = np.append(bad, len(data) - 2)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, bad, "right") - 1] = True
    return out


class Tokenizer:
    """Ids of whole texts, with a table of known pieces that gives way to a new one when it holds ``limit``.

    A piece has two places in the table, from its hash; the second is taken where
    the first is, and one that stood there is forgotten, and encoded anew when met again.
    The table before this one stays: pieces met again go over from it, so only those
    that were met in neither are encoded.
    """

    def __init__(self, path: str, ordinary: bool = False, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library, self.limit = Library.from_file(path), limit
        self.library.encode_special_tokens = ordinary
        added = self.library.get_added_tokens_decoder().values()
        self.special = [] if ordinary else [t.content.encode() for t in added]
        # The same model behind a pre-tokenizer that splits at line breaks alone, for pieces of letters.
        self.model, self.letter = None, np.zeros(256, bool)
        if type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None and type(self.library.model).__name__ == "BPE":
            from tokenizers import pre_tokenizers

            self.model = Library.from_file(path)
            self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
            vocabulary = self.model.get_vocab(with_added_tokens=True)
            #: Bytes of each id: a letter of a byte-level token is one.
            self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.length[i] = len(token)
            shown = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0].encode() for c in map(chr, range(128))]
            # Characters of the bytes from 0x80 on, in the order of their code points: as they are from U+00A1 on, without U+00AD; the others follow the control characters.
            taken = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            shown += [chr(b if b in taken else 256 + sum(c not in taken for c in range(b))).encode() for b in range(128, 256)]
            self.wide = np.array([len(x) - 1 for x in shown])
            self.char = np.array([[x[0] for x in shown], [x[-1] for x in shown]], np.uint8)
            self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.bits = U(max(10, int(limit).bit_length() + 1))
        self.past = None
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at = np.zeros(1 << int(self.bits), U), np.zeros(1 << int(self.bits), np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (U(1) << self.bits) - U(1)
        return (keys & mask).astype(np.int64), (keys >> (U(64) - self.bits)).astype(np.int64)

    def _library(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces that the pre-tokenizer leaves whole: its work is done here, byte by byte, and the library's model does the rest."""
        size = end - start
        flat = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        # Each byte as its character, one or two bytes long, and a line break after each piece.
        wide, ends = self.wide[flat], np.cumsum(size)
        at = np.cumsum(1 + wide) - 1 - wide + np.repeat(np.arange(len(size)), size)
        joined = np.full(len(flat) + int(wide.sum()) + len(size), 10, np.uint8)
        joined[at] = self.char[0][flat]
        two = np.flatnonzero(wide)
        joined[at[two] + 1] = self.char[1][flat[two]]
        ids = np.array(self.model.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.searchsorted(np.cumsum(self.length[ids]), ends, "left") + 1
        return ids, np.diff(upto, prepend=0)

    def _add(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Have new pieces encoded; as of ``_store``."""
        # Letters of one or two bytes after at most one blank are whole for the pre-tokenizer.
        from_ = start + (data[start] == 32)
        size = end - from_
        text = data[np.repeat(from_ - np.cumsum(size) + size, size) + np.arange(size.sum())]
        # Of each byte: a letter, the first byte of one, the second, one of the two signs.
        kind = self.letter[text] + (text == 0xC3) * 0x10001 + ((text >= 0x80) & (text < 0xC0)) * (1 - 0x10000) + ((text == 0x97) | (text == 0xB7)) * (1 << 40)
        first = np.minimum(np.cumsum(size) - size, max(0, len(text) - 1))
        simple = (size > 0) & (np.add.reduceat(kind, first) == size) if len(text) else np.zeros(len(size), bool)
        at = np.empty(len(keys), np.int64)
        for some in (np.flatnonzero(simple), np.flatnonzero(~simple)) if self.model else (np.arange(0), np.arange(len(keys))):
            for k in range(0, len(some), 20_000):
                own = some[k : k + 20_000]
                if self.model and simple[own[0]]:
                    flat, counts = self._library(data, start[own], end[own])
                else:
                    found = [e.ids for e in self.library.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)], add_special_tokens=False)]
                    flat, counts = np.fromiter((i for x in found for i in x), np.uint32), np.array([len(x) for x in found], np.int64)
                at[own] = self._store(flat, counts)
        return at

    def _store(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Put ids of pieces into the pool; where they stand there, and how many, in one number each."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = (self.used + np.cumsum(counts) - counts) << 28 | counts
        self.used += len(flat)
        return at

    def _recall(self, keys: np.ndarray) -> np.ndarray:
        """Take pieces over from the table before this one: as of ``_store``, or -1 for those that it doesn't hold."""
        at = np.full(len(keys), -1, np.int64)
        if self.past is None:
            return at
        past_keys, past_at, pool = self.past
        for place in self._places(keys):
            held = np.flatnonzero(past_keys[place] == keys)
            at[held] = past_at[place[held]]
        held = np.flatnonzero(at >= 0)
        size, start = at[held] & ((1 << 28) - 1), at[held] >> 28
        at[held] = self._store(pool[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())], size)
        return at

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Give pieces that this table doesn't hold a place in it; as of ``_store``."""
        at = self._recall(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._add(keys[new], data, start[new], end[new])
        one, two = self._places(keys)
        free = self.keys[one] == 0
        place = np.where(free, one, two)
        self.keys[place], self.at[place] = keys, at
        self.held += len(keys)
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after another, and how many each text has."""
        data, offsets = raw(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        space, mark = _SPACE[data], _MARK[data]
        letter = _ALNUM[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        # Letters of two bytes, from U+00C0 on but for the two signs among them, end before punctuation as well.
        two = np.flatnonzero(data[:-2] == 0xC3) if len(data) > 2 else np.zeros(0, np.int64)
        two = two[mark[two + 2] & (data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        cut[two + 2] = True
        # One line break by itself goes with nothing after it.
        line = np.flatnonzero(data[:-1] == 10)
        line = line[~space[line + 1] & ((line == 0) | ~space[line - 1])]
        cut[line + 1] = True
        cut[0] = True
        whole = _whole(data, offsets)
        if self.special:
            text = data.tobytes()
            for x in self.special:
                at = text.find(x)
                while at >= 0:
                    whole[np.searchsorted(offsets, at, "right") - 1] = True
                    at = text.find(x, at + 1)
        for doc in np.flatnonzero(whole).tolist():
            cut[offsets[doc] : offsets[doc + 1]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        if self.held > self.limit:
            self.past = self.keys, self.at, self.pool
            self._empty()
        keys = span_hash(prefix(data), start, end) | U(1)
        one, two = self._places(keys)
        known = self.keys.take(one, mode="clip") == keys
        at = self.at.take(one, mode="clip")
        rest = np.flatnonzero(~known)
        second = self.keys[two[rest]] == keys[rest]
        at[rest[second]] = self.at[two[rest[second]]]
        rest = rest[~second]
        if len(rest):
            new, first, which = np.unique(keys[rest], return_index=True, return_inverse=True)
            at[rest] = self._learn(new, data, start[rest[first]], end[rest[first]])[which]
        size = at & ((1 << 28) - 1)
        at >>= 28
        upto = np.concatenate([[0], np.cumsum(size)])
        at -= upto[:-1]
        ids = self.pool.take(np.repeat(at, size) + np.arange(upto[-1]), mode="clip")
        return ids, np.diff(upto[np.searchsorted(start, offsets)])


_loaded: dict[tuple[str, bool], Tokenizer] = {}


def tokenizer(path: str, ordinary: bool = False) -> Tokenizer:
    """The tokenizer of this process for ``path``, loaded once.  ``ordinary``: the strings of special tokens are ordinary text."""
    if (path, ordinary) not in _loaded:
        _loaded[path, ordinary] = Tokenizer(path, ordinary)
    return _loaded[path, ordinary]


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write ``data`` under a name no other attempt uses, in any file system that pyarrow or fsspec knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def read_file(uri: str, offset: int = 0, size: int | None = None) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        source.seek(offset)
        return source.read(size) if size is not None else source.read()


MANIFEST = "part int, path string, documents long, ids long, bytes long"


def files(docs: DataFrame, folder: str, save: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes], path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Encode ``docs`` in ascending id order and save one file for each partition; the manifest, a row for each file.

    A task writes under a name of its own attempt and tells it in its row, so a
    repeated or speculative attempt leaves at most a file that no row names.
    The manifest must be written before it is used twice.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, keys, counts = tokenizer(path), [], [], []
        for part in slices(batches, "text", TEXT):
            flat, count = own.encode(part.column("text"))
            ids.append(np.insert(flat, np.cumsum(count), end_id))
            keys.append(part.column("id").to_numpy())
            counts.append(count + 1)
        if not keys:
            return
        flat, count, key = np.concatenate(ids), np.concatenate(counts), np.concatenate(keys)
        part = TaskContext.get().partitionId()
        data = save(flat, key, count)
        at = write_file(folder, f"{part:06d}-{uuid.uuid4().hex[:8]}.ids", data)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([at]), pa.array([len(key)]), pa.array([len(flat)]), pa.array([len(data)])], ["part", "path", "documents", "ids", "bytes"])

    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text")).mapInArrow(run, MANIFEST)


def before(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first_id`` and ``first_document``: how many stand in earlier files.

    One row for each file, so the running sum is over a table some 10^7 times smaller than the data.
    """
    earlier = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return manifest.withColumns({"first_id": F.coalesce(F.sum("ids").over(earlier), zero), "first_document": F.coalesce(F.sum("documents").over(earlier), zero)})


def spread(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows dealt so that about each is a task of its own."""
    return rows.repartition(max(1, n), key)


@trimmed
def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, keys, lengths = codec.decode(read_file(row["path"]))
            start = row["first_id"] + np.cumsum(lengths) - lengths
            data, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(lengths)]) * 4
            crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
            yield pa.record_batch([pa.array(keys), pa.array(start), pa.array(lengths), pa.array(crc)], ["id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as compressed id files (see codec) into ``folder``; the manifest, with each file's first id.

    ``folder`` is a URI of a shared file system, by default one under
    ``spark.checkpoint.dir``.
    """
    scratch = Scratch(docs.sparkSession, "ids")
    rows = files(docs, folder or f"{scratch.path}/files", codec.encode, tokenizer_path or default_tokenizer(), end_id, id_col, text_col)
    return scratch.write(before(scratch.write(rows, "manifest")), "placed")


def token_ids(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files that this writes.

    Ids follow one another over all documents in ascending id order; each
    document ends with ``end_id``.  Null and empty texts have that id alone.
    Rows that repeat an id are documents of their own, next to each other; rows
    with a null id have no place in the order and are left out.  Very long
    texts are encoded whole.  An empty table gives an empty result; other
    columns are not read.
    """
    manifest = write_ids(docs, folder, tokenizer_path, end_id, id_col, text_col)
    out = spread(manifest, manifest.count(), "path").mapInArrow(_read_back, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


FLAT = np.dtype("<u2")
SCAN = 1 << 20


def _flat(ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) > 65535:
        raise ValueError("these ids don't fit into two bytes")
    return ids.astype(FLAT).tobytes()


def _scan(end_id: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(read_file(row["path"], row["from"], row["size"]), FLAT)
                at = np.flatnonzero(ids == end_id)
                yield pa.record_batch([pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int64()), lists(np.array([len(at)]), at.astype(np.int64)), pa.array([len(ids)])], ["part", "block", "ends", "n"])

    return run


def count_tokens(files_: DataFrame, end_id: int, block: int = SCAN, item: int = FLAT.itemsize) -> DataFrame:
    """(ordinal, start, n_tokens) of every document in flat files of ids that have no index.

    ``files_`` has part (the order of the files), path and bytes.  Files are
    read in blocks of ``block`` bytes, each a task's own; a block gives the
    places of its end-of-document ids.  A prefix scan over the blocks, one small
    row each, tells how many ids and ends stand before a block and where the
    last end before it was, which stitches documents over any number of blocks
    and files.  A document's count holds its end id.  Ids after the last end
    are a document without end and come last, with their count.  Empty files
    and no files give no rows.
    """
    scratch = Scratch(files_.sparkSession, "scan")
    cut = files_.where("bytes > 0").select("part", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {block}"))).alias("block"))
    cut = cut.select("part", "path", "block", (F.col("block") * block).alias("from"), F.least(F.lit(block), F.col("bytes") - F.col("block") * block).alias("size"))
    found = cut.repartition(max(1, min(cut.count(), 100_000)), "part", "block")
    found = scratch.write(found.mapInArrow(_scan(end_id), "part int, block long, ends array<long>, n long"), "ends")
    order = W.partitionBy(F.lit(1)).orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1)
    small = found.select("part", "block", "n", F.size("ends").cast("long").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    zero = F.lit(0).cast("long")
    small = small.withColumns({"ids_before": F.coalesce(F.sum("n").over(order), zero), "ends_before": F.coalesce(F.sum("k").over(order), zero)})
    small = small.withColumn("open", F.coalesce(F.max(F.col("ids_before") + F.col("last") + 1).over(order), zero))
    small = scratch.write(small, "blocks")
    each = found.join(small.select("part", "block", "ids_before", "ends_before", "open"), ["part", "block"])
    each = each.select("ids_before", "ends_before", "open", "ends", F.posexplode("ends").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("ids_before") + F.get("ends", F.col("k") - 1) + 1)
    docs = each.select((F.col("ends_before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("ids_before") + F.col("at") + 1 - start).alias("n_tokens"))
    total = small.agg(F.sum("n").alias("ids"), F.sum("k").alias("ordinal"), F.max(F.col("ids_before") + F.col("last") + 1).alias("end"))
    rest = total.select("ordinal", F.coalesce("end", zero).alias("start"), (F.col("ids") - F.coalesce("end", zero)).alias("n_tokens")).where("n_tokens > 0")
    return docs.unionByName(rest)


def document_tokens(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens) of every document, by a scan of flat files of all documents' ids.

    The flat files hold two-byte ids and nothing else.  The k-th document found
    belongs to the k-th document written; ``start`` counts the ids of all
    documents of smaller ids.  ``end_id`` must be a special token's: a text that holds its
    string is encoded as ordinary text, so the id stands at ends alone.  Null
    and empty texts count their end alone; rows that repeat an id are documents
    of their own, in an order that is not told; null ids are left out; an empty
    table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "flat")
    path, folder = tokenizer_path or default_tokenizer(), f"{scratch.path}/files"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, keys = tokenizer(path, ordinary=True), [], []
        for part in slices(batches, "text", TEXT):
            flat, count = own.encode(part.column("text"))
            ids.append(_flat(np.insert(flat, np.cumsum(count), end_id)))
            keys.append(part.column("id").to_numpy())
        if not keys:
            return
        key, data = np.concatenate(keys), b"".join(ids)
        part = TaskContext.get().partitionId()
        at = write_file(folder, f"{part:06d}-{uuid.uuid4().hex[:8]}.ids", data)
        n = len(key)
        yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array([at] * n), pa.array(np.full(n, len(data))), pa.array(np.arange(n)), pa.array(key)], ["part", "path", "bytes", "k", "id"])

    # Files are written where the texts lie, so that no text is shuffled; their rows tell which documents they hold.
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    written = scratch.write(text.mapInArrow(run, "part int, path string, bytes long, k long, id long"), "written")
    parts = written.groupBy("part").agg(F.max("path").alias("path"), F.max("bytes").alias("bytes"), F.count("*").alias("documents"))
    earlier = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = scratch.write(parts.withColumn("first", F.coalesce(F.sum("documents").over(earlier), F.lit(0).cast("long"))), "parts")
    found = count_tokens(parts, end_id).select("ordinal", "n_tokens")
    numbered = written.join(parts.select("part", "first"), "part").select("id", (F.col("first") + F.col("k")).alias("ordinal"))
    counted = numbered.join(found, "ordinal").select("id", "n_tokens")
    # Starts in ascending id order: sums inside ranges of ids, and a prefix scan over the ranges.
    ranged = scratch.write(counted.repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("p").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("p", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    inside = F.sum("n_tokens").over(W.partitionBy("p").orderBy("id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return ranged.join(sums, "p").withColumn("inside", inside).select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens")
