"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

A file holds the ids of many documents as one run, cut into blocks of ``BLOCK``
ids.  Each block is coded from a fresh state, so that blocks decode (and fail
their checksum) independently; numpy codes many blocks in step, one id of each
block at a time, as lanes of one array program.

Prediction.  All three orders adapt within the block.  Order 2 and order 1 keep, in
hashed slots (the last id has a group of them, the one before it the place of order 2
in it), the id that followed the context last and how sure it is; order 0
keeps the last id of each class of ids.  The candidate of the highest order that
has one is coded as hit or miss; the probability mixes, in the logistic domain and
with weights that adapt after each id, how often slots of order 2 and of order 1 in
their present state were right, and order 0's frequency of the candidate.  A
missed id is coded by order 0: its class, then whether it is the class's last id,
with an adaptive probability, and else its place in the class.  Classes have about equal shares of the file's ids (the
header has the frequencies); a frequent id is a class by itself.  All of it is
integer arithmetic, the same on every machine.

Coder.  A carry range coder with 62-bit ranges that gives out 32-bit words.

File: magic, lengths of the sections, header (JSON with counts and checksums),
symbols (zlib: distinct ids and frequencies), documents (zlib: document keys
and lengths), block table (bytes and crc32 of the ids of each block), payload.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

U = np.uint64
MAGIC = b"OCM3"
BLOCK, LANES = 1024, 8192
#: Groups of slots of an id, each with one of order 1 and NEAR of order 2.
GROUPS, NEAR = 512, 7
#: Bits of class frequencies and of places in a class.
CLASSES, INSIDE = 16, 12
#: Bits of a range; words are cut from the top when it has no more than the lower ones.
WINDOW = 62
_LOW, _WORD = U(WINDOW - 32), U(32)
_LEAST, _REST = U(1 << WINDOW - 32), U((1 << WINDOW - 32) - 1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.rint(np.log(p / (1 - p)) * 256).astype(np.int32)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 1, 4095).astype(np.int32)
    return stretch, squash


STRETCH, SQUASH = _tables()
TABLES_CRC = zlib.crc32(STRETCH.tobytes() + SQUASH.tobytes())


class FileError(ValueError):
    """A file that is cut, changed or of another format."""


def scaled(count: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to integers of at least 1 that sum to 2 ** bits."""
    total = 1 << bits
    f = 1 + (count.astype(np.int64) * (total - len(count))) // max(1, int(count.sum()))
    f[np.argmax(f)] += total - int(f.sum())
    return f


class Symbols:
    """Classes of the symbols 0 .. n - 1, in the order of their numbers: frequencies of classes, and of symbols in their class.

    A symbol with 1 / 512 of all ids or more is a class by itself.  The others
    are cut into runs of about 1 / 512, and of 2 ** INSIDE - 1 symbols at most.
    """

    def __init__(self, count: np.ndarray):
        n, total = len(count), int(count.sum())
        alone = count * 512 >= max(1, total)
        rest = np.where(alone, 0, count.astype(np.int64))
        run = np.cumsum(rest) * 512 // max(1, total)
        place = np.cumsum(~alone) // ((1 << INSIDE) - 1)
        key = np.where(alone, np.arange(n) + 2, 0) + (np.where(alone, 0, run * (n + 2) + place) * (n + 2))
        _, first, self.of = np.unique(key, return_index=True, return_inverse=True)
        self.of = self.of.astype(np.int64)
        self.n = max(1, len(first))
        if self.n > 1 << CLASSES - 1:
            raise ValueError("a file can't have so many distinct ids")
        mass = np.bincount(self.of, weights=count, minlength=self.n).astype(np.int64)
        self.freq = scaled(mass, CLASSES)
        self.cum = np.cumsum(self.freq) - self.freq
        single = np.bincount(self.of, minlength=self.n) == 1
        # Places in a class: 2 ** INSIDE shared by its symbols.
        order = np.argsort(self.of, kind="stable")
        inside = np.empty(n, np.int64)
        start = np.searchsorted(self.of[order], np.arange(self.n + 1))
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            if b > a:
                inside[order[a:b]] = scaled(count[order[a:b]], INSIDE)
        flat = inside[order]
        before = np.empty(n, np.int64)
        before[order] = np.cumsum(flat) - flat - (self.of[order] << INSIDE)
        self.ordered = order + 1
        share = np.clip((count.astype(np.int64) << 12) // max(1, total), 0, 4095)
        # Lanes number symbols from 1.  Symbol 0 and class n are those that aren't coded: they leave a range as it is, but for its last bits.
        #: Type of a slot, which holds a symbol and three bits.
        self.slot = np.uint16 if n < 1 << 13 else np.int32
        self.stretched = np.append(np.int32(0), STRETCH[share])
        self.of = np.append(0, self.of)
        self.alone = (first + 1).astype(self.slot)
        self.several = np.append(~single, False)
        self.freq, self.cum = np.append(self.freq, 1 << CLASSES).astype(U), np.append(self.cum, 0).astype(U)
        self.inside, self.before = np.append(1 << INSIDE, inside).astype(U), np.append(0, before).astype(U)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The class at each of 2 ** CLASSES places, and the symbol at each place of each class."""
        return np.repeat(np.arange(self.n, dtype=np.int16), self.freq[:-1].astype(np.int64)), np.repeat(self.ordered.astype(self.slot), self.inside[self.ordered].astype(np.int64))


class _Lanes:
    """State of blocks that are coded in step.  Arrays of two or three rows have one for each order, the lowest first."""

    def __init__(self, lanes: int, symbols: Symbols):
        self.stretched = symbols.stretched
        lane = np.arange(lanes)
        # The slots of orders 1 and 2 of an id stand together, so that memory is waited for once; those of order 0 follow all groups.
        width = GROUPS * (NEAR + 1)
        self.row = np.stack([lane * symbols.n + lanes * width, lane * width])
        self.slots = np.zeros(lanes * (symbols.n + width), symbols.slot)
        self.row16 = np.stack([lane * 16, (lane + lanes) * 16])
        self.hits = np.full(lanes * 32, 1 << 15, np.int32)
        # An empty slot has state 0, whose probability stays 0.
        self.row8 = lane * 8
        self.recent = np.full(lanes * 8, 1 << 15, np.int32)
        self.recent[::8] = 0
        self.weights = np.repeat(np.array([[12_000], [22_000], [26_000]], np.int32), lanes, axis=1)
        self.range = np.full(lanes, (1 << WINDOW) - 1, U)
        self.group, self.place = np.zeros(lanes, np.uint32), np.ones(lanes, np.uint32)
        self.next = self.place
        self.at, self.v = np.zeros((3, lanes), np.int64), np.zeros((3, lanes), symbols.slot)
        self.inputs, self.products = np.zeros((3, lanes), np.int32), np.zeros((3, lanes), np.int32)

    def predict(self) -> None:
        """``guess`` and ``p``, 12 bits, which is 0 where there is none.

        What depends on a lane's luck is chosen by products with 0 and 1 here and below: branches on it would be guessed wrong.
        """
        at = self.at[1:]
        at[0] = self.group
        at[0] += self.row[1]
        np.add(at[0], self.place, out=at[1])
        v = self.slots.take(at, mode="clip", out=self.v[1:])
        g = v[0] * (v[1] == 0)
        g += v[1]
        self.guess = g >> 3
        state = v & 7
        state <<= 1
        state += (v ^ g) < 8
        self.state = state.astype(np.int64)
        self.state += self.row16
        self.seen = self.hits.take(self.state, mode="clip")
        x = self.inputs
        self.stretched.take(self.guess, mode="clip", out=x[0])
        STRETCH.take(self.seen >> 4, mode="clip", out=x[1:])
        dot = np.multiply(x, self.weights, out=self.products)
        dot[0] += dot[1]
        dot[0] += dot[2]
        dot = dot[0] >> 16
        dot += 2048
        self.p = SQUASH.take(dot, mode="clip")
        self.p *= g > 0

    def order0(self, cls: np.ndarray) -> np.ndarray:
        """What stands in the slots of these classes."""
        np.add(self.row[0], cls, out=self.at[0])
        return self.slots.take(self.at[0], mode="clip", out=self.v[0])

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of a hit, which stands above, and of a miss."""
        bound = self.range >> U(12)
        bound *= self.p.astype(U)
        return bound, self.range - bound

    def adapt(self, state: np.ndarray, p: np.ndarray, same: np.ndarray) -> None:
        """``p`` of these states of order 0 towards what came."""
        goal = same.astype(np.int32)
        goal *= 65535
        goal -= p
        goal += 8
        goal >>= 4
        goal += p
        self.recent[state] = goal

    def learn(self, symbol: np.ndarray, hit: np.ndarray) -> None:
        goal = hit.astype(np.int32)
        error = goal << 12
        error -= self.p
        error *= self.p > 0
        error *= 6
        x = np.multiply(self.inputs, error, out=self.products)
        x += 0x8000
        x >>= 16
        self.weights += x
        goal *= 65535
        seen = goal - self.seen
        seen >>= 4
        seen += self.seen
        self.hits[self.state] = seen
        first = symbol << 3
        sure = self.v & 7
        np.minimum(sure, 6, out=sure)
        sure *= (self.v ^ first) < 8
        first |= 1
        sure += first
        self.slots[self.at] = sure
        # The id before the last has the place in the group.
        self.place = self.next
        hashed = symbol.astype(np.uint32)
        hashed *= np.uint32(0x9E3779B1)
        self.group = (hashed >> np.uint32(33 - GROUPS.bit_length())) * np.uint32(NEAR + 1)
        hashed &= np.uint32(0xFFFF)
        hashed *= np.uint32(NEAR)
        self.next = (hashed >> np.uint32(16)) + np.uint32(1)


def _encode_lanes(symbols: np.ndarray, of: Symbols) -> list[bytes]:
    """Codes of the rows of ``symbols``."""
    lanes, steps = symbols.shape
    s = _Lanes(lanes, of)
    # Words are kept in 64 bits: a carry of ``low`` is the word's bit 32, and carried on at the end.
    low, width = np.zeros(lanes, U), 8 + steps // 2
    out, size, first = np.zeros((lanes, width), U), np.ones(lanes, np.int64), np.arange(lanes)

    def flush(span: np.ndarray, low: np.ndarray, lane: np.ndarray) -> None:
        nonlocal out, width
        at = np.flatnonzero(span < _LEAST)
        if len(at):
            lane = lane.take(at)
            k = size.take(lane)
            if int(k.max()) >= width - 4:
                out, width = np.concatenate([out, np.zeros_like(out)], axis=1), width * 2
            x = low.take(at)
            out[lane, k] = x >> _LOW
            size[lane] = k + 1
            low[at] = (x & _REST) << _WORD
            span[at] <<= _WORD

    for symbol in np.ascontiguousarray(symbols.T.astype(of.slot)):
        s.predict()
        hit = s.guess == symbol
        bound, rest = s.split()
        wide = hit.astype(U)
        above = rest * wide
        low += above
        rest -= above
        bound *= wide
        rest += bound
        rest >>= U(CLASSES)
        cls = of.of.take(symbol, mode="clip")
        v0 = s.order0(cls)
        cls += (of.n - cls) * wide.view(np.int64)
        low += rest * of.cum.take(cls, mode="clip")
        s.range = rest * of.freq.take(cls, mode="clip")
        some = np.flatnonzero(of.several.take(cls, mode="clip"))
        x, v, have, base = symbol.take(some), v0.take(some), s.range.take(some), low.take(some)
        flush(have, base, some)
        state = s.row8.take(some)
        state += v & 7
        p = s.recent.take(state, mode="clip")
        same = (v >> 3) == x
        s.adapt(state, p, same)
        bound = (have >> U(16)) * p.astype(U)
        have -= bound
        wide = same.astype(U)
        x -= x * same
        have += (bound - have) * wide
        have >>= U(INSIDE)
        bound -= bound * wide
        base += bound
        base += have * of.before.take(x, mode="clip")
        low[some] = base
        have *= of.inside.take(x, mode="clip")
        s.range[some] = have
        flush(s.range, low, first)
        s.learn(symbol, hit)
    for _ in range(2):
        out[first, size] = low >> _LOW
        size += 1
        low = (low & _REST) << _WORD
    for k in range(int(size.max()) - 1, 0, -1):  # carries
        out[:, k - 1] += out[:, k] >> _WORD
    words = out.astype("<u4")
    return [words[i, 1:n].tobytes() for i, n in enumerate(size.tolist())]


def _decode_lanes(codes: list[bytes], steps: int, of: Symbols) -> np.ndarray:
    lanes = len(codes)
    s = _Lanes(lanes, of)
    words = np.zeros((lanes, max(map(len, codes)) // 4 + 4), U)
    for i, c in enumerate(codes):
        words[i, : len(c) // 4] = np.frombuffer(c, "<u4")
    # A window ends two bits before a word does.
    code = words[:, 0] << _LOW | words[:, 1] >> U(2)
    words = (words[:, 1:-1] << _LOW | words[:, 2:] >> U(2)).astype(np.uint32)
    first, last = np.arange(lanes), np.arange(1, lanes + 1) * words.shape[1] - 1
    words, place = words.ravel(), first * words.shape[1]
    class_at, symbol_at = of.tables()
    out = np.zeros((steps, lanes), of.slot)

    def refill(span: np.ndarray, code: np.ndarray, lane: np.ndarray) -> None:
        at = np.flatnonzero(span < _LEAST)
        if len(at):
            lane = lane.take(at)
            k = place.take(lane)
            code[at] = code.take(at) << _WORD | words.take(k)
            place[lane] = np.minimum(k + 1, last.take(lane))
            span[at] <<= _WORD

    for symbol in out:
        s.predict()
        bound, rest = s.split()
        hit = code >= rest
        wide = hit.astype(U)
        above = rest * wide
        code -= above
        rest -= above
        bound *= wide
        rest += bound
        rest >>= U(CLASSES)
        cls = class_at.take((code // rest).view(np.int64), mode="clip").astype(np.int64)
        wide = wide.view(np.int64)
        cls += (of.of.take(s.guess, mode="clip") - cls) * wide
        v0 = s.order0(cls)
        of.alone.take(cls, mode="clip", out=symbol)  # right for a class of one symbol
        symbol += (s.guess - symbol) * hit
        cls += (of.n - cls) * wide
        code -= rest * of.cum.take(cls, mode="clip")
        s.range = rest * of.freq.take(cls, mode="clip")
        some = np.flatnonzero(of.several.take(cls, mode="clip"))
        v, have, left = v0.take(some), s.range.take(some), code.take(some)
        refill(have, left, some)
        state = s.row8.take(some)
        state += v & 7
        p = s.recent.take(state, mode="clip")
        bound = (have >> U(16)) * p.astype(U)
        same = left < bound
        s.adapt(state, p, same)
        have -= bound
        wide = same.astype(U)
        have += (bound - have) * wide
        bound -= bound * wide
        left -= bound
        have >>= U(INSIDE)
        at = (left // have).view(np.int64)
        np.minimum(at, (1 << INSIDE) - 1, out=at)
        at += cls.take(some) << INSIDE
        x = symbol_at.take(at, mode="clip")
        far = x - x * same
        v >>= 3
        symbol[some] = far + v * same
        left -= have * of.before.take(far, mode="clip")
        code[some] = left
        have *= of.inside.take(far, mode="clip")
        s.range[some] = have
        refill(s.range, code, first)
        s.learn(symbol, hit)
    return out.T


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, each as zigzag differences, through zlib."""
    parts = []
    for a in arrays:
        d = np.diff(a.astype(np.int64), prepend=np.int64(0))
        parts.append(((d << 1) ^ (d >> 63)).view(U).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return zlib.compress(b"".join(parts), 6)


def _unpack(data: bytes, n: int, count: int) -> list[np.ndarray]:
    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(count, 8, n)
    out = []
    for part in flat:
        z = np.ascontiguousarray(part.T).view("<u8").reshape(-1).astype(U)
        out.append(np.cumsum((z >> U(1)).astype(np.int64) ^ -(z & U(1)).astype(np.int64)))
    return out


def _turns(blocks: int) -> list[tuple[int, int]]:
    """Runs of blocks that are coded in step, of about equal length."""
    n = -(-blocks // LANES)
    return [(blocks * i // n, blocks * (i + 1) // n) for i in range(n)]


def encode(ids: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file of the documents ``keys`` with ``lengths`` ids each, which stand in ``ids`` one after another."""
    ids = np.ascontiguousarray(ids, "<u4")
    if int(lengths.sum()) != len(ids):
        raise ValueError("the lengths don't add up to the ids")
    if len(ids) and int(ids.max()) < 1 << 22:  # most vocabularies: counted without sorting
        count = np.bincount(ids)
        distinct = np.flatnonzero(count)
        count, number = count[distinct], np.zeros(len(count), np.int32)
        number[distinct] = np.arange(1, len(distinct) + 1)
        symbols = number[ids]
    else:
        distinct, symbols, count = np.unique(ids, return_inverse=True, return_counts=True)
        symbols += 1
    of = Symbols(count)
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, int(np.argmax(count)) + 1 if len(ids) else 0, np.int32)
    padded[: len(ids)] = symbols
    padded = padded.reshape(blocks, BLOCK)
    codes: list[bytes] = []
    for a, b in _turns(blocks):
        codes += _encode_lanes(padded[a:b], of)
    crcs = [zlib.crc32(ids[a : a + BLOCK].tobytes()) for a in range(0, len(ids), BLOCK)]
    sections = [_pack(distinct, count), _pack(keys, lengths), np.array([[len(c), crc] for c, crc in zip(codes, crcs, strict=True)], "<u4").tobytes()]
    header = {"ids": len(ids), "block": BLOCK, "blocks": blocks, "symbols": len(distinct), "documents": len(keys), "tables": TABLES_CRC, "crc": [zlib.crc32(x) for x in sections]}
    head = json.dumps(header, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<5I", len(head), zlib.crc32(head), *map(len, sections)) + head + b"".join(sections) + b"".join(codes)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, lengths) of a file; FileError if any checksum fails."""
    if data[:4] != MAGIC or len(data) < 24:
        raise FileError("not a token file")
    n_head, crc, *sizes = struct.unpack_from("<5I", data, 4)
    at = 24 + n_head
    if zlib.crc32(data[24:at]) != crc:
        raise FileError("the header is damaged")
    header = json.loads(data[24:at])
    if header["tables"] != TABLES_CRC or header["block"] != BLOCK:
        raise FileError("written with other tables")
    sections = []
    for size, want in zip(sizes, header["crc"], strict=True):
        sections.append(data[at : at + size])
        at += size
        if zlib.crc32(sections[-1]) != want:
            raise FileError("a section is damaged")
    distinct, count = _unpack(sections[0], header["symbols"], 2)
    of = Symbols(count)
    keys, lengths = _unpack(sections[1], header["documents"], 2)
    table = np.frombuffer(sections[2], "<u4").reshape(-1, 2)
    ends = at + np.cumsum(table[:, 0].astype(np.int64))
    if len(table) != header["blocks"] or (len(ends) and ends[-1] != len(data)):
        raise FileError("the file is cut")
    ids, distinct = np.empty(header["blocks"] * BLOCK, "<u4"), np.append(0, distinct).astype("<u4")
    for a, b in _turns(header["blocks"]):
        codes = [data[e - n : e] for e, n in zip(ends[a:b].tolist(), table[a:b, 0].tolist(), strict=True)]
        found = _decode_lanes(codes, BLOCK, of)
        ids[a * BLOCK : a * BLOCK + found.size] = distinct[found.ravel()]
    ids = ids[: header["ids"]]
    for k, want in enumerate(table[:, 1].tolist()):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != want:
            raise FileError("block %d is damaged" % k)
    return ids, keys, lengths
