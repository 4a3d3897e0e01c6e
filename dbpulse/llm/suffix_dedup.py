"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``length`` bytes, most significant digits
first, and only as far as they stay together with a suffix of another document:

* A suffix enters at a synchronising point: the places where the hash of ``GRAM`` bytes is
  the least of some window of ``length`` bytes. Equal windows hold equal points at equal
  offsets, so sorting the windows of each point sorts every window, and about one byte in
  fourteen is moved.
* pass 1 takes the gram at the point as first digit and buckets by it; grams that one
  document alone has are finished.
* pass 2 folds copies: points whose whole context, all windows around the point, also
  stands in a smaller document are finished.
* pass 3 sorts what is left: the windows of a gram at one offset are ordered by their next
  eight bytes, then the next, most significant first, through ``length`` bytes. After each
  digit only groups that hold two documents go on. Equal groups after the last digit are
  exactly the repeated windows.

Grams with more than ``large`` points are too many for one task: their contexts are folded
in buckets by context, and their windows are dealt, whole, by the hash of all their bytes,
so that each becomes many small groups of equal windows.

Documents are dealt once to blocks by id; each pass sends a block's distinct digits to the
digit's bucket and gets back a few bits for each. A digit occurs at most once in a block, so
a group has at most as many members as there are blocks, however often a passage repeats.
Grams, contexts and the windows of frequent grams are compared as hashes of 96 bits or more
together, all other windows byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside_names, set_aside, shuffle_partitions

GRAM = 24
CHUNK = 1 << 20
BLOCK_BYTES = 4 << 20
LARGEST = np.iinfo(np.int64).max
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ADDED = ("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text", "__block")
REQUEST = "__block int, bucket int, kind int, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other (a multiply and xor-shift finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, byte by byte, which compresses well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


class _Reader:
    def __init__(self, payload: bytes):
        self.raw, self.at = np.frombuffer(payload, np.uint8), 4
        self.n = int(self.raw[:4].view("<u4")[0])

    def planes(self, width: int) -> np.ndarray:
        out = np.zeros((self.n, 8), np.uint8)
        out[:, :width] = self.take(width).reshape(width, self.n).T
        return out.view("<u8").ravel()

    def take(self, width: int) -> np.ndarray:
        part = self.raw[self.at : self.at + width * self.n]
        self.at += width * self.n
        return part


def _payload(n: int, *parts: bytes) -> bytes:
    return b"".join((np.array([n], "<u4").tobytes(), *parts))


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * BASE).astype(np.uint32)


def _points_of(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Synchronising points of one chunk; ``ends`` are where texts end in it."""
    if len(data) < length:
        return np.zeros(0, np.int64)
    power, roll, span = np.uint32(0x01000193), _BYTE[data], 1
    parts = {1: roll}
    with np.errstate(over="ignore"):
        factor = {1: power}
        while span * 2 <= GRAM:
            roll = roll[:-span] * factor[span] + roll[span:]
            factor[span * 2] = factor[span] * factor[span]
            span *= 2
            parts[span] = roll
        have, rest = span, GRAM - span
        while rest:
            step = 1 << (rest.bit_length() - 1)
            n = len(data) - have - step + 1
            roll = roll[:n] * factor[step] + parts[step][have : have + n]
            have, rest = have + step, rest - step
        roll = (roll ^ (roll >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        roll = (roll ^ (roll >> np.uint32(12))) * np.uint32(0x297A2D39)
        roll = (roll ^ (roll >> np.uint32(15))) | np.uint32(1)
    windows = length - GRAM + 1
    least = _slide(roll, windows, True)
    over = (ends[:, None] - np.arange(1, length)).ravel()  # windows from here would cross an end
    least[over[(over >= 0) & (over < len(least))]] = 0
    pad = np.zeros(windows - 1, np.uint32)
    return np.flatnonzero(_slide(np.concatenate((pad, least, pad)), windows, False) == roll)


class Block:
    """The texts of one block in a fixed order, with their synchronising points."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, length: int):
        ids = table.column(id_col).cast(pa.int64()).fill_null(LARGEST).to_numpy()
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in table.column(text_col)]
        self.order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
        texts = [texts[i] for i in self.order]
        self.ids, self.length = ids[self.order], length
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.reach = length - GRAM  # how far windows around a point go to either side of its gram
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        found, at, total = [], 0, len(self.data)
        while at < total:
            to = min(total, at + CHUNK + length - 1)
            first, last = np.searchsorted(self.ends, [at, to], side="right")
            found.append(at + _points_of(self.data[at:to], self.ends[first:last] - at, length))
            at += CHUNK
        points = np.sort(np.concatenate(found), kind="stable") if found else np.zeros(0, np.int64)  # sorted but for the seams
        self.points = points[np.concatenate(([True], points[1:] != points[:-1]))] if len(points) else points
        self.text_of = np.searchsorted(self.ends, self.points, side="right")
        self.doc = self.ids[self.text_of]
        padded = np.concatenate((np.zeros(self.reach, np.uint8), self.data, np.zeros(length, np.uint8)))
        self.around = np.lib.stride_tricks.sliding_window_view(padded, GRAM + 2 * self.reach) if len(self.data) else padded
        grams = np.lib.stride_tricks.sliding_window_view(padded, GRAM)
        gram = grams[self.points + self.reach]
        key = np.zeros(len(gram), np.uint64)
        for lane in range(GRAM // 8):
            key = _mix((key + BASE) ^ np.ascontiguousarray(gram[:, 8 * lane : 8 * lane + 8]).view("<u8").ravel())
        self.key = key >> np.uint64(16)

    def contexts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes around points (zero outside their text) and how far the text goes left and right."""
        at, text = self.points[which], self.text_of[which]
        left = np.minimum(self.reach, at - self.starts[text])
        right = np.minimum(self.reach, self.ends[text] - at - GRAM)
        around = self.around[at] if len(at) else np.zeros((0, GRAM + 2 * self.reach), np.uint8)
        place = np.arange(around.shape[1])
        inside = (place >= (self.reach - left)[:, None]) & (place < (self.reach + GRAM + right)[:, None])
        np.multiply(around, inside, out=around)
        return around, left, right


def _context_hash(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(around), -(-around.shape[1] // 8) * 8), np.uint8)
    wide[:, : around.shape[1]] = around
    out = (left * 256 + right).astype(np.uint64)
    for lane in range(wide.shape[1] // 8):
        out = _mix((out + OTHER) ^ np.ascontiguousarray(wide[:, 8 * lane : 8 * lane + 8]).view("<u8").ravel())
    return out


def _window_hashes(around: np.ndarray, length: int):
    """For each offset, two 64-bit hashes of the window that starts there in every context."""
    with np.errstate(over="ignore"):
        for seeds in [(_mix(np.arange(1, 257, dtype=np.uint64) * BASE), _mix(np.arange(1, 257, dtype=np.uint64) * OTHER))]:
            tables = seeds
        bases = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))
        rolls, tops = [], []
        for lut, base in zip(tables, bases):
            roll = np.zeros(len(around), np.uint64)
            for j in range(length):
                roll = roll * base + lut[around[:, j]]
            rolls.append(roll)
            top = np.uint64(1)
            for _ in range(length):
                top = top * base
            tops.append(top)
        for offset in range(around.shape[1] - length + 1):
            if offset:
                for i, (lut, base) in enumerate(zip(tables, bases)):
                    rolls[i] = rolls[i] * base + lut[around[:, offset + length - 1]] - lut[around[:, offset - 1]] * tops[i]
            yield offset, _mix(rolls[0]), _mix(rolls[1])


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns (first is most significant), and where a new value begins in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return order, new


def _least(doc: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """For each row, the least ``doc`` among rows that are equal in the columns."""
    order, new = _runs(*columns)
    out = np.empty_like(doc)
    if len(doc):
        first = np.flatnonzero(new)
        out[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.concatenate((first, [len(doc)]))))
    return out


def _bucket(key48: np.ndarray, buckets: int) -> np.ndarray:
    return ((key48 >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)


def _slices(bucket: np.ndarray):
    """(bucket, first, last) of equal neighbours."""
    if len(bucket):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(bucket[a]), a, b


def _requests(block: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, p = zip(*rows) if rows else ((), (), ())
    return pa.table({"__block": pa.array([block] * len(rows), pa.int32()), "bucket": pa.array(b, pa.int32()), "kind": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})


def _replies(replies: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    rows = zip(replies.column("bucket").to_pylist(), replies.column("kind").to_pylist(), replies.column("payload").to_pylist())
    return {(b, k): np.frombuffer(p, np.uint8) for b, k, p in rows}


class _Passes:
    """What a block knows after each pass; computed anew from its texts and the replies."""

    def __init__(self, block: Block, buckets: int):
        self.block, self.buckets = block, buckets
        order, new = _runs(block.key, block.doc)
        key, doc = block.key[order], block.doc[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.digit = key[start]
        ends = np.concatenate((start[1:], [len(key)])) - 1 if len(start) else start
        several = doc[start] != doc[ends] if len(start) else np.zeros(0, bool)
        points = ends - start + 1
        # one bit for several documents, and how many points there are as a power of two
        self.held = (several | (np.ceil(np.log2(np.maximum(points, 1))).astype(np.int64) << 1)).astype(np.uint8)
        self.parts1 = list(_slices(_bucket(self.digit, buckets)))

    def request1(self):
        return [(b, 1, _payload(e - a, _planes(self.digit[a:e], 6), self.held[a:e].tobytes())) for b, a, e in self.parts1]

    def after1(self, got):
        shared, frequent = np.zeros(len(self.digit), bool), np.zeros(len(self.digit), bool)
        for b, a, e in self.parts1:
            bits = np.unpackbits(got[b, 1]).astype(bool)
            shared[a:e], frequent[a:e] = bits[: e - a], bits[len(bits) // 2 :][: e - a]
        block = self.block
        where = np.searchsorted(self.digit, block.key)
        self.alive = np.flatnonzero(shared[where]) if len(self.digit) else np.zeros(0, np.int64)
        around, left, right = block.contexts(self.alive)
        key, doc, context = block.key[self.alive], block.doc[self.alive], _context_hash(around, left, right)
        order, new = _runs(key, context, doc)
        group = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1])))) if len(order) else np.zeros(0, np.int64)
        self.head = order[group]  # of each distinct (digit, context), the point of least document
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(group)), np.diff(np.concatenate((group, [len(order)])))) if len(order) else 0
        self.key2, self.context2, self.doc2 = key[self.head], context[self.head], doc[self.head]
        self.later = doc > self.doc2[self.of]
        often = frequent[where[self.alive[self.head]]] if len(self.head) else np.zeros(0, bool)
        few, many = np.flatnonzero(~often), np.flatnonzero(often)
        many = many[np.argsort(self.context2[many], kind="stable")]
        self.parts2 = [(2, few[a:e], b) for b, a, e in _slices(_bucket(self.key2[few], self.buckets))]
        self.parts2 += [(5, many[a:e], b) for b, a, e in _slices(_bucket(self.context2[many] >> np.uint64(16), self.buckets))]

    def request2(self):
        return [
            (b, kind, _payload(len(at), _planes(self.key2[at], 6), _planes(self.context2[at], 8), _planes(self.doc2[at].view(np.uint64), 8)))
            for kind, at, b in self.parts2
        ]

    def after2(self, got):
        self.code = np.zeros(len(self.head), np.uint8)
        for kind, at, b in self.parts2:
            self.code[at] = got[b, kind]
        block = self.block
        self.mixed = np.flatnonzero(self.code == 2)
        self.parts3 = list(_slices(_bucket(self.key2[self.mixed], self.buckets)))
        large = np.flatnonzero(self.code == 3)
        around, left, right = block.contexts(self.alive[self.head[large]])
        rows = []
        for offset, one, two in _window_hashes(around, block.length):
            ok = (left >= block.reach - offset) & (right >= offset)
            rows.append((large[ok], np.full(int(ok.sum()), offset), one[ok], two[ok]))
        self.w_head, self.w_offset, one, two = (np.concatenate(x) for x in zip(*rows))
        w_doc = self.doc2[self.w_head]
        order, new = _runs(one, two, w_doc)
        group = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))) if len(order) else np.zeros(0, np.int64)
        self.w_of = np.empty(len(order), np.int64)
        self.w_of[order] = np.repeat(np.arange(len(group)), np.diff(np.concatenate((group, [len(order)])))) if len(order) else 0
        first = order[group]
        self.w_one, self.w_two, self.w_doc = one[first], two[first], w_doc[first]
        self.w_later = w_doc > self.w_doc[self.w_of]
        self.parts4 = list(_slices(_bucket(self.w_one >> np.uint64(16), self.buckets)))

    def request3(self):
        block, rows = self.block, []
        around, left, right = block.contexts(self.alive[self.head[self.mixed]])
        key, doc = self.key2[self.mixed], self.doc2[self.mixed]
        for b, a, e in self.parts3:
            rows.append((b, 3, _payload(e - a, _planes(key[a:e], 6), np.ascontiguousarray(around[a:e]).tobytes(), left[a:e].astype(np.uint8).tobytes(), right[a:e].astype(np.uint8).tobytes(), _planes(doc[a:e].view(np.uint64), 8))))
        for b, a, e in self.parts4:
            rows.append((b, 4, _payload(e - a, _planes(self.w_one[a:e], 8), _planes(self.w_two[a:e], 8), _planes(self.w_doc[a:e].view(np.uint64), 8))))
        return rows

    def covered(self, got) -> np.ndarray:
        """Which bytes of the block are to go."""
        block, reach = self.block, self.block.reach
        offsets = reach + 1
        every = (1 << offsets) - 1
        mask = np.where(self.code == 1, every, 0).astype(np.uint64)
        for b, a, e in self.parts3:
            mask[self.mixed[a:e]] = got[b, 3].view("<u4")
        if len(self.w_of):
            hit = np.zeros(len(self.w_one), bool)
            for b, a, e in self.parts4:
                hit[a:e] = np.unpackbits(got[b, 4], count=e - a).astype(bool)
            hit = hit[self.w_of] | self.w_later
            np.bitwise_or.at(mask, self.w_head[hit], np.uint64(1) << self.w_offset[hit].astype(np.uint64))
        point = np.where(self.later, np.uint64(every), mask[self.of]) if len(self.of) else np.zeros(0, np.uint64)
        at, text = block.points[self.alive], block.text_of[self.alive]
        begins = np.zeros(len(block.data) + 1, bool)
        for offset in range(offsets):
            start = at - reach + offset
            ok = ((point >> np.uint64(offset)) & np.uint64(1)).astype(bool)
            ok &= (start >= block.starts[text]) & (start + block.length <= block.ends[text])
            begins[start[ok]] = True
        place = np.flatnonzero(begins)
        steps = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(steps, place, 1)
        np.add.at(steps, place + block.length, -1)
        return np.cumsum(steps)[:-1] > 0


def _sorted_windows(key: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each context, which of its windows (bit = offset) also stand in a smaller document.

    Most-significant-digit radix passes over eight bytes each: a pass orders the windows
    within their groups by the next digit and drops groups that hold one document only.
    """
    mask = np.zeros(len(key), np.uint32)
    rank = np.unique(key, return_inverse=True)[1]
    for offset in range(length - GRAM + 1):
        rows = np.flatnonzero((left >= length - GRAM - offset) & (right >= offset))
        group = rank[rows]
        for at in range(offset, offset + length, 8):
            width = min(8, offset + length - at)
            digit = np.zeros((len(rows), 8), np.uint8)
            digit[:, :width] = around[rows, at : at + width]
            digit = digit.view(">u8").ravel().astype(np.uint64)
            order, new = _runs(group, digit)
            rows, first = rows[order], np.flatnonzero(new)
            if not len(rows):
                break
            size = np.diff(np.concatenate((first, [len(rows)])))
            least, most = np.minimum.reduceat(doc[rows], first), np.maximum.reduceat(doc[rows], first)
            go_on = np.repeat(least < most, size)
            rows, group = rows[go_on], np.repeat(np.arange(len(first)), size)[go_on]
        if len(rows):  # what is left is equal through the whole length
            hit = rows[_least(doc[rows], group) < doc[rows]]
            mask[hit] |= np.uint32(1 << offset)
    return mask


def _answer(table: pa.Table, length: int, large: int) -> pa.Table:
    """One bucket's replies to all blocks."""
    blocks, kinds = table.column("__block").to_numpy(), table.column("kind").to_numpy()
    payloads, bucket = table.column("payload").to_pylist(), table.column("bucket")[0].as_py()
    out = []
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind).tolist()
        readers = [_Reader(payloads[r]) for r in rows]
        sizes = [r.n for r in readers]
        gather = lambda f: np.concatenate([f(r) for r in readers])
        if kind == 1:
            key, held = gather(lambda r: r.planes(6)), gather(lambda r: r.take(1))
            order, new = _runs(key)
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate((first, [len(key)])))
            shared = (count > 1) | (np.maximum.reduceat(held[order] & 1, first) > 0)
            frequent = np.add.reduceat(np.left_shift(1, (held[order] >> 1).astype(np.int64)), first) > large
            result = np.empty((len(key), 2), np.uint8)
            result[order] = np.repeat(np.stack((shared, frequent), axis=1), count, axis=0)
        elif kind in (2, 5):
            key, context = gather(lambda r: r.planes(6)), gather(lambda r: r.planes(8))
            doc = gather(lambda r: r.planes(8)).view(np.int64)
            least = _least(doc, key, context)
            result = np.full(len(key), 3, np.uint8)
            if kind == 2:  # the whole gram is here: with one context there is nothing left to sort
                order, new = _runs(key, context)
                starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                contexts = np.repeat(np.add.reduceat(new.astype(np.int64), starts), np.diff(np.concatenate((starts, [len(key)]))))
                result[order] = np.where(contexts > 1, 2, 0)
            result[doc > least] = 1
        elif kind == 3:
            width = GRAM + 2 * (length - GRAM)
            parts = [(r.planes(6), r.take(width).reshape(-1, width), r.take(1), r.take(1), r.planes(8).view(np.int64)) for r in readers]
            key, around, left, right, doc = (np.concatenate(x) for x in zip(*parts))
            result = _sorted_windows(key, np.ascontiguousarray(around), left, right, doc, length)
        else:
            one, two, doc = gather(lambda r: r.planes(8)), gather(lambda r: r.planes(8)), gather(lambda r: r.planes(8)).view(np.int64)
            result = (_least(doc, one, two) < doc).astype(np.uint8)
        at = 0
        for r, n in zip(rows, sizes):
            part = result[at : at + n]
            at += n
            if kind == 1:
                part = np.concatenate((np.packbits(part[:, 0]), np.packbits(part[:, 1])))
            out.append((int(blocks[r]), kind, (np.packbits(part) if kind == 4 else part).tobytes()))
    b, k, p = zip(*out)
    return pa.table({"__block": pa.array(b, pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "kind": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})


def repeated_passages(
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int | None = None,
    buckets: int | None = None,
    large: int = 4096,
    texts: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with what to remove: each byte that lies in a ``length``-byte
    string which also starts in a document of smaller id.

    Columns of ``docs`` stay; added are ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``spans`` (their byte starts and ends), ``kept_sha256`` (of the remaining
    bytes joined) and, with ``texts``, ``kept_text`` (those bytes as a string; a character
    of which a cut leaves only some bytes is left out). Strings are judged on the input, matches never cross
    documents. A null text counts as empty; a null id as larger than all others; rows
    with one id are one document, so they never remove from each other. An empty table
    gives an empty table. A column named like an added one is called ``<name>_given``.

    ``blocks`` and ``buckets`` bound what a task holds and how many requests there are; by
    default there is one of each for ``BLOCK_BYTES`` of text, but no more blocks than four
    times the shuffle partitions, and no more buckets than twice these, since there is a
    request for each pair of them: on more data blocks grow, to 125 MB at 100 TB with 200,000
    shuffle partitions. ``large`` is the number of points from which a gram is dealt anew.
    """
    if length < GRAM or length - GRAM > 31:
        raise ValueError(f"length must be {GRAM} to {GRAM + 31}")
    spark = docs.sparkSession
    names = aside_names(docs.columns, ADDED)
    docs, id_col, text_col = set_aside(docs, *ADDED), names[id_col], names[text_col]
    if not (blocks and buckets):
        bytes_ = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        least = -(-int(bytes_) // BLOCK_BYTES) or 1
        blocks = blocks or min(least, 4 * shuffle_partitions(spark))
        buckets = buckets or min(least, 2 * shuffle_partitions(spark))
    key = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int")
    dealt = docs.withColumn("__block", key)
    own = list(docs.columns)

    def opened(table):
        return _Passes(Block(table, id_col, text_col, length), buckets), table.column("__block")[0].as_py() if table.num_rows else 0

    def pass1(table):
        state, block = opened(table)
        return _requests(block, state.request1())

    def pass2(table, replies):
        state, block = opened(table)
        state.after1(_replies(replies))
        return _requests(block, state.request2())

    def pass3(table, replies):
        state, block = opened(table)
        got = _replies(replies)
        state.after1(got)
        state.after2(got)
        return _requests(block, state.request3())

    def last(table, replies):
        state, _ = opened(table)
        got = _replies(replies)
        state.after1(got)
        state.after2(got)
        gone, block = state.covered(got), state.block
        before = np.concatenate(([False], gone[:-1]))[: len(gone)]
        before[block.starts[block.starts < len(gone)]] = False
        begin = np.flatnonzero(gone & ~before)
        after = np.concatenate((gone[1:], [False]))[: len(gone)]
        after[block.ends[block.ends > 0] - 1] = False
        end = np.flatnonzero(gone & ~after) + 1
        total = np.concatenate(([0], np.cumsum(gone)))
        first, stop = np.searchsorted(begin, block.starts), np.searchsorted(begin, block.ends)
        n_bytes, removed = block.ends - block.starts, total[block.ends] - total[block.starts]
        kept, spans, digest = [], [], []
        for a, e, i, j in zip(block.starts.tolist(), block.ends.tolist(), first.tolist(), stop.tolist()):
            part = block.data[a:e]
            part = (part[~gone[a:e]] if i < j else part).tobytes()
            if texts:
                kept.append(part.decode("utf-8", "ignore"))
            digest.append(hashlib.sha256(part).hexdigest())
            spans.append([{"start": int(begin[s]) - a, "end": int(end[s]) - a} for s in range(i, j)])
        rows = table.take(pa.array(block.order)).select(own)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for name, column in (
            ("n_bytes", pa.array(n_bytes, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("n_spans", pa.array(stop - first, pa.int64())),
            ("spans", pa.array(spans, kind)), ("kept_sha256", pa.array(digest, pa.string())), ("kept_text", pa.array(kept, pa.string())),
        )[: 5 + texts]:
            rows = rows.append_column(name, column)
        return rows

    def ask(requests: DataFrame) -> DataFrame:
        return requests.groupBy("bucket").applyInArrow(lambda t: _answer(t, length, large), REQUEST)

    grouped = dealt.groupBy("__block")
    one = ask(grouped.applyInArrow(pass1, REQUEST))
    two = ask(grouped.cogroup(one.groupBy("__block")).applyInArrow(pass2, REQUEST))
    both = one.unionByName(two)
    three = ask(grouped.cogroup(both.groupBy("__block")).applyInArrow(pass3, REQUEST))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(
        "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept_text string" * texts
    ).fields])
    return grouped.cogroup(both.unionByName(three).groupBy("__block")).applyInArrow(last, schema)
