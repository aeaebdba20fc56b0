"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks, each with a model of its own that starts afresh from the
segment's table and a checksum of its own. Per id, an order-2 and an order-1 table
each predict one id with a confidence. Hit rates by confidence, which learn on
every id, and the order-0 probability of the predicted id are mixed in the
logistic domain, with weights that learn on every id, into the probability that
the better prediction holds. After a miss the id is coded with order-0 counts,
which start from the segment's and take in the block's own from time to time.

A block is cut into streams of equal length that are coded side by side: they
share the block's tables and counts, while hit rates, weights and the range coder
are each stream's own. All streams of all blocks of a segment advance together, a
few numpy steps per position; of two streams that write to one entry at a
position, the later one stays. All arithmetic is on integers, so that decoding
repeats encoding exactly. The coder keeps a window of 60 bits and gives words of
20; carries stay in the words until the end of a segment. Behind its last word a
stream goes on with zeros.

A segment stands alone. Little-endian: b"QSG4", ids (u64), distinct ids (u32),
streams of a block (u32), ids of a stream (u32), bytes of the table (u32), crc32 of
all these and the packed table (u32), the table (zlib: the distinct ids in
ascending order as u32, their order-0 frequencies as u32, the number of each one's
commonest follower as u32, that follower's first confidence as u8), then blocks:
b"QRC2", ids (u32), crc32 of the ids as u32 (u32), payload bytes (u32), words of
each stream (u16, or u32 where u16 can't hold twice a stream's ids and one), their
words (five bytes for two). Only the last block may hold fewer ids; it is padded
with the first distinct id inside.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, BLOCK_MAGIC = b"QSG4", b"QRC2"
_HEAD, _BLOCK = struct.Struct("<4sQIIIII"), struct.Struct("<4sIII")
#: Streams of a block at most, and ids of a stream at least where a block has several.
STREAMS, LEAST = 16, 1024
#: Streams of a segment at most, slots of a block's order-2 table, and cells of all order-0 tables of a segment.
LANES, SLOTS, CELLS = 1 << 12, 1 << 14, 1 << 24
_BITS = 12
_WINDOW, _WORD = 60, 20
_LEFT = 1 << (_WINDOW - _WORD)
_EMPTY = -16 + 8
#: How fast hit rates and weights learn, as shifts, and what an own id weighs beside the segment's count.
RATE, LEARN, OWN = 5, 10, 16


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(-2047, 2048)
    squash = np.clip(np.round(4096 / (1 + np.exp(-x / 256.0))), 1, 4095).astype(np.int32)
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.round(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)
    return squash, stretch


_SQUASH, _STRETCH = _logistic()
#: By confidence (8: empty), for misses and, from 16 on, for hits: whether the entry is replaced, and else the change of its confidence.
_REPLACED = np.array([1, 1, 0, 0, 0, 0, 0, 0, 1, *[0] * 23], bool)
_CHANGE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 0, *[0] * 7, 1, 1, 1, 1, 1, 1, 1, 0, 0, *[0] * 7], np.int32)
#: A block's own counts are taken in after so many positions, and whenever these have doubled.
FIRST = 16
#: Weights are kept in bounds after so many ids; between, they can't overflow.
_BOUND = 16


class _Table:
    """What a segment's blocks start from."""

    def __init__(self, names: np.ndarray, freq: np.ndarray, follower: np.ndarray, sure: np.ndarray) -> None:
        self.names, self.freq, self.follower, self.sure = names, freq.astype(np.int64), follower, sure
        self.bits = max(14, int(len(names) - 1).bit_length() + 2)

    @staticmethod
    def of(names: np.ndarray, x: np.ndarray) -> _Table:
        """From the numbers x of a segment's ids."""
        n = len(names)
        total = 1 << max(14, int(n - 1).bit_length() + 2)
        cum = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]) * (total - n) // len(x) + np.arange(n + 1)
        follower, sure = np.zeros(n, np.int64), np.full(n, 8, np.uint8)
        if len(x) > 1:
            kind = np.uint32 if n < 1 << 16 else np.int64
            pairs, count = np.unique(x[:-1].astype(kind) * kind(n) + x[1:].astype(kind), return_counts=True)
            pairs = pairs.astype(np.int64)
            before = pairs // n
            first = np.flatnonzero(np.diff(before, prepend=-1))
            most = np.maximum.reduceat(count, first)
            best = np.flatnonzero(count == np.repeat(most, np.diff(first, append=len(pairs))))
            best = best[np.flatnonzero(np.diff(before[best], prepend=-1))]
            follower[before[best]] = pairs[best] % n
            sure[before[best]] = np.minimum(most * 8 // np.add.reduceat(count, first), 7)
        return _Table(names, np.diff(cum), follower, sure)

    def pack(self) -> bytes:
        return zlib.compress(b"".join([*(np.asarray(v).astype("<u4").tobytes() for v in (self.names, self.freq, self.follower)), self.sure.tobytes()]), 6)

    @staticmethod
    def unpack(data: bytes, n: int) -> _Table:
        raw = zlib.decompress(data)
        if len(raw) != 13 * n:
            raise ValueError("damaged table")
        three = np.frombuffer(raw, "<u4", 3 * n).reshape(3, n)
        return _Table(three[0].astype(np.int64), three[1], three[2].astype(np.int64), np.frombuffer(raw, np.uint8, n, 12 * n))


class _Model:
    """Predictions of all streams for the next id; orders 1 and 2 stand one after the other in each array.

    Streams are numbered so that the first of each block come first.
    """

    def __init__(self, table: _Table, streams: int, blocks: int, capacity: int, inverse: bool) -> None:
        n = streams * blocks
        self.lanes, self.blocks, self.table, self.capacity, self.inverse = n, blocks, table, capacity, inverse
        self.names = len(table.names)
        slots = 1 << int(self.names - 1).bit_length()
        #: Each stream's block.
        self.block = np.tile(np.arange(blocks, dtype=np.int64), streams)
        self.base1, self.base2 = self.block * slots, blocks * slots + self.block * SLOTS
        first = np.full(slots, _EMPTY, np.int32)
        known = table.sure < 8
        first[: self.names] = np.where(known, table.follower << 4 | table.sure, _EMPTY)
        self.entry = np.concatenate([np.tile(first, blocks), np.full(blocks * SLOTS, _EMPTY, np.int32)])
        rate = np.zeros(16, np.int32)
        rate[:8] = np.round(65536 * (np.arange(8) + 1) / (np.arange(8) + 4))
        self.rate = np.tile(rate, 2 * n)
        self.cells = np.arange(2 * n, dtype=np.int64) * 16
        self.weight = np.repeat(np.array([[30000], [40000], [12000]], np.int32), n, axis=1)
        share = table.freq * 4096 >> table.bits
        self.stretch0 = _STRETCH[np.minimum(share, 4095)]
        self.prev = np.zeros(n, np.int64)
        self.prev2 = np.zeros(n, np.int64)
        self.hash = np.empty(2 * n, np.int64)
        self.step, self.rebuild_at = 0, FIRST
        self.count = None
        self.seen: list[np.ndarray] = []
        self._rebuild()

    def _rebuild(self) -> None:
        total, n = 1 << self.table.bits, self.names
        if not self.step:
            cum = np.concatenate([[0], np.cumsum(self.table.freq)])[None]
        else:
            if self.count is None:
                self.count = np.tile(self.table.freq, (self.blocks, 1))
            self.count += np.bincount(np.concatenate(self.seen), minlength=self.count.size).reshape(self.count.shape) * OWN
            self.seen.clear()
            cum = np.zeros((self.blocks, n + 1), np.int64)
            np.cumsum(self.count, axis=1, out=cum[:, 1:])
            whole = cum[:, -1].tolist()
            cum *= total - n
            for row, w in zip(cum, whole, strict=True):
                row //= w  # by one number at a time, which numpy does several times as fast
            cum += np.arange(n + 1)
        cum = cum.astype(np.int32)
        if self.inverse:
            symbols = np.tile(np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.int32), len(cum))
            back = np.repeat(symbols, np.diff(cum, axis=1).ravel())
        if len(cum) < self.blocks:
            cum = np.tile(cum, (self.blocks, 1))
            back = np.tile(back, self.blocks) if self.inverse else None
        self.cum = cum.astype(np.int64).ravel()
        if self.inverse:
            self.back = back

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(predicted number or -1, probability of a hit out of 2**12) per stream."""
        if self.step == self.rebuild_at:
            self._rebuild()
            self.rebuild_at *= 2
        n = self.lanes
        np.add(self.prev, self.base1, out=self.hash[:n])
        h = self.prev * 40503
        h += self.prev2 * 30011
        h >>= 3
        h &= SLOTS - 1
        np.add(h, self.base2, out=self.hash[n:])
        self.got = self.entry.take(self.hash, mode="clip")
        self.conf = self.got & 15
        self.cell = self.cells + self.conf
        self.p = self.rate.take(self.cell, mode="clip")
        self.st = _STRETCH.take(self.p >> 4, mode="clip")
        self.guess = self.got >> 4
        one, two = self.guess[:n], self.guess[n:]
        self.second = self.st[n:] >= self.st[:n]
        agree = one == two
        self.cand = np.where(self.second, two, one)
        #: What each input says of the candidate; an order that predicts another id is silent.
        self.input = np.empty((3, n), np.int32)
        np.multiply(self.st[:n], agree | ~self.second, out=self.input[0])
        np.multiply(self.st[n:], agree | self.second, out=self.input[1])
        self.stretch0.take(self.cand, mode="clip", out=self.input[2])
        product = self.input * self.weight
        mixed = product[0] + product[1]
        mixed += product[2]
        mixed >>= 16
        mixed += 2047
        self.mixed = _SQUASH.take(mixed, mode="clip")
        return self.cand, self.mixed

    def update(self, ids: np.ndarray, hit: np.ndarray, cells: np.ndarray) -> None:
        """Learn the ids, whose order-0 counts are at cells; hit: streams where the prediction held."""
        if self.rebuild_at < self.capacity:
            self.seen.append(cells)
        twice = np.concatenate([ids, ids])
        held = (self.guess == twice).view(np.int8)
        change = held * np.int32(65535)
        change -= self.p
        change >>= RATE
        change += self.p
        self.rate[self.cell] = change
        error = hit * np.int32(4096)
        error -= self.mixed
        change = self.input * error
        change >>= LEARN
        self.weight += change
        if not self.step % _BOUND:
            np.clip(self.weight, -20_000, 150_000, out=self.weight)
        state = held << 4
        state |= self.conf.astype(np.int8)
        twice <<= 4
        stays = self.got + _CHANGE.take(state, mode="clip")
        self.entry[self.hash] = np.where(_REPLACED.take(state, mode="clip"), twice, stays)
        self.prev2, self.prev = self.prev, ids.astype(np.int64)
        self.step += 1


def _shape(n: int, names: int) -> tuple[int, int, int]:
    """(streams of a block, blocks, ids of a stream) for n ids of so many distinct ones."""
    bits = max(14, int(names - 1).bit_length() + 2)
    streams = max(1, min(STREAMS, n // LEAST))
    blocks = max(1, min(LANES // streams, n // (LEAST * streams), CELLS >> bits))
    capacity = -(-n // (streams * blocks))
    return streams, -(-n // (streams * capacity)), capacity


def _counts(capacity: int) -> str:
    return "<u2" if 2 * capacity + 1 < 1 << 16 else "<u4"


def encode_segment(ids: np.ndarray) -> bytes:
    """Blocks of a segment of ids, one after the other."""
    n = len(ids)
    if not n:
        return b""
    top = int(ids.max()) + 1
    known = np.flatnonzero(np.bincount(ids, minlength=top)) if top < 1 << 22 else np.unique(ids)
    if top < 1 << 22:
        number = np.zeros(top, np.int64)
        number[known] = np.arange(len(known))
        x = number[ids]
    else:
        x = np.searchsorted(known, ids)
    table = _Table.of(known, x)
    names, bits = len(known), table.bits
    streams, blocks, capacity = _shape(n, names)
    lanes, whole = streams * blocks, streams * capacity
    grid = np.zeros(lanes * capacity, np.int32)
    grid[:n] = x
    grid = np.ascontiguousarray(grid.reshape(blocks, streams, capacity).transpose(2, 1, 0)).reshape(capacity, lanes)
    model = _Model(table, streams, blocks, capacity, False)
    low = np.zeros(lanes, np.int64)
    size = np.full(lanes, (1 << _WINDOW) - 1, np.int64)
    # words stand by their place in a stream first, so that those written together lie together
    out = np.zeros((capacity * 2 + 16) * lanes, np.int32)
    gaps = model.block
    own, to = gaps * names, np.arange(lanes, dtype=np.int64)
    for t in range(capacity):
        now = grid[t]
        cand, p = model.predict()
        hit = cand == now
        part = size >> _BITS
        part *= p
        size -= part
        r = size >> bits
        cells = now + own
        c = cells + gaps
        start = model.cum.take(c)
        c += 1
        freq = model.cum.take(c) - start
        start *= r
        start += part
        low += np.where(hit, 0, start)
        r *= freq
        size = np.where(hit, part, r)
        at = np.flatnonzero(size < _LEFT)
        while len(at):
            lo = low.take(at)
            place = to.take(at)
            out[place] = lo >> (_WINDOW - _WORD)
            to[at] = place + lanes
            low[at] = (lo & (_LEFT - 1)) << _WORD
            s = size.take(at) << _WORD
            size[at] = s
            at = at[s < _LEFT]
        model.update(now, hit, cells)
    # sizes are 2**40 at least, so that one word more is enough
    out[to] = (low + (_LEFT - 1)) >> (_WINDOW - _WORD)
    used = to // lanes + 1
    words = out.reshape(-1, lanes)[: used.max()]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> _WORD
        words[k] &= (1 << _WORD) - 1
    words, used = words.reshape(-1, streams, blocks).transpose(2, 1, 0), used.reshape(streams, blocks).T
    kept = np.arange(words.shape[2]) < used[..., None]
    body = table.pack()
    fields = _HEAD.pack(MAGIC, n, names, streams, capacity, len(body), 0)[:-4]
    frames = [fields, struct.pack("<I", zlib.crc32(body, zlib.crc32(fields))), body]
    for i in range(blocks):
        block = ids[i * whole:(i + 1) * whole]
        payload = used[i].astype(_counts(capacity)).tobytes() + _packed(words[i][kept[i]])
        frames += [_BLOCK.pack(BLOCK_MAGIC, len(block), zlib.crc32(block.astype("<u4").tobytes()), len(payload)), payload]
    return b"".join(frames)


def _packed(words: np.ndarray) -> bytes:
    """Five bytes for two words."""
    a, b = np.append(words, np.zeros(len(words) % 2, np.int32)).reshape(-1, 2).T
    packed = np.stack([a >> 12, a >> 4 & 255, (a & 15) << 4 | b >> 16, b >> 8 & 255, b & 255], axis=-1).astype(np.uint8)
    return packed.tobytes()[: -(-len(words) * 5 // 2)]


def _unpacked(data: bytes, count: int) -> np.ndarray:
    if len(data) != -(-count * 5 // 2):
        raise ValueError("damaged block")
    five = np.frombuffer(data + bytes(-len(data) % 5), np.uint8).reshape(-1, 5).astype(np.int32).T
    return np.stack([five[0] << 12 | five[1] << 4 | five[2] >> 4, (five[2] & 15) << 16 | five[3] << 8 | five[4]], axis=-1).reshape(-1)[:count]


def decode_segment(data: bytes) -> np.ndarray:
    """Ids of a segment; ValueError if a block or the table is damaged."""
    if not data:
        return np.zeros(0, np.int32)
    if len(data) < _HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a segment")
    _, count, names, streams, capacity, length, crc = _HEAD.unpack_from(data)
    at = _HEAD.size + length
    body = data[_HEAD.size:at]
    if zlib.crc32(body, zlib.crc32(data[: _HEAD.size - 4])) != crc:
        raise ValueError("damaged table")
    table = _Table.unpack(body, names)
    bits, total = table.bits, 1 << table.bits
    kind = np.dtype(_counts(capacity))
    sizes, sums, used, words = [], [], [], []
    while at < len(data):
        if data[at:at + 4] != BLOCK_MAGIC or at + _BLOCK.size > len(data):
            raise ValueError("damaged block")
        _, n, crc, length = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        if n > streams * capacity or at + length > len(data) or length < streams * kind.itemsize:
            raise ValueError("damaged block")
        sizes.append(n)
        sums.append(crc)
        used.append(np.frombuffer(data, kind, streams, at).astype(np.int64))
        words.append(_unpacked(data[at + streams * kind.itemsize:at + length], int(used[-1].sum())))
        at += length
    if sum(sizes) != count:
        raise ValueError("a block is missing")
    blocks = len(sizes)
    lanes = streams * blocks
    used = np.stack(used)
    row = int(used.max()) + _WINDOW // _WORD
    # by place in a stream first, as in encoding, and zeros behind a stream's words
    padded = np.zeros((blocks, streams, row), np.int32)
    padded[np.arange(row) < used[..., None]] = np.concatenate(words)
    words = padded.transpose(2, 1, 0).reshape(-1)
    model = _Model(table, streams, blocks, capacity, True)
    gaps = model.block
    own, rows, to = gaps * names, gaps << bits, np.arange(lanes, dtype=np.int64)
    size = np.full(lanes, (1 << _WINDOW) - 1, np.int64)
    diff = np.zeros(lanes, np.int64)
    for _ in range(_WINDOW // _WORD):
        diff = (diff << _WORD) | words.take(to)
        to += lanes
    grid = np.zeros((capacity, lanes), np.int32)
    for t in range(capacity):
        cand, p = model.predict()
        part = size >> _BITS
        part *= p
        hit = diff < part
        hit &= cand >= 0
        size -= part
        r = size >> bits
        rest = diff - part
        v = rest // r
        np.minimum(v, total - 1, out=v)
        v += rows
        now = np.where(hit, cand, model.back.take(v, mode="clip"))
        cells = now + own
        c = cells + gaps
        start = model.cum.take(c)
        c += 1
        freq = model.cum.take(c) - start
        start *= r
        rest -= start
        diff = np.where(hit, diff, rest)
        r *= freq
        size = np.where(hit, part, r)
        at = np.flatnonzero(size < _LEFT)
        while len(at):
            place = to.take(at)
            diff[at] = (diff.take(at) << _WORD) | words.take(place, mode="clip")
            to[at] = place + lanes
            s = size.take(at) << _WORD
            size[at] = s
            at = at[s < _LEFT]
        model.update(now, hit, cells)
        grid[t] = now
    full = table.names.astype(np.int32)[grid.reshape(capacity, streams, blocks).transpose(2, 1, 0)].reshape(blocks, -1)
    parts = []
    for i in range(blocks):
        block = full[i, : sizes[i]]
        if zlib.crc32(block.astype("<u4").tobytes()) != sums[i]:
            raise ValueError(f"checksum of block {i} does not match")
        parts.append(block)
    return np.concatenate(parts)
