"""Elias-Fano coding of monotone sequences in mapped files, with searches over whole arrays at once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

U64 = np.uint64
BLOCK = 512  # bits; the high bits fill whole blocks
GROUP = 16384  # keys that are searched at a time, so that all arrays of a step stay in the processor's cache
NEAR_BITS = 8
NEAR = 1 << NEAR_BITS  # zeros from one remembered block to the next
WHOLE = 57  # bits that eight bytes hold from any bit of the first


def _at_bytes(words: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as a number: a view, so mapped words stay mapped."""
    return np.ndarray((len(words) * 8 - 7,), "<u8", words, 0, (1,))


def _nth_bit() -> np.ndarray:
    """[byte, r] -> place of its r-th set bit."""
    t = np.zeros((256, 8), np.uint8)
    for b in range(256):
        at = [i for i in range(8) if b >> i & 1]
        t[b, :len(at)] = at
    return t


NTH = _nth_bit()


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays for strictly or weakly rising ``values`` (uint64) below ``universe``: the low bits packed, the high bits as
    one set bit a value, one zero a step, the number of zeros before each word of them, and the index of the searches, so
    that a mapped file is ready for use as it is."""
    n = len(values)
    low_bits = max(0, (max(1, universe // max(1, n))).bit_length() - 1)
    high = (values >> U64(low_bits)).astype(np.int64)
    top = int(high[-1]) if n else 0
    bits = np.zeros(-(-(n + top + 2) // BLOCK) * BLOCK, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(U64)
    zeros = np.cumsum(64 - np.bitwise_count(words).astype(np.int64))
    packed = np.zeros(n * low_bits // 64 + 2, U64)
    if low_bits:
        low = values & U64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        shift = (at & 63).astype(U64)
        np.bitwise_or.at(packed, at >> 6, low << shift)
        over = (at & 63) + low_bits > 64
        np.bitwise_or.at(packed, (at[over] >> 6) + 1, low[over] >> (U64(64) - shift[over]))
    zeros = np.concatenate([[0], zeros])
    steps = zeros[::8]
    # the block of every NEAR-th zero, from which the search for a zero begins
    hints = np.searchsorted(steps, np.arange(0, int(zeros[-1]) + NEAR, NEAR), side="right") - 1
    return {"high": words, "zeros": zeros.astype(np.uint32), "low": packed, "head": np.array([n, low_bits, top], np.int64),
            "steps": np.append(steps, np.iinfo(np.int64).max), "ones": np.arange(len(steps)) * BLOCK - steps, "hints": hints}


def _in_word(words: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Place of the rest-th set bit of each word: by halves down to a byte, then by table."""
    place = np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        count = np.bitwise_count(words & U64((1 << half) - 1)).astype(np.int64)
        go = rest >= count
        rest = rest - count * go
        shift = go * half
        words = words >> shift.astype(U64)
        place += shift
    return place + NTH[(words & U64(255)).astype(np.int64), rest]


class EliasFano:
    def __init__(self, a: dict[str, np.ndarray]) -> None:
        self.high, self.zeros, self.low = a["high"], a["zeros"], a["low"]
        self.n, self.low_bits, self.top = (int(x) for x in a["head"])
        self.steps, self.after, self.ones, self.hints = a["steps"][:-1], a["steps"][1:], a["ones"], a["hints"]
        self.high_at, self.low_at = _at_bytes(self.high), _at_bytes(self.low)

    def _select0(self, j: np.ndarray) -> np.ndarray:
        """Place of the j-th zero (from 0) of the high bits."""
        block = self.hints[j >> NEAR_BITS]
        for _ in range(2):
            block += self.after[block] <= j
        if len(far := np.flatnonzero(self.after[block] <= j)):
            block[far] = np.searchsorted(self.steps, j[far], side="right") - 1
        word = block * 8
        for step in (4, 2, 1):
            to = np.minimum(word + step, len(self.zeros) - 1)
            word = np.where(self.zeros[to] <= j, to, word)
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _in_word(~self.high[word], j - self.zeros[word])

    def _select1(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one."""
        word = (np.searchsorted(self.ones, i, side="right") - 1) * 8
        for step in (4, 2, 1):
            to = np.minimum(word + step, len(self.zeros) - 1)
            word = np.where(to * 64 - self.zeros[to].astype(np.int64) <= i, to, word)
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _in_word(self.high[word], i - (word * 64 - self.zeros[word].astype(np.int64)))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        if self.low_bits <= WHOLE:
            return self.low_at[at >> 3] >> (at & 7).astype(U64) & U64((1 << self.low_bits) - 1)
        word, shift = at >> 6, (at & 63).astype(U64)
        x = self.low[word] >> shift
        more = self.low[word + 1] << ((U64(64) - shift) & U64(63))
        x = np.where(shift > 0, x | more, x)
        return x & U64((1 << self.low_bits) - 1)

    def buckets(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 index of the values with these high bits: the ones between two zeros."""
        before = np.maximum(high - 1, 0)
        place = np.where(high > 0, self._select0(before) + 1, 0)
        begin = np.where(high > 0, place - high, 0)
        byte = np.minimum(place >> 3, len(self.high_at) - 1)
        run = self.high_at[byte] >> (place - (byte << 3)).astype(U64)
        size = np.bitwise_count(run ^ (run + U64(1))).astype(np.int64) - 1  # ones at the low end
        if len(long := np.flatnonzero(size >= WHOLE - 1)):
            size[long] = self._select0(high[long]) - high[long] - begin[long]
        return begin, begin + size

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= key among those with the key's high bits, and whether it equals the key."""
        out, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for a in range(0, len(keys) if self.n else 0, GROUP):
            self._successor(keys[a:a + GROUP], out[a:a + GROUP], hit[a:a + GROUP])
        return out, hit

    def _successor(self, keys: np.ndarray, out: np.ndarray, hit: np.ndarray) -> None:
        high = keys >> U64(self.low_bits)
        live = np.flatnonzero(high <= U64(self.top))
        if not len(live):
            return
        lo, hi = self.buckets(high[live].astype(np.int64))
        todo = np.flatnonzero(lo < hi)
        low, end, want = lo[todo], hi[todo], keys[live[todo]] & U64((1 << self.low_bits) - 1)
        while len(todo):
            # every place where a search can end before its bucket's end has been a middle once
            mid = (low + end) >> 1
            value = self._low(mid)
            less = value < want
            hit[live[todo[value == want]]] = True
            low, end = np.where(less, mid + 1, low), np.where(less, end, mid)
            lo[todo] = low
            more = np.flatnonzero(low < end)
            todo, low, end, want = todo[more], low[more], end[more], want[more]
        out[live] = lo

    def values(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        out = np.zeros(len(i), U64)
        for a in range(0, len(i), GROUP):
            at = np.asarray(i[a:a + GROUP], np.int64)
            out[a:a + GROUP] = (self._select1(at) - at).astype(U64) << U64(self.low_bits) | self._low(at)
        return out


def encode_set(values: np.ndarray) -> dict[str, np.ndarray]:
    """A rising sequence of distinct small numbers as one bit for each number, with the ones before each word."""
    size = int(values[-1]) + 1 if len(values) else 1
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[values.astype(np.int64)] = 1
    words = np.packbits(bits, bitorder="little").view(U64)
    return {"bits": words, "ones": np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1].astype(np.uint32)}


class BitSet:
    def __init__(self, a: dict[str, np.ndarray]) -> None:
        self.bits, self.ones = a["bits"], a["ones"]

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each key among the set's numbers, and whether it is one."""
        word = (keys >> U64(6)).astype(np.int64)
        inside = word < len(self.bits)
        word = np.minimum(word, len(self.bits) - 1)
        w, bit = self.bits[word], keys & U64(63)
        hit = inside & ((w >> bit & U64(1)) > 0)
        return self.ones[word] + np.bitwise_count(w & ((U64(1) << bit) - U64(1))).astype(np.int64), hit


# ---------------------------------------------------------------- files of arrays in the shared folder

def pack(arrays: dict[str, np.ndarray]) -> bytes:
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [str(a.dtype), list(a.shape), at]
        data = a.tobytes() + b"\0" * (-a.nbytes % 8)
        body.append(data)
        at += len(data)
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    return len(top).to_bytes(8, "little") + top + b"".join(body)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes one file of its own name (so a repeated task never touches another's) and returns its path."""
    data, name = pack(arrays), f"{name}-{uuid.uuid4().hex}.bin"
    if folder.startswith("file:") or "://" not in folder:
        folder = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{name}"
        with open(path, "wb") as f:
            f.write(data)
        return path
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(data)
    return f"{folder}/{name}"


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped: from the shared folder itself where that is mounted, else from a copy that this
    executor makes once."""
    if "://" in path:
        from pyarrow import fs

        local = os.path.join(tempfile.gettempdir(), path.rsplit("/", 1)[-1])
        if not os.path.exists(local):
            store, base = fs.FileSystem.from_uri(path)
            part = f"{local}.{uuid.uuid4().hex}"
            with store.open_input_stream(base) as f, open(part, "wb") as g:
                while chunk := f.read(1 << 22):
                    g.write(chunk)
            os.replace(part, local)
        path = local
    data = np.memmap(path, np.uint8, mode="r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(data[8:8 + n].tobytes()).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[8 + n + at:8 + n + at + size].view(kind).reshape(shape).view(np.ndarray)
    return out
