"""Suffix arrays by external induced sorting, with common-prefix values cut off at ``CAP``.

The text is a byte array of strings, each ended by a separator; suffixes are sorted through the types L (larger than its
successor) and S, with S* the leftmost of each run of S. The S* substrings are named, the reduced string of names is sorted
by recursion, and its order seeds two induction passes:

* pass one goes through the buckets (first bytes) upwards and induces the L suffixes from S* and L suffixes,
* pass two goes downwards and induces the S suffixes from L and S suffixes.

Each pass is driven by a disk-backed priority queue. Its tuples carry the position, up to eight preceding bytes, so
that the text is read once in eight steps only, and the common prefix with the tuple before it in the bucket. A
monotone key (bucket, order of insertion) lets the queue keep a first-in-first-out list a bucket, in memory up to a
limit and in files beyond it, and lets numpy treat many tuples of a bucket at once. The common prefix of two tuples
inserted next to each other is one more than the least value met between their sources.

Names on higher levels are an integer alphabet with very many buckets: up to ``base`` names are sorted in memory by
doubling, more by the same two passes with tuples popped one at a time from a heap that spills sorted runs.

Only the first ``CAP`` bytes decide: suffixes that agree on them may come in any order, with the value ``CAP``.
"""

from __future__ import annotations

import heapq
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 50
CHUNK = 1 << 16
IN_MEMORY = 64 << 20
BASE = 1 << 23
_FIELDS = np.dtype([("pos", "<i8"), ("prev", "<u8"), ("left", "u1"), ("lcp", "u1")])


class BucketQueue:
    """Priority queue of tuples with the key (bucket, order of insertion); beyond ``limit`` bytes tuples move to files."""

    def __init__(self, folder: str, limit: int = IN_MEMORY):
        self.folder, self.limit, self.held = folder, limit, 0
        self.memory: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.files: dict[int, list] = {}  # bucket: path, tuples read, tuples written
        self.spilled = 0

    def push(self, bucket: int, rows: np.ndarray) -> None:
        self.memory[bucket].append(rows)
        self.held += rows.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        for bucket, parts in enumerate(self.memory):
            if parts:
                entry = self.files.setdefault(bucket, [os.path.join(self.folder, f"{id(self):x}-{bucket}"), 0, 0])
                with open(entry[0], "ab") as f:
                    for rows in parts:
                        f.write(rows.tobytes())
                        entry[2] += len(rows)
                        self.spilled += len(rows)
                parts.clear()
        self.held = 0

    def pop(self, bucket: int, n: int = CHUNK) -> np.ndarray | None:
        """The next tuples of a bucket, at most ``n``, in order; None if there are none now."""
        entry = self.files.get(bucket)
        if entry and entry[1] < entry[2]:
            k = min(n, entry[2] - entry[1])
            rows = np.fromfile(entry[0], _FIELDS, k, offset=entry[1] * _FIELDS.itemsize)
            entry[1] += k
            return rows
        parts = self.memory[bucket]
        if not parts:
            return None
        if len(parts) == 1:
            rows = parts.pop()
        else:
            rows = np.concatenate(parts)
            parts.clear()
        self.held -= rows.nbytes
        if len(rows) > n:
            parts.append(rows[n:])
            self.held += rows[n:].nbytes
        return rows[:n]


class Stack(BucketQueue):
    """What pass one leaves, read from its end by pass two: whole chunks, last in first out."""

    def __init__(self, folder: str, limit: int = IN_MEMORY):
        super().__init__(folder, limit)
        self.sizes: list[list[int]] = [[] for _ in range(256)]

    def push(self, bucket: int, rows: np.ndarray) -> None:
        self.sizes[bucket].append(len(rows))
        super().push(bucket, rows)

    def chunks(self, bucket: int) -> Iterator[np.ndarray]:
        """Chunks from the last to the first, each in ascending order."""
        yield from (self.memory[bucket].pop() for _ in range(len(self.memory[bucket])))
        if bucket in self.files:
            path, _, total = self.files[bucket]
            at = total
            while at:
                k = min(CHUNK, at)
                at -= k
                yield np.fromfile(path, _FIELDS, k, offset=at * _FIELDS.itemsize)


def _range_least(values: np.ndarray) -> list[np.ndarray]:
    levels, width = [values], 1
    while 2 * width <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    return levels


class _Pass:
    """Inserts what a run of processed suffixes induces, with common-prefix values."""

    def __init__(self, text: np.ndarray, queue: BucketQueue):
        self.queue = queue
        # the eight bytes before each position, the nearest in the highest byte; the text starts with eight zeros
        self.before = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        self.least = np.full(256, CAP, np.uint8)  # since the last insertion into the bucket
        self.begun = np.zeros(256, bool)

    def induce(self, rows: np.ndarray, below: int, upto: int) -> None:
        """Insert the predecessors of ``rows`` whose byte is in below..upto. rows.lcp: with the one processed before."""
        pos, prev, left, lcp = rows["pos"], rows["prev"], rows["left"], rows["lcp"]
        empty = np.flatnonzero(left == 0)
        if len(empty):
            prev, left = prev.copy(), left.copy()
            prev[empty] = self.before[pos[empty]]
            left[empty] = 8
        byte = (prev >> np.uint64(56)).astype(np.uint8)
        at = np.flatnonzero((pos > 0) & (byte >= below) & (byte <= upto))
        lowest = lcp.min()
        if not len(at):
            np.minimum(self.least, lowest, out=self.least)
            return
        at = at[np.argsort(byte[at], kind="stable")]
        to = byte[at]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        value = np.empty(len(at), np.uint8)
        levels = _range_least(lcp)
        start, end = at[:-1] + 1, at[1:]  # between neighbours of a bucket; what crosses buckets is replaced below
        ok = np.flatnonzero(end >= start)
        span = (end - start + 1)[ok]
        level = np.frexp(span.astype(np.float64))[1] - 1
        got = np.empty(len(ok), np.uint8)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            a, b = start[ok[own]], end[ok[own]] - (1 << int(k)) + 1
            got[own] = np.minimum(levels[k][a], levels[k][b])
        value[1:][ok] = got
        first = np.minimum.accumulate(lcp)
        value[heads] = np.minimum(self.least[to[heads]], first[at[heads]])
        value = np.minimum(value, CAP - 1) + 1
        fresh = ~self.begun[to[heads]]
        value[heads[fresh]] = 0
        self.begun[to[heads]] = True
        tails = np.concatenate([heads[1:], [len(at)]]) - 1
        last = np.minimum.accumulate(lcp[::-1])[::-1]
        np.minimum(self.least, lowest, out=self.least)
        rest = at[tails] + 1
        self.least[to[tails]] = np.where(rest < len(lcp), last[np.minimum(rest, len(lcp) - 1)], CAP)
        out = np.empty(len(at), _FIELDS)
        out["pos"], out["prev"], out["left"], out["lcp"] = pos[at] - 1, prev[at] << np.uint64(8), left[at] - 1, value
        for a, b in zip(heads, tails + 1, strict=True):
            self.queue.push(int(to[a]), out[a:b])


def _types(text: np.ndarray) -> np.ndarray:
    """True for S. The last symbol counts as S."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if n > 1:
        differ = text[:-1] != text[1:]
        where = np.where(differ, np.arange(n - 1), n - 1)
        nxt = np.minimum.accumulate(where[::-1])[::-1]
        up = np.append(text[:-1] < text[1:], True)
        smaller[:-1] = up[nxt]
    return smaller


def _common(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes, up to CAP, of the suffixes at a and b; ``padded`` starts with eight and ends with 64 zeros."""
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for at in range(0, CAP + 8, 8):
        x = words[a[open_] + 8 + at] ^ words[b[open_] + 8 + at]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        out[open_] += same
        open_ = open_[same == 8]
        if not len(open_):
            break
    return np.minimum(out, CAP).astype(np.uint8)


def _names(padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-preserving names of the S* substrings, of which 56 bytes count; the one that ends the text is the least.

    A substring that is the start of another ends in S where the other goes on with L, and so is the larger: hence padding with 255.
    """
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    length = np.append(np.diff(starts) + 1, 1)

    def word(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        w = words[at + 8].byteswap()
        size = np.clip(size, 0, 8)
        mask = np.where(size >= 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.minimum(size, 7) * 8).astype(np.uint64))
        return w | mask

    first = word(starts, length)
    first[-1] = 0
    rest = np.full(len(starts), np.iinfo(np.int64).max)
    long_ = np.flatnonzero(length > 8)
    if len(long_):
        more = [word(np.minimum(starts[long_] + k, len(words) - 9), length[long_] - k) for k in range(8, 56, 8)]
        order = np.lexsort(more[::-1])
        step = np.zeros(len(order), np.int64)
        for m in more:
            step[1:] |= m[order][1:] != m[order][:-1]
        rest[long_[order]] = np.cumsum(step)
    order = np.lexsort((rest, first))
    step = np.zeros(len(order), np.int64)
    step[1:] = (first[order][1:] != first[order][:-1]) | (rest[order][1:] != rest[order][:-1])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(step)
    return names


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of ``names`` by their first ``depth`` symbols, in memory. A rank is the place of the first of equals."""
    n = len(names)
    key = names * (n + 1)
    key[:-1] += names[1:] + 1
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(n), 0))
    k = 2
    while k < depth:
        sizes = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(sizes[rank] > 1)
        if not len(tied):
            break
        key = rank[tied] * (n + 1)
        key += np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0)
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        own, at = rank[tied], np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), at, 0))
        split = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        rank[tied] = own + split - group
        k *= 2
    return np.argsort(rank)


class SpillingHeap:
    """Priority queue popped one tuple at a time; sorted runs go to files beyond ``limit`` tuples."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.heap, self.runs, self.n = folder, limit, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            path = os.path.join(self.folder, f"run-{id(self):x}-{self.n}")
            self.n += 1
            with open(path, "wb") as f:
                for part in itertools.batched(sorted(self.heap), 4096):
                    pickle.dump(part, f)
            self.heap = []
            run = self._read(path)
            self.runs.append([next(run), run])

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def pop(self) -> tuple | None:
        best = min(self.runs, key=lambda r: r[0], default=None)
        if best is not None and (not self.heap or best[0] < self.heap[0]):
            item = best[0]
            best[0] = next(best[1], None)
            if best[0] is None:
                self.runs.remove(best)
            return item
        return heapq.heappop(self.heap) if self.heap else None


def _reduced_order(names: np.ndarray, folder: str, base: int, depth: int, limit: int) -> np.ndarray:
    """Suffix order of a string over integers; the last symbol is the least and occurs once."""
    n = len(names)
    if n <= base or n < 4:
        return _doubled(names, depth)
    small = _types(names)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.append(star[1:], n - 1)
    # substrings as tuples; a start of another one is the larger, so an infinite symbol ends each
    pieces = [(*names[a : b + 1].tolist(), n) if a < n - 1 else (-1,) for a, b in zip(star, ends, strict=True)]
    index = {p: i for i, p in enumerate(sorted(set(pieces)))}
    own = np.array([index[p] for p in pieces], np.int64)
    seeds = star[_reduced_order(own, folder, base, depth, limit)] if len(index) < len(own) else star[np.argsort(own)]
    heap, count, larger = SpillingHeap(folder, limit), 0, []
    for j, p in enumerate(seeds.tolist()):
        heap.push((int(names[p]), 1, j, p))
    while (item := heap.pop()) is not None:
        c, kind, _, p = item
        if kind == 0:
            larger.append(p)
        if p and names[p - 1] >= c and not small[p - 1]:
            heap.push((int(names[p - 1]), 0, count, p - 1))
            count += 1
    heap, count, out = SpillingHeap(folder, limit), 0, []
    for j, p in enumerate(reversed(larger)):
        heap.push((-int(names[p]), 1, j, p))
    heap.push((-int(names[n - 1]), 0, -1, n - 1))
    while (item := heap.pop()) is not None:
        p = item[3]
        out.append(p)
        if p and small[p - 1]:
            heap.push((-int(names[p - 1]), 0, count, p - 1))
            count += 1
    return np.array(out[::-1], np.int64)


def suffixes_downwards(text: np.ndarray, folder: str | None = None, limit: int = IN_MEMORY, base: int = BASE, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all suffixes in descending order with the common prefix (up to CAP) with the one yielded before.

    text: uint8, strings of symbols 1..254, each followed by a 0. Suffixes that begin with a separator are left out.
    """
    if not len(text):
        return
    with tempfile.TemporaryDirectory(dir=folder) as folder:
        n = len(text)
        padded = np.concatenate([np.zeros(8, np.uint8), text, np.zeros(64, np.uint8)])
        small = _types(text)
        star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        order = _reduced_order(_names(padded, star), folder, base, CAP // 2 + 1, limit // 64)  # a name covers two bytes or more
        seeds = star[order]
        seed_lcp = np.zeros(len(seeds), np.uint8)
        for at in range(1, len(seeds), chunk):
            part = slice(at, min(len(seeds), at + chunk))
            seed_lcp[part] = _common(padded, seeds[at - 1 : part.stop - 1], seeds[part])
        bounds = np.searchsorted(text[seeds], np.arange(257))
        del small, star, order

        one, left = _Pass(padded, BucketQueue(folder, limit)), Stack(folder, limit)
        for c in range(256):
            last = None
            while (rows := one.queue.pop(c, chunk)) is not None:
                left.push(c, rows)
                last = rows["pos"][-1]
                one.induce(rows, c, 255)
            for at in range(bounds[c], bounds[c + 1], chunk):
                part = slice(at, min(bounds[c + 1], at + chunk))
                rows = np.zeros(part.stop - at, _FIELDS)
                rows["pos"], rows["lcp"] = seeds[part], seed_lcp[part]
                if at == bounds[c]:
                    rows["lcp"][0] = 0 if last is None else _common(padded, np.array([last]), seeds[at : at + 1])[0]
                one.induce(rows, c, 255)
        del seeds, seed_lcp

        two = _Pass(padded, BucketQueue(folder, limit))
        for c in range(255, -1, -1):
            last = None
            while (rows := two.queue.pop(c, chunk)) is not None:
                if c:
                    yield rows["pos"], rows["lcp"]
                last = rows["pos"][-1]
                two.induce(rows, 0, c)
            after = None  # the common prefix of the chunk before with what comes next
            for rows in left.chunks(c):
                rows = rows[::-1].copy()
                own = rows["lcp"].copy()
                rows["lcp"][1:] = own[:-1]
                rows["lcp"][0] = after if after is not None else (0 if last is None else _common(padded, rows["pos"][:1], np.array([last]))[0])
                after = own[-1]
                # the preceding bytes were used up in pass one only as copies: they still stand
                yield rows["pos"], rows["lcp"]
                two.induce(rows, 0, c - 1)
        assert n
