"""Removal of repeated substrings: every byte of a 50-byte string that also starts in a document with a smaller id.

How the text is dealt out. Each 50-byte window has a minimizer, the least hash of its 16-byte strings, so equal windows
have equal minimizers. Runs of neighbouring windows with one minimizer are cut out as segments (about 68 bytes for 18
windows) and dealt to shards by the minimizer: windows that could be equal meet in one shard, whatever documents
they come from. Before that each task drops repeats of whole segments within a few MB of text, remembering them as removed, so a
passage that very many documents share is sent about once a task. There are ``MOST_PARTS`` partitions at most, whatever the input; one
may hold many shards, which it sorts one after the other.

A partition keeps its segments in files beyond ``HELD`` bytes and maps them. Segments whose minimizer nobody else has cannot repeat;
the others are taken in batches of whole minimizers, ``BATCH`` bytes of text each, and their suffixes sorted by external induced sorting
(see ``induced``), which yields common prefixes along the way. A minimizer with more text than a batch, such as a phrase met in very
many contexts, is cut again by the least of another hash of the same strings, and again, which parts the contexts; a shard of more
than ``LARGE`` bytes is so cut from file to file, a block at a time. So a task's memory holds one batch and the positions of ``LARGE``
bytes of segments, whatever the shard. A maximal run of
suffixes that agree on 50 bytes is one string; it is removed wherever the document is not the smallest of the run.

Defined cases: null counts as empty text; texts of fewer than 50 bytes are kept whole; documents with a null id are kept whole
and take nothing from others; rows that share an id count as one document for comparing (no row of it removes from another),
each is returned, and all lose the same bytes only if their texts are equal, so ids should be unique; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import table, written
from specweave.llm.induced import suffixes_downwards

LENGTH = 50
GRAM = 16
BLOCK = 4 << 20
SHARD_TEXT = 4 << 20  # bytes of text for each shard; segments make about 3.7 times as much of it
MOST_PARTS = 4096
HELD = 64 << 20  # bytes of segments that a task holds in memory before they go to files
BATCH = 16 << 20  # bytes of segments that are sorted at a time
LARGE = 128 << 20
DEEPEST = 6  # cuts of one minimizer's segments by further hashes; what is larger even then is sorted whole

#: Bytes to symbols 1..254 (UTF-8 has no byte 255 or 254) and 0 for separators.
_SHIFT = bytes((i + 1) % 256 for i in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the 16 bytes at each position."""
    word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    return _mixed(_mixed(word[:-8]) ^ (word[8:] + np.uint64(0x632BE59BD9B4E019)))


def window_minimizers(hashes: np.ndarray, length: int) -> np.ndarray:
    width, least, n = length - GRAM + 1, hashes, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    rest = width - n
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segment_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """A hash of each segment's bytes, from prefix sums of its 16-byte hashes; start, end: of its windows."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        n = len(hashes)
        power, inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
        power[1:], inverse[1:] = base, np.uint64(pow(int(base), -1, 1 << 64))
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power, dtype=np.uint64)])
        stop = end + length - GRAM
        return _mixed((sums[stop] - sums[start]) * inverse[start] + stop.astype(np.uint64) - start.astype(np.uint64))


def _blocks(batches, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (id, offset, bytes) of about BLOCK bytes; long texts are cut so that each window is in one piece."""
    own, size = [], 0
    for batch in batches:
        for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (x.as_py() or "").encode("utf-8", "surrogatepass")
            if key is None or len(data) < length:
                continue
            for at in range(0, len(data) - length + 1, BLOCK):
                own.append((key, at, data[at : at + BLOCK + length - 1]))
                size += len(own[-1][2])
                if size >= BLOCK:
                    yield own
                    own, size = [], 0
    if own:
        yield own


def _grouped_spans(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each key, sorted."""
    order = np.lexsort((start, keys))
    keys, start, end = keys[order], start[order], end[order]
    if not len(keys):
        return keys, start, end
    # running ends within a key: shift each key above all before it
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    lift = np.cumsum(new_key) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    head = new_key.copy()
    head[1:] |= start[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return keys[at], start[at], np.maximum.reduceat(end, at)


def _span_batch(keys: np.ndarray, start: np.ndarray, end: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One row a key with its spans packed as pairs of int32."""
    keys, start, end = _grouped_spans(keys, start, end)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    pairs = np.stack([start, end], 1).astype("<i4")
    packed = [pairs[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(keys)), strict=True)] if len(keys) else []
    return pa.RecordBatch.from_arrays([pa.array(keys[at], pa.int64()), pa.array(packed, pa.binary())], schema=schema)


_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())])
#: Fields of a payload; keys and starts are stored as differences, and the low 24 bits of the minimizer do within a shard (the
#: high bits of a minimum are mostly zero).
_HEADER = np.dtype([("key", "<i8"), ("start", "<i4"), ("n", "<u2"), ("high", "<u2"), ("low", "u1")])


def _runs(data: bytes, bounds: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Of the pieces of ``data``: hashes and minimizers by position, the piece of each window, and the runs of windows with one minimizer."""
    hashes = gram_hashes(data)
    least = window_minimizers(_mixed(hashes ^ np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))) if salt else hashes, length)
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    inside = np.arange(len(least)) <= np.repeat(bounds[1:] - length, np.diff(bounds))[: len(least)]
    head = np.ones(len(least), bool)
    head[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
    cut = np.flatnonzero(head | ~inside)
    start = np.flatnonzero(head & inside)
    end = np.append(cut, len(least))[np.searchsorted(cut, start, side="right")]
    long_ = end - start > 60_000  # so that lengths fit 16 bits; periodic text only
    if long_.any():
        more = [(np.arange(a, b, 60_000), b) for a, b in zip(start[long_], end[long_], strict=True)]
        start = np.concatenate([start[~long_], *(a for a, _ in more)])
        end = np.concatenate([end[~long_], *(np.append(a[1:], b) for a, b in more)])
    return hashes, least, piece, start, end


def _pieces(block: list[tuple[int, int, bytes]], length: int, shards: int, parts: int) -> tuple[list[tuple[int, bytes]], pa.RecordBatch]:
    """Payloads for the partitions, and what repeats within the block. A shard's partition is its number modulo theirs."""
    keys = np.array([k for k, _, _ in block], np.int64)
    offsets = np.array([o for _, o, _ in block], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for _, _, d in block])])
    data = b"".join(d for _, _, d in block)
    hashes, least, piece, start, end = _runs(data, bounds, length)
    key = keys[piece[start]]
    content = segment_hashes(hashes, start, end, length)
    order = np.lexsort((key, content))
    group = np.cumsum(np.concatenate([[0], content[order][1:] != content[order][:-1]])) if len(order) else order
    first = key[order][np.searchsorted(group, group)] if len(order) else key
    sent = order[key[order] == first]
    repeat = order[key[order] != first]
    local = offsets[piece] - bounds[piece]
    spans = _span_batch(key[repeat], (start + local[start])[repeat], (end + local[start])[repeat] + length - 1, _SPANS)
    sent = np.sort(sent)
    part = (least[start[sent]] >> np.uint64(20)) % np.uint64(shards) % np.uint64(parts)
    by = np.argsort(part, kind="stable")
    sent, part = sent[by], part[by]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    out, squeeze = [], zstandard.ZstdCompressor(level=5)
    start, end, key = start[sent], end[sent], key[sent]
    place, mark = start + local[start], least[start] & np.uint64(0xFFFFFF)
    for a, b in zip(cuts, np.append(cuts[1:], len(sent)), strict=True):
        header = np.empty(b - a, _HEADER)
        header["key"], header["start"] = np.diff(key[a:b], prepend=0), np.diff(place[a:b], prepend=0)
        header["n"], header["high"], header["low"] = end[a:b] - start[a:b], mark[a:b] >> np.uint64(8), mark[a:b] & np.uint64(255)
        fields = b"".join(header[f].tobytes() for f in _HEADER.names)
        text = b"".join([data[x : y + length - 1] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
        out.append((int(part[a]), squeeze.compress((b - a).item().to_bytes(8, "little") + fields + text)))
    return out, spans


def _unpacked(payload: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at = int.from_bytes(raw[:8], "little"), 8
    header = np.empty(n, _HEADER)
    for f in _HEADER.names:
        width = _HEADER[f].itemsize
        header[f] = np.frombuffer(raw, _HEADER[f], n, at)
        at += n * width
    header["key"], header["start"] = np.cumsum(header["key"]), np.cumsum(header["start"])
    return header, np.frombuffer(raw, np.uint8, -1, at)


def _taken(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the given stretches, one after the other."""
    ends = np.cumsum(size)
    return text[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Segments:
    """A partition's segments by shard; beyond ``held`` bytes they go to files of a folder of the task, and are mapped."""

    def __init__(self, folder: str, shards: int, length: int = LENGTH, held: int = HELD):
        self.folder, self.shards, self.length, self.limit, self.held = folder, shards, length, held, 0
        self.memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(shards)]
        self.spilled = 0

    def add(self, header: np.ndarray, text: np.ndarray) -> None:
        if self.shards == 1:
            own = [(0, header, text)]
        else:  # equal minimizers have equal marks, and so one shard
            size = header["n"].astype(np.int64) + self.length - 1
            place = np.cumsum(size) - size
            shard = _marks(header) % self.shards
            own = [(k, header[at], _taken(text, place[at], size[at])) for k in np.unique(shard).tolist() for at in (np.flatnonzero(shard == k),)]
        for k, h, t in own:
            self.memory[k].append((h, t))
            self.held += h.nbytes + t.nbytes
        if self.held > self.limit:
            self._spill()

    def _paths(self, k: int) -> tuple[str, str]:
        return os.path.join(self.folder, f"{k}.segments"), os.path.join(self.folder, f"{k}.text")

    def _spill(self) -> None:
        for k, parts in enumerate(self.memory):
            if parts:
                with open(self._paths(k)[0], "ab") as f, open(self._paths(k)[1], "ab") as g:
                    for h, t in parts:
                        f.write(h.tobytes())
                        g.write(t.tobytes())
                        self.spilled += t.nbytes
                parts.clear()
        self.held = 0

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Header and text of a shard; once."""
        if self.spilled:
            self._spill()
            if not os.path.exists(self._paths(k)[0]):
                return np.empty(0, _HEADER), np.empty(0, np.uint8)
            return tuple(np.memmap(p, t, "r") for p, t in zip(self._paths(k), (_HEADER, np.uint8), strict=True))
        parts, self.memory[k] = self.memory[k], []
        return tuple(np.concatenate([p[i] for p in parts]) if parts else e for i, e in ((0, np.empty(0, _HEADER)), (1, np.empty(0, np.uint8))))

    def drop(self, k: int) -> None:
        for path in self._paths(k):
            if os.path.exists(path):
                os.remove(path)


def _marks(header: np.ndarray) -> np.ndarray:
    return header["high"].astype(np.int64) * 256 + header["low"]


def _slices(weight: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours of about ``most`` weight together."""
    at = np.searchsorted(np.cumsum(weight), np.arange(0, int(weight.sum()) + most, most), side="left")
    at = np.unique(np.append(at, [0, len(weight)]))
    yield from (slice(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _contents(text: np.ndarray, place: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes of each segment, a few MB at a time."""
    out = np.empty(len(place), np.uint64)
    for own in _slices(n + length - 1, BLOCK):
        size = n[own] + length - 1
        at = np.cumsum(size) - size
        out[own] = segment_hashes(gram_hashes(_taken(text, place[own], size).tobytes()), at, at + n[own], length)
    return out


def _cut_again(text: np.ndarray, place: np.ndarray, n: np.ndarray, length: int, salt: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer by another hash: the segment, the first window, the number of windows and the mark of each."""
    out = []
    for own in _slices(n + length - 1, BLOCK):
        size = n[own] + length - 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        _, least, piece, start, end = _runs(_taken(text, place[own], size).tobytes(), bounds, length, salt)
        out.append((piece[start] + own.start, start - bounds[piece[start]], end - start, (least[start] >> np.uint64(1)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def stored_spans(store: Segments, k: int, length: int = LENGTH, batch: int = BATCH, large: int = LARGE, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans (key, start, end) to remove, of a shard that may be larger than memory; the shard's files go."""
    header, text = store.shard(k)
    if len(text) <= large or level >= DEEPEST:
        yield shard_spans(header, text, length, batch, level)
        store.drop(k)
        return
    with tempfile.TemporaryDirectory(dir=store.folder) as folder:
        inner = Segments(folder, 2 * -(-len(text) // large), length, min(store.limit, large))
        at = 0
        for own in _slices(header["n"] + np.int64(length - 1), BLOCK):
            own = header[own]
            n = own["n"].astype(np.int64)
            size = n + length - 1
            part, at = np.array(text[at : at + int(size.sum())]), at + int(size.sum())
            place = np.cumsum(size) - size
            stands = _leaders(_contents(part, place, n, length), own["key"])
            other = own["key"] != own["key"][stands]
            yield own["key"][other].astype(np.int64), own["start"][other].astype(np.int64), own["start"][other] + size[other]
            own, n, place = own[~other], n[~other], place[~other]
            piece, first, windows, marks = _cut_again(part, place, n, length, level + 1)
            cut = np.empty(len(piece), _HEADER)
            cut["key"], cut["start"], cut["n"] = own["key"][piece], own["start"][piece] + first, windows
            cut["high"], cut["low"] = marks >> 8 & 0xFFFF, marks & 255
            inner.add(cut, _taken(part, place[piece] + first, windows + length - 1))
        store.drop(k)
        del header, text
        for j in range(inner.shards):
            yield from stored_spans(inner, j, length, batch, large, level + 1)


def _leaders(content: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each segment the one of the smallest key among those with its content."""
    order = np.lexsort((key, content))
    group = np.cumsum(np.concatenate([[0], content[order][1:] != content[order][:-1]]))
    stands = np.empty(len(order), np.int64)
    stands[order] = order[np.searchsorted(group, group)]
    return stands


def shard_spans(header: np.ndarray, text: np.ndarray, length: int = LENGTH, batch: int = BATCH, level: int = 0, **sorting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (key, start, end) to remove from the documents of a shard's segments."""
    n = header["n"].astype(np.int64)
    place = np.cumsum(n + length - 1) - (n + length - 1)
    none = np.empty(0, np.int64)
    found = [(none, none, none), *_searched(header["key"].astype(np.int64), header["start"].astype(np.int64), n, _marks(header), place, text, length, batch, level, sorting)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _searched(key, start, n, mark, place, text, length, batch, level, sorting) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans of segments given by key, place in the document, windows, mark of the minimizer and place in ``text``."""
    _, inverse, count = np.unique(mark, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    key, start, n, mark, place = (x[some] for x in (key, start, n, mark, place))
    if not len(key):
        return
    size = n + length - 1
    # equal segments: one of the smallest document stands for them
    stands = _leaders(_contents(text, place, n, length), key)
    other = np.flatnonzero(key != key[stands])
    yield key[other], start[other], start[other] + size[other]
    lead = np.flatnonzero(stands == np.arange(len(stands)))
    followers = np.flatnonzero((stands != np.arange(len(stands))) & (key == key[stands]))
    # suffixes of the others, where more than one segment has the minimizer: whole minimizers, in batches
    lead = lead[np.argsort(mark[lead], kind="stable")]
    heads = np.flatnonzero(np.concatenate([[True], mark[lead][1:] != mark[lead][:-1]]))
    members = np.diff(np.append(heads, len(lead)))
    weight = np.add.reduceat(size[lead] + 1, heads)
    hot = (weight > batch) & (level < DEEPEST)
    for at, k in zip(heads[hot].tolist(), members[hot].tolist(), strict=True):
        own = lead[at : at + k]
        own = np.concatenate([own, followers[mark[followers] == mark[own[0]]]])
        piece, first, windows, marks = _cut_again(text, place[own], n[own], length, level + 1)
        yield from _searched(key[own][piece], start[own][piece] + first, windows, marks, place[own][piece] + first, text, length, batch, level + 1, sorting)
    usual = (members > 1) & ~hot
    for part in _slices(weight[usual], batch):
        at, k = heads[usual][part], members[usual][part]
        yield from _sorted(lead[_taken(np.arange(len(lead)), at, k)], followers, stands, key, start, size, place, text, length, sorting)


def _sorted(lead, followers, stands, key, start, size, place, text, length, sorting) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans of the segments ``lead`` by sorting their suffixes, and of those that are equal to them in the same document."""
    own_size = size[lead] + 1
    joined = np.zeros(int(own_size.sum()), np.uint8)
    at = np.cumsum(own_size) - own_size
    body = np.ones(len(joined), bool)
    body[at + size[lead]] = False
    joined[body] = _taken(text, place[lead], size[lead]) + np.uint8(1)
    owner = np.repeat(np.arange(len(lead), dtype=np.int32), own_size)
    pos = np.concatenate([np.empty(0, np.int64), *_repeats(joined, owner, key[lead], at + size[lead], length, **sorting)])
    who = owner[pos]
    begin = start[lead][who] + pos - at[who]
    yield key[lead][who], begin, begin + length
    index = np.full(len(stands), -1)
    index[lead] = np.arange(len(lead))
    followers = followers[index[stands[followers]] >= 0]
    if len(followers) and len(pos):  # other places of the same document with the same segment lose the same
        which = index[stands[followers]]
        by = np.argsort(who, kind="stable")
        low, high = np.searchsorted(who[by], which), np.searchsorted(who[by], which, side="right")
        hit = by[_taken(np.arange(len(by)), low, high - low)]
        to = np.repeat(followers, high - low)
        begin = start[to] + pos[hit] - at[who[hit]]
        yield key[to], begin, begin + length


def _repeats(text: np.ndarray, owner: np.ndarray, key: np.ndarray, end: np.ndarray, length: int, **sorting) -> Iterator[np.ndarray]:
    """Positions of ``text`` at which a string of ``length`` bytes starts that a smaller document also has."""
    kept_pos, kept_lcp = np.empty(0, np.int64), np.empty(0, np.uint8)

    def closed(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        head = lcp < length
        head[0] = True
        at = np.flatnonzero(head)
        docs = key[owner[pos]]
        least = np.minimum.reduceat(docs, at)
        larger = docs > np.repeat(least, np.diff(np.append(at, len(pos))))
        return pos[larger & (end[owner[pos]] - pos >= length)]

    for pos, lcp in suffixes_downwards(text, **sorting):
        pos, lcp = np.concatenate([kept_pos, pos]), np.concatenate([kept_lcp, lcp])
        heads = np.flatnonzero(lcp < length)
        cut = int(heads[-1]) if len(heads) else 0
        if cut:
            yield closed(pos[:cut], lcp[:cut])
        kept_pos, kept_lcp = pos[cut:], lcp[cut:]
    if len(kept_pos):
        yield closed(kept_pos, kept_lcp)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_text: int = SHARD_TEXT) -> DataFrame:
    """(doc_id, spans): spans to remove as packed pairs of int32; several rows a document."""
    if length != LENGTH:
        raise ValueError("common prefixes are kept up to 50 bytes")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    shards = max(8, -(-total // shard_text))
    parts = min(shards, MOST_PARTS)
    own_shards = -(-shards // parts)

    def dealt(batches):
        at = 0
        for block in _blocks(batches, length):
            payloads, spans = _pieces(block, length, shards, parts)
            if spans.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _SPANS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(spans)
                payloads.append((at % parts, sink.getvalue().to_pybytes()))
            at += 7919
            kinds = [0] * len(payloads)
            if spans.num_rows:
                kinds[-1] = 1
            for a in range(0, len(payloads), 64):  # small batches, so that the JVM holds few payloads at once
                some = payloads[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.int32()), pa.array(kinds[a : a + 64], pa.int32()), pa.array([p for _, p in some], pa.binary())], ["part", "kind", "payload"])

    def searched(batches):
        with tempfile.TemporaryDirectory() as folder:  # of this task: what is lost with it is made again with it
            store = Segments(folder, own_shards, length)
            for batch in batches:
                for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if kind:
                        yield from pa.ipc.open_stream(payload.as_py())
                    else:
                        store.add(*_unpacked(payload.as_py(), length))
            for k in range(own_shards):
                for found in stored_spans(store, k, length):
                    out = _span_batch(*found, _SPANS)
                    yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(dealt, "part int, kind int, payload binary").repartitionById(parts, F.col("part")).mapInArrow(searched, "doc_id long, spans binary")


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, kept (the bytes left), one row a document."""
    found = repeated_spans(docs, id_col, text_col, length)
    spans = written(found.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "substring-spans")

    def cut(batches):
        for batch in batches:
            sizes, removed, runs, hashes, left = [], [], [], [], []
            for x, packed in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (x.as_py() or "").encode("utf-8", "surrogatepass")
                n = 0
                kept, at = [], 0
                if packed:
                    pairs = np.concatenate([np.frombuffer(p, "<i4").reshape(-1, 2) for p in packed]).astype(np.int64)
                    _, start, end = _grouped_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    n = len(start)
                    for a, b in zip(start.tolist(), end.tolist(), strict=True):
                        kept.append(data[at:a])
                        at = b
                kept = b"".join([*kept, data[at:]])
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
                runs.append(n)
                hashes.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(hashes, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.binary())] * with_text, names + ["kept"] * with_text)

    key = spans.withColumnRenamed("doc_id", "_u_id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(key, F.col("id").cast("long") == F.col("_u_id"), "left").select("id", "text", "spans")
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents"))
