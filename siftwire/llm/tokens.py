"""Public tokenizers as Arrow operators: encoding, packing into containers, splitting at boundaries.

The vocabulary file is a parameter (``TOKENIZER``); each Python worker loads it once.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import cut

#: The rank file of the public tokenizer byte_bpe_50k; set SIFTWIRE_TOKENIZER or pass ``vocabulary`` for another place.
TOKENIZER = os.environ.get("SIFTWIRE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The leaves of the tree of halves hold at most this many characters (and so many tokens, when decoding).
LEAF = 512
#: The blanks of PATTERN's \\s (Unicode White_Space), spelled out: Python's own \\s has four more.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks of a text: blanks and the word after them.  No piece of PATTERN goes on with a blank after a non-blank, so a chunk
#: begins a piece in any context and its ids are its own.
_CHUNKS = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: Positions at which a piece begins whatever stands around: chunks, and sentence marks after plain letters and digits.
_SYNC = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[a-zA-Z0-9\\u0621-\\u064a\\u4e00-\\u9fa5])(?=[.,;:!?\\u3002\\uff0c\\u3001\\u061f\\u060c])")
#: Most chunks that a worker remembers; beyond it, it starts anew.
_REMEMBERED, _LONGEST = 400_000, 48


class Encoder:
    """Exact byte-level BPE of whole texts, with a bounded memory of the ids of recurring chunks."""

    def __init__(self, vocabulary: str = TOKENIZER, leaf: int = LEAF):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._coder = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self._known: dict[str, array] = {}

    def chunk(self, c: str) -> array:
        """Ids of one chunk."""
        ids = self._known.get(c)
        if ids is None:
            ids = array("i", self._coder.encode_ordinary(c))
            if len(c) <= _LONGEST:
                if len(self._known) >= _REMEMBERED:
                    self._known.clear()
                self._known[c] = ids
        return ids

    def flat(self, text: str) -> array:
        """Ids of a text by its chunks."""
        out, known, chunk = array("i"), self._known, self.chunk
        for c in _CHUNKS.findall(text):
            ids = known.get(c)
            out += chunk(c) if ids is None else ids
        return out

    def encode(self, text: str | None) -> array:
        """Ids of ``text``; none for null and empty texts."""
        if not text:
            return array("i")
        return self._tree(text)

    def decode(self, ids) -> str:
        """The text of ids: bytes concatenated up the tree."""
        return self._bytes(ids).decode("utf-8")

    def _bytes(self, ids) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self._coder.decode_single_token_bytes, ids))
        mid = len(ids) // 2
        return self._bytes(ids[:mid]) + self._bytes(ids[mid:])

    def _tree(self, text: str) -> array:
        """Halves, joined: only the window round the seam is encoded again."""
        if len(text) <= self.leaf:
            return self.flat(text)
        mid = len(text) // 2
        return self._join(text[:mid], self._tree(text[:mid]), text[mid:], self._tree(text[mid:]))

    def _join(self, a: str, ids_a: array, b: str, ids_b: array) -> array:
        """The ids of ``a + b`` from those of its parts.

        The window grows to either side until it ends at a position where a piece begins in any context: that is the proof that
        the tokens outside are stable.  What is left of the window is then the same pieces in ``a`` and in ``a + b``, and so on the
        right; merges never cross pieces.
        """
        p, q = self._last_sync(a), self._first_sync(b)
        kept_a = ids_a[: len(ids_a) - len(self.flat(a[p:]))] if p else array("i")
        kept_b = ids_b[len(self.flat(b[:q])) :] if q < len(b) else array("i")
        return kept_a + self.flat(a[p:] + b[:q]) + kept_b

    @staticmethod
    def _last_sync(a: str) -> int:
        size = 64
        while True:
            start = max(0, len(a) - size)
            found = [m.start() for m in _SYNC.finditer(a, max(start, 1)) if m.start() < len(a)]
            if found or not start:
                return found[-1] if found else 0
            size *= 4

    @staticmethod
    def _first_sync(b: str) -> int:
        m = _SYNC.search(b, 1) if len(b) > 1 else None
        return m.start() if m else len(b)


@lru_cache(4)
def encoder(vocabulary: str = TOKENIZER) -> Encoder:
    return Encoder(vocabulary)


def _int_lists(lists: list[array]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = array("i")
    for x in lists:
        flat += x
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): the token ids of each document, without special tokens.

    Null and empty texts give an empty list, strings of special tokens are ordinary text, repeated rows are kept.  One pass
    without a shuffle; texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _int_lists([e.encode(t) for t in part.column(1).to_pylist()])], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


# --- Packing -----------------------------------------------------------------------------------------------------------

CAPACITY = 2048
_DIMS, _BITS, _BUCKETS = 3, 10, 256


def _projection() -> np.ndarray:
    """The fixed random projection of bucket counts to a few dimensions."""
    return np.random.default_rng(7).standard_normal((_BUCKETS, _DIMS))


def _buckets(ids: np.ndarray) -> np.ndarray:
    """Hash bucket of each token id, whatever the size of the vocabulary."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def hilbert_key(axes: list[int], bits: int = _BITS) -> int:
    """The position of a grid point along the Hilbert curve (Skilling's transposition, most significant bits first)."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> bit & 1)
    return key


def measure_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens, curve): the size of each document and its place on the curve through the hashed token vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        projection = _projection()
        for b in batches:
            sizes, curve = [], []
            for t in b.column(1).to_pylist():
                ids = e.encode(t)
                sizes.append(len(ids))
                if len(ids):
                    ids = np.frombuffer(ids, np.int32)
                    counts = np.bincount(_buckets(ids), minlength=_BUCKETS).astype(float)
                    v = counts @ projection / np.sqrt((counts * counts).sum())
                    grid = ((np.tanh(v / 2) + 1) / 2 * ((1 << _BITS) - 1)).astype(int)
                    curve.append(hilbert_key([int(g) for g in grid]))
                else:
                    curve.append(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(curve, pa.int64())], ["key", "n_tokens", "curve"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, curve bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each into the fullest open container that still holds it."""
    room: list[tuple[int, int]] = []
    out = np.zeros(len(sizes), np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, c = room.pop(at)
        else:
            left, c = capacity, used
            used += 1
        out[i] = c
        insort(room, (left - s, c))
    return out


#: Containers of a window are kept from this share of their capacity on; items of others wait for at most so many windows.
FULL, PATIENCE = 0.98, 2


def packed_windows(batches: Iterator[pa.RecordBatch], capacity: int, window: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(container numbers, items) of items with ``n_tokens`` that come in order, ``window`` at a time.

    Containers that are FULL are given out, and so are those with an item that has waited PATIENCE windows, however full: a task
    holds no more than PATIENCE + 1 windows of items.
    """
    number, held, waited = 0, None, np.zeros(0, np.int64)
    waiting: list[pa.RecordBatch] = []

    def packed(part: pa.Table, age: np.ndarray, last: bool):
        nonlocal number, held, waited
        sizes = part["n_tokens"].to_numpy()
        bins = best_fit(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)
        done = (fill >= FULL * capacity) | last
        done[bins[age >= PATIENCE]] = True
        names = np.cumsum(done) - 1 + number
        number += int(done.sum())
        keep = done[bins]
        held, waited = part.filter(pa.array(~keep)), age[~keep] + 1
        return names[bins[keep]], part.filter(pa.array(keep))

    def gathered() -> tuple[pa.Table, np.ndarray]:
        new = pa.Table.from_batches(waiting) if waiting else held.slice(0, 0)
        return (new, np.zeros(new.num_rows, np.int64)) if held is None else (pa.concat_tables([held, new]), np.concatenate([waited, np.zeros(new.num_rows, np.int64)]))

    for b in batches:
        # Windows are counted in items, however the batches come.
        for at in range(0, b.num_rows, window):
            waiting.append(b.slice(at, window))
            if sum(x.num_rows for x in waiting) >= window:
                yield packed(*gathered(), False)
                waiting = []
    if waiting or held is not None and held.num_rows:
        yield packed(*gathered(), True)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str = TOKENIZER, window: int = 8192) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens): every document in containers of ``capacity`` tokens.

    A document alone above the capacity gives full pieces and a rest; no other is split.  Items are range-sorted by their key
    on a Hilbert curve through the hashed document vectors and packed, best fit of decreasing sizes, among ``window``
    neighbours along the curve; the containers of a window that stay less than FULL are given up and their items packed again with
    those of the next window, PATIENCE times at most, so that little room is lost where windows meet.  Container ids are
    (part of the range sort) * 2^40 + number.  Empty and null texts take no room and go into the container of their
    neighbours; repeated rows are packed each.  Only sizes and keys are shuffled.
    """
    items = measure_documents(documents, key, text, vocabulary)
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity)
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), full)))
    items = items.withColumn("start_token", F.col("piece_no") * capacity).withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(capacity)))
    # Range sorting samples its input first: the sizes are written once, else every text would be encoded twice.
    items = cut(items).repartitionByRange("curve", "key", "piece_no").sortWithinPartitions("curve", "key", "piece_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        for names, part in packed_windows(batches, capacity, window):
            yield from part.append_column("container_id", pa.array(base + names, pa.int64())).to_batches()

    kind = documents.schema[key].dataType.simpleString()
    out = items.select("key", "piece_no", "start_token", "n_tokens").mapInArrow(run, f"key {kind}, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint")
    return out.select("container_id", F.col("key").alias(key), "piece_no", "start_token", "n_tokens")


# --- Splitting ---------------------------------------------------------------------------------------------------------

LIMIT, OVERLAP = 512, 64
_STOP, _PAUSE, _CLOSERS = ".!?\u061f\u3002\uff01\uff1f\u2026", ",;:\u060c\u061b\u2013\u2014)", "\"'\u201d\u2019\xbb)]"


def _power(before: str, after: str) -> int:
    """How good a cut between two chunks is: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word."""
    if "\n" in after:
        blank = after[: len(after) - len(after.lstrip())]
        if "\n" in blank:
            return 5 if blank.count("\n") > 1 else 4
    if before[-1] in _STOP or before[-1] in _CLOSERS and before.rstrip(_CLOSERS)[-1:] in _STOP:
        return 3
    return 2 if before[-1] in _PAUSE else 1


#: Ends of sentences and clauses inside an unbroken run; a mark between digits ends neither.
_RUN_MARKS = re.compile(f"[{re.escape(_STOP + _PAUSE)}]+[{re.escape(_CLOSERS)}]*(?<![0-9][.,:](?=[0-9]))")


def _run_places(run: str, e: Encoder, most: int) -> list[tuple[int, int, int]]:
    """(end, tokens, power) of the segments of an unbroken run: cut behind sentence and clause marks, and where a segment between
    two marks measures more than ``most``, at fixed widths as well (power 0)."""
    ends = [(m.end(), 3 if m[0].rstrip(_CLOSERS)[-1:] in _STOP else 2) for m in _RUN_MARKS.finditer(run) if m.end() < len(run)]
    out, at = [], 0
    for end, power in [*ends, (len(run), 9)]:
        parts = _parts(run[at:end], e, most)
        out += [(at + a, n, 0) for a, n in parts[:-1]] + [(end, parts[-1][1], power)]
        at = end
    return out


def _back(text: str, own: int, e: Encoder, most: int) -> int:
    """The first character of the longest end of ``text[:own]`` that measures at most ``most`` tokens by itself."""
    size = lambda width: len(e._coder.encode_ordinary(text[own - width : own]))
    low, high = 0, min(own, max(1, most))
    while high < own and size(high) <= most:
        low, high = high, min(own, 2 * high)
    if size(high) <= most:
        return own - high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if size(middle) <= most else (low, middle)
    return own - low


def _measured(text: str, own: int, end: int, e: Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces, as of ``split_text``, of ``text[own:end]``, measured for themselves; the overlap is measured back by characters."""
    n = len(e.encode(text[own:end]))
    if n > limit and end - own > 1:
        ends = [own, *[own + a for a, _ in _parts(text[own:end], e, limit - overlap)]]
        return [x for a, b in zip(ends, ends[1:]) for x in _measured(text, a, b, e, limit, overlap)]
    start, room = own, min(overlap, limit - n)
    while own and room > 0:
        start = _back(text, own, e, room)
        both = len(e.encode(text[start:end]))
        if both <= limit:
            return [(start, end, own, both)]
        start, room = own, room - (both - limit)
    return [(start, end, own, n)]


def split_text(text: str, e: Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, own_start, n_tokens) of each piece of a text: characters ``own_start:end`` are its own, ``start:own_start``
    repeats the end of the piece before.

    Atoms are sentences and lines; an atom too large in itself is cut at clauses, then words, then characters.  Adjacent atoms
    stand in a heap by the weakness of the boundary between them (then by their sum, then by place) and are merged while the
    sum plus the overlap fits the limit.  Cuts fall between chunks, whose ids are their own, so sizes add up exactly.  An unbroken
    run is cut behind its own sentence and clause marks, then at fixed widths; its segments weigh what they measure alone, and a
    piece that begins or ends in it is measured for itself.  Where no chunk begins in the later half of the overlap's reach, the
    overlap is measured back by characters until its tokens are reached.
    """
    chunks = _CHUNKS.findall(text)
    known, chunk = e._known, e.chunk
    sizes = [len(ids if (ids := known.get(c)) is not None else chunk(c)) for c in chunks]
    total = sum(sizes)
    if total <= limit:
        return [(0, len(text), 0, total)]
    room = limit - overlap
    # Places where a cut can be: character, tokens before it, segments' tokens before it, power of the boundary, in a run or not.
    place, before, weight, power, inner = [0], [0], [0], [9], [False]
    at = tokens = weighed = 0
    for i, c in enumerate(chunks):
        if i:
            place.append(at)
            before.append(tokens)
            weight.append(weighed)
            power.append(_power(chunks[i - 1], c))
            inner.append(False)
        if sizes[i] > room:  # an unbroken run
            measured = 0
            segments = _run_places(c, e, room)
            for a, n, strength in segments[:-1]:
                measured += n
                place.append(at + a)
                before.append(tokens + min(measured, sizes[i]))
                weight.append(weighed + measured)
                power.append(strength)
                inner.append(True)
            weighed += measured + segments[-1][1]
        else:
            weighed += sizes[i]
        at += len(c)
        tokens += sizes[i]
    place.append(at)
    before.append(tokens)
    weight.append(weighed)
    power.append(9)
    inner.append(False)
    bounds = [i for i in range(len(place)) if power[i] >= 3]
    for least in (2, 1, 0):  # finer cuts only where an atom is too large
        finer = [bounds[0]]
        for a, b in zip(bounds, bounds[1:]):
            if weight[b] - weight[a] > room:
                finer += [i for i in range(a + 1, b) if power[i] >= least]
            finer.append(b)
        bounds = finer
    k = len(bounds) - 1
    size = [weight[bounds[i + 1]] - weight[bounds[i]] for i in range(k)]
    left, right, version = list(range(-1, k - 1)), list(range(1, k + 1)), [0] * k
    heap = [(power[bounds[i + 1]], size[i] + size[i + 1], i, 0, 0) for i in range(k - 1) if size[i] + size[i + 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, both, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if version[i] != vi or j >= k or version[j] != vj:
            continue
        size[i], right[i] = both, right[j]
        version[j] = -1
        version[i] += 1
        j = right[i]
        if j < k:
            left[j] = i
            if both + size[j] <= room:
                heapq.heappush(heap, (power[bounds[j]], both + size[j], i, version[i], version[j]))
        h = left[i]
        if h >= 0 and size[h] + both <= room:
            heapq.heappush(heap, (power[bounds[i]], size[h] + both, h, version[h], version[i]))
    out, i = [], 0
    while i < k:
        a, b = bounds[i], bounds[right[i]]
        s = bisect_left(before, before[a] - overlap, 0, a) if overlap and i else a
        if inner[a] or inner[b] or inner[s] or i and before[a] - before[s] < overlap // 2:
            out += _measured(text, place[a], place[b], e, limit, overlap)
        else:
            out.append((place[s], place[b], place[a], before[b] - before[s]))
        i = right[i]
    return out


def _parts(run: str, e: Encoder, most: int) -> list[tuple[int, int]]:
    """Ends of parts of an unbroken run that each measure at most ``most`` tokens by themselves, with the tokens of each.

    The length is halved until a part fits, so each part is measured a few times, whatever the length of the run.
    """
    out, at, step = [], 0, max(1, 3 * most)
    while at < len(run):
        width = min(step, len(run) - at)
        n = len(e._coder.encode_ordinary(run[at : at + width]))
        while n > most and width > 1:
            width = max(1, min(width - 1, int(width * most / n)))
            n = len(e._coder.encode_ordinary(run[at : at + width]))
        at += width
        out.append((at, n))
    return out


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece_no, start, end, own_start, n_tokens, piece): every document in pieces of at most ``limit`` tokens.

    ``piece`` is characters start:end of the text; own_start:end follow each other without gap, so joining the own parts gives
    the text again.  Null and empty texts give one empty piece of 0 tokens.  One pass without a shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                keys, texts = b.column(0).slice(at, 512), b.column(1).slice(at, 512).to_pylist()
                rows, of = [], []
                for i, t in enumerate(texts):
                    for no, (s, z, o, n) in enumerate(split_text(t or "", e, limit, overlap)):
                        rows.append((no, s, z, o, n, (t or "")[s:z]))
                        of.append(i)
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.string()]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["key", "piece_no", "start", "end", "own_start", "n_tokens", "piece"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece_no bigint, start bigint, end bigint, own_start bigint, n_tokens bigint, piece string")
    return out.withColumnRenamed("key", key)
