"""Vectorised text helpers for Arrow batches: words, word hashes, shingles.

A batch of texts is looked at as one flat UTF-8 buffer.  Words
(``[^\\x20\\x09-\\x0D]+``) are found from byte masks and hashed with prefix
sums, so a text costs a few numpy passes whatever its words look like.
Batches are cut into pieces of bounded size; a longer text is a piece of its
own, never cut.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: text of a piece; tokenizers take longer ones, as they look each distinct word up once a piece
PIECE_BYTES, TOKENIZER_PIECE_BYTES = 1 << 19, 1 << 21

_U = np.uint64
_SEED = 20240607
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (functions shipped by
    value get new globals in each task)."""
    return sys.modules.setdefault("_tessera_llm_cache", types.ModuleType("_tessera_llm_cache")).__dict__


def kept(key, make):
    """The one large object (a tokenizer) that a worker keeps between tasks."""
    cache = worker_cache()
    if cache.get("kept", (None,))[0] != key:
        cache["kept"] = (key, make())
    return cache["kept"][1]


def release() -> None:
    """Let go of what another operator has kept in this worker."""
    worker_cache().pop("kept", None)


def tidy() -> None:
    """Give the system back what nothing holds: a worker may idle for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """An Arrow function that tidies up at the end of its task."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()
    return wrapped


def _tables() -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "bytes" not in cache:
        t = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        low = t.copy()
        low[65:91] = t[97:123]
        cache["bytes"] = (t, low)
    return cache["bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size > 2 * TOKENIZER_PIECE_BYTES:  # one huge text: not kept
            return have
        cache["powers"] = have
    return have


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for hashes of runs from prefix
    sums."""
    up, down = _powers(n)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``size`` bytes of text, or one row."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a piece: byte ``start`` and ``end`` in the flat buffer and
    the row ``doc`` of each.  ``solid`` marks the bytes that words are made of
    (by default all but white space)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None):
        self.buf, self.offsets, self.n_docs = buf, offsets, len(offsets) - 1
        solid = ~SPACE[buf] if solid is None else solid
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(buf), bool)
        after = np.empty(len(buf), bool)
        if len(buf):
            before[0] = after[-1] = False
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self, lower: bool = True, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word (or of any byte ranges); ``lower`` folds A-Z."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        up, down = _powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_tables()[int(lower)][self.buf] * up[:len(self.buf)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one row, and the index of its first
    word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[at + i]) * _U(0x2545F4914F6CDD1D)
        out = out ^ (out >> _U(29))
    return mix(out), at


def distinct_by_doc(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, ordered by doc, then value."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[keep], values[keep]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles by document.  A document of fewer than k words
    has its whole word sequence as its only shingle; one without words none."""
    hashes = words.hashes()
    values, at = shingles(hashes, words.doc, k)
    docs = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            run = hashes[words.first[d]:words.first[d + 1]]
            whole[i] = shingles(run, np.zeros(len(run), np.int64), len(run))[0][0]
        docs, values = np.concatenate((docs, short)), np.concatenate((values, whole))
    return distinct_by_doc(docs, values)
