"""SimHash near-duplicates: documents whose fingerprints differ in few bits.

A text's fingerprint has a bit set where more than half of its word shingles'
hashes have it.  Two fingerprints that differ in at most ``2 r`` bits leave at
least two of ``2 r + 2`` blocks untouched, so every pair of blocks is a join
key: close pairs share at least one, and the Hamming distance of each pair
that a block gathers is verified.

Equal fingerprints are one class before anything is joined.  A block of up to
``SHORT`` classes is joined with itself.  The classes of a longer block (a
template's pages) are not paired: each emits the ball of fingerprints within
``r`` bits of its own, and classes that share a point of their balls are
linked to the smallest one of them.  Two classes share a point exactly if they
differ in at most ``2 r`` bits, so no link between two of them is lost, and
the rows grow in proportion to the classes, not with their square.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import drop, id_and_text, stored

SHINGLE, BITS, SEED = 3, 2, 42
#: classes up to which a block is joined with itself
SHORT = 64
#: shingles whose bits are counted at once
STEP = 1 << 16


def _spaced(words: W.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a piece, A-Z lower-cased, with one space after each; where
    each starts and ends."""
    size = words.end - words.start
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    text = np.full(int((size + 1).sum()), 0x20, np.uint8)
    shift = np.repeat(start - words.start, size)
    at = np.arange(len(shift)) + np.repeat(words.start - np.concatenate(([0], np.cumsum(size)))[:-1], size)
    raw = words.buf[at]
    text[at + shift] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    return text.tobytes(), start, start + size


def _hashes(text: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], seed) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def _bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many hashes of each row (``counts`` of them, in order) have each of
    the 64 bits."""
    rows = np.flatnonzero(counts)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(counts), 64), np.int64)
    if len(rows):
        first = np.concatenate(([0], np.cumsum(counts[rows])))[:-1]
        total[rows] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return total


def fingerprints_of(words: W.Words, k: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (64 bits) and number of shingles of each row of a piece."""
    text, start, end = _spaced(words)
    n = np.where(words.counts >= k, words.counts - k + 1, (words.counts > 0).astype(np.int64))
    row = np.repeat(np.arange(words.n_docs), n)
    place = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    first = words.first[row] + place
    last = first + np.minimum(words.counts[row], k) - 1
    total = np.zeros((words.n_docs, 64), np.int64)
    for at in range(0, len(row), STEP):
        part = slice(at, at + STEP)
        lo, hi = row[part][0], row[part][-1] + 1
        total[lo:hi] += _bit_counts(_hashes(text, start[first[part]], end[last[part]], seed),
                                    np.bincount(row[part] - lo, minlength=hi - lo))
    bits = (2 * total > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1), n


def _fingerprints(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        for batch in batches:
            for piece in W.pieces(batch):
                value, n = fingerprints_of(W.Words(*W.flat(piece.column(1))), k, seed)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["doc_id", "f", "n"])
    return W.tidied(run)


def _block_keys(radius: int) -> str:
    """The keys of a fingerprint ``f``: number and bits of each pair of blocks."""
    many = 2 * radius + 2
    edges = [64 * i // many for i in range(many + 1)]

    def block(i: int) -> str:
        size = edges[i + 1] - edges[i]
        return f"(shiftrightunsigned(f, {edges[i]}) & {(1 << size) - 1}L)", size
    keys = []
    for number, (i, j) in enumerate(itertools.combinations(range(many), 2)):
        (x, _), (y, size) = block(i), block(j)
        keys.append(f"shiftleft({number}L, 32) | shiftleft({x}, {size}) | {y}")
    return f"array({', '.join(keys)})"


def _ball(radius: int) -> str:
    """All fingerprints within ``radius`` bits of ``f``, with literal masks."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)]
    return f"transform(array({', '.join(f'{m - (1 << 64) if m >> 63 else m}L' for m in masks)}), m -> f ^ m)".replace(
        "-9223372036854775808L", "(-9223372036854775807L - 1L)")


def close_pairs(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: links between fingerprints ``f`` (longs, each once) that connect
    whatever differs in at most ``bits`` (an even number) bits."""
    if bits < 0 or bits % 2:
        raise ValueError("bits must be an even number")
    radius = bits // 2
    keys = classes.select("f", F.explode(F.expr(_block_keys(radius))).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    blocks = stored(keys.join(sizes, "key"), "blocks")
    low = blocks.where(F.col("many") <= SHORT).select("key", F.col("f").alias("a"))
    pairs = low.join(low.select("key", F.col("a").alias("b")), "key").where("a < b").where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    # at most as many classes share a point as a ball has points
    crowd = blocks.where(F.col("many") > SHORT).select("f").distinct()
    points = crowd.select("f", F.explode(F.expr(_ball(radius))).alias("point"))
    stars = points.groupBy("point").agg(F.collect_set("f").alias("all")).where("size(all) > 1").select(
        F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    links = stored(pairs.union(stars).distinct(), "pairs")
    drop(blocks)
    return links


def simhash_groups(docs: DataFrame, k: int = SHINGLE, bits: int = BITS, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_shingles: one row
    per row of ``docs``.

    Words are runs of anything but white space, A-Z lower-cased; a shingle is
    ``k`` words joined by spaces, repeats included, or the whole sequence of a
    shorter text.  A text without words (null, empty, blank) has fingerprint
    zero and is linked like any other.  Documents link when their fingerprints
    differ in at most ``bits`` bits; component_id is the smallest id reachable
    by links.  A row without an id links nothing and has no component.  Rows
    that repeat an id each keep their own row; they are connected only by
    links.  An empty table gives an empty result.  Further columns are ignored.
    """
    rows = stored(id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(k, seed), "doc_id long, f long, n long"),
                  "fingerprints")
    classes = stored(rows.where("doc_id IS NOT NULL").groupBy("f").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = components(close_pairs(classes, bits))
    linked = found.join(classes, found.node == classes.f).select("f", "component", "doc_id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least, "component").select(F.col("f").alias("g"), "component_id")
    named = stored(classes.join(named, classes.f == named.g, "left").select(
        "f", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    return rows.join(named, "f", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.col("n").alias("n_shingles"))
