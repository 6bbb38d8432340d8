"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut into units (a run of white space with the word after it) that
the tokenizer's own splitting rule never joins.  Each distinct unit of a
batch is encoded once: the symbols of all new units stand in one flat array,
every round finds the ranks of all adjacent pairs by binary search over the
sorted pair keys, and merges the lowest-rank pairs of all units at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .scratch import id_and_text

#: units kept by a worker between batches (about 40 bytes each); a full store starts anew
STORE_UNITS = 500_000

# The splitting rule of byte-level BPE and the white space it knows.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+"
         rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

_NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Merge tables of a byte-level tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        import regex
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        suffix = spec["model"]["end_of_word_suffix"]  # stands at the last symbol of each pre-token
        self.of_last = np.array([vocab[c + suffix] for c in letters], np.int64) if suffix else self.of_byte
        self.size = max(vocab.values()) + len(spec["added_tokens"]) + 1
        sides = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in sides], np.int64)
        made = np.array([vocab[a + b] for a, b in sides], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(letters)}
        by_id = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        by_id |= {i: t.encode() for t, i in self.special.items()}
        texts = [by_id.get(i, b"") for i in range(self.size)]
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.store = Store()

    def parts(self, text: str) -> Iterator[str | int]:
        """Pre-tokens of a text, and the ids of special tokens in it."""
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                yield from self.split.findall(piece)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and the n+1 offsets."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.of_byte[symbols]
        last = np.cumsum(lengths) - 1
        ids[last] = self.of_last[symbols[last]]
        word = np.repeat(np.arange(len(tokens)), lengths)
        done_ids, done_words, done_at = [], [], []
        while len(ids):
            pair = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(ids), _NONE)
            rank[:-1] = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, heads)
            spread = np.repeat(best, np.diff(np.append(heads, len(ids))))
            over = spread == _NONE  # nothing left to merge in these words
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, rank, spread = ids[~over], word[~over], rank[~over], spread[~over]
                if not len(ids):
                    break
            hit = rank == spread
            # a run of overlapping equal pairs (aaa): every second one, from the left
            begin = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
            run = np.arange(len(ids))
            hit &= (run - begin[np.maximum(np.searchsorted(begin, run, "right") - 1, 0)]) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[1:] = ~hit[:-1]
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(tokens) + 1, np.int64)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(tokens))
        return np.concatenate(done_ids)[order], np.concatenate(([0], np.cumsum(counts)))

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit, by its pre-tokens: flat ids and n+1 offsets."""
        tokens: dict[bytes, int] = {}
        plan, ends = [], []
        for unit in units:
            for part in self.parts(unit):
                plan.append(-1 - part if isinstance(part, int) else tokens.setdefault(part.encode(), len(tokens)))
            ends.append(len(plan))
        flat, at = self.merge(list(tokens))
        plan = np.array(plan, np.int64)
        special = plan < 0
        token = np.where(special, 0, plan)
        sizes = np.where(special, 1, (at[1:] - at[:-1])[token] if len(tokens) else 1)
        starts = np.where(special, len(flat) + np.arange(len(plan)), at[token])
        flat = np.concatenate((flat, np.where(special, -1 - plan, 0)))
        total = np.concatenate(([0], np.cumsum(sizes)))
        return gather(flat, starts, sizes), total[np.concatenate(([0], np.array(ends, np.int64)))]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n+1 offsets."""
        start, end, doc = units(buf, offsets)
        hashes = W.Words.hashes(Range(buf), False, start, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place, sizes = self.store.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            data = buf.tobytes()
            text = [data[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]], end[first[new]])]
            flat, at = self.encode_units(text)
            self.store.add(distinct[new], flat, at, distinct)
            place, sizes = self.store.find(distinct)
        ids = gather(self.store.flat, place[which], sizes[which])
        total = np.concatenate(([0], np.cumsum(sizes[which])))
        return ids, total[np.searchsorted(doc, np.arange(len(offsets)), "left")]

    def decode(self, ids: np.ndarray) -> str:
        at = self.token_at
        return gather(self.token_bytes, at[ids], at[ids + 1] - at[ids]).tobytes().decode("utf-8", "replace")


class Range:
    """Just a buffer, for hashing byte ranges of it."""

    def __init__(self, buf):
        self.buf = buf


class Store:
    """Ids of units seen before, by 64-bit hash."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.known, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        there = self.known[at] == hashes
        return np.where(there, self.place[at], -1), np.where(there, self.size[at], 0)

    def add(self, hashes: np.ndarray, flat: np.ndarray, at: np.ndarray, needed: np.ndarray) -> None:
        """Add units, sorted by hash; when full, keep only those ``needed`` now."""
        if len(self.known) + len(hashes) > STORE_UNITS:
            place, size = self.find(needed)
            kept = place >= 0
            ids = gather(self.flat, place[kept], size[kept])
            self.known, self.size, self.flat = needed[kept], size[kept], ids
            self.place = np.cumsum(self.size) - self.size
        at_known = np.searchsorted(self.known, hashes)  # both are sorted
        self.place = np.insert(self.place, at_known, at[:-1] + len(self.flat))
        self.size = np.insert(self.size, at_known, at[1:] - at[:-1])
        self.known = np.insert(self.known, at_known, hashes)
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` one after another."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return flat[:0]
    return flat[np.arange(total[-1]) + np.repeat(start - (total - size), size)]


def _odd_space(buf: np.ndarray) -> np.ndarray:
    """Start of each white-space character beyond ASCII."""
    at = np.flatnonzero((buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)))
    a, b, c = buf[:-2], buf[1:-1], buf[2:]
    wide = (((a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
            | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    return np.concatenate((at, np.flatnonzero(wide)))


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that can be encoded apart, and their rows: a word with the
    white space before it, or the white space at a text's end.  A text with
    white space beyond ASCII is one unit."""
    words = W.Words(buf, offsets)
    start = np.empty(len(words.start), np.int64)
    if len(start):
        start[0] = 0
        start[1:] = words.end[:-1]
        start = np.maximum(start, offsets[words.doc])
    last = offsets[:-1].copy()
    some = words.counts > 0
    last[some] = words.end[words.first[1:][some] - 1]
    tail = np.flatnonzero(last < offsets[1:])
    start = np.concatenate((start, last[tail]))
    end = np.concatenate((words.end, offsets[1:][tail]))
    doc = np.concatenate((words.doc, tail))
    odd = _odd_space(buf) if len(buf) > 1 else np.zeros(0, np.int64)
    if len(odd):
        whole = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        rest = ~np.isin(doc, whole)
        start = np.concatenate((start[rest], offsets[:-1][whole]))
        end = np.concatenate((end[rest], offsets[1:][whole]))
        doc = np.concatenate((doc[rest], whole))
    order = np.lexsort((start, doc))
    return start[order], end[order], doc[order]


def tokenizer_source(path: str | None, default: str) -> str:
    """JSON text of a tokenizer file, read by the driver; ``path`` None takes
    the named public file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(default)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _model(source) -> Bpe:
    return W.kept(("bpe", hash(source.value)), lambda: Bpe(source.value))


def _encode(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(source)
        for batch in batches:
            for piece in W.pieces(batch, size=W.TOKENIZER_PIECE_BYTES):
                ids, at = bpe.encode(*W.flat(piece.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"])
    return W.tidied(run)


def _decode(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(source)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return W.tidied(run)


def _digest(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(source)
        for batch in batches:
            for piece in W.pieces(batch, size=W.TOKENIZER_PIECE_BYTES):
                ids, at = bpe.encode(*W.flat(piece.column(1)))
                raw = memoryview(ids.astype("<u4").tobytes())
                sha = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                back = [hashlib.sha256(bpe.decode(ids[a:b]).encode()).hexdigest() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sha),
                                                  pa.array(back)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return W.tidied(run)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every text.

    The ids are those of the tokenizer file, without added tokens or
    truncation; strings of special tokens inside a text become those tokens.
    Null and empty texts have no ids.  Null ids and repeated rows stay as they
    are; an empty table gives an empty result; further columns are ignored.
    """
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path, "byte_bpe_50k.json"))
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode(source), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of ``encode``'s rows (null ids: null); bytes that are no
    UTF-8 become U+FFFD."""
    source = encoded.sparkSession.sparkContext.broadcast(tokenizer_source(path, "byte_bpe_50k.json"))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(source), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from
    them; edge cases as in ``encode``."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path, "byte_bpe_50k.json"))
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _digest(source), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
