"""Order-preserving packing of token sequences.

Each task reads its documents in order as one stream of tokens and cuts it
into windows of at most ``size`` tokens.  A dynamic program picks the cuts
among document ends, sentence ends (one in 16 tokens) and, inside very long
sentences, every 64th token, so that padding plus truncation penalties are least: the best way
to end at a position is the least value among the starts that lie within
``size`` tokens before it, which a monotone queue hands over in constant
time; windows whose length is a power of two carry no padding and are looked
up by length.  There is no shuffle, and memory holds one stretch of the
stream (about ``STRETCH`` tokens, or one document if that is longer).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import words as W
from .bpe import Bpe, Store, gather, tokenizer_source
from .scratch import id_and_text

STRETCH = 1 << 20
#: price of a cut inside a document, in tokens of padding: after a sentence, elsewhere
SENTENCE_CUT, HARD_CUT = 4, 64
#: a cut position at most in so many tokens, besides the document ends
CELL = 16
#: a sentence longer than this may be cut after each HARD_STEP tokens
LONG_SENTENCE, HARD_STEP = 512, 64

_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "ids binary")


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space: each
    distinct word is encoded once.

    Plain Latin words go through the merge rounds of ``Bpe``, split by the
    file's own rule; the others, and those with a special token's string in
    them, through the tokenizers library.
    """

    # Fixed value: the tokenizer's splitting rule, and one more branch for the spaces set between words
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| "

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bpe, self.split, self.store = Bpe(source), regex.compile(self.SPLIT), Store()
        self.foreign = regex.compile("[^\0-\u024f]|\xa0|\x85|" + "|".join(map(regex.escape, self.bpe.special)))

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of plain Latin words."""
        tokens: dict[str, int] = {}
        number = tokens.setdefault
        plan = np.array([-1 if t == " " else number(t, len(tokens))
                         for t in self.split.findall(" ".join(texts).lower())], np.int64)
        flat, at = self.bpe.merge([t.encode() for t in tokens])
        word = np.cumsum(plan < 0)
        word, plan = word[plan >= 0], plan[plan >= 0]
        sizes = at[1:] - at[:-1]
        return gather(flat, at[plan], sizes[plan]), np.bincount(
            word, weights=sizes[plan], minlength=len(texts)).astype(np.int64)

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the n+1 offsets by word."""
        distinct, first, which = np.unique(words.hashes(lower=False), return_index=True, return_inverse=True)
        place, size = self.store.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            data = words.buf.tobytes()
            texts = [data[a:b].decode() for a, b in zip(words.start[first[new]].tolist(),
                                                        words.end[first[new]].tolist())]
            odd = np.array([self.foreign.search(t) is not None for t in texts])
            simple = np.flatnonzero(~odd)
            if len(simple):
                flat, sizes = self.plain([texts[i] for i in simple.tolist()])
                self.store.add(distinct[new[simple]], flat, np.concatenate(([0], np.cumsum(sizes))), distinct)
            odd = np.flatnonzero(odd)
            if len(odd):
                ids = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in odd.tolist()],
                                                                       add_special_tokens=False)]
                at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, at[-1])
                self.store.add(distinct[new[odd]], flat, at, distinct)
            place, size = self.store.find(distinct)
        return gather(self.store.flat, place[which], size[which]), np.concatenate(([0], np.cumsum(size[which])))


def sentence_ends(words: W.Words) -> np.ndarray:
    """Whether a sentence ends with the word: it closes with . ! or ?, or the
    white space after it breaks the line."""
    breaks = np.concatenate(([0], np.cumsum(words.buf == 10)))
    after = np.empty(len(words.start), np.int64)
    if len(after):
        after[:-1] = words.start[1:]
        after[-1] = len(words.buf)
    last = words.buf[words.end - 1] if len(after) else np.zeros(0, np.uint8)
    return (last == 46) | (last == 33) | (last == 63) | (breaks[after] > breaks[words.end])


def best_cuts(at: np.ndarray, price: np.ndarray, size: int) -> list[int]:
    """Indices into ``at`` (ascending token positions, the first 0) of the
    cheapest cuts up to the last position; neighbours lie at most ``size``
    apart.  Ties go to the earlier start, so to the longer window."""
    n = len(at)
    ends, starts, power = [], [], 1
    while power <= size:
        found = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at >= power) & (at[found] == at - power))
        ends.append(hit)
        starts.append(found[hit])
        power *= 2
    order = np.argsort(np.concatenate(ends), kind="stable")
    ends = np.concatenate(ends)[order].tolist() + [n]
    starts = np.concatenate(starts)[order].tolist()
    position, cost = at.tolist(), price.tolist()
    best, back, key = [0] * n, [0] * n, [0] * n
    queue, head, exact = [0], 0, 0
    for j in range(1, n):
        here = position[j]
        while position[queue[head]] < here - size:
            head += 1
        i = queue[head]
        value = key[i] + size - here
        while ends[exact] == j:
            k = starts[exact]
            exact += 1
            if best[k] < value:
                value, i = best[k], k
        best[j] = value = value + cost[j]
        back[j] = i
        key[j] = value = value + here
        while len(queue) > head and key[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _pack(source, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = W.kept(("words", hash(source.value)), lambda: WordTokenizer(source.value))
        sequence = TaskContext.get().partitionId() << 33
        ids, at, price = [], [], []  # token chunks, cut positions and prices of the stretch
        docs, held = [], 0  # [doc_id, position of its first token, tokens before the stretch, all tokens]

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal ids, at, price, docs, held, sequence
            flat = np.concatenate(ids)
            position = np.concatenate((np.zeros(1, np.int64), *at))
            toll = np.concatenate((np.zeros(1, np.int64), *price))
            cuts = best_cuts(position, toll, size)
            if not last and len(cuts) > 1:
                cuts = cuts[:-1]
            ends = position[cuts]
            first = np.array([d[1] for d in docs], np.int64)
            borders = np.unique(np.concatenate((first[(first > 0) & (first < ends[-1])], ends, [0])))
            begin, stop = borders[:-1], borders[1:]
            doc = np.searchsorted(first, begin, "right") - 1
            window = np.searchsorted(ends, begin, "right")
            raw = flat.astype("<u4").tobytes()
            view = memoryview(raw)
            window_start = np.concatenate(([0], ends))[window]
            out = pa.RecordBatch.from_arrays([
                pa.array([docs[d][0] for d in doc.tolist()], pa.int64()),
                pa.array([b - docs[d][1] + docs[d][2] for b, d in zip(begin.tolist(), doc.tolist())], pa.int64()),
                pa.array(stop - begin),
                pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin.tolist(), stop.tolist())], pa.int64()),
                pa.array([docs[d][3] for d in doc.tolist()], pa.int64()),
                pa.array(window + sequence), pa.array(begin - window_start),
                pa.array([raw[4 * a:4 * b] if with_ids else None for a, b in zip(begin.tolist(), stop.tolist())],
                         pa.binary())],
                names=[c.split()[0] for c in _SCHEMA.split(", ")])
            sequence += len(cuts)
            cut = int(ends[-1])
            ids, held = [flat[cut:]], len(flat) - cut
            rest = position > cut
            at, price = [position[rest] - cut], [toll[rest]]
            if held:
                kept = int(np.searchsorted(first, cut, "right")) - 1
                docs = docs[kept:]
                for d in docs:
                    d[1] -= cut
                if docs[0][1] < 0:
                    docs[0][2] -= docs[0][1]
                    docs[0][1] = 0
            else:
                ids, at, price, docs = [], [], [], []
            return out

        for batch in batches:
            for piece in W.pieces(batch, size=W.TOKENIZER_PIECE_BYTES):
                words = W.Words(*W.flat(piece.column(1)))
                flat, place = tokenizer.encode(words)
                close = place[1:][sentence_ends(words)]
                bounds = place[words.first]  # of the documents, without end tokens
                many = np.diff(bounds) + 1
                # the end token goes after each document's ids
                flat = np.insert(flat.astype(np.uint32), bounds[1:], end_id)
                ends = np.cumsum(many)
                close = close + np.searchsorted(bounds[1:], close, "left")  # end tokens before it
                # one a cell of CELL tokens; the document's end follows right after its last token
                close = close[np.append(close[1:] // CELL != close[:-1] // CELL, True)] if len(close) else close
                close = np.setdiff1d(close, ends - 1)
                position = np.unique(np.concatenate((close, ends)))
                gaps = np.diff(np.concatenate(([0], position)))
                long = np.flatnonzero(gaps > min(LONG_SENTENCE, size))
                step = min(HARD_STEP, size)
                hard = [np.arange(position[i] - gaps[i] + step, position[i], step) for i in long.tolist()]
                hard = np.concatenate(hard) if hard else np.zeros(0, np.int64)
                hard = np.setdiff1d(hard, position)
                toll = np.full(len(position), SENTENCE_CUT)
                toll[np.isin(position, ends)] = 0
                position = np.concatenate((position, hard))
                order = np.argsort(position)
                toll = np.concatenate((toll, np.full(len(hard), HARD_CUT)))[order]
                docs.extend([d, held + int(e - m), 0, int(m)]
                            for d, e, m in zip(piece.column(0).to_pylist(), ends, many))
                ids.append(flat)
                at.append(position[order] + held)
                price.append(toll)
                held += len(flat)
                if held >= STRETCH:
                    yield flush(last=False)
        while held:
            yield flush(last=True)
    return W.tidied(run)


def pack(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = 2, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids (little-endian 32-bit; null if not
    ``with_ids``).

    A document is the ids of its text and then ``end_id``; a null or empty
    text is that one token.  Documents follow each other in the order in
    which the table is read; a sequence never spans two input partitions, so
    each of these ends with one or a few shorter sequences.  Null ids,
    repeated rows and equal ids are documents like any other.  An empty table
    gives an empty result; further columns are ignored.
    """
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path, "word_bpe_49k.json"))
    return id_and_text(docs, id_col, text_col).mapInArrow(_pack(source, size, end_id, with_ids), _SCHEMA)
