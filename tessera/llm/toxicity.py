"""Toxic spans and document scores from a linear-chain conditional random field.

Words are tagged clean (0) or toxic (1).  Labels exist for documents only, so
the training tags are derived: in documents labelled toxic, a word is tagged
if one of its features (the word, its first 4, 5 or 6 letters, its last 5)
occurs among toxic documents so much more often than among clean ones that
chance does not explain it (copies of a document count once, by the words
around).  The field learns
weights of the features, of their neighbours' and of the tag transitions by
gradient ascent on the exact likelihood.  Forward-backward marginals give each word's
probability; they aggregate to a document score (a logistic function fitted
on the same sample) and to the offending offsets.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS``, texts of
at most ``SAMPLE_BYTES``) and runs in one task; scoring reads every text once
and shuffles nothing.  Language, source, id and label are no inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import id_and_text

SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 16_384
#: longest chain; a longer sentence is tagged in runs of so many words
CHAIN = 64
STEPS = 60
THRESHOLD = 0.3

_U = np.uint64


class Tokens:
    """Words (runs of letters), their chains (sentences) and feature hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.raw = buf
        low = buf.copy()
        accent = np.concatenate(([False], buf[:-1] == 0xC3)) if len(buf) else np.zeros(0, bool)
        low[accent & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32  # capital Latin letters with accents
        letters = ((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 128)
        self.words = w = W.Words(low, offsets, letters)
        stops = np.concatenate(([0], np.cumsum((buf == 46) | (buf == 33) | (buf == 63) | (buf == 10))))
        n = len(w.start)
        new = np.ones(n, bool)
        if n:
            new[1:] = (w.doc[1:] != w.doc[:-1]) | (stops[w.start[1:]] > stops[w.end[:-1]])
        heads = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        self.chain = np.cumsum(place % CHAIN == 0) - 1
        self.first = np.flatnonzero(place % CHAIN == 0)
        self.length = np.diff(np.append(self.first, n))
        self.n, self.n_docs, self.doc = n, w.n_docs, w.doc

    def features(self) -> Iterator[np.ndarray]:
        """A hash of each kind for every word; 0 where the word is too short."""
        w = self.words
        yield w.hashes()
        size = w.end - w.start
        for kind, k in ((1, 4), (2, 5), (3, 6)):
            h = w.hashes(True, w.start, np.minimum(w.start + k, w.end))
            yield np.where(size > k, W.mix(h + _U(kind)), _U(0))
        h = w.hashes(True, np.maximum(w.end - 5, w.start), w.end)
        yield np.where(size > 5, W.mix(h + _U(4)), _U(0))


class Sample:
    """Tokens of several pieces in a row; no flat buffer of all texts."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]]):
        docs, chains, lengths, kinds = [], [], [], []
        n_docs = n_chains = 0
        for buf, offsets in pieces:
            t = Tokens(buf, offsets)
            docs.append(t.words.doc + n_docs)
            chains.append(t.chain + n_chains)
            lengths.append(t.length)
            kinds.append(list(t.features()))
            n_docs += len(offsets) - 1
            n_chains += len(t.length)
        self.doc, self.chain, self.length = (np.concatenate(x) if x else np.zeros(0, np.int64)
                                             for x in (docs, chains, lengths))
        self.first = np.cumsum(self.length) - self.length
        self.n, self.n_docs = len(self.doc), n_docs
        self.kinds = [np.concatenate(x) for x in zip(*kinds)] if kinds else [np.zeros(0, np.uint64)]

    def features(self) -> Iterator[np.ndarray]:
        return iter(self.kinds)


def _known(hashes: np.ndarray, table: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words whose hash is in the sorted table, and the places there."""
    word = np.flatnonzero(near[(hashes >> _U(44)).astype(np.int64)])
    if not len(table) or not len(word):
        return word[:0], word[:0]
    at = np.minimum(np.searchsorted(table, hashes[word]), len(table) - 1)
    hit = table[at] == hashes[word]
    return word[hit], at[hit]


def _near(table: np.ndarray) -> np.ndarray:
    near = np.zeros(1 << 20, bool)
    near[(table >> _U(44)).astype(np.int64)] = True
    return near


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(score: np.ndarray, first: np.ndarray, length: np.ndarray,
                     trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 for every word, and the summed pair marginals.

    ``score`` is the log weight of tag 1 against tag 0 by word; chains are
    runs of words.  All chains advance together, the longest first.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n = len(score)
    f = np.zeros((n, 2))
    b = np.zeros((n, 2))
    longest = int(length[0]) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(longest + 1)]  # chains longer than t
    f[first, 1] = score[first]
    for t in range(1, longest):
        i = first[:live[t]] + t
        p = f[i - 1]
        f[i, 0] = _logsum(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0])
        f[i, 1] = _logsum(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1]) + score[i]
    for t in range(longest - 2, -1, -1):
        i = first[:live[t + 1]] + t
        q0, q1 = b[i + 1, 0], b[i + 1, 1] + score[i + 1]
        b[i, 0] = _logsum(q0 + trans[0, 0], q1 + trans[0, 1])
        b[i, 1] = _logsum(q0 + trans[1, 0], q1 + trans[1, 1])
    both = f + b
    total = _logsum(both[:, 0], both[:, 1])
    marginal = np.exp(both[:, 1] - total)
    inner = np.ones(n, bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    pairs = np.empty((2, 2))
    for x in (0, 1):
        for y in (0, 1):
            step = f[i - 1, x] + trans[x, y] + (score[i] if y else 0.0) + b[i, y] - total[i]
            pairs[x, y] = np.exp(step).sum()
    return marginal, pairs


def _document_inputs(marginal: np.ndarray, doc: np.ndarray, n: int, floor: float) -> np.ndarray:
    """Highest marginal and log of the summed likely ones, by document."""
    top = np.full(n, floor)
    np.maximum.at(top, doc, marginal)
    sure = marginal >= 0.5
    return np.stack([top, np.log1p(np.bincount(doc[sure], weights=marginal[sure], minlength=n))], axis=1)


class Field:
    """The fitted field."""

    def __init__(self, table: np.ndarray, weight: np.ndarray, beside: np.ndarray, bias: float, trans: np.ndarray,
                 link: np.ndarray):
        self.table, self.weight, self.beside, self.bias, self.trans, self.link = (
            table, weight, beside, bias, trans, link)

    def scores(self, tokens: Tokens | Sample) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of tag 1 by word, and which words or neighbours are known."""
        n = tokens.n
        score = np.full(n, self.bias)
        known = np.zeros(n, bool)
        near = self.__dict__.setdefault("near", _near(self.table))
        for hashes in tokens.features():
            word, at = _known(hashes, self.table, near)
            np.add.at(score, word, self.weight[at])
            known[word] = True
            for step in (-1, 1):
                to = word + step
                ok = (to >= 0) & (to < n)
                ok[ok] = tokens.chain[to[ok]] == tokens.chain[word[ok]]
                np.add.at(score, to[ok], self.beside[at[ok]])
        return score, known

    def marginals(self, tokens: Tokens | Sample) -> tuple[np.ndarray, np.ndarray]:
        """Words of chains that hold a known word, and their marginals.  All
        words of the other chains are alike and get the floor."""
        score, known = self.scores(tokens)
        some = np.zeros(len(tokens.first), bool)
        some[tokens.chain[known]] = True
        word = np.flatnonzero(some[tokens.chain]) if len(score) else np.zeros(0, np.int64)
        length = tokens.length[some]
        m, _ = forward_backward(score[word], np.cumsum(length) - length, length, self.trans)
        return word, m

    @property
    def floor(self) -> float:
        return float(forward_backward(np.full(3, self.bias), np.array([0]), np.array([3]), self.trans)[0].max())

    def documents(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of every document; the words with a marginal, and it."""
        word, m = self.marginals(tokens)
        x = _document_inputs(m, tokens.doc[word], tokens.n_docs, self.floor)
        return 1 / (1 + np.exp(-(x @ self.link[:2] + self.link[2]))), word, m


def fit(tokens: Sample, toxic: np.ndarray) -> Field:
    """Train on whole texts and their labels (0 or 1)."""
    doc, n_docs = tokens.doc, len(toxic)
    bad, good = max(int(toxic.sum()), 1), max(int(n_docs - toxic.sum()), 1)
    share = bad / (bad + good)
    whole = next(tokens.features())
    around = np.concatenate((whole[:1], whole[:-1])) ^ W.mix(np.concatenate((whole[1:], whole[-1:])))
    del whole
    tables, tested = [], []
    for hashes in tokens.features():
        there = hashes != 0
        d, h = W.distinct_by_doc(doc[there], hashes[there])
        names, at = np.unique(h, return_inverse=True)
        a = np.bincount(at, weights=toxic[d], minlength=len(names))
        b = np.bincount(at, minlength=len(names)) - a
        # copies of a document show a word between the same neighbours
        settings = []
        for kind in (1, 0):
            own = there & (toxic[doc] == kind)
            f, _ = W.distinct_by_doc(np.searchsorted(names, hashes[own]), around[own])
            settings.append(np.bincount(f, minlength=len(names)))
        a, b = np.minimum(a, settings[0]), np.maximum(b, np.minimum(settings[1], b + 1))
        rate = np.clip(a / np.maximum(a + b, 1), 1e-9, 1 - 1e-9)
        gain = a * np.log(rate / share) + b * np.log((1 - rate) / (1 - share))
        tables.append((names, np.where(rate > share, gain, 0)))
        tested.append(np.count_nonzero(a >= 2))
    # evidence beyond what the best of so many features shows by chance
    least = np.log(max(sum(tested), 2)) + 2
    table = np.sort(np.concatenate([names[gain >= least] for names, gain in tables]))
    near = _near(table)
    n = tokens.n
    del around
    found = [_known(h, table, near) for h in tokens.features()]
    marked = np.zeros(n, bool)
    for word, _ in found:
        marked[word] = True
    tag = ((toxic[doc] == 1) & marked).astype(np.int64)
    # chains with a known word, and as many of the others
    some = np.zeros(len(tokens.first), bool)
    some[tokens.chain[marked]] = True
    rest = np.flatnonzero(~some)
    some[rest[::max(1, len(rest) // max(1, 2 * int(some.sum())))]] = True
    word = np.flatnonzero(some[tokens.chain]) if n else np.zeros(0, np.int64)
    place = np.full(n, -1)
    place[word] = np.arange(len(word))
    length = tokens.length[some]
    first = np.cumsum(length) - length
    chain, tag = tokens.chain[word], tag[word]
    links = []  # (word, feature, own or neighbour)
    for w, at in found:
        i = place[w]
        at = at[i >= 0]
        i = i[i >= 0]
        links.append((i, at))
        for step in (-1, 1):
            to = i + step
            ok = (to >= 0) & (to < len(word))
            ok[ok] = chain[to[ok]] == chain[i[ok]]
            links.append((to[ok], at[ok] + len(table)))
    row = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
    col = np.concatenate([x for _, x in links]) if links else np.zeros(0, np.int64)
    theta = np.zeros(2 * len(table) + 5)
    theta[-5] = -2.0
    inner = np.ones(len(word), bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    seen = np.bincount(2 * tag[i - 1] + tag[i], minlength=4).reshape(2, 2)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1) if len(word) else ():
        score = theta[-5] + np.bincount(row, weights=theta[col], minlength=len(word))
        m, pairs = forward_backward(score, first, length, theta[-4:].reshape(2, 2))
        slope = np.zeros_like(theta)
        slope[:-5] = np.bincount(col, weights=(tag - m)[row], minlength=len(theta) - 5)
        slope[-5] = (tag - m).sum()
        slope[-4:] = (seen - pairs).ravel()
        slope -= 0.05 * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        theta = theta + 0.3 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    field = Field(table, theta[:len(table)], theta[len(table):-5], float(theta[-5]), theta[-4:].reshape(2, 2),
                  np.zeros(3))
    # the logistic step from marginals to labels
    word, m = field.marginals(tokens)
    x = np.column_stack([_document_inputs(m, doc[word], n_docs, field.floor), np.ones(n_docs)])
    link = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ link))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        link += np.linalg.solve(curve, x.T @ (toxic - p) - 0.1 * link)
    field.link = link
    return field


@W.tidied
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.int32())]))
    if not table.num_rows:
        return
    W.release()
    toxic = table.column(1).to_numpy().astype(np.float64)
    batch = table.combine_chunks().to_batches()[0]
    model = fit(Sample([W.flat(piece.column(0)) for piece in W.pieces(batch)]), toxic)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(
        (model.table, model.weight, model.beside, model.bias, model.trans, model.link))], pa.binary())],
        names=["model"])


def train(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most SAMPLE_ROWS labelled rows (a third of them toxic, if
    there are so many), picked by a hash of the id.

    ``learn`` is a condition on ``doc_id`` of the rows that may be used.
    Rows without label, id or text are left out.  With no rows at all, the
    model scores every document alike, below THRESHOLD.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if learn is not None:
        marked = marked.where(learn)
    texts = id_and_text(docs, id_col, text_col).where(
        F.octet_length("text") <= SAMPLE_BYTES)

    def pick(kind: int, rows: int) -> DataFrame:
        return marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = pick(1, SAMPLE_ROWS // 3).union(pick(0, SAMPLE_ROWS - SAMPLE_ROWS // 3))
    sample = (texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE_ROWS)
              .select("text", F.col("toxic").cast("int")))
    rows = sample.coalesce(1).mapInArrow(_train, "model binary").collect()
    if not rows:
        return Field(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), -2.0, np.zeros((2, 2)), np.array([0, 0, -2.0]))
    return Field(*pickle.loads(rows[0].model))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        field = model.value
        for batch in batches:
            for piece in W.pieces(batch):
                buf, offsets = W.flat(piece.column(1))
                tokens = Tokens(buf, offsets)
                score, word, m = field.documents(tokens)
                hit = m >= 0.5
                word, m = word[hit], m[hit]
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                doc = tokens.words.doc[word]
                base = chars[offsets[doc]]
                begin, end = chars[tokens.words.start[word]] - base, chars[tokens.words.end[word]] - base
                at = np.searchsorted(doc, np.arange(len(offsets)))
                spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(m, pa.float64())],
                    names=["start", "end", "p"]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score, pa.float64()), spans],
                                                 names=["doc_id", "score", "spans"])
    return W.tidied(run)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and spans (code-point start, end, p of each word
    more likely toxic than not) of every text.

    Null, empty and wordless texts get the score of a text without marks and
    no spans.  Null ids and repeated rows stay; an empty table gives an empty
    result; further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _score(held), "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def _clean(model, text: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        field = model.value
        for batch in batches:
            name = batch.schema.names[text]
            for piece in W.pieces(batch, name):
                scores, _, _ = field.documents(Tokens(*W.flat(piece.column(text))))
                yield piece.filter(pa.array(scores < threshold))
    return W.tidied(run)


def clean(docs: DataFrame, model: Field, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below the
    threshold; edge cases as in ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(held, docs.columns.index(text_col), threshold), docs.schema)


def held_out():
    """Rows that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2
