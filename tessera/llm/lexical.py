"""Ranked lexical search: Block-Max MaxScore over compressed posting lists.

**Index.** Each task turns its documents into shards of bounded size.  A
shard holds one posting list per term, in blocks of ``BLOCK`` postings: gaps
and term frequencies in one, two or four bytes each, beside each block its
first and last document and, for each frequency in it, the length of the
shortest document.  These pairs give a block's exact largest score whatever
the corpus statistics turn out to be, so one pass over the texts is enough and
nothing is shuffled.  Terms are told apart by 64-bit hashes.

**Search.** The lists of the queries' terms are joined to the queries (in
blocks of ``QUERIES``) and meet, shard by shard, in one task each.  There a
list's best block bounds its score.  Lists whose bounds together stay under
the tenth best score so far are non-essential: only documents of the other,
essential lists are candidates.  A candidate's blocks in the non-essential
lists bound what it can still gain, and candidates that cannot reach the heap
go before any of these blocks is decompressed.  The remaining lists are looked
up from the strongest to the weakest, with the bound tightened each time.
Documents are visited in windows, vectorised, so the threshold rises early.
The shards' heaps are merged in two levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import drop, id_and_text, stored

TOP = 10
#: postings of a block; terms from which on a shard is closed; queries searched together
BLOCK, SHARD_TERMS, QUERIES = 128, 1 << 20, 256
#: (shard, query block) groups searched by one task: they are small but take long, so no size counts here
GROUPS_A_TASK = 4
#: documents of the first window of a shard, each next one is twice as large
WINDOW = 512
#: heaps of so many groups of shards are merged first
GROUPS = 64
#: distinct query terms up to which they are broadcast (16 bytes each), beyond it they are shuffled
BROADCAST_TERMS = 1_000_000

_INDEX = "shard long, term long, df long, total long, heads binary, peaks binary, body binary"
_HEAD = 6  # per block: first and last document, postings, widths of gaps and frequencies, where its body and its peaks start


def _solid() -> np.ndarray:
    """Bytes that terms are made of: 0-9, A-Z, a-z and all beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _terms(column) -> W.Words:
    buf, offsets = W.flat(column)
    return W.Words(buf, offsets, _solid()[buf])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Write each value's low ``width`` bytes from byte ``at`` on."""
    for b in range(4):
        some = width > b
        out[at[some] + b] = (values[some] >> (8 * b)) & 255


def _binaries(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value per list, cut from a flat buffer at byte ``edges``."""
    raw = np.ascontiguousarray(flat).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def encode_shard(hashes: np.ndarray, doc: np.ndarray, lengths: np.ndarray):
    """Posting lists of a shard from the term hash and the document of each
    token (documents in order): terms, list lengths, and the binaries."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h))).astype(np.int64)
    h, d = h[at], d[at].astype(np.int64)
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(head)
    df = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, df)
    opens = np.flatnonzero(place % BLOCK == 0)  # first posting of each block
    block = np.cumsum(place % BLOCK == 0) - 1
    size = np.diff(np.append(opens, len(h)))
    gap = np.zeros(len(h), np.int64)
    gap[1:] = d[1:] - d[:-1]
    gap[opens] = 0
    gaps, freqs = _width(np.maximum.reduceat(gap, opens)), _width(np.maximum.reduceat(tf, opens))
    blocks = -(-df // BLOCK)
    of_list = np.repeat(np.arange(len(df)), blocks)
    body = _starts(size * (gaps + freqs))
    raw = np.zeros(body[-1], np.uint8)
    inside = np.arange(len(h)) - opens[block]
    _put(raw, body[block] + inside * gaps[block], gap, gaps[block])
    _put(raw, body[block] + size[block] * gaps[block] + inside * freqs[block], tf, freqs[block])
    # shortest document for each frequency of a block
    by = np.lexsort((lengths[d], tf, block))
    b, t = block[by], tf[by]
    best = np.ones(len(by), bool)
    best[1:] = (b[1:] != b[:-1]) | (t[1:] != t[:-1])
    peaks = np.stack((t[best], lengths[d[by]][best]), axis=1).astype("<u4")
    peak_at = _starts(np.bincount(b[best], minlength=len(opens)))
    list_block = _starts(blocks)
    base_body, base_peak = body[list_block[:-1]][of_list], peak_at[list_block[:-1]][of_list]
    heads = np.stack((d[opens], d[opens + size - 1], size, gaps * 8 + freqs, body[:-1] - base_body, peak_at[:-1] - base_peak),
                     axis=1).astype("<u4")
    return (h[first], df, _binaries(heads, list_block * _HEAD * 4), _binaries(peaks, peak_at[list_block] * 8),
            _binaries(raw, body[list_block]))


@W.tidied
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    W.release()
    names = [c.split()[0] for c in _INDEX.split(", ")]
    number = TaskContext.get().partitionId() << 32
    ids, hashes, docs, lengths = [], [], [], []

    def closed():
        n = np.concatenate(lengths)
        yield pa.RecordBatch.from_arrays([
            pa.array([number]), pa.nulls(1, pa.int64()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
            pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
            pa.array([n.astype("<i8").tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=names)
        h = np.concatenate(hashes)
        if len(h):
            terms, df, *binaries = encode_shard(h, np.concatenate(docs), n)
            for at in range(0, len(terms), 1 << 14):
                part = slice(at, at + (1 << 14))
                rows = len(terms[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, number)), pa.array(terms[part].view(np.int64)), pa.array(df[part].astype(np.int64)),
                    pa.nulls(rows, pa.int64()), *(x.slice(at, rows) for x in binaries)], names=names)

    held = tokens = 0
    for batch in batches:
        for piece in W.pieces(batch):
            words = _terms(piece.column(1))
            ids.append(piece.column(0).to_numpy())
            hashes.append(words.hashes())
            docs.append((words.doc + held).astype(np.int32))
            lengths.append(words.counts.astype(np.int64))
            held, tokens = held + words.n_docs, tokens + len(words.doc)
            if tokens >= SHARD_TERMS:
                yield from closed()
                ids, hashes, docs, lengths = [], [], [], []
                number, held, tokens = number + 1, 0, 0
    if held:
        yield from closed()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all documents that have an id: for each shard a row
    without a term (number of documents with terms, number of terms, ids,
    lengths) and a row per term (documents, block heads, peaks, blocks)."""
    rows = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    return stored(rows.mapInArrow(_index, _INDEX), "index")


@W.tidied
def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, key, term, number of times, of each query."""
    for batch in batches:
        for piece in W.pieces(batch):
            words = _terms(piece.column(2))
            pairs = np.rec.fromarrays([words.doc, words.hashes().view(np.int64)], names="row,term")
            found, times = np.unique(pairs, return_counts=True)
            row = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(row), piece.column(1).take(row),
                                              pa.array(np.ascontiguousarray(found["term"])), pa.array(times)],
                                             names=["item", "key", "term", "times"])


class PostingList:
    """One term's list in a shard; blocks are decompressed when first asked for."""

    def __init__(self, heads: bytes, peaks: bytes, body: bytes, weight: int, norms):
        head = np.frombuffer(heads, "<u4").reshape(-1, _HEAD).astype(np.int64)
        peak = np.frombuffer(peaks, "<u4").reshape(-1, 2).astype(np.int64)
        self.first, self.last, self.size, self.widths, self.at, start = head.T
        self.weight, self.body, self.norms = weight, body, norms
        self.block_best = weight * np.maximum.reduceat(impact(peak[:, 0], norms.of_length(peak[:, 1])), start)
        self.best = int(self.block_best.max())
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term gives each."""
        if i not in self.blocks:
            at, size = int(self.at[i]), int(self.size[i])
            gap, freq = divmod(int(self.widths[i]), 8)
            docs = self.first[i] + np.cumsum(np.frombuffer(self.body, f"<u{gap}", size, at).astype(np.int64))
            tf = np.frombuffer(self.body, f"<u{freq}", size, at + gap * size).astype(np.int64)
            self.blocks[i] = docs, self.weight * impact(tf, self.norms.of_doc[docs])
        return self.blocks[i]

    def where(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that may hold each document, and the most it gives there."""
        at = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        return at, np.where((self.first[at] <= docs) & (docs <= self.last[at]), self.block_best[at], 0)

    def exact(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the term gives each document (in order), of block ``at``."""
        out = np.zeros(len(docs), np.int64)
        for i in np.unique(at).tolist():
            lo, hi = np.searchsorted(at, [i, i + 1])
            held, gives = self.block(i)
            place = np.minimum(np.searchsorted(held, docs[lo:hi]), len(held) - 1)
            out[lo:hi] = np.where(held[place] == docs[lo:hi], gives[place], 0)
        return out


def impact(tf, norm):
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


class Norms:
    """The length part of a score: 25 + 75 n N div L."""

    def __init__(self, lengths: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.of_doc = self.of_length(lengths)

    def of_length(self, n):
        return 25 + 75 * n * self.n_docs // max(self.n_terms, 1)


def best_of_shard(lists: list[tuple[PostingList, int]], ids: np.ndarray, top: int = TOP, window: int = WINDOW):
    """Ids and scores of the ``top`` best documents of a shard, and how many
    blocks were decompressed for candidates of non-essential lists.  ``lists``
    holds the query's lists and how often it has the term."""
    lists = sorted(lists, key=lambda x: x[0].best * x[1])
    bound = _starts(np.array([x.best * times for x, times in lists], np.int64))  # of the first i lists together
    scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = opened = 0
    lo = 0
    while lo < len(ids):
        hi = min(lo + window, len(ids))
        # documents of these lists alone score less than the heap's last: they cannot enter, not even by a tie
        split = int(np.searchsorted(bound[1:], floor)) if floor else 0
        if split == len(lists):
            break
        got = np.zeros(hi - lo, np.int64)
        for x, times in lists[split:]:
            for i in range(*np.searchsorted(x.last, [lo, hi - 1]).tolist()):
                _gather(got, x.block(i), times, lo, hi)
            i = int(np.searchsorted(x.last, hi - 1))
            if i < len(x.last) and x.first[i] < hi:
                _gather(got, x.block(i), times, lo, hi)
        cand = np.flatnonzero(got) + lo
        have = got[cand - lo]
        keep = have + bound[split] >= floor
        cand, have = cand[keep], have[keep]
        if split and len(cand):
            places, most = zip(*(x.where(cand) for x, _ in lists[:split]))
            places, most = list(places), np.array([m * times for m, (_, times) in zip(most, lists)])
            left = most.sum(axis=0)
            for i in range(split - 1, -1, -1):
                keep = have + left >= floor
                if not keep.all():
                    cand, have, left, most = cand[keep], have[keep], left[keep], most[:, keep]
                    places = [p[keep] for p in places]
                    if not len(cand):
                        break
                may = np.flatnonzero(most[i])
                x, times = lists[i]
                opened += len(np.unique(places[i][may]))
                left = left - most[i]
                have = have.copy()
                have[may] += times * x.exact(cand[may], places[i][may])
        scores, docs = np.concatenate((scores, have)), np.concatenate((docs, cand))
        some = scores > 0
        scores, docs = scores[some], docs[some]
        order = np.lexsort((ids[docs], -scores))[:top]
        scores, docs = scores[order], docs[order]
        floor = int(scores[-1]) if len(scores) == top else 0
        lo, window = hi, window * 2
    return ids[docs], scores, opened


def _gather(got: np.ndarray, block: tuple[np.ndarray, np.ndarray], times: int, lo: int, hi: int) -> None:
    held, gives = block
    a, b = np.searchsorted(held, [lo, hi])
    got[held[a:b] - lo] += times * gives[a:b]


def _search(n_docs: int, n_terms: int, top: int):
    def run(table: pa.Table) -> pa.Table:
        lists, asks, ids, norms = [], {}, np.zeros(0, np.int64), None
        rows = {n: table.column(n) for n in ("term", "heads", "peaks", "body", "weight", "asks")}
        known = rows["term"].is_valid().to_numpy()
        for i in np.flatnonzero(~known).tolist():
            ids = np.frombuffer(rows["heads"][i].as_py(), "<i8")
            norms = Norms(np.frombuffer(rows["peaks"][i].as_py(), "<i8"), n_docs, n_terms)
        for i in np.flatnonzero(known).tolist():
            x = PostingList(*(rows[n][i].as_py() for n in ("heads", "peaks", "body", "weight")), norms)
            lists.append(x)
            for ask in rows["asks"][i].as_py():
                asks.setdefault((ask["item"], ask["key"]), []).append((x, ask["times"]))
        out = [[], [], [], []]
        for (item, key), own in asks.items():
            found, scores, _ = best_of_shard(own, ids, top)
            for column, values in zip(out, ([item] * len(found), [key] * len(found), found.tolist(), scores.tolist())):
                column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item", "key", "doc_id", "score"])
    return run


def search(index: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each query the ``top`` documents of
    the index with the highest scores above 0 (equal scores by smaller id).

    Terms are runs of ASCII letters and digits and anything beyond ASCII, A-Z
    lower-cased.  A query without terms, or whose terms no document has, gives
    no row, and so does one without an id.  Queries that repeat an id and its
    text count once; with other texts each is ranked by itself.
    """
    spark = index.sparkSession
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.xxhash64(F.col(text_col)).alias("key"),
                          F.col(text_col).cast("string").alias("text"))
    rows = rows.where("item IS NOT NULL").dropDuplicates(["item", "key"])
    asked = stored(rows.mapInArrow(_query_terms, "item long, key long, term long, times long"), "asked")
    shards = index.where("term IS NULL")
    whole = shards.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    parts = max(1, math.ceil(asked.select("item", "key").distinct().count() / QUERIES))
    wanted = asked.select("term").distinct()
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    hits = stored(index.where("term IS NOT NULL").join(wanted, "term").drop("total"), "hits")
    # the logarithm and its product are taken in doubles
    ratio = (F.lit(2.0) * whole["n"] + 2) / (F.lit(2.0) * F.col("d") + 1)
    weight = hits.groupBy("term").agg(F.sum("df").alias("d")).select(
        "term", F.floor(F.log(ratio) * 1000).cast("long").alias("weight"))
    # the queries of a block that have a term are at most QUERIES, give or take what hashing deals out
    block = F.expr(f"cast(pmod(xxhash64(item, key), {parts}) AS int)")
    asks = asked.groupBy("term", block.alias("part")).agg(F.collect_list(F.struct("item", "key", "times")).alias("asks"))
    lists = hits.join(asks.join(weight, "term"), "term").select(
        "shard", "part", "term", "weight", "asks", "heads", "peaks", "body")
    numbers = shards.where("df > 0").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("term"),
        F.lit(None).cast("long").alias("weight"), F.lit(None).cast(asks.schema["asks"].dataType).alias("asks"),
        "heads", "peaks", "body")
    tasks = max(1, math.ceil(parts * shards.count() / GROUPS_A_TASK))
    heaps = lists.union(numbers).repartitionByRange(tasks, "shard", "part").groupBy("shard", "part").applyInArrow(
        _search(whole["n"], whole["l"], top), "item long, key long, doc_id long, score long")
    best = [F.desc("score"), F.asc("doc_id")]
    group = F.expr(f"pmod(xxhash64(doc_id), {GROUPS})")
    near = heaps.withColumn("g", group).withColumn("rn", F.row_number().over(
        Window.partitionBy("item", "key", "g").orderBy(*best))).where(F.col("rn") <= top)
    rank = F.row_number().over(Window.partitionBy("item", "key").orderBy(*best))
    found = near.withColumn("rank", rank).where(F.col("rank") <= top).select(
        F.col("item").alias("item_id"), "rank", "doc_id", "score")
    found = stored(found, "found")
    drop(hits)
    drop(asked)
    return found


def ranked_documents(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                     query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The index of ``docs`` and the search of all ``queries`` in it.

    Documents without an id take no part; one without terms (null, empty,
    blank) is never found and does not count.  Rows that repeat an id are
    documents of their own.  An empty table on either side gives an empty
    result.  Further columns are ignored.
    """
    index = build_index(docs, id_col, text_col)
    found = search(index, queries, top, query_id, query_text)
    drop(index)
    return found
