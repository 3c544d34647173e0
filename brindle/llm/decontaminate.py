"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task takes its documents in shards.  A shard's suffix array holds the suffixes that
can match a window at all: those within runs of words that the benchmark has, as long
as a window or begun like a shorter item.  Prefix doubling over word ranks orders them.
Every suffix of every benchmark item is then binary-searched (all of them at once, a
word more at each step) for its longest verbatim match, an interval of shard suffixes.
Intervals reached with `window` words, or with a whole item that is shorter, give the
places hit; equal windows of many items are one class with one interval, and only a
document's list of classes is turned into items, so that a prompt that all items share
costs no pairs of items and places.  Documents lie whole in a shard, so nothing is
shuffled.  The benchmark is measured first: one of at most `block_words` words goes to
all tasks at once; a larger one is taken in such blocks, each with a pass over the
documents, whose hits are joined by document.

Defined results: null and wordless texts have no words, are never hit and, as items,
hit nothing; equal texts of several items each count; repeated documents are each
judged; an item whose item_id is null hits like any other, but is not named in items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import PUNCT, find_words, hash_spans, in_pieces, texts_of, window_hashes

_HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids in the order of the `depth` or more values from there on (beyond the end counts as least)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        key = rank * np.int64(n + 1)
        key[: max(0, n - k)] += rank[k:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, key[1:] != key[:-1]])
        k *= 2
        if k >= depth or rank[order[-1]] == n:
            return order


def search(seq: np.ndarray, order: np.ndarray, test: np.ndarray, upto: np.ndarray, mark: np.ndarray):
    """Binary search of every suffix test[i:upto[i]] in the suffix array `order` of seq.

    Two triples (length, low, high) of arrays: of its prefix of mark[i] words (length 0:
    none there), and of its longest match; order[low:high] are the places that match."""
    n = len(order)
    alive = np.arange(len(test))
    low, high, length = np.zeros(len(test), np.int64), np.full(len(test), n, np.int64), np.zeros(len(test), np.int64)
    at_mark = [np.zeros(len(test), np.int64) for _ in range(3)]
    padded = np.r_[seq, 0]
    depth = 0
    while len(alive):
        want = test[alive + depth]
        bounds = []
        for right in (False, True):
            a, b = low[alive], high[alive]
            while (go := a < b).any():
                mid = (a + b) >> 1
                value = padded[np.minimum(order[np.minimum(mid, n - 1)] + depth, len(seq))]
                less = (value <= want) if right else (value < want)
                a, b = np.where(go & less, mid + 1, a), np.where(go & ~less, mid, b)
            bounds.append(a)
        ok = bounds[0] < bounds[1]
        alive = alive[ok]
        depth += 1
        low[alive], high[alive], length[alive] = bounds[0][ok], bounds[1][ok], depth
        here = alive[mark[alive] == depth]
        for x, y in zip(at_mark, (length, low, high), strict=True):
            x[here] = y[here]
        alive = alive[alive + depth < upto[alive]]
    return at_mark, (length, low, high)


class Benchmark:
    """Items as one sequence of word ids (2 and on), and the windows that begin in it."""

    def __init__(self, items: list[tuple], window: int):
        t = texts_of(pa.array([x for _, x in items], pa.string())).lower()
        w = find_words(t, PUNCT)
        hashes = hash_spans(t.buf, w.start, w.end)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.words, self.upto, item = ids.astype(np.int64) + 2, np.repeat(w.first[1:], np.diff(w.first)), w.text
        self.window, self.longest = window, int(np.diff(w.first).max(initial=0))
        n = np.repeat(np.diff(w.first), np.diff(w.first))
        whole = (n < window) & (w.place == 0)
        self.mark = np.where((n >= window) & (w.place <= n - window), window, np.where(whole, n, 0))
        self.need = np.full(len(self.vocabulary) + 2, window)  # words that a suffix that begins so must have
        np.minimum.at(self.need, self.words[whole], n[whole])
        # classes of equal windows, and the names (by rank) of the items of each
        key = np.zeros(len(hashes), np.uint64)
        for size in np.unique(self.mark[self.mark > 0]).tolist():
            at = np.flatnonzero(self.mark == size)
            key[at] = window_hashes(hashes, size, size)[at]
        begins = np.flatnonzero(self.mark)
        self.of = np.full(len(hashes), -1)
        self.of[begins] = np.unique(key[begins], return_inverse=True)[1]
        known = sorted({str(k) for k, _ in items if k is not None})
        self.names = pa.array(known, pa.string())
        rank = {k: i for i, k in enumerate(known)}
        ranks = np.array([-1 if k is None else rank[str(k)] for k, _ in items], np.int64)[item[begins]] if len(begins) else begins
        pairs = np.unique(np.stack([self.of[begins], ranks]), axis=1) if len(begins) else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[1] >= 0]
        self.rank, self.rank_at = pairs[1], np.searchsorted(pairs[0], np.arange(int(self.of.max(initial=-1)) + 2))
        self.sets: dict[bytes, np.ndarray] = {}

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids; 1 for words that no item has."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)

    def ranks_of(self, classes: np.ndarray) -> np.ndarray:
        """The ranks of the names of all items that have one of these windows; documents often hold the same ones."""
        key = classes.tobytes()
        if key not in self.sets:
            if len(self.sets) >= 1000:
                self.sets.clear()
            self.sets[key] = np.unique(np.concatenate([self.rank[self.rank_at[c] : self.rank_at[c + 1]] for c in classes.tolist()]))
        return self.sets[key]


def _spread(order, low, high):
    """All places of these intervals, and the interval of each."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return order[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)], which


def _deepest(order, low, high, length) -> np.ndarray:
    """For each place of a suffix array, the greatest length of the intervals it is in."""
    out = np.zeros(len(order), np.int64)
    if len(low):
        low, high, length = np.unique(np.stack([low, high, length]), axis=1)
    wide = high - low > 256
    for a, b, n in zip(low[wide].tolist(), high[wide].tolist(), length[wide].tolist(), strict=True):
        np.maximum(out[a:b], n, out=out[a:b])
    place, which = _spread(np.arange(len(order)), low[~wide], high[~wide])
    np.maximum.at(out, place, length[~wide][which])
    return out


def shard_hits(bench: Benchmark, hashes: np.ndarray, first: np.ndarray):
    """Of a shard's words: (word place, length, class) of each window found, and (word place, length) of each longest match that holds one."""
    none = [np.zeros(0, np.int64)] * 3
    n = len(hashes)
    ids = bench.ids_of(hashes)
    bound = np.zeros(n + 1, bool)  # a run ends before these words
    bound[first] = True
    bound[:-1] |= ids == 1
    bound[1:] |= np.r_[ids == 1]
    edge = np.flatnonzero(bound)
    run = np.searchsorted(edge, np.arange(n), "right")  # of each word, its run; run k ends at edge[k]
    begins = (ids > 1) & (edge[run] - np.arange(n) >= bench.need[ids]) if n else np.zeros(0, bool)
    if not begins.any():
        return none, none[:2]
    wanted = np.zeros(len(edge) + 1, bool)
    wanted[run[begins]] = True
    where = np.flatnonzero(wanted[run] & (ids > 1))
    apart = np.flatnonzero(np.diff(run[where])) + 1
    seq, home = np.insert(ids[where], apart, 1), np.insert(where, apart, -1)
    order = suffix_order(seq, bench.longest + 1)
    (got, low, high), (length, wide_low, wide_high) = search(seq, order, bench.words, bench.upto, bench.mark)
    some = np.flatnonzero(got)
    some = some[np.unique(bench.of[some], return_index=True)[1]]  # equal windows have one interval
    place, which = _spread(order, low[some], high[some])
    far = np.flatnonzero((length >= bench.window) | (got > 0))
    deep = _deepest(order, wide_low[far], wide_high[far], length[far])
    held = np.flatnonzero(deep)
    return (home[place], got[some][which], bench.of[some][which]), (home[order[held]], deep[held])


def _blocks(bench: DataFrame, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about block_words words at most (a longer item alone may be more)."""
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text") / 4)).first()[0] or 0  # at least as many as there are words of 3 letters
    n = max(1, math.ceil(size / block_words))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


def _held(rows: DataFrame, window: int):
    """A function that gives a part of the benchmark in a task, made once a worker."""
    sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])
    made = []

    def held() -> Benchmark:
        if not made:
            made.append(Benchmark(sent.value, window))
        return made[0]

    return held


def _judge(table: pa.Table, bench: Benchmark, named: bool = True) -> dict[str, list]:
    """For each row: n_words, n_hit, items (if named), longest and spans."""
    t = texts_of(table.column("text")).lower()
    w = find_words(t, PUNCT)
    hashes, text = hash_spans(t.buf, w.start, w.end), w.text
    (place, length, found), (far, far_length) = shard_hits(bench, hashes, w.first)
    delta = np.bincount(place, minlength=len(w) + 1) - np.bincount(place + length, minlength=len(w) + 1)
    hit = np.cumsum(delta)[:-1] > 0
    out = {"n_words": np.diff(w.first), "n_hit": np.diff(np.r_[0, np.cumsum(hit)][w.first])}
    if not named:
        return out
    longest = np.zeros(len(t), np.int64)
    np.maximum.at(longest, text[far], far_length)
    size = int(found.max(initial=0)) + 1
    pairs = np.unique(text[place] * size + found)
    edge = np.searchsorted(pairs, np.arange(len(t) + 1) * size)
    ranks = [bench.ranks_of(pairs[a:b] % size) if b > a else pairs[:0] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    at = np.r_[0, np.cumsum([len(r) for r in ranks])]
    spans = [[]] * len(t)
    for d in np.flatnonzero(out["n_hit"]).tolist():
        spans[d] = np.flatnonzero(np.diff(np.r_[0, hit[w.first[d] : w.first[d + 1]].view(np.int8), 0])).reshape(-1, 2).tolist()
    return out | {"items": pa.ListArray.from_arrays(pa.array(at, pa.int32()), bench.names.take(pa.array(np.concatenate(ranks)))), "longest": longest, "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}


def _hits(docs: DataFrame, rows: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """_HITS and text_key of docs (doc_id, text, text_key) by a part of the benchmark."""
    held = _held(rows, window)

    def run(batches):
        for table in in_pieces(batches, at_most=shard_bytes):
            out = _judge(table, held())
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *(x if isinstance(x := out[f.name], pa.Array) else pa.array(x, pa.int64()) for f in _HITS.fields[1:]), table.column("text_key").combine_chunks()], names=[*_HITS.names, "text_key"])

    return docs.mapInArrow(run, T.StructType([*_HITS, T.StructField("text_key", T.LongType())]))


def _merged(batches):
    """Rows with what several parts found: lists of item lists and of span lists."""
    for b in batches:
        items, spans, hits = [], [], []
        for names, found in zip(b.column("items").to_pylist(), b.column("spans").to_pylist(), strict=True):
            items.append(sorted({x for some in names or () for x in some}))
            over: list[list[int]] = []
            for low, high in sorted(x for some in found or () for x in some):
                if over and low <= over[-1][1]:
                    over[-1][1] = max(over[-1][1], high)
                else:
                    over.append([low, high])
            spans.append(over)
            hits.append(sum(y - x for x, y in over))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), b.column("longest"), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=_HITS.names)


def find_hits(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = 10, shard_bytes: int = 16 << 20, block_words: int = 1_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (ids as sorted strings), longest (words of the longest match that holds a window) and spans of words hit."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    found = [_hits(docs, rows, window, shard_bytes) for rows in _blocks(bench, block_words)]
    if len(found) == 1:
        return found[0].select(*_HITS.names)
    hits = found[0].where("n_hit > 0")
    for x in found[1:]:
        hits = hits.union(x.where("n_hit > 0"))
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("nameless"), "text_key"]
    hits = hits.select(*key, "items", "longest", "spans").groupBy("k", "nameless", "text_key").agg(F.collect_set("items").alias("items"), F.max("longest").alias("longest"), F.collect_set("spans").alias("spans"))
    rows = found[0].select("doc_id", "n_words", *key).join(hits, ["k", "nameless", "text_key"], "left")
    return rows.select("doc_id", "n_words", "items", F.coalesce("longest", F.lit(0)).alias("longest"), "spans").mapInArrow(_merged, _HITS)


def remove_affected(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = 10, shard_bytes: int = 16 << 20, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    for rows in _blocks(bench, block_words):
        held = _held(rows, window)

        def run(batches, held=held):
            for table in in_pieces(batches, at_most=shard_bytes):
                yield from table.filter(pa.array(_judge(table, held(), named=False)["n_hit"] == 0)).to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
