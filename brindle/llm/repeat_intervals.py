"""Maximal repeats of bytes, found in interval trees of enhanced suffix arrays.

Of each run of window starts that pick the same gram (the least hash of the GRAM-byte
strings in a window, the first of several), one *anchor* stands in the text: any two equal
windows pick equal grams at equal offsets, so anchors with equal grams meet in one shard
and no window is missed.  An anchor's *context* is the text that its windows cover.

In a shard the contexts of a gram are the suffixes (from the anchor on) of an enhanced
suffix array: sorted, with the lengths of the common prefixes of neighbours.  A stack
scan of those gives the interval tree; the members of each interval are put in the order
of their left contexts, whose common lengths tell how far occurrences go on to the left
before they differ (left-extension diversity).  Interval and left length together are a
maximal repeat with all its occurrences; those of at least `window` bytes count.  Equal
contexts are one leaf with a count, and need no text where they meet no other context.

Grams of more than CONTEXTS different contexts (the ends of a passage that very many
documents share) are dealt out anew by their whole windows, so that no shard grows with
the number of copies; equal windows, equal anchors with equal contexts, are summed up
within some megabytes of text before they are shuffled.

Defined results: a null text counts as empty; a text shorter than the window loses
nothing; repeated rows repeat each other's text and lose it all; a null doc_id is a
document as others are.  Matches do not cross rows.  The operators read doc_id and text
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import in_pieces, mix, texts_of
from .scratch import Scratch

CONTEXTS = 2048
_CHUNK = 1 << 20  # window starts that are looked at together
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = int(np.iinfo(np.int64).max)

_ANCHORS = "key long, ctx long, rank long, tag long, pos int, left int, right int, n int"
_CONTEXTS = "key long, gram long, ctx long, rank long, tag long, pos int, left int, right int, n int, body binary"
_SPANS = "rank long, tag long, start int, end int"
_GROUPS = "key long, node long, length int, gram long, ctx long, before int"
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base & ((1 << 64) - 1), np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


class Spans:
    """Hashes of any spans of 8 bytes or more of a buffer: sums of its mixed 8-byte blocks, each times a power of its place."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = _power_tables(n + 1)
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        x = mix(np.ndarray(n, "<u8", padded, strides=(1,)).copy())
        x *= up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size - 7] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        """Those of every span of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size - 7 : size - 7 + n] - self.sums[:n]) * self.down[:n])


def _sliding_least(v: np.ndarray, size: int) -> np.ndarray:
    n = len(v)
    whole = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = v
    rows = whole.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1 : n])


def gram_of(window: int) -> int:
    """Bytes of a gram: long enough to be rare, short enough for few anchors."""
    return max(8, 2 * window // 5)


def _in_chunk(buf: np.ndarray, offset: np.ndarray, window: int):
    """Of the anchors of a buffer: the place, bytes before and after it, hashes of the gram and of the context."""
    gram = gram_of(window)
    n = len(buf)
    hashes = Spans(buf)
    g = hashes.all(gram)
    least = _sliding_least((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), window - gram + 1)
    crosses = np.zeros(n + 1, np.int32)
    ends = offset[1:-1]
    np.add.at(crosses, np.maximum(ends - window + 1, 0), 1)
    np.add.at(crosses, ends, -1)
    at = np.flatnonzero(np.cumsum(crosses[: len(least)]) == 0)
    pick = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
    last = np.r_[first[1:] - 1, len(at) - 1] if len(at) else at
    pos, low, high = pick[first], at[first], at[last]
    left, right = pos - low, high + window - pos
    ctx = mix(hashes.of(low, left + right) ^ mix((left * (1 << 31) + right).astype(np.uint64)))
    return pos, left, right, g[pos], ctx


def anchors_of(t, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of texts (text, pos in its text, left, right, key, ctx), chunk by chunk."""
    n = len(t.buf)
    for base in range(0, max(n - window + 1, 0), _CHUNK):
        end = min(base + _CHUNK + window - 1, n)
        inner = t.offset[(t.offset > base) & (t.offset < end)]
        pos, left, right, key, ctx = _in_chunk(t.buf[base:end], np.r_[0, inner - base, end - base], window)
        text = np.searchsorted(t.offset, pos + base, "right") - 1
        yield text, pos + base - t.offset[text], left, right, key, ctx


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of spans of each owner."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    wide = np.int64(1) << 40
    lift = np.cumsum(np.r_[0, owner[1:] != owner[:-1]]) * wide
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.r_[True, start[1:] + lift[1:] > reach[:-1]])
    return owner[new], start[new], (reach - lift)[np.r_[new[1:] - 1, len(owner) - 1]]


def _collapsed(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal hashes: how many there are (at the first one, else 0), and whether there are several."""
    order = np.argsort(same, kind="stable")
    new = np.r_[True, same[order][1:] != same[order][:-1]] if len(same) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(same)])
    n, several = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    n[order[first]] = size
    several[order] = np.repeat(size > 1, size)
    return n, several


def _anchors(window: int, piece: int, every: bool):
    """Anchors of each document; of equal contexts in a piece of text the first alone, with their number, and what all of them cover as spans (rows of n 0)."""

    def run(batches):
        for table in in_pieces(batches, at_most=piece):
            parts = list(anchors_of(texts_of(table.column("text")), window))
            if not parts:
                continue
            text, pos, left, right, key, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(text):
                continue
            rank, tag = table.column("rank").to_numpy(), table.column("tag").to_numpy()
            n = np.ones(len(key), np.int64)
            if not every:
                n, several = _collapsed(key ^ mix(ctx))
                owner, start, end = merged(text[several], (pos - left)[several], (pos + right)[several])
                if len(owner):
                    zero = np.zeros(len(owner), np.int32)
                    yield _batch(_ANCHORS, tag[owner], zero.astype(np.int64), rank[owner], tag[owner], start, zero, end - start, zero)
            rows = np.flatnonzero(n)
            yield _batch(_ANCHORS, key[rows].view(np.int64), ctx[rows].view(np.int64), rank[text[rows]], tag[text[rows]], pos[rows], left[rows], right[rows], n[rows])

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, list) else np.asarray(c).astype("i8" if k == "long" else "i4"), _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _contexts(window: int, every: bool):
    """The texts of wanted contexts; windows one by one where a gram has too many contexts."""

    def run(batches):
        for table in in_pieces(batches):
            rank, tag = table.column("rank").to_numpy(), table.column("tag").to_numpy()
            lists = table.column("wanted").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            t = texts_of(table.column("text"))
            raw = t.buf.tobytes()
            offset = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(offset))
            key, ctx, pos, left, right, n, hot = (lists.values.field(c).to_numpy(zero_copy_only=False)[offset[0] : offset[-1]] for c in ("key", "ctx", "pos", "left", "right", "n", "hot"))
            low = t.offset[row] + pos
            few = np.flatnonzero(~hot)
            for cut in range(0, len(few), 4096):
                i = few[cut : cut + 4096]
                bodies = [raw[a:b] for a, b in zip((low[i] - left[i]).tolist(), (low[i] + right[i]).tolist(), strict=True)]
                yield _batch(_CONTEXTS, key[i], key[i], ctx[i], rank[row[i]], tag[row[i]], pos[i], left[i], right[i], n[i], bodies)
            many = np.flatnonzero(hot)
            if not len(many):
                continue
            hashes = [Spans(t.buf[a:b]).all(window) for a, b in zip((low[many] - left[many]).tolist(), (low[many] + right[many]).tolist(), strict=True)]
            size = np.array([len(x) for x in hashes])
            i, same = np.repeat(many, size), np.concatenate(hashes)
            before = left[i] - (np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size))  # of the window, from the anchor
            count = n[i].astype(np.int64)
            if not every:
                times, several = _collapsed(same)
                several |= count > 1
                owner, start, end = merged(row[i][several], (pos[i] - before)[several], (pos[i] - before)[several] + window)
                zero = np.zeros(len(owner), np.int64)
                yield _batch(_CONTEXTS, tag[owner], zero, zero, rank[owner], tag[owner], start, zero, end - start, zero, [None] * len(owner))
                count = np.where(times > 0, np.maximum(times, count), 0)
            some = np.flatnonzero(count)
            i, before = i[some], before[some]
            yield _batch(_CONTEXTS, same[some].view(np.int64), key[i], ctx[i], rank[row[i]], tag[row[i]], pos[i], before, window - before, count[some], [None] * len(i))

    return run


def _by_key(batches) -> Iterator[pa.Table]:
    """The rows of some keys at a time, of rows sorted by key; each key's rows are whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if held and held[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class _RangeLeast:
    """Least values of any ranges of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            below, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of x[low:high], not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            i = level == k
            x = self.levels[k]
            out[i] = np.minimum(x[low[i]], x[high[i] - (1 << k)])
        return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _sorted_with_common(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of some suffixes, and what each has in common with the one before it (the first: -1)."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    common = [-1] + [_common(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False)]
    return np.array(order), np.array(common, np.int64)


def intervals(common: np.ndarray, at_least: int) -> Iterator[tuple[int, int, int]]:
    """The intervals (length, from, to) of two members or more of the common-prefix tree, in one stack scan."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common[1:].tolist(), -1], 1):
        low = i - 1
        while stack and stack[-1][0] > value:
            length, low = stack.pop()
            if length >= at_least:
                yield length, low, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, low))


class Tree:
    """The interval tree of some contexts of one gram, with their left contexts in order."""

    def __init__(self, bodies: list[bytes], left: list[int]):
        self.order, self.common = _sorted_with_common([b[k:] for b, k in zip(bodies, left, strict=True)])
        by_left, shared = _sorted_with_common([b[:k][::-1] for b, k in zip(bodies, left, strict=True)])
        rank = np.empty(len(bodies), np.int64)
        rank[by_left] = np.arange(len(bodies))
        self.left_rank, self.by_left = rank[self.order], by_left
        self.shared = _RangeLeast(shared)
        self.most_left = max(left)

    def nodes(self, window: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Of each interval that can hold repeats: its length and range, its members by left context (ranks), and what each shares to the left with the one before it."""
        for length, low, high in intervals(self.common, window - self.most_left):
            ranks = np.sort(self.left_rank[low:high])
            yield length, low, high, ranks, self.shared.of(ranks[:-1] + 1, ranks[1:] + 1)

    def reach(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """How far repeats of at least `window` bytes reach from each context's anchor to the left (-1: no repeat) and to the right."""
        before, after = np.full(len(self.order), -1, np.int64), np.full(len(self.order), -1, np.int64)
        for length, _, _, ranks, shared in self.nodes(window):
            most = np.maximum(np.r_[-1, shared], np.r_[shared, -1])
            hit = most + length >= window
            member, most = self.by_left[ranks[hit]], most[hit]
            before[member] = np.maximum(before[member], most)
            after[member] = np.maximum(after[member], length)
        return before, after

    def repeats(self, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """The maximal repeats: bytes before and after the anchor, and the contexts in which they occur."""
        where = np.empty(len(self.order), np.int64)
        where[self.order] = np.arange(len(self.order))
        common = _RangeLeast(self.common)
        for length, _, _, ranks, shared in self.nodes(window):
            for more, a, b in intervals(np.r_[-1, shared], window - length):
                members = self.by_left[ranks[a:b]]
                at = where[members]
                if int(common.of(at.min(keepdims=True) + 1, at.max(keepdims=True) + 1)[0]) == length:  # not all go on to the right
                    yield more, length, members


def _groups_in(table: pa.Table) -> Iterator[tuple[int, int]]:
    key = table.column("key").to_numpy()
    edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    yield from zip(edge, edge[1:], strict=False)


def _trees(window: int):
    """What each context's repeats cover."""

    def run(batches):
        for table in _by_key(batches):
            key, rank, tag, pos, left, right, n = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "rank", "tag", "pos", "left", "right", "n"))
            bodies = table.column("body").to_pylist()
            before, after = np.where(n == 0, left, -1), right.copy()  # spans that are decided
            plain = np.array([b is None for b in bodies]) & (n > 0)
            if plain.any():  # windows without text: equal if their keys are
                i = np.flatnonzero(plain)
                _, several = _collapsed(key[i].view(np.uint64))
                i = i[several | (n[i] > 1)]
                before[i] = left[i]
            for a, b in _groups_in(table):
                some = [i for i in range(a, b) if bodies[i] is not None]
                if len(some) == 2:
                    i, j = some
                    x, y = bodies[i], bodies[j]
                    more, length = _common(x[: left[i]][::-1], y[: left[j]][::-1]), _common(x[left[i] :], y[left[j] :])
                    if more + length >= window:
                        before[some], after[some] = more, length
                elif len(some) > 2:
                    low, high = Tree([bodies[i] for i in some], left[some].tolist()).reach(window)
                    before[some], after[some] = low, high
            hit = np.flatnonzero(before >= 0)
            yield _batch(_SPANS, rank[hit], tag[hit], (pos - before)[hit], (pos + after)[hit])

    return run


def _repeat_rows(window: int):
    """Every maximal repeat of each gram, a row for each context in which it occurs."""

    def run(batches):
        for table in _by_key(batches):
            key, gram, ctx, left, right, n = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "gram", "ctx", "left", "right", "n"))
            bodies = table.column("body").to_pylist()
            for a, b in _groups_in(table):
                some = [i for i in range(a, b) if bodies[i] is not None]
                some += [i for i in some if n[i] > 1]  # several occurrences are two leaves at least
                found = []
                if len(some) > 1:
                    for more, length, members in Tree([bodies[i] for i in some], left[some].tolist()).repeats(window):
                        i = np.unique(np.array(some)[members])
                        found.append((np.full(len(i), more), length, i))
                if not some and n[a:b].sum() > 1:
                    found.append((left[a:b], int(window - left[a]), np.arange(a, b)))
                for node, (more, length, i) in enumerate(found):
                    yield _batch(_GROUPS, key[i], np.full(len(i), node), more + length, gram[i], ctx[i], more)

    return run


def _cut(batches):
    for table in in_pieces(batches):
        t = texts_of(table.column("text"))
        raw = t.buf.tobytes()
        lists = table.column("spans").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offset = lists.offsets.to_numpy()
        start, end = (lists.values.field(c).to_numpy(zero_copy_only=False)[offset[0] : offset[-1]].astype(np.int64) for c in ("start", "end"))
        owner, start, end = merged(np.repeat(np.arange(len(lists)), np.diff(offset)), start, end)
        first = np.searchsorted(owner, np.arange(len(lists) + 1)).tolist()
        start, end = start.tolist(), end.tolist()
        kept, spans = [], []
        for i, (low, high) in enumerate(zip(t.offset[:-1].tolist(), t.offset[1:].tolist(), strict=True)):
            a, b = first[i], first[i + 1]
            if a == b:
                kept.append(raw[low:high])
                spans.append([])
                continue
            edges = [0, *(x for pair in zip(start[a:b], end[a:b], strict=True) for x in pair), high - low]
            kept.append(b"".join(raw[low + x : low + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([list(x) for x in zip(start[a:b], end[a:b], strict=True)])
        size = np.diff(t.offset)
        gone = size - np.array([len(x) for x in kept])
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=_OUT.names)


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row, known by rank and tag."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("rank"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _found(scratch: Scratch, plain: DataFrame, window: int, piece: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors whose grams occur twice or more, the different contexts among them, and the spans (rows of n 0) besides."""
    found = scratch.write(plain.select("rank", "tag", "text").mapInArrow(_anchors(window, piece, every), _ANCHORS))
    sent = found.where("n > 0")
    again = sent.groupBy("key").agg(F.sum("n").alias("m")).where("m > 1").select("key")
    repeated = scratch.write(sent.join(again, "key").select(sent.columns))
    one = [F.first(c).alias(c) for c in ("rank", "tag", "pos", "left", "right")]  # of one and the same row
    return repeated, scratch.write(repeated.groupBy("key", "ctx").agg(F.least(F.sum("n"), F.lit(1 << 30)).cast("int").alias("n"), *one)), found.where("n = 0")


def _fetched(plain: DataFrame, wanted: DataFrame, window: int, every: bool) -> DataFrame:
    """The contexts of wanted (distinct ones, hot) with their texts, in order of key."""
    lists = wanted.groupBy("rank", "tag").agg(F.collect_list(F.struct("key", "ctx", "pos", "left", "right", "n", "hot")).alias("wanted"))
    rows = plain.join(lists, ["rank", "tag"])  # all columns of plain, so that its exchange is the one of the last join too
    return rows.mapInArrow(_contexts(window, every), _CONTEXTS).repartition("key").sortWithinPartitions("key")


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 400, piece: int = 8 << 20, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the bytes left) and spans (maximal removed runs as [first byte, byte after the last]) of every row.

    piece: bytes of text whose equal contexts are summed up before anything is shuffled;
    contexts: how many different ones of a gram one tree takes."""
    plain = _plain(docs)
    repeated, distinct, decided = _found(Scratch(spark, "intervals"), plain, window, piece, False)
    several = repeated.join(distinct.where("n > 1").select("key", "ctx"), ["key", "ctx"])
    met = distinct.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    wanted = distinct.join(met, "key").withColumn("hot", F.col("k") > contexts)
    trees = _fetched(plain, wanted, window, False).mapInArrow(_trees(window), _SPANS)
    span = lambda rows: rows.select("rank", "tag", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    spans = trees.union(span(several)).union(span(decided)).groupBy("rank", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return plain.join(spans, ["rank", "tag"], "left").mapInArrow(_cut, _OUT)


def repeat_groups(spark: SparkSession, docs: DataFrame, window: int = 400, contexts: int = CONTEXTS) -> DataFrame:
    """The maximal repeats of at least `window` bytes with all their occurrences: group, length, n (occurrences), doc_id, start.

    A repeat is maximal within its anchor's reach (the windows that pick the gram); a
    longer one is given by the groups of its anchors, which overlap.  Windows of grams of
    more than `contexts` contexts are groups of their own."""
    plain = _plain(docs)
    scratch = Scratch(spark, "groups")
    repeated, distinct, _ = _found(scratch, plain, window, 8 << 20, True)
    met = distinct.groupBy("key").agg(F.count("*").alias("k"))
    wanted = distinct.join(met, "key").withColumn("hot", F.col("k") > contexts)
    nodes = _fetched(plain.dropDuplicates(["rank", "tag"]), wanted, window, True).mapInArrow(_repeat_rows(window), _GROUPS)
    places = repeated.select(F.col("key").alias("gram"), "ctx", "rank", "pos")
    out = scratch.write(nodes.join(places, ["gram", "ctx"]).select(F.xxhash64("key", "node").alias("group"), F.col("length").cast("long").alias("length"), F.when(F.col("rank") != _LAST, F.col("rank")).alias("doc_id"), (F.col("pos") - F.col("before")).cast("long").alias("start")))
    return out.join(out.groupBy("group").agg(F.count("*").alias("n")), "group").select("group", "length", "n", "doc_id", "start")
