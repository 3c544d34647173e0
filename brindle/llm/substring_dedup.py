"""Substring deduplication with fixed-block anchors.

The reference side of the index is every document's non-overlapping blocks of
``(window + 1) // 2`` words: any window of `window` words holds one whole block of the
document it lies in.  Every rolling block-sized span of every document probes that
index.  A probe that meets a block of a document with a smaller id, and that block,
are the anchors.  Each anchor is extended: all windows around it are compared through
their 64-bit hashes (within a slice chosen by other hash bits), and the windows that
prove to be repeats of a smaller document run together into maximal exact repeats,
whose words are removed.

What few rows of a task can decide, is decided before anything is shuffled: of equal
spans within some megabytes of text only those of the least and the greatest document
go on, so that a passage of very many documents sends a few rows a piece of text, not
one a document.  The spans of a partition are then compared slice by slice.  What is
shuffled is probes (4 bytes of hash and about 1.3 of place each, packed by document),
anchors, windows around anchors, and the rows themselves once: one exchange by doc_id
serves both joins, with the anchors and with the repeats, unless Spark broadcasts those.
All of it is linear in the words: a window found in n documents never makes pairs.

Defined results: null text counts as empty (no words, nothing removed, kept text '');
documents of fewer words than a window lose nothing; repeated doc_ids are of equal
rank, so such rows remove nothing from each other; a null doc_id ranks with the largest
id of all, 9223372036854775807.  Extra columns are carried along by callers (the
operator reads doc_id and text alone).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import SPACE, coverage, in_pieces, window_hashes, window_starts, words_hashed
from .scratch import Scratch, shuffle_partitions

LAST = np.iinfo(np.int64).max
PIECE = 2 << 20  # bytes of text at a time: of 8 MB, a worker's arrays take 140 MB more

_PACKED = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("docs", "tags", "counts", "keys", "places"))])
_PLACES = T.StructType([T.StructField("rank", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("tags", "counts", "places"))])
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which the shuffle's compression shrinks as the high ones are zero."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(part, doc, tag, key, place) -> pa.RecordBatch:
    """One row for each value of part, of rows in ascending (part, doc, place) order."""
    n = len(part)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if n else np.zeros(0, np.int64)
    run = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if n else edge
    delta = place.copy()
    if n:
        delta[1:] -= place[:-1]
        delta[run] = place[run]
    count = np.diff(np.r_[run, n])
    cut = np.searchsorted(run, np.r_[edge, n])
    ends = np.r_[edge, n]
    rows = {c: [] for c in ("docs", "tags", "counts", "keys", "places")}
    rd, rt = doc[run], tag[run]
    for i in range(len(edge)):
        a, b, r, s = ends[i], ends[i + 1], cut[i], cut[i + 1]
        rows["docs"].append(rd[r:s].tobytes())
        rows["tags"].append(rt[r:s].tobytes())
        rows["counts"].append(_planes(count[r:s]))
        rows["keys"].append(key[a:b].tobytes() if key is not None else b"")
        rows["places"].append(_planes(delta[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), *(pa.array(rows[c], pa.binary()) for c in rows)], names=["part", *rows])


def _unpack(table: pa.Table, key_type):
    """(doc, tag, key, place) of packed rows."""
    doc, tag, key, place = [], [], [], []
    for d, t, c, k, p in zip(*(table.column(c).to_pylist() for c in ("docs", "tags", "counts", "keys", "places")), strict=True):
        counts, delta = _unplanes(c).astype(np.int64), _unplanes(p).astype(np.int64)
        total = np.cumsum(delta)
        first = np.r_[0, np.cumsum(counts)[:-1]]
        place.append((total - np.repeat(total[first] - delta[first], counts)).astype(np.int32))
        doc.append(np.repeat(np.frombuffer(d, np.int64), counts))
        tag.append(np.repeat(np.frombuffer(t, np.uint32), counts))
        if key_type:
            key.append(np.frombuffer(k, key_type))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(doc, np.int64), join(tag, np.uint32), join(key, key_type or np.uint8), join(place, np.int32)


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    x = doc.view(np.uint64)
    return np.mod((x ^ (x >> np.uint64(29))).view(np.int64), groups)


def _packed_by_group(doc, tag, place, groups: int, base: int = 0):
    """Places by document, packed by groups of documents."""
    part = _group(doc, groups) + base
    order = np.lexsort((place, tag, doc, part))
    return _pack(part[order], doc[order], tag[order], None, place[order])


def _by_part(batches) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each part in turn, of rows sorted by part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[0].column("part")[0].as_py() != part[a]:
                yield held[0].column("part")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("part")[0].as_py(), pa.Table.from_batches(held)


def _several(key: np.ndarray):
    """Of equal keys in several rows: the rows, one run after another, and where each run begins."""
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else order
    size = np.diff(np.r_[first, len(key)])
    some = size > 1
    return order[np.repeat(some, size)], np.cumsum(np.r_[0, size[some]])[:-1]


def _first_of_runs(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Flags of the first flagged row of each run."""
    at = np.flatnonzero(flags)
    run = np.searchsorted(starts, at, "right")
    out = np.zeros(len(flags), bool)
    out[at[np.r_[True, run[1:] != run[:-1]]] if len(at) else at] = True
    return out


def _sent(doc, tag, key, place, part, keep, decided, slices: int, groups: int):
    """Rows to keep, packed by part, and the decided ones, packed by groups beyond all parts."""
    rows = np.flatnonzero(keep)
    order = rows[np.argsort(part[rows].astype(np.uint16 if slices < 1 << 16 else np.uint32), kind="stable")]
    yield _pack(part[order].astype(np.int64), doc[order], tag[order], key[order], place[order])
    if decided.any():
        yield _packed_by_group(doc[decided], tag[decided], place[decided], groups, slices)


def _probes(window: int, block: int, slices: int, groups: int, piece: int):
    """Rolling spans of each document; those that a piece of text shows to be anchors already are given as such, and stand for others with the least and the greatest document only."""

    def run(batches):
        for table in in_pieces(batches, at_most=piece):
            _, w, h = words_hashed(table.column("text"), SPACE)
            keep = np.diff(w.first) >= window
            at = window_starts(w.first, block)
            text = w.text
            at = at[keep[text[at]]]
            if not len(at):
                continue
            key, place, row = window_hashes(h, block)[at], w.place[at].astype(np.int32), text[at]
            doc = table.column("rank").to_numpy()[row]
            decided, keep = np.zeros(len(at), bool), np.ones(len(at), bool)
            rows, starts = _several(key)
            if len(rows):
                size = np.diff(np.r_[starts, len(rows)])
                d, own = doc[rows], place[rows] % block == 0
                spread = lambda x: np.repeat(x, size)
                least, most = spread(np.minimum.reduceat(d, starts)), spread(np.maximum.reduceat(d, starts))
                one = spread(row[rows][_first_of_runs(d == least, starts)])  # the text that stands for the least document
                late = (d > least) | (row[rows] != one)
                decided[rows] = late | (own & (d < most))
                keep[rows] = ~late | _first_of_runs(d == most, starts) | _first_of_runs(own & (d == spread(np.minimum.reduceat(np.where(own, d, LAST), starts))), starts)
            yield from _sent(doc, np.zeros(len(at), np.uint32), key.astype(np.uint32), place, (key >> np.uint64(32)) % np.uint64(slices), keep, decided, slices, groups)

    return run


def _anchors(block: int, slices: int, groups: int):
    """Of the probes and blocks of each slice, those that meet: the anchors, by groups of documents."""

    def run(batches):
        for part, table in _by_part(batches):
            if part >= slices:  # decided before
                yield from table.set_column(0, "part", pa.array(np.full(len(table), part - slices, np.int32))).to_batches()
                continue
            doc, tag, key, place = _unpack(table, np.uint32)
            own = np.flatnonzero(place % block == 0)
            own = own[np.argsort(key[own], kind="stable")]
            first = np.flatnonzero(np.r_[True, key[own][1:] != key[own][:-1]]) if len(own) else own
            if not len(first):
                continue
            known, least = key[own][first], np.minimum.reduceat(doc[own], first)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.flatnonzero((known[at] == key) & (doc > least[at]))
            most = np.full(len(known), np.iinfo(np.int64).min)
            np.maximum.at(most, at[hit], doc[hit])
            met = own[doc[own] < np.repeat(most, np.diff(np.r_[first, len(own)]))]
            pick = np.union1d(hit, met)
            if len(pick):
                yield _packed_by_group(doc[pick], tag[pick], place[pick], groups)

    return run


def _places(batches):
    """One row a document: its places, by tag."""
    for _, table in _by_part(batches):
        doc, tag, _, place = _unpack(table, None)
        order = np.lexsort((place, tag, doc))
        doc, tag, place = doc[order], tag[order], place[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1])]  # decided before and again
        doc, tag, place = doc[new], tag[new], place[new]
        run = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        count = np.diff(np.r_[run, len(doc)])
        edge = np.flatnonzero(np.r_[True, doc[run][1:] != doc[run][:-1]])
        ends = [*edge.tolist(), len(run)]
        cut = np.r_[run, len(doc)]
        out = [(tag[run[a:b]].tobytes(), count[a:b].tobytes(), place[cut[a] : cut[b]].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[run[edge]]), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=_PLACES.names)


def _places_of(row: int, columns: list[list], tag: int) -> np.ndarray | None:
    """The places of a row's document under a tag."""
    tags, counts, places = (x[row] for x in columns)
    if tags is None:
        return None
    k = np.flatnonzero(np.frombuffer(tags, np.uint32) == tag)
    if not len(k):
        return None
    at = np.r_[0, np.cumsum(np.frombuffer(counts, np.int64))]
    return np.frombuffer(places, np.int32)[at[k[0]] : at[k[0] + 1]]


def _tag(text: bytes) -> int:
    return zlib.crc32(text)


def _candidates(window: int, block: int, slices: int, groups: int, piece: int):
    """Windows around anchors; of those that a piece of text shows to be repeats, the least document's alone go on."""

    def run(batches):
        for table in in_pieces(batches, at_most=piece):
            t, w, h = words_hashed(table.column("text"), SPACE)
            columns = [table.column(c).to_pylist() for c in ("tags", "counts", "places")]
            raw, starts = t.buf.tobytes(), []
            for i in range(len(t)):
                low, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
                found = _places_of(i, columns, 0)
                at = (found[:, None] - np.arange(window - block + 1)).ravel()
                starts.append(np.unique(at[(at >= 0) & (at <= n - window)]).astype(np.int64) + low)  # rows with equal ids may differ in length
            at = np.concatenate(starts)
            if not len(at):
                continue
            tags = np.array([_tag(raw[a:b]) for a, b in zip(t.offset[:-1].tolist(), t.offset[1:].tolist(), strict=True)], np.uint32)
            text = w.text[at]
            doc, tag, key, place = table.column("rank").to_numpy()[text], tags[text], window_hashes(h, window)[at], w.place[at].astype(np.int32)
            decided, keep = np.zeros(len(at), bool), np.ones(len(at), bool)
            rows, first = _several(key)
            if len(rows):
                d = doc[rows]
                decided[rows] = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(rows)]))
                keep = ~decided
            yield from _sent(doc, tag, key, place, window_hashes(h, window, 1)[at] % np.uint64(slices), keep, decided, slices, groups)

    return run


def _repeats(slices: int, groups: int):
    """Of each slice's windows, those that a document with a smaller id has too."""

    def run(batches):
        for part, table in _by_part(batches):
            if part >= slices:
                yield from table.set_column(0, "part", pa.array(np.full(len(table), part - slices, np.int32))).to_batches()
                continue
            doc, tag, key, place = _unpack(table, np.uint64)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(order)]))
            late = order[doc[order] > least]
            if len(late):
                yield _packed_by_group(doc[late], tag[late], place[late], groups)

    return run


def _removed(window: int, carry: bool):
    def run(batches):
        for table in in_pieces(batches, at_most=PIECE):
            columns = [table.column(c).to_pylist() for c in ("tags", "counts", "places")]
            out = {f.name: [] for f in _OUT}
            for i, (d, text) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)):
                raw = (text or "").encode()
                words, spans, gone = raw.split(), [], 0  # bytes.split() splits at \x20 and \x09-\x0D
                n = len(words)
                if (starts := _places_of(i, columns, _tag(raw))) is not None:
                    over = coverage(starts, window, n)
                    edge = np.flatnonzero(np.diff(np.r_[0, over.view(np.int8), 0]))
                    spans, gone = edge.reshape(-1, 2).tolist(), int(over.sum())
                    words = [w for w, x in zip(words, over.tolist(), strict=True) if not x]
                kept = text if carry and not gone else b" ".join(words).decode()
                for c, v in zip(out, (d, n, gone, kept, spans), strict=True):
                    out[c].append(v)
            arrays = [pa.array(out[c], k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, table.column("rest").combine_chunks()] if carry else arrays, names=[*out, *["rest"] * carry])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 13, carry: bool = False, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words, one space between) and spans (maximal repeats as [first word, word after the last]) of every row.

    With carry, kept_text is the text itself where nothing goes, and `rest` holds the other columns.
    piece: bytes of text of which repeats are found before anything is shuffled."""
    parts = shuffle_partitions(spark)
    slices, groups = parts, parts | 1  # odd, so that even strides of ids spread over all
    block = (window + 1) // 2
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")) or [F.lit(None)]).alias("rest")] if carry else []
    doc_id = F.col("doc_id").cast("long")
    plain = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(int(LAST))).alias("rank"), F.col("text").cast("string").alias("text"), *rest)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part")

    probes = plain.select("rank", "text").mapInArrow(_probes(window, block, slices, groups, piece), _PACKED)
    anchors = dealt(dealt(probes).mapInArrow(_anchors(block, slices, groups), _PACKED)).mapInArrow(_places, _PLACES)
    near = plain.join(Scratch(spark, "anchors").write(anchors), "rank").mapInArrow(_candidates(window, block, slices, groups, piece), _PACKED)
    repeats = dealt(dealt(near).mapInArrow(_repeats(slices, groups), _PACKED)).mapInArrow(_places, _PLACES)
    out = T.StructType([*_OUT, *([plain.schema["rest"]] if carry else [])])
    return plain.join(repeats, "rank", "left").mapInArrow(_removed(window, carry), out)


def cut_repeats(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs, all columns, with the repeats cut out of text (and n_chars, where there is one, counted anew)."""
    kinds = dict(docs.dtypes)

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col("doc_id" if c == "doc_id" else "kept_text").cast(kinds[c]).alias(c)
        value = F.col("rest").getField(c)
        return (F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(value).cast(kinds[c]) if c == "n_chars" else value).alias(c)

    return remove_repeats(spark, docs, window, carry=True).select(*map(column, docs.columns))
