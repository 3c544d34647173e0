"""Alignment of two tokenizers' tokens of the same text, by the bytes where both end one.

Texts are cut before each space that follows a character other than white space: both
tokenizers begin a token there, so a chunk's alignment is the same wherever it occurs and
is found once per worker (within a bound).  In a chunk the shorter list of token ends
drives an exponential and then binary (galloping) search into the longer one, many chunks
in step; the common ends cut the tokens into groups.  The ranks of the ends around a
token's bytes give the range of tokens of the other side that it overlaps: its links.

How many documents hold a pair of ids linked is counted for each piece of text before it
is shuffled.  The counts that the second pass over the documents needs go to all tasks as
long as they are at most HEAD pairs; of more pairs, the most frequent ones (down to a
power of two) go to all tasks and the rest, each in few documents, meets the documents'
links in a join.

Defined results: texts that are null or empty, or whose tokens' bytes are not a space and
the text (for example those with U+2581), have no tokens: zeros and '' for the groups.
Repeated rows are documents of their own.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import Texts, class_table, hash_spans, in_pieces, texts_of, unicode_space
from .scratch import Scratch

HEAD = 1 << 21
_PIECE = 4 << 20  # bytes of text that are looked at together
_FALSE_SPACE = "▁".encode()  # becomes a space
_CUT_AFTER = class_table(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, rest array<long>"


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranks (i, j) of equal values of two ascending lists; the shorter one gallops through the longer."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    found, low, n = [], 0, len(b)
    for i, x in enumerate(a):
        high, step = low, 1
        while high < n and b[high] < x:
            low, high, step = high + 1, high + step, 2 * step
        low = bisect_left(b, x, low, min(high, n))
        if low == n:
            break
        if b[low] == x:
            found.append((i, low))
            low += 1
    return found


def gallop(short: np.ndarray, s_low, s_high, long: np.ndarray, l_low, l_high) -> tuple[np.ndarray, np.ndarray]:
    """As common_ends, of many pairs of lists at once: places in short and long that hold equal values.

    List k is short[s_low[k]:s_high[k]] and long[l_low[k]:l_high[k]]; one step of all pairs is taken together, and the last few pairs are finished one by one."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    s, s_high, low, l_high = (np.array(x) for x in (s_low, s_high, l_low, l_high))
    while True:
        on = (s < s_high) & (low < l_high)
        s, s_high, low, l_high = s[on], s_high[on], low[on], l_high[on]
        if len(s) <= 16:
            break
        x, high, step = short[s], low.copy(), np.ones(len(s), np.int64)
        go = np.flatnonzero(long[high] < x)
        while len(go):
            low[go] = high[go] + 1
            high[go] += step[go]
            step[go] *= 2
            go = go[high[go] < l_high[go]]
            go = go[long[high[go]] < x[go]]
        high = np.minimum(high, l_high)
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) >> 1
            less = long[mid] < x[go]
            low[go[less]], high[go[~less]] = mid[less] + 1, mid[~less]
        hit = low < l_high
        hit[hit] = long[low[hit]] == x[hit]
        found.append((s[hit], low[hit]))
        low[hit] += 1
        s = s + 1
    for a, b, c, d in zip(s.tolist(), s_high.tolist(), low.tolist(), l_high.tolist(), strict=True):
        pairs = np.array(common_ends(short[a:b].tolist(), long[c:d].tolist()), np.int64).reshape(-1, 2)
        found.append((pairs[:, 0] + a, pairs[:, 1] + c))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))


def byte_level(token: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary: printable bytes stand for themselves, the others follow at U+0100."""
    return bytes(_BYTES[c] for c in token)


_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def piece_bytes(piece: str) -> bytes:
    one = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()


class Aligner:
    """Alignments of chunks by hash; forgets all once it holds `most` chunks or 8 times as many links."""

    def __init__(self, a_path: str, b_path: str, texts: bool = True, most: int = 300_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [special[i] if i in special else byte_level(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a space after another character can't be cut at spaces")
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.space = self.b.piece_to_id("▁")
        self.a_widths, self.b_widths = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_strings = np.array([[f"{mark}{i}" for i in range(len(self.a_bytes))] for mark in ("", ";", ",")], object)
        self.b_strings = np.array([[f"{mark}{i}" for i in range(len(self.b_bytes))] for mark in ("", "|", ",")], object)
        self.most, self.with_texts = most, texts
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of both, groups, 1 if the bytes fit
        self.texts: list[str] = []  # the groups of each chunk
        self.links, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        joins = np.array([1 < len(c) < 256 and (0x20 < c[-1] < 0x7F or c[-2] == 0xC3) and _FALSE_SPACE not in c for c in chunks], bool)
        first, links, ends = len(self.at) - 1, [self.links], [self.at]
        order = np.r_[np.flatnonzero(joins), np.flatnonzero(~joins)]
        for part, encode in ((np.flatnonzero(joins), self._encode_joined), (np.flatnonzero(~joins), self._encode_alone)):
            for base in range(0, len(part), 1 << 13):
                some = [chunks[i] for i in part[base : base + (1 << 13)].tolist()]
                more, at = self._align(*encode(some))
                links.append(more)
                ends.append(ends[-1][-1] + at)
        self.links, self.at = np.concatenate(links), np.concatenate(ends)
        hashes, slot = np.r_[self.hashes, hashes[order]], np.r_[self.slot, np.arange(len(chunks)) + first]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.slot = hashes[order], slot[order]

    def _encode_joined(self, chunks: list[bytes]):
        """As _encode_alone, of chunks that end in a printable ASCII character or one of U+00C0 to U+00FF, many in one text: tokens end where chunks do."""
        whole = b"".join(chunks)
        texts = [b"".join(chunks[i : i + 256]).decode() for i in range(0, len(chunks), 256)]
        lists = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1))
        ends = np.cumsum([len(c) for c in chunks])
        ids, number = [], []
        for side, table, widths in zip(lists, (self.a_bytes, self.b_bytes), (self.a_widths, self.b_widths), strict=True):
            flat = list(chain.from_iterable(side))
            ids.append(np.array(flat, np.int64))
            at = np.cumsum(widths[ids[-1]])
            rank = np.searchsorted(at, ends)
            if b"".join(map(table.__getitem__, flat)) != whole or not np.array_equal(at[rank], ends):
                return self._encode_alone(chunks)
            number.append(np.diff(np.r_[-1, rank]))
        return ids, number, np.ones(len(chunks), bool)

    def _encode_alone(self, chunks: list[bytes]):
        """Ids of both sides, how many each chunk has, and which chunks' bytes both sides give back."""
        texts = [c.decode() for c in chunks]
        lists = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], [x or [self.space] for x in self.b.encode([t[1:] for t in texts], num_threads=1)])  # a space alone has no ids
        number = [np.array([len(x) for x in side]) for side in lists]
        ids = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(lists, number, strict=True)]
        fit = np.array([all(b"".join(map(t.__getitem__, x)) == c for t, x in ((self.a_bytes, x), (self.b_bytes, y))) for c, x, y in zip(chunks, *lists, strict=True)], bool)
        return ids, number, fit

    def _align(self, ids: list[np.ndarray], number: list[np.ndarray], fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add sizes and groups of chunks; their links, and where each chunk's end."""
        ids = [x[np.repeat(fit, n)] for x, n in zip(ids, number, strict=True)]
        number = [n * fit for n in number]
        at = [np.r_[0, np.cumsum(n)] for n in number]
        end = [np.cumsum(w[x]) for w, x in zip((self.a_widths, self.b_widths), ids, strict=True)]
        common = [np.zeros(len(x), bool) for x in ids]
        shorter = number[0] <= number[1]
        for x, y, some in ((0, 1, shorter), (1, 0, ~shorter)):
            i, j = gallop(end[x], at[x][:-1][some], at[x][1:][some], end[y], at[y][:-1][some], at[y][1:][some])
            common[x][i] = common[y][j] = True
        if self.with_texts:
            self.texts += self._groups(ids, number, at, common)
        self.sizes = np.concatenate([self.sizes, np.stack([*number, _sums(common[0], at[0]), fit.astype(np.int64)], axis=1)])
        low = np.searchsorted(end[1], end[0] - self.a_widths[ids[0]], "right")  # the ranks of the tokens in which a token's first
        n = np.searchsorted(end[1], end[0], "left") - low + 1  # and last bytes lie
        place = np.r_[0, np.cumsum(n)]
        links = np.repeat(ids[0] << 32, n) | ids[1][np.repeat(low - place[:-1], n) + np.arange(place[-1])]
        return links, place[at[0][1:]]

    def _groups(self, ids, number, at, common) -> list[str]:
        """The groups of each chunk, written out."""
        flat, group = [], []
        for k, strings in enumerate((self.a_strings, self.b_strings)):
            opens = np.r_[True, common[k][:-1]] if len(common[k]) else common[k]
            mark = np.where(opens, 1, 2)
            if not k:
                mark[at[k][:-1][number[k] > 0]] = 0
            flat.append(strings[mark, ids[k]])
            group.append(2 * (np.cumsum(opens) - 1) + k)
        flat = np.concatenate(flat)[np.argsort(np.concatenate(group), kind="stable")].tolist()
        cut = (at[0] + at[1]).tolist()
        return ["".join(flat[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

    def slots(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts, one text after another (each with a space before it), and where each text's begin; empty texts have one chunk."""
        plain = texts_of(column)
        t = Texts(np.insert(plain.buf, plain.offset[:-1], 32), plain.offset + np.arange(len(plain.offset)))
        if len(self.sizes) > self.most or len(self.links) > 8 * self.most:
            self.forget()
        after = _CUT_AFTER[t.buf] | unicode_space(t.buf)
        cut = np.zeros(len(t.buf), bool)
        cut[1:] = (t.buf[1:] == 32) & ~after[:-1]
        cut[t.offset[:-1]] = True
        starts = np.flatnonzero(cut)
        which, unique = pd.factorize(hash_spans(t.buf, starts, np.r_[starts[1:], len(t.buf)]))
        at = np.searchsorted(self.hashes, unique)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            own = np.empty(len(unique), np.int64)
            own[which[::-1]] = np.arange(len(which))[::-1]
            whole, ends = t.buf.tobytes(), np.r_[starts[1:], len(t.buf)]
            self.learn(unique[new], [whole[a:b] for a, b in zip(starts[own[new]].tolist(), ends[own[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, unique)
        return self.slot[at][which], np.searchsorted(starts, t.offset)

    def links_in(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some chunks, one chunk after another, and where each chunk's begin."""
        low = self.at[slots]
        n = self.at[slots + 1] - low
        place = np.r_[0, np.cumsum(n)]
        return self.links[np.repeat(low - place[:-1], n) + np.arange(place[-1])], place


@lru_cache(1)
def aligner(a_path: str, b_path: str, texts: bool = True) -> Aligner:
    return Aligner(a_path, b_path, texts)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _sums(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[place[1:]] - total[place[:-1]]


def _whole(found: Aligner, slots: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Flags of the texts that have tokens."""
    return (size > 0) & (_sums(1 - found.sizes[slots, 3], first) == 0)


def _pair_counts(a_path: str, b_path: str):
    """In how many documents of a piece of text each pair is linked."""

    def run(batches):
        for table in in_pieces(batches, at_most=_PIECE):
            found = aligner(a_path, b_path, False)
            column = table.column("text")
            slots, first = found.slots(column)
            whole = _whole(found, slots, first, np.diff(texts_of(column).offset))
            doc = np.repeat(np.arange(len(whole)), np.diff(first))
            number = len(found.sizes)
            once = _distinct((doc * number + slots)[whole[doc]])
            links, place = found.links_in(once % number)
            if not len(links):
                continue
            which, pairs = pd.factorize(links)
            both = _distinct(np.repeat(once // number, np.diff(place)) * len(pairs) + which)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(both % len(pairs), minlength=len(pairs)).astype(np.int64))], names=["pair", "n"])

    return run


def _rows(a_path: str, b_path: str, head, texts: bool):
    """The rows of documents; `rest` has the links whose pairs are not in head."""

    def run(batches):
        pairs, counts, best = head.value
        for table in in_pieces(batches, at_most=_PIECE):
            found = aligner(a_path, b_path)
            column = table.column("text")
            slots, first = found.slots(column)
            whole = _whole(found, slots, first, np.diff(texts_of(column).offset))
            which, some = pd.factorize(slots)
            links, place = found.links_in(some)
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            known = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
            of = lambda x: _sums(_sums(np.where(known, x[at], 0), place)[which], first) * whole if len(pairs) else np.zeros(len(whole), np.int64)  # noqa: B023, E731
            sizes = [_sums(found.sizes[slots, k], first) * whole for k in range(3)]
            n_links = _sums((found.at[some + 1] - found.at[some])[which], first) * whole
            strings = [found.texts[s] for s in some.tolist()]
            which, edge = which.tolist(), first.tolist()
            groups = [";".join(map(strings.__getitem__, which[a:b])) if w else "" for a, b, w in zip(edge, edge[1:], whole.tolist(), strict=False)]
            rest: list = [None] * len(whole)
            if not known.all():
                left = [links[a:b][~known[a:b]] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
                rest = [np.concatenate([left[s] for s in which[a:b]]) if w else None for a, b, w in zip(edge, edge[1:], whole.tolist(), strict=False)]
            arrays = [table.column("doc_id").combine_chunks(), *(pa.array(x, pa.int64()) for x in (*sizes, n_links, of(best), of(counts)))]
            arrays.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()))
            arrays += [pa.array(groups if texts else [None] * len(groups), pa.string()), pa.array(rest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _ROWS.split(", ")])

    return run


def pair_counts(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (id of a * 2**32 + id of b), n (documents that hold it linked), best (no pair of that id of a has more)."""
    scratch = Scratch(spark, "pairs")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = scratch.write(texts.mapInArrow(_pair_counts(a_path, b_path), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # a row an id of the vocabulary at most
    return scratch.write(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _least_of_head(counts: DataFrame, head: int) -> int:
    """The count from which on pairs go to all tasks: 1, or the least power of two that at most `head` pairs reach."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("pairs")).collect()  # 63 at most
    total = sum(r.pairs for r in levels)
    for r in sorted(levels, key=lambda r: r.level):
        if total <= head:
            return 1 << r.level
        total -= r.pairs
    return 1 << 62


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, groups: bool = False) -> DataFrame:
    """Of every row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their a id's highest), count_sum (counts of all links), groups_sha256; with groups, the groups too (ids a1,a2|b1;...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = pair_counts(spark, docs, a_path, b_path)
    least = _least_of_head(counts, head)
    arrow = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(arrow.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(arrow.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("pair", "n", "best")))
    out = docs.mapInArrow(_rows(a_path, b_path, shared, groups), _ROWS)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    if least == 1:
        return out.select(kept)
    rows = Scratch(spark, "aligned").write(out.withColumn("row", F.monotonically_increasing_id()))
    rare = counts.where(F.col("n") < least)
    more = rows.select("row", F.explode("rest").alias("pair")).join(rare, "pair").groupBy("row").agg(F.sum("n").alias("more_n"), F.sum(F.col("best").cast("long")).alias("more_best"))
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_n", F.lit(0))}
    return rows.drop("rest").join(more, "row", "left").withColumns(added).select(kept)
