"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text is cut where no piece can cross: before each run of the space mark and around
control characters.  Equal chunks of a batch are segmented once, all together: pieces
are found by rolling hashes, forward Viterbi scores come from one vectorised pass over
ends, and backward scores give each chunk's gap to its second best segmentation.  The
N best segmentations of a whole text can differ from the best in the N - 1 chunks of
least gap only (of equal gaps, by the order below), so those chunks alone are ranked: short ones all at once, by the n
best ways to each of their nodes, and long ones by an A* search: backwards from the
chunk's end, with the forward Viterbi scores as exact heuristics, so that complete
segmentations leave the heap best first.  As the heuristics are exact, a hypothesis costs
what its departures from the best edges lose; the one that is expanded follows its best
edges back to the start, and the least of the departures on that way join the heap.  The
N best of a text carry what each of these chunks chose, and their ids are put together
from that.

Order of segmentations: higher total score; then fewer pieces; then, from the end, longer
pieces first.  Scores are whole multiples of 1 / `unit` (a power of two, at most 2**24; exact
for models whose scores are whole numbers).  A chunk's score and count of pieces share an
integer, of 64 bits or, where those would not do, of any length.  A character that is no
piece becomes its UTF-8 byte pieces (at the least score minus 10, as one piece), or the
unknown piece where the model has none.

Defined results: null and empty texts have no pieces, score 0 and decode to ''.
The space mark U+2581 in a text can't be told from a space after decoding.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import hash_spans, in_pieces, mix, texts_of

_MARK = 0x2581
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_PIECES = 1 << 20  # a score's unit, so that the count of pieces breaks ties
_WIDE = 1 << 40  # the same where no unit fits 64 bits: such scores are Python integers
PIECE = 1 << 20  # bytes of text at a time: of 4 MB, a worker takes some 300 MB more and no less time
_SHORT = 128  # characters of chunks whose best segmentations are found all at once
_NO_GAP = np.iinfo(np.int64).max  # of chunks with one segmentation
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType()), T.StructField("nbest_scores", T.ArrayType(T.DoubleType())), T.StructField("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("round_trip", T.BooleanType())])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The pieces of a model file, by hash."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte = np.full(256, -1, np.int64)
        usable = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.text[i][1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable.append(i)
        self.fallback = bool((self.byte >= 0).all())
        score = np.array([sp.get_score(i) for i in usable], np.float64)
        most = float(np.abs(score).max(initial=0.0)) + 10
        units = [1 << k for k in range(25) if most * (1 << k) < 1 << 41]
        self.unit = next((u for u in units if (score * u == np.round(score * u)).all()), units[-1])
        least = float(score.min(initial=0.0)) - 10
        code = lambda x: np.int64(round(x * self.unit)) * _PIECES - 1
        self.unknown_score = code(least)
        codes = [_code_points(self.text[i]) for i in usable]
        self.longest = max(map(len, codes), default=1)
        # over the code points of all pieces, one after another: a worker reads the model in less than a second
        size = np.array([len(x) for x in codes], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *codes])
        piece, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        place = np.arange(len(flat)) - first[piece]
        marked = [codes[i] for i in np.unique(piece[(flat == _MARK) & (place > 0)]).tolist() if not (codes[i] == _MARK).all()]
        self.cut_at_mark = not any((x[:-1] != _MARK)[x[1:] == _MARK].any() for x in marked)
        self.controls = np.zeros(33, bool)
        self.controls[:32] = True
        self.controls[flat[(flat < 32) & (size[piece] > 1)]] = False
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, _FACTOR)])
        hashes = np.zeros(len(size), np.uint64)
        np.add.at(hashes, piece, (flat.astype(np.uint64) + np.uint64(1)) * up[place])
        hashes = mix(hashes + size.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable, np.int64)[order]
        self.scores = np.array([code(x) for x in score], np.int64)[order]
        slot = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.slots = np.full(1 << 22, -1, np.int32)  # of the first bits of a hash, the first piece that has them
        self.slots[slot[::-1]] = np.arange(len(slot))[::-1]
        self.in_slot = int(np.bincount(slot).max(initial=1)) if len(slot) else 1
        raw = [bytes([int(x[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else x.encode() for i, x in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.cumsum([0, *map(len, raw)])

    def edges(self, codes: np.ndarray, end: np.ndarray):
        """All pieces in chunks: (start, length, score, id) with ids of -1 for unknown characters. end: of each place, where its chunk ends."""
        n = len(codes)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _FACTOR)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _INVERSE)])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        found = []
        single = np.zeros(n, bool)
        inside = np.arange(n)
        room = end - inside
        for size in range(1, min(self.longest, n) + 1):
            inside = start = inside[room[inside] >= size]
            h = mix((total[start + size] - total[start]) * down[start] + np.uint64(size))
            at = self.slots[(h >> np.uint64(42)).astype(np.int64)]
            ok = np.flatnonzero(at >= 0)
            start, h, at = start[ok], h[ok], at[ok]
            for _ in range(1, self.in_slot):
                at = np.where(self.hashes[at] < h, np.minimum(at + 1, len(self.hashes) - 1), at)
            ok = self.hashes[at] == h
            start, at = start[ok], at[ok]
            if size == 1:
                single[start] = True
            found.append((start, np.full(len(start), size), self.scores[at], self.ids[at]))
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.unknown_score), np.full(len(lone), -1)))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def bytes_of(self, code: int) -> list[int]:
        if not self.fallback:
            return [self.unknown]
        return [int(self.byte[b]) for b in chr(code).encode("utf-8", "surrogatepass")]


@lru_cache(4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _steps(node: np.ndarray, chunk_of_node: np.ndarray, first: np.ndarray):
    """Edges in groups whose nodes have the same distance from their chunk's start: (group's edges, in order) by distance."""
    distance = node - first[chunk_of_node]
    order = np.argsort(distance, kind="stable")
    d = distance[order]
    return order, np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)


def _relax(value, target, source, score, order, cut):
    """value[target] = max over edges of value[source] + score, group by group."""
    if len(order) < 40 * len(cut):  # of few and long chunks
        best: list = value.tolist()
        seen = np.zeros(len(value), bool).tolist()
        for t, x, y in zip(target[order].tolist(), source[order].tolist(), score[order].tolist(), strict=True):
            new = best[x] + y
            if not seen[t] or new > best[t]:
                best[t] = new
                seen[t] = True
        value[:] = best
        return
    for a, b in zip(cut, np.r_[cut[1:], len(order)], strict=True):
        e = order[a:b]
        t = target[e]
        new = value[source[e]] + score[e]
        edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        value[t[edge]] = np.maximum.reduceat(new, edge)


def _no_gap(kind):
    return _NO_GAP if kind == np.int64 else 1 << 200


class Lattice:
    """Chunks, one after another, with a node before each character and one at each chunk's end."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, first: np.ndarray, unit: int = _PIECES):
        self.pieces, self.codes, self.first = pieces, codes, first
        count = len(first) - 1
        chunk = np.repeat(np.arange(count), np.diff(first))
        end = np.repeat(first[1:], np.diff(first))
        start, size, score, ids = pieces.edges(codes, end)
        order = np.argsort((start + size) * (pieces.longest + 1) - size, kind="stable")  # by end, longest first
        start, size, score, ids = start[order], size[order], score[order], ids[order]
        if unit != _PIECES:
            score = ((score + 1) // _PIECES).astype(object if unit == _WIDE else np.int64) * unit - 1
        home = chunk[start]
        self.low = start + home  # nodes: a place plus the chunk's number
        self.high = self.low + size
        self.size, self.score, self.ids, self.home = size, score, ids, home
        node_first = first + np.arange(count + 1)
        self.node_first = node_first
        nodes = int(node_first[-1])
        self.ahead = np.zeros(nodes, score.dtype)
        _relax(self.ahead, self.high, self.low, score, *_steps(self.high, home, node_first))
        self.best = self.ahead[node_first[1:] - 1]

    def best_path(self):
        """Edges of every chunk's best segmentation, in order, and each chunk's first edge among them."""
        optimal = np.flatnonzero(self.ahead[self.low] + self.score == self.ahead[self.high])
        back = np.full(int(self.node_first[-1]), -1)
        back[self.high[optimal[::-1]]] = optimal[::-1]  # the longest comes first at its end
        at = self.node_first[1:] - 1
        alive = np.flatnonzero(at > self.node_first[:-1])
        at, steps = at[alive], []
        while len(alive) > 8:
            e = back[at]
            steps.append((alive, e))
            at = self.low[e]
            ok = at > self.node_first[alive]
            alive, at = alive[ok], at[ok]
        for c, node in zip(alive.tolist(), at.tolist(), strict=True):
            first, way = int(self.node_first[c]), []
            edges = back[first : node + 1].tolist()
            while node > first:
                way.append(edges[node - first])
                node = int(self.low[way[-1]])
            steps.append((np.full(len(way), c), np.array(way, np.int64)))
        chunk = np.concatenate([c for c, _ in steps]) if steps else np.zeros(0, np.int64)
        edge = np.concatenate([e for _, e in steps]) if steps else chunk
        order = np.lexsort((self.low[edge], chunk))
        edge, chunk = edge[order], chunk[order]
        return edge, np.searchsorted(chunk, np.arange(len(self.first)))

    def gaps(self, path: np.ndarray) -> np.ndarray:
        """What each chunk's second best segmentation scores less than the best (see _no_gap if there is none)."""
        count = len(self.first) - 1
        behind = np.zeros(int(self.node_first[-1]), self.score.dtype)
        away = self.node_first[1:][self.home] - 1 - self.low
        order = np.argsort(away * (len(behind) + 1) + self.low, kind="stable")
        d = away[order]
        _relax(behind, self.low, self.high, self.score, order, np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else order)
        other = np.ones(len(self.low), bool)
        other[path] = False
        out = np.full(count, _no_gap(self.score.dtype), self.score.dtype)
        e = np.flatnonzero(other)
        home = self.home[e]  # in order, as edges are
        if len(e):
            first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            out[home[first]] = np.minimum.reduceat(self.best[home] - (self.ahead[self.low[e]] + self.score[e] + behind[self.high[e]]), first)
        return out

    def n_best(self, chunk: int, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a chunk as (score, ids)."""
        return [(s, ids) for s, ids, _ in self.ranked(chunk, n)]

    def ranked(self, chunk: int, n: int) -> list[tuple[int, list[int], int]]:
        """The n best segmentations of a chunk as (score, ids, turn among them by longer pieces from the end), by A* from the chunk's end."""
        if not hasattr(self, "by_high"):
            self.by_high = np.searchsorted(self.high, np.arange(int(self.node_first[-1]) + 1))
        first, last = int(self.node_first[chunk]), int(self.node_first[chunk + 1]) - 1
        begin, end = int(self.by_high[first]), int(self.by_high[last + 1])
        at = (self.by_high[first : last + 2] - begin).tolist()  # edges at[v]:at[v + 1] end in node v, longest first
        ahead = self.ahead[first : last + 1].tolist()
        low, size = (self.low[begin:end] - first).tolist(), self.size[begin:end].tolist()
        loss = [ahead[u + k] - ahead[u] - x for u, k, x in zip(low, size, self.score[begin:end].tolist(), strict=True)]
        best = [next((e for e in range(at[v], at[v + 1]) if not loss[e]), -1) for v in range(last - first + 1)]

        def followed(way: list[int], node: int) -> list[int]:
            while node:
                way.append(best[node])
                node = low[way[-1]]
            return way

        def departures(lost: int, way: list[int], done: int, node: int):
            for k in range(done, len(way)):
                taken = way[k]
                for e in range(at[node], at[node + 1]):
                    if e != taken:  # longer pieces first, from the end
                        yield (lost + loss[e], size[e] < size[taken], k if size[e] > size[taken] else -k, -size[e], k, e)
                node = low[taken]

        key = lambda way: [-size[e] for e in way]
        way = followed([], last - first)
        heap, out = [(0, key(way), way, 0, last - first)], []
        while heap and len(out) < n:
            lost, order, way, done, node = heapq.heappop(heap)
            out.append((ahead[-1] - lost, way, order))
            for more, *_, k, e in heapq.nsmallest(n - len(out), departures(lost, way, done, node)):
                new = followed([*way[:k], e], low[e])
                heapq.heappush(heap, (more, key(new), new, k + 1, low[e]))
        turn = {k: i for i, k in enumerate(sorted(range(len(out)), key=lambda k: out[k][2]))}
        return [(s, [x for e in reversed(way) for x in self.token(begin + e)], turn[k]) for k, (s, way, _) in enumerate(out)]

    def all_ranked(self, n: int) -> list[list[tuple[int, list[int], int]]]:
        """`ranked` of every chunk, all at once (for short chunks and 64-bit scores): the n best ways to a node are the best of those to the nodes before it.

        Ways of equal scores keep the order of their edges (longest first) and of what is before those, which is the order of segmentations."""
        nodes = int(self.node_first[-1])
        value, via, rank = np.zeros((nodes, n), np.int64), np.full((nodes, n), -1), np.zeros((nodes, n), np.int64)
        known = np.zeros((nodes, n), bool)
        known[self.node_first[:-1], 0] = True
        order, cut = _steps(self.high, self.home, self.node_first)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            row, r = np.nonzero(known[self.low[order[a:b]]])
            e = order[a:b][row]
            new, node = value[self.low[e], r] + self.score[e], self.high[e]
            best = np.lexsort((-new, node))
            first = np.flatnonzero(np.r_[True, node[best][1:] != node[best][:-1]])
            place = np.arange(len(best)) - np.repeat(first, np.diff(np.r_[first, len(best)]))
            best, place = best[place < n], place[place < n]
            at = (node[best], place)
            value[at], via[at], rank[at], known[at] = new[best], e[best], r[best], True
        last = self.node_first[1:] - 1
        chunk, r = np.nonzero(known[last])
        score, node, way = value[last[chunk], r], last[chunk], np.arange(len(chunk))
        steps = []
        while len(way):
            e = via[node, r]
            steps.append((way, e))
            r, node = rank[node, r], self.low[e]
            on = np.flatnonzero(node > self.node_first[self.home[e]])
            way, r, node = way[on], r[on], node[on]
        ways, edge = (np.concatenate(x) for x in zip(*steps, strict=True))
        by = np.argsort(ways, kind="stable")  # of each way the edges from the end on
        edge, at = edge[by], np.searchsorted(ways[by], np.arange(len(chunk) + 1)).tolist()
        ids, size = self.ids[edge], (-self.size[edge]).tolist()
        lone = np.zeros(len(chunk), bool)
        lone[ways[by][ids < 0]] = True
        ids, score, lone = ids.tolist(), score.tolist(), lone.tolist()
        bounds, out = np.searchsorted(chunk, np.arange(len(last) + 1)).tolist(), []
        for low, high in zip(bounds, bounds[1:], strict=False):
            turn = {k: i for i, k in enumerate(sorted(range(low, high), key=lambda k: size[at[k] : at[k + 1]]))}
            found = []
            for k in range(low, high):
                own = [x for e in reversed(edge[at[k] : at[k + 1]].tolist()) for x in self.token(e)] if lone[k] else ids[at[k] : at[k + 1]][::-1]
                found.append((score[k], own, turn[k]))
            out.append(found)
        return out

    def token(self, e: int) -> tuple:
        return (int(self.ids[e]),) if self.ids[e] >= 0 else tuple(self.pieces.bytes_of(int(self.codes[self.low[e] - self.home[e]])))


def _chunks(pieces: Pieces, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where chunks begin in the code points of texts (first: where texts begin, and the end)."""
    n = len(codes)
    cut = np.zeros(n + 1, bool)
    if pieces.cut_at_mark:
        mark = codes == _MARK
        cut[1:n] |= mark[1:] & ~mark[:-1]
    control = np.zeros(n, bool)
    low = codes < 32
    control[low] = pieces.controls[codes[low]]
    cut[:n] |= control
    cut[1:] |= control
    cut[first] = True
    return np.flatnonzero(cut[:n])


def _marked(table_text: pa.ChunkedArray):
    """Code points of texts with spaces as marks and one before each text that isn't empty; where texts begin."""
    t = texts_of(table_text)
    text = t.buf.tobytes().decode("utf-8")
    codes = _code_points(text)
    lead = (t.buf & 0xC0) != 0x80
    first = np.r_[0, np.cumsum(lead)][t.offset]
    codes = np.where(codes == 32, np.uint32(_MARK), codes)
    some = np.diff(first) > 0
    codes = np.insert(codes, first[:-1][some], _MARK)
    return t, codes, first + np.r_[0, np.cumsum(some)]


def _spans(values: np.ndarray, low: np.ndarray, high: np.ndarray):
    """values[low:high] of all spans, one after another, and where each begins."""
    n = high - low
    at = np.r_[0, np.cumsum(n)]
    return values[np.repeat(low - at[:-1], n) + np.arange(at[-1])], at


def _kth(values: np.ndarray, m: int):
    return (np.partition(values, m - 1) if values.dtype == np.int64 else np.sort(values))[m - 1]


def _near(gap: np.ndarray, which: np.ndarray, later: np.ndarray, m: int) -> np.ndarray:
    """The m places of a text, in order, whose second best segmentations make the best texts.

    later: whether a chunk's second best comes before its best where scores are equal.  Of two
    places with the same gap the later decides, as it is compared first."""
    some = np.flatnonzero(gap < _no_gap(gap.dtype))
    if len(some) > m:
        limit = _kth(gap[some], m)
        sure, tied = some[gap[some] < limit], some[gap[some] == limit]
        first = later[which[tied]]
        some = np.sort(np.r_[sure, np.r_[tied[first][::-1], tied[~first]][: m - len(sure)]])
    return some


def _combined(options: list[list[tuple[int, list[int], int]]], n: int) -> list[tuple[int, ...]]:
    """The n best choices of one segmentation of each list (best first)."""
    found: list[tuple] = [(0, (), ())]
    for some in options:  # a later chunk's turn is compared before those of earlier ones
        found = sorted((s - x + some[0][0], (turn, *turns), (*picks, k)) for s, turns, picks in found for k, (x, _, turn) in enumerate(some))[:n]
    return [picks for *_, picks in found]


def _blocks(sizes: np.ndarray, most: int = 200_000):
    """Ranges of chunks of about `most` characters: a lattice takes some 400 bytes a character."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _unit(pieces: Pieces, longest: int) -> int:
    """A unit of scores that is more than any count of pieces of a chunk of so many characters, and leaves room for sums of scores."""
    most = max(-int(pieces.scores.min(initial=0)), -int(pieces.unknown_score), int(pieces.scores.max(initial=0))) // _PIECES + 1
    return next((u for u in (_PIECES, 1 << longest.bit_length()) if longest < u and longest * most * u < 1 << 61), _WIDE)


def _best_of(pieces: Pieces, codes: np.ndarray, at: np.ndarray, unit: int):
    """Of chunks: ids of their best segmentations, how many each has, the scores, and the gaps to the second best."""
    lattice = Lattice(pieces, codes, at, unit)
    path, first = lattice.best_path()
    ids = lattice.ids[path]
    more = np.ones(len(ids), np.int64)
    lone = np.flatnonzero(ids < 0)  # characters without a piece
    if len(lone):
        found = [pieces.bytes_of(int(codes[lattice.low[e] - lattice.home[e]])) for e in path[lone]]
        more[lone] = [len(b) for b in found]
        place = np.r_[0, np.cumsum(more)]
        ids = np.repeat(ids, more)
        for k, b in zip(lone, found, strict=True):
            ids[place[k] : place[k] + len(b)] = b
    place = np.r_[0, np.cumsum(more)]
    return ids.astype(np.int32), np.diff(place[first]), lattice.best, lattice.gaps(path)


def encode_table(pieces: Pieces, text: pa.ChunkedArray, n: int):
    """Per text: ids (and where they begin), scores, and the scores of the n best segmentations."""
    return encode_n_best(pieces, text, n)[:5]


def encode_n_best(pieces: Pieces, text: pa.ChunkedArray, n: int):
    """As encode_table, and the ids of all the n best segmentations, one after another, and where each begins."""
    t, codes, first = _marked(text)
    starts = _chunks(pieces, codes, first[:-1][np.diff(first) > 0])
    ends = np.r_[starts[1:], len(codes)]
    raw = codes.astype("<u4").view(np.uint8)
    which, unique = pd.factorize(hash_spans(raw, starts * 4, ends * 4))
    own = np.empty(len(unique), np.int64)
    own[which[::-1]] = np.arange(len(which))[::-1]
    unit = _unit(pieces, int((ends - starts).max(initial=0)))
    real = lambda x: -(-x // unit)  # noqa: E731  without the count of pieces
    parts = [_best_of(pieces, *_spans(codes, starts[own[i:j]], ends[own[i:j]]), unit) for i, j in _blocks(ends[own] - starts[own])]
    ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    path_at = np.r_[0, np.cumsum(np.concatenate([p[1] for p in parts]))] if parts else np.zeros(1, np.int64)
    best, gaps = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (2, 3))
    out, chunk_at = _spans(ids.astype(np.int32), path_at[:-1][which], path_at[1:][which])
    text_at = np.searchsorted(starts, first)
    total = np.r_[0, np.cumsum(real(best)[which])]
    total = total[text_at[1:]] - total[text_at[:-1]]
    gap = gaps[which]
    bounds = list(zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True))
    wanted = np.zeros(len(unique), bool)
    for a, b in bounds:
        some = gap[a:b][gap[a:b] < _no_gap(gap.dtype)]
        if n > 1 and len(some):
            wanted[which[a:b][gap[a:b] <= _kth(some, min(n - 1, len(some)))]] = True
    wanted = np.flatnonzero(wanted)
    size = (ends - starts)[own[wanted]]
    kept: dict[int, list[tuple[int, list[int], int]]] = {}
    later = np.zeros(len(unique), bool)
    at_once = (size <= _SHORT) & (unit != _WIDE)
    for some, together in ((wanted[at_once], True), (wanted[~at_once], False)):
        for i, j in _blocks(ends[own[some]] - starts[own[some]]):
            lattice = Lattice(pieces, *_spans(codes, starts[own[some[i:j]]], ends[own[some[i:j]]]), unit)
            found = lattice.all_ranked(n) if together else [lattice.ranked(k, n) for k in range(j - i)]
            for u, ranked in zip(some[i:j].tolist(), found, strict=True):
                kept[u] = ranked
                later[u] = ranked[1][2] < ranked[0][2]
    place, more = {}, []  # segmentations other than the best, after the best ones of all chunks
    for u, found in kept.items():
        for k in range(1, len(found)):
            place[u, k] = len(unique) + len(more)
            more.append(found[k][1])
    pool = np.concatenate([ids.astype(np.int32), *(np.array(x, np.int32) for x in more)])
    pool_at = np.r_[path_at, path_at[-1] + np.cumsum([len(x) for x in more], dtype=np.int64)]
    many, source, at, put = [], [], 0, []
    for k, (a, b) in enumerate(bounds):
        near = _near(gap[a:b], which[a:b], later, n - 1) if n > 1 else np.zeros(0, np.int64)
        chunks = which[a:b][near].tolist()
        found = _combined([kept[u] for u in chunks], n)
        many.append([(int(total[k]) + sum(real(kept[u][x][0]) - real(kept[u][0][0]) for u, x in zip(chunks, picks, strict=True))) / pieces.unit for picks in found])
        for picks in found:
            put += [(at + p, place[u, x]) for p, u, x in zip(near.tolist(), chunks, picks, strict=True) if x]
            source.append(which[a:b])
            at += b - a
    span = np.concatenate(source) if source else np.zeros(0, np.int64)
    if put:
        to, what = np.array(put, np.int64).T
        span[to] = what
    size = np.array([len(x) for x in source], np.int64)
    all_ids, all_at = _spans(pool, pool_at[span], pool_at[span + 1])
    return t, out, chunk_at[text_at], [x / pieces.unit for x in total.tolist()], many, all_ids, all_at[np.r_[0, np.cumsum(size)]]


def decode_ids(pieces: Pieces, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """UTF-8 of each ids[at[k]:at[k + 1]], without the mark before the text."""
    raw, byte_at = _spans(pieces.raw, pieces.raw_at[ids], pieces.raw_at[ids + 1])
    cut = byte_at[at]
    whole = raw.tobytes()
    return [whole[a:b].replace("▁".encode(), b" ")[1:] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _encoded(model_path: str, n: int):
    def run(batches):
        pieces = pieces_of(model_path)
        for table in in_pieces(batches, at_most=PIECE):
            t, ids, at, score, many, all_ids, all_at = encode_n_best(pieces, table.column("text"), n)
            whole = t.buf.tobytes()
            same = [whole[a:b] == x for a, b, x in zip(t.offset[:-1].tolist(), t.offset[1:].tolist(), decode_ids(pieces, ids, at), strict=True)]
            lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
            each = lists(np.r_[0, np.cumsum([len(m) for m in many])], lists(all_at, pa.array(all_ids, pa.int32())))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), lists(at, pa.array(ids, pa.int32())), pa.array(score), pa.array(many, pa.list_(pa.float64())), each, pa.array(same)], names=_OUT.names)

    return run


def encode(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id, ids, score, nbest_scores and nbest_ids (of the n best segmentations, best first) and round_trip (decoding gives the text) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(model_path, n), _OUT)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null ids give null)."""

    def run(batches):
        pieces = pieces_of(model_path)
        for b in batches:
            column = b.column("ids")
            ids = np.asarray(column.flatten(), np.int64)
            at = np.r_[0, np.cumsum([len(x) if x is not None else 0 for x in column.to_pylist()])]
            texts = [None if null else x.decode("utf-8", "replace") for x, null in zip(decode_ids(pieces, ids, at), column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
