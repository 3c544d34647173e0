"""Near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets collapse to the least doc_id first.  Each remaining
set has 64 minwise tokens.  Several independent trees branch the documents: a root
picks tokens, and the documents that agree on a picked token form a node, which
branches again on tokens that its own path picks.  Small nodes are compared
exhaustively, by their tokens; pairs that can reach the threshold (all but some 3 in a
million that do) are confirmed on the full sets, 100 * |A & B| >= percent * |A | B|.
With b picks in a node, a pair of similarity J lives on in a subtree with the chance of
a branching process of mean b * J, here 0.94 a root node at J = 0.8, and trees * b = 10
root nodes bring the recall of the worst pair beyond 0.999999.

Spark deals the root nodes out.  A node of at most `bound` documents (and HEAVY bytes of
full sets) branches within its task.  In a larger one all documents are held against a
few pivots first, which links a group of near copies at once; only documents outside the
node's largest component can still need it.  If those are few, they meet all of the node
in cells of bounded size over many tasks; if not, the node branches by another shuffle.
No candidate is capped.

Only connectivity is asked for, so the pairs are taken in two rounds.  First come stars
and spanning forests of the likeliest pairs, about one a document and node.  Documents
that may still be linked to another component then meet within their nodes or cells with
their full sets: blocks of them are compared by products of their presence matrices,
which give all intersections exactly.  So a group of thousands of copies never becomes
rows of all its pairs, and no link between components is missed.

Defined results: documents without words have an empty set, are linked with nothing
and are kept; a null doc_id has a null component_id, is linked with nothing and kept;
rows that share a doc_id count as one document (linked with each other), each row
keeping its own n_shingles.  Texts are compared after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import SPACE, in_pieces, mix, window_hashes, words_hashed
from .components import components
from .scratch import BROADCAST_PAIRS, Scratch, to_all

TOKENS = 64
SMALL = 64  # rows of a node that are compared exhaustively
HEAVY = 32 << 20  # bytes of the full sets of a node that one task may hold
PIVOTS = 2  # of a large node, a round
PIECE = 2 << 20  # bytes of text at a time
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("roots", T.ArrayType(T.LongType()))])
_NODE = T.StructType([T.StructField("node", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n_shingles", T.LongType())])
_MET = T.StructType([T.StructField("node", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("left", T.BooleanType()), T.StructField("right", T.BooleanType())])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _shingles(table: pa.Table, size: int):
    """Each text's sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    _, w, h = words_hashed(table.column("text"), SPACE, lower=True)
    all_of = window_hashes(h, size)
    for low, high in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if high - low >= size:
            yield np.unique(all_of[low : high - size + 1])
        elif high > low:
            yield window_hashes(h[low:high], high - low, 1)
        else:
            yield h[:0]


def _sketcher(size: int, trees: int, picks: int):
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    root = np.concatenate([rng.permutation(TOKENS) for _ in range(-(-trees * picks // TOKENS))])[: trees * picks]  # each token at most once, where there are enough
    tree = np.repeat(np.arange(trees), picks).astype(np.uint64)

    def run(batches):
        for table in in_pieces(batches, at_most=PIECE):
            n, s1, s2, sketch, roots = [], [], [], [], []
            for g in _shingles(table, size):
                n.append(len(g))
                s1.append(int(mix(g).sum().view(np.int64)))
                s2.append(int(mix(g ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)))
                if len(g):
                    least = np.full(TOKENS, ~np.uint64(0))
                    for at in range(0, len(g), 4096):
                        np.minimum(least, (g[at : at + 4096, None] * factor).min(axis=0), out=least)
                    token = mix(least)
                    sketch.append((token >> np.uint64(48)).astype("<u2").tobytes())
                    roots.append(mix(token[root] ^ mix(tree * np.uint64(TOKENS) + root.astype(np.uint64))).view(np.int64))
                else:
                    sketch.append(None)
                    roots.append(None)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(roots, pa.list_(pa.int64()))], names=_SETS.names)

    return run


def _tokens(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), TOKENS)


def _alike(percent: int) -> int:
    """Equal tokens that a pair at the threshold has all but 3 times in a million."""
    j = percent / 100
    return int(TOKENS * j - 4.5 * (TOKENS * j * (1 - j)) ** 0.5)


def _pair_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_node(work):
    """Runs `work(table)` over whole nodes of sorted batches; several small ones at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            change = np.flatnonzero(node[1:] != node[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut or (held and held[-1].column("node")[0].as_py() != node[0]):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


class _Node:
    """The rows of one node, branched within a task."""

    def __init__(self, rep, n, comp, tokens, percent, picks, depth):
        self.rep, self.n, self.comp, self.tokens, self.percent, self.picks, self.depth = rep, n, comp, tokens, percent, picks, depth
        self.alike = _alike(percent)
        self.found: list[tuple] = []

    def compare(self, i, j):
        """Keep those pairs of rows i and j that can be similar enough and lie in different components."""
        n = self.n
        ok = (np.minimum(n[i], n[j]) * 100 >= self.percent * np.maximum(n[i], n[j])) & (self.comp[i] != self.comp[j])
        i, j = i[ok], j[ok]
        same = (self.tokens[i] == self.tokens[j]).sum(axis=1)
        ok = same >= self.alike
        self.found.append((i[ok], j[ok], same[ok]))
        return j[ok]

    def all_pairs(self, s):
        """Rows of a component that holds most of s meet only the others."""
        if len(s) <= SMALL:
            i, j = np.triu_indices(len(s), 1)
            self.compare(s[i], s[j])
            return
        values, of = np.unique(self.comp[s], return_inverse=True)
        most = np.bincount(of).argmax()
        rest = s[of != most]
        for k, x in enumerate(rest):
            self.compare(np.full(len(s) - len(rest), x), s[of == most])
            self.compare(np.full(len(rest) - k - 1, x), rest[k + 1 :])

    def stars(self, s):
        """Pull out those like a pivot, as long as they are many."""
        while len(s) > SMALL:
            like = self.compare(np.full(len(s) - 1, s[0]), s[1:])
            if len(like) < 0.2 * len(s):
                break
            s = s[~np.isin(s, like)]
        return s

    def run(self, stars: bool):
        todo = [(np.arange(len(self.rep)), self.depth, len(self.rep))]
        while todo:
            s, depth, path = todo.pop()
            if stars:
                s = self.stars(s)
            elif (self.comp[s] == self.comp[s[0]]).all():
                continue
            if len(s) <= SMALL or not depth:
                self.all_pairs(s)
                continue
            first = int(mix(np.array([path], np.uint64))[0] % np.uint64(TOKENS))
            for k in range(self.picks):
                at = (first + k * 29) % TOKENS
                order = np.argsort(self.tokens[s, at], kind="stable")
                value = self.tokens[s, at][order]
                for g in np.split(s[order], np.flatnonzero(value[1:] != value[:-1]) + 1):
                    if len(g) > 1:
                        todo.append((g, depth - 1, (path * TOKENS + at + (int(self.tokens[g[0], at]) << 20)) % (1 << 63)))
        i, j, same = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else [np.zeros(0, np.int64)] * 3
        key = np.minimum(i, j) * len(self.rep) + np.maximum(i, j)
        key, first = np.unique(key, return_index=True)
        return i[first], j[first], same[first]

    def forest(self, i, j, same):
        """Of pairs of rows, a spanning forest of the components, likeliest pairs first."""
        up: dict = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        keep = []
        for k in np.lexsort((self.rep[j], self.rep[i], -same)).tolist():
            a, b = top(self.comp[i[k]]), top(self.comp[j[k]])
            if a != b:
                up[max(a, b)] = min(a, b)
                keep.append(k)
        return i[keep], j[keep]


def _flags(node: int, rep, comp, rows) -> tuple:
    """Rows of a node as _MET: those of the largest component need not meet one another."""
    rows = np.unique(rows)
    values, of = np.unique(comp[rows], return_inverse=True)
    return np.full(len(rows), node), rep[rows], of != np.bincount(of).argmax(), np.ones(len(rows), bool)


def _met_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=_MET.names)


def _nodes_in_task(percent: int, picks: int, depth: int, first: bool):
    """Of whole nodes: in the first round the pairs of stars and forests; later the rows (as _MET) that may be linked to a row of another component."""

    def work(table):
        node, rep, n, comp = (table.column(c).to_numpy() for c in ("node", "rep", "n_shingles", "comp"))
        tokens = _tokens(table.column("sketch"))
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(node)], strict=True):
            if (comp[a:b] == comp[a]).all():
                continue
            this = _Node(rep[a:b], n[a:b], comp[a:b], tokens[a:b], percent, picks, depth)
            i, j, same = this.run(first)
            if first:
                i, j = this.forest(i, j, same)
                x, y = rep[a:b][i], rep[a:b][j]
                out.append((np.minimum(x, y), np.maximum(x, y)))
            elif len(i):
                out.append(_flags(node[a], rep[a:b], comp[a:b], np.r_[i, j]))
        if out:
            yield _pair_batch(*(np.concatenate(x) for x in zip(*out, strict=True))) if first else _met_batch(out)

    return _by_node(work)


def _cells_in_task(percent: int):
    """Of cells, the rows that may be linked: those of the left side to one of the right."""

    def work(table):
        node, rep, n, comp, side = (table.column(c).to_numpy() for c in ("node", "rep", "n_shingles", "comp", "side"))
        tokens = _tokens(table.column("sketch"))
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(rep)], strict=True):
            left, right = low + np.flatnonzero(side[low:high] == 0), low + np.flatnonzero(side[low:high] == 1)
            this = _Node(rep, n, comp, tokens, percent, 0, 0)
            for x in left:
                this.compare(np.full(len(right), x), right)
            i, j = (np.concatenate(x) for x in list(zip(*this.found, strict=True))[:2]) if this.found else [np.zeros(0, np.int64)] * 2
            if len(i):
                every = np.unique(rep[np.r_[i, j]])
                yield _met_batch([(np.full(len(every), node[low]), every, np.isin(every, rep[i]), np.isin(every, rep[j]))])

    return _by_node(work)


def _like_pivots(percent: int):
    """Pairs of rows and their node's pivots that can be similar enough."""
    least = _alike(percent)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column("n_shingles").to_numpy(), b.column("p_shingles").to_numpy()
            ok = (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & ((_tokens(b.column("sketch")) == _tokens(b.column("p_sketch"))).sum(axis=1) >= least)
            x, y = b.column("rep").to_numpy()[ok], b.column("pivot").to_numpy()[ok]
            yield _pair_batch(np.minimum(x, y), np.maximum(x, y))

    return run


def _branch(picks: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node, tokens = b.column("node").to_numpy().view(np.uint64), _tokens(b.column("sketch"))
            first = (mix(node ^ np.uint64(0x1357)) % np.uint64(TOKENS)).astype(np.int64)
            step = 1 + (mix(node ^ np.uint64(0x2468)) % np.uint64(TOKENS // 2 - 1)).astype(np.int64)
            out = []
            for k in range(picks):
                at = (first + k * step) % TOKENS
                value = tokens[np.arange(len(at)), at].astype(np.uint64)
                out.append(mix(node ^ mix((value << np.uint64(8)) + at.astype(np.uint64))).view(np.int64))
            more = [pa.array(np.tile(b.column(c).to_numpy(), picks), pa.int64()) for c in ("rep", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64()), *more], names=_NODE.names)

    return run


def _full_sets(size: int):
    def run(batches):
        for table in in_pieces(batches, at_most=PIECE):
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array([g.tobytes() for g in _shingles(table, size)], pa.binary())], names=["doc_id", "grams"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (sorted, distinct values), by products of presence matrices over some of the values at a time."""
    def coded(sets):
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        ok = known[at] == values
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[ok], at[ok]

    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(known):
        return out.astype(np.int64)
    (lr, lc), (rr, rc) = coded(left), coded(right)
    for low in range(0, len(known), width):
        pair = []
        for rows, columns, n in ((lr, lc, len(left)), (rr, rc, len(right))):
            some = (columns >= low) & (columns < low + width)
            m = np.zeros((n, min(width, len(known) - low)), np.float32)
            m[rows[some], columns[some] - low] = 1
            pair.append(m)
        out += pair[0] @ pair[1].T
    return out.astype(np.int64)


def _exact_nodes(percent: int, block: int = 512):
    """Links between left and right rows of different components of nodes or cells, by their full sets."""

    def work(table):
        node, rep, comp, is_left, is_right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "rep", "comp", "left", "right"))
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams").combine_chunks()] if table.num_rows else []
        size = np.array([len(g) for g in grams])
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(node)], strict=True):
            left, right = low + np.flatnonzero(is_left[low:high]), low + np.flatnonzero(is_right[low:high])
            for a in range(0, len(left), block):
                for b in range(0, len(right), block):
                    i, j = left[a : a + block], right[b : b + block]
                    both = intersections([grams[k] for k in i], [grams[k] for k in j])
                    ok = (both > 0) & (100 * both >= percent * (size[i][:, None] + size[j] - both)) & (comp[i][:, None] != comp[j])
                    x, y = np.nonzero(ok)
                    x, y = i[x], j[y]
                    one = np.unique(np.sort(np.stack([comp[x], comp[y]], axis=1), axis=1), axis=0, return_index=True)[1]  # a link of each two components
                    if len(one):
                        yield _pair_batch(rep[x[one]], rep[y[one]])

    return _by_node(work)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                ok = []
                for x, y in zip(b.column("grams_a"), b.column("grams_b"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    k = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[k] == x).sum()) if len(x) and len(y) else 0
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Join:
    """One run of the join: the tables that its steps share."""

    def __init__(self, spark, docs, percent, shingle, trees, picks, bound, depth, cell):
        self.spark, self.docs, self.percent, self.shingle, self.roots, self.picks, self.bound, self.depth, self.cell = spark, docs, percent, shingle, trees * picks, picks, bound, depth, cell
        self.scratch = Scratch(spark, "near")
        self.sets = self.scratch.write(docs.where("doc_id is not null").mapInArrow(_sketcher(shingle, trees, picks), _SETS))
        some = self.sets.where("n_shingles > 0")
        self.rows, ids = some.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
        self.classes = self.scratch.write(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), self.rows)
        own = some.join(self.classes, ["s1", "s2"]).where("doc_id = rep")
        self.shared = None
        if self.rows > ids:  # rows that share an id are linked
            own = own.dropDuplicates(["rep", "s1", "s2"])
            of = some.select("doc_id", "s1", "s2").join(self.classes, ["s1", "s2"])
            self.shared = self.scratch.write(of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b"))
        self.reps = self.scratch.write(own.select("rep", "n_shingles", "sketch", "roots"), self.rows)
        self.grams = self.labels = None
        self.n_grams = self.n_labels = 0  # their rows

    def nodes(self, rows: DataFrame, most: int) -> DataFrame:
        """rows (node, rep, n_shingles; at most so many) of nodes of two rows or more, with their number, the bytes of their full sets, and the sketch."""
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), (F.sum("n_shingles") * 8).alias("bytes")).where("n > 1")
        return self.scratch.write(rows.join(sizes, "node").join(self.reps.select("rep", "sketch"), "rep"), most)

    def labelled(self, rows: DataFrame, rep: str = "rep", comp: str = "comp") -> DataFrame:
        """With `comp`, the component of rep so far."""
        if self.labels is None:
            return rows.withColumn(comp, F.col(rep))
        labels = to_all(self.labels.select(F.col("v").alias(rep), F.col("c").alias(comp)), self.n_labels, BROADCAST_PAIRS)
        return rows.join(labels, rep, "left").withColumn(comp, F.coalesce(comp, rep))

    def apart(self, nodes: DataFrame) -> DataFrame:
        """With comp, `out` (whether a row is outside its node's largest component), and how many rows and bytes are."""
        rows = self.labelled(nodes)
        sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("k"), (F.sum("n_shingles") * 8).alias("size"))
        main = sizes.groupBy("node").agg(F.max(F.struct("k", "comp", "size")).alias("main"))
        return rows.join(main, "node").withColumns({"out": F.col("comp") != F.col("main.comp"), "n_out": F.col("n") - F.col("main.k"), "out_bytes": F.col("bytes") - F.col("main.size")}).drop("main")

    def in_tasks(self, nodes: DataFrame, first: bool) -> DataFrame:
        rows = self.labelled(nodes).select("node", "rep", "n_shingles", "comp", "sketch")
        return rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_nodes_in_task(self.percent, self.picks, self.depth, first), _PAIR if first else _MET)

    def in_cells(self, nodes: DataFrame) -> DataFrame:
        """Rows outside each node's largest component against all rows, in cells."""
        rows = self.apart(nodes).where("n_out > 0")
        blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / self.cell), F.ceil(F.col(size) / (HEAVY // 2)), F.lit(1)).cast("long")
        rows = rows.withColumns({"lows": blocks("n_out", "out_bytes"), "highs": blocks("n", "bytes"), "h": F.xxhash64("rep")})
        cell = lambda low, high, side: F.struct(F.xxhash64("node", low, high).alias("node"), F.lit(side).alias("side"))
        each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
        right = each("lows", lambda k: cell(k, F.pmod("h", "highs"), 1))
        left = F.when(F.col("out"), each("highs", lambda k: cell(F.pmod("h", "lows"), k, 0))).otherwise(F.array().cast("array<struct<node:bigint,side:int>>"))
        rows = rows.select(F.explode(F.concat(left, right)).alias("cell"), "rep", "n_shingles", "comp", "sketch").select("cell.*", "rep", "n_shingles", "comp", "sketch")
        return rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_cells_in_task(self.percent), _MET)

    def pivots(self, nodes: DataFrame, most: int, rounds: int = 2) -> DataFrame:
        """Link the rows (at most so many) of large nodes to some pivots of theirs; the nodes with what is then left (see `apart`).

        A pivot is the row of least hash, so that nodes of much the same rows have the same pivots."""
        left = None
        for _ in range(rounds):
            some = self.labelled(nodes) if left is None else left.where(f"out and n_out > {self.cell}")
            if left is not None and some.isEmpty():
                break
            least = some.groupBy("node").agg(*(F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)))
            least = least.select("node", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("pivot"))
            least = least.join(self.reps.select(F.col("rep").alias("pivot"), F.col("n_shingles").alias("p_shingles"), F.col("sketch").alias("p_sketch")), "pivot")
            least = self.scratch.write(self.labelled(least, "pivot", "p_comp"), most)
            met = some.select("node", "rep", "comp", "n_shingles", "sketch").join(least, "node").where("comp <> p_comp")
            self.confirm(met.mapInArrow(_like_pivots(self.percent), _PAIR), PIVOTS * most)
            self.scratch.drop(least, *([left] if left is not None else []))
            left = self.scratch.write(self.apart(nodes), most)
        return left

    def exact(self, small: DataFrame, celled: DataFrame | None) -> None:
        """Link what still lies in different components of a node."""
        rows = self.in_tasks(small, first=False)
        rows = self.scratch.write(rows if celled is None else rows.union(self.in_cells(celled)))
        found = rows.count()
        if not found:
            return
        self.fetch(rows.select(F.col("rep").alias("doc_id")), found)
        rows = self.labelled(rows).join(self.grams.withColumnRenamed("doc_id", "rep"), "rep").select("node", "rep", "comp", "left", "right", "grams")
        self.merge(rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_exact_nodes(self.percent), _PAIR))

    def fetch(self, ids: DataFrame, rows: int) -> None:
        """Have the full sets of these documents (ids at most so many, some of them several times)."""
        if self.grams is not None:
            ids = ids.join(to_all(self.grams.select("doc_id"), self.n_grams), "doc_id", "left_anti")
            if ids.isEmpty():
                return
        found = self.scratch.write(self.docs.join(to_all(ids, rows), "doc_id", "left_semi").mapInArrow(_full_sets(self.shingle), "doc_id long, grams binary"))
        self.grams = found if self.grams is None else self.grams.union(found)
        self.n_grams += found.count()

    def confirm(self, pairs: DataFrame, most: int) -> None:
        """Test these pairs (at most so many) on full sets, and bring the components up to date."""
        pairs = self.scratch.write(pairs.distinct(), most)
        rows = pairs.count()
        if rows:
            self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), 2 * rows)
            sure = self.grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a")).join(to_all(pairs, rows, BROADCAST_PAIRS), "a")
            sure = sure.join(self.grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b")), "b")
            self.merge(sure.select("a", "b", "grams_a", "grams_b").mapInArrow(_confirm(self.percent), _PAIR), rows)
        self.scratch.drop(pairs)

    def merge(self, edges: DataFrame, rows: int | None = None) -> None:
        before = self.labels
        if before is not None:
            edges = edges.union(before.select("v", "c"))
        self.labels = components(self.scratch, edges, rows and rows + self.n_labels)
        self.n_labels = self.labels.count()
        if before is not None:
            self.scratch.drop(before)

    def run(self) -> None:
        """Find `labels`: v and c, the component, of every representative that is linked with another (None: there is none)."""
        if self.shared is not None:
            self.merge(self.shared)
        most = self.rows * self.roots
        nodes = self.nodes(self.reps.select(F.explode("roots").alias("node"), "rep", "n_shingles"), most)
        small, celled = None, None
        both = lambda x, y: y if x is None else x.union(y)
        for level in range(self.depth + 1):
            fits = f"n <= {self.bound} and bytes <= {HEAVY}"
            small = both(small, nodes.where(fits))
            large = nodes.where(f"not ({fits})").select("node", "rep", "n_shingles", "n", "bytes", "sketch")
            rows = large.count()
            if not rows:
                break
            left = self.pivots(large, rows)
            branches = f"n_out > {4 * self.cell}" if level < self.depth else "false"
            celled = both(celled, left.where(f"not ({branches})").select(large.columns))
            on = left.where(branches)
            if on.isEmpty():
                break
            nodes = self.nodes(on.select("node", "rep", "n_shingles", "sketch").mapInArrow(_branch(self.picks), _NODE), self.picks * rows)
            most += self.picks * rows
        self.confirm(self.in_tasks(small, first=True), most)
        self.exact(small, celled)


def _components(spark: SparkSession, docs: DataFrame, percent: int, shingle: int, trees: int = 5, picks: int = 2, bound: int = 1 << 10, depth: int = 6, cell: int = 1 << 10) -> tuple[DataFrame, Scratch]:
    """What near_duplicates gives, and the tables that it is read from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    join = _Join(spark, docs, percent, shingle, trees, picks, bound, depth, cell)
    join.run()
    of = join.scratch.write(join.labelled(join.classes, comp="component_id").select("s1", "s2", "component_id"), join.rows)
    join.scratch.drop_others(join.sets, of)
    found = join.sets.select("doc_id", "n_shingles", "s1", "s2").join(of, ["s1", "s2"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").mapInArrow(_sketcher(shingle, 1, 1), _SETS).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return found.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), join.scratch


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80, shingle: int = 5, **how: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    how: trees, picks (of a node), bound (rows of a node that branches in a task), depth (levels), cell (rows of a side of a cell)."""
    return _components(spark, docs, percent, shingle, **how)[0]


def keep_first(spark: SparkSession, docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of docs, all columns, without those that are near-duplicates of a document with a smaller id; a doc_id stays once."""
    found, scratch = _components(spark, docs, percent, shingle)
    gone = Scratch(spark, "gone").write(found.where("not kept").select("doc_id").distinct())
    scratch.drop_others()
    once = docs.join(to_all(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    rows, ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if rows == ids:
        return once
    # of rows that share an id, the one with the least text
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    one = once.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), F.coalesce("text", F.lit("")))).alias("row"))
    return once.join(several, "doc_id", "left_anti").select(*docs.columns).union(one.select("row.*"))
