"""Collocations of two and three words, grown best first under score bounds.

Words are counted, then pairs of words that occur often enough each (membership is tested
in Bloom filters of bounded size, whose false positives the counts remove).  A pair is the
prefix of phrases of three words; since such a phrase occurs at most as often as its prefix
and as its last two words, its score is at most f(prefix) / f(first word): the prefix's
counts bound what can grow from it.  The frontier of pairs is expanded best first: each
round takes, of each language not settled, the prefixes whose bound is at least a floor,
and the pairs whose own score is, and counts their longer phrases in one pass over the
texts.  Above its floor a language is then known whole, ties included; it is settled once
`top` phrases survive there, or its floor is 0; otherwise the floor falls.

Counts are summed up within some megabytes of text before they are shuffled, sums of a
language's words, score levels and ranks within salted parts first, so that a language
with most of the rows is no bottleneck.  Phrases are known by 64-bit hashes of language
and words until they are ranked.

Defined results: a null text is empty; a null language is `und`; repeated rows count each.
Languages without a candidate have no row.  Arithmetic is in exact integers (products as
decimals of 38 digits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytewords import class_table, find_words, hash_spans, in_pieces, mix, texts_of
from .scratch import Scratch

MILLION = 1_000_000
FILTER_BITS = 1 << 29  # of a filter at most: 64 MB
_SALTS = 64
_PIECE = 4 << 20  # bytes of text that are counted together
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK, _SEPARATOR = class_table(_BREAKS), class_table(_BREAKS + b" \t")
_LOWER_KEY, _UPPER_KEY = np.uint64(0xD1342543DE82EF95), np.uint64(0xAEF17502108EF2D9)


class Filter:
    """A Bloom filter of 64-bit hashes, given as the words of its bits that are not zero."""

    def __init__(self, bits: int, slots: np.ndarray, words: np.ndarray):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[slots] = words.view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in range(_PROBES):
            at = _probe(h, k) & np.uint64(self.bits - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


_PROBES = 3


def _probe(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(20 * k)) ^ (h << np.uint64(7 * k + 3))


def make_filter(spark: SparkSession, hashes: DataFrame, n: int):
    """A filter of the hashes (one long column h, n rows), for all tasks; it has at most FILTER_BITS bits, however many rows there are."""
    bits = 1 << 10
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    h = F.col("h")
    probes = [F.shiftrightunsigned(h, 20 * k).bitwiseXOR(F.shiftleft(h, 7 * k + 3)).bitwiseAND(bits - 1) for k in range(_PROBES)]
    at = hashes.select(F.explode(F.array(*probes)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("word")).toArrow()
    return spark.sparkContext.broadcast(Filter(bits, rows.column("slot").to_numpy(), rows.column("word").to_numpy()))


def join_hash(a, b):
    """Of two numpy arrays of hashes, in order."""
    return mix(a * _LOWER_KEY + mix(b ^ _UPPER_KEY))


class _Words:
    """The words of a table of texts: hashes that know the language, and which words directly follow the one before."""

    def __init__(self, table: pa.Table):
        t = texts_of(table.column("text")).lower()
        self.t, self.w = t, find_words(t, _SEPARATOR)
        lang = table.column("lang").combine_chunks().dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        keys = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], np.uint64)
        self.lang = lang.indices.to_numpy()[self.w.text]
        self.h = mix(hash_spans(t.buf, self.w.start, self.w.end) ^ keys[self.lang])
        breaks = np.r_[0, np.cumsum(_BREAK[t.buf], dtype=np.int32)]
        text = self.w.text
        self.follows = np.r_[False, (text[1:] == text[:-1]) & (breaks[self.w.start[1:]] == breaks[self.w.end[:-1]])] if len(text) else np.zeros(0, bool)


def _counted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row is first, and how often it occurs."""
    key = columns[0]
    for c in columns[1:]:
        key = join_hash(key, c)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else order
    return order[first], np.diff(np.r_[first, len(key)])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _word_counts(batches):
    """Words with their numbers, and the number of all words of each language (h is null)."""
    for table in in_pieces(batches, at_most=_PIECE):
        words = _Words(table)
        at, n = _counted(words.h)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), _longs(words.h[at]), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])
        total = np.bincount(words.lang, minlength=len(words.langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words.langs, pa.string()), pa.nulls(len(total), pa.int64()), pa.array(total)], names=["lang", "h", "n"])


def _pair_counts(frequent):
    """Pairs of frequent words with their numbers; and each frequent word once (h2 is null)."""

    def run(batches):
        for table in in_pieces(batches, at_most=_PIECE):
            words = _Words(table)
            often = frequent.value.holds(words.h)
            second = np.flatnonzero(words.follows & often & np.r_[False, often[:-1]])
            at, n = _counted(words.h[second - 1], words.h[second])
            at = second[at]
            some = np.flatnonzero(often)
            one = some[_counted(words.h[some])[0]]
            raw = words.t.buf.tobytes()
            names = [raw[a:b].decode() for a, b in zip(words.w.start[one].tolist(), words.w.end[one].tolist(), strict=True)]
            lang = pa.array([words.langs[k] for k in words.lang[one].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([_longs(words.h[at - 1]), _longs(words.h[at]), pa.array(n.astype(np.int64)), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string())], names=_PAIR_NAMES)
            yield pa.RecordBatch.from_arrays([_longs(words.h[one]), pa.nulls(len(one), pa.int64()), pa.nulls(len(one), pa.int64()), lang, pa.array(names, pa.string())], names=_PAIR_NAMES)

    return run


_PAIRS = "h1 long, h2 long, n long, lang string, word string"
_PAIR_NAMES = ["h1", "h2", "n", "lang", "word"]


def _triple_counts(pairs, expanded):
    """Phrases of three words whose pairs are both frequent, one of them among those to expand."""

    def run(batches):
        for table in in_pieces(batches, at_most=_PIECE):
            h, follows = (words := _Words(table)).h, words.follows
            second = np.flatnonzero(follows)
            pair = join_hash(h[second - 1], h[second])
            often = pairs.value.holds(pair)
            second, pair = second[often], pair[often]
            grown = expanded.value.holds(pair)
            run = np.flatnonzero((np.diff(second) == 1) & (grown[1:] | grown[:-1])) + 1
            third = second[run]
            at, n = _counted(pair[run - 1], h[third])
            at = third[at]
            yield pa.RecordBatch.from_arrays([_longs(h[at - 2]), _longs(h[at - 1]), _longs(h[at]), pa.array(n.astype(np.int64))], names=["h1", "h2", "h3", "n"])

    return run


def _with_hash(batches):
    """The joint hash h of h1 and h2 besides."""
    for b in batches:
        h = join_hash(*(b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")))
        yield pa.RecordBatch.from_arrays([*b.columns, _longs(h)], names=[*b.schema.names, "h"])


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), in exact arithmetic."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(MILLION).cast("decimal(7,0)"), whole(left) * whole(right))


class Counts:
    """Totals of the languages, frequent words, and frequent pairs of words with their scores and bounds."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least: int):
        self.spark, self.least, self.scratch = spark, least, Scratch(spark, "phrases")
        self.texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        words = self.texts.mapInArrow(_word_counts, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
        words = self.scratch.write(words.where((F.col("h").isNull() & (F.col("n") > 0)) | (F.col("n") >= least)))
        self.totals = words.where("h is null").select("lang", "n")
        often = words.where("h is not null").select("h", "n")
        rows = self.texts.mapInArrow(_pair_counts(make_filter(spark, often.select("h"), often.count())), _PAIRS).groupBy("h1", "h2", "lang", "word").agg(F.sum("n").alias("n"))
        rows = self.scratch.write(rows.where(F.col("h2").isNull() | (F.col("n") >= least)))
        names = rows.where("h2 is null").select(F.col("h1").alias("h"), "lang", "word")
        self.words = self.scratch.write(often.join(names, "h"))
        one, two = self.words.select(F.col("h").alias("h1"), "lang", F.col("n").alias("l")), self.words.select(F.col("h").alias("h2"), F.col("n").alias("r"))
        pairs = rows.where("h2 is not null").select("h1", "h2", F.col("n").alias("a"))
        pairs = pairs.mapInArrow(_with_hash, "h1 long, h2 long, a long, h long").join(one, "h1").join(two, "h2")
        self.pairs = self.scratch.write(pairs.select("lang", "h", "h1", "h2", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"), F.call_function("div", F.col("a").cast("decimal(19,0)") * MILLION, F.col("l").cast("decimal(19,0)")).alias("bound")))
        self.known = make_filter(spark, self.pairs.select("h"), self.pairs.count())

    def floors(self, rank: int) -> DataFrame:
        """Of each language the score of its pair of that rank, or 0 where there are fewer."""
        levels = self.pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))  # scores are at most a million
        above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
        return levels.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= rank, F.col("score"))), F.lit(0)).alias("floor"))

    def grown(self, floors: DataFrame) -> DataFrame:
        """The frequent phrases of three words that score at least their language's floor or hold a pair that does."""
        chosen = self.pairs.join(floors, "lang").where("bound >= floor or score >= floor").select("h")
        expanded = make_filter(self.spark, chosen, chosen.count())
        counted = self.texts.mapInArrow(_triple_counts(self.known, expanded), "h1 long, h2 long, h3 long, n long").groupBy("h1", "h2", "h3").agg(F.sum("n").alias("a")).where(F.col("a") >= self.least)
        first = self.pairs.select("h1", "h2", "lang", F.col("l").alias("f1"), F.col("a").alias("f12"))
        last = self.pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("r").alias("f3"), F.col("a").alias("f23"))
        rows = counted.join(first, ["h1", "h2"]).join(last, ["h2", "h3"]).join(floors, "lang")
        rows = rows.withColumns({"s1": _score(F.col("a"), F.col("f1"), F.col("f23")), "s2": _score(F.col("a"), F.col("f12"), F.col("f3"))})
        by = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
        return self.scratch.write(rows.select("lang", "floor", "h1", "h2", "h3", "a", by("f1", "f12").alias("l"), by("f23", "f3").alias("r"), by("s1", "s2").alias("score")))

    def survivors(self, floors: DataFrame, percent: int) -> DataFrame:
        """The phrases at or above the floors that no longer one takes the place of."""
        longer = self.grown(floors)
        inside = longer.select("h1", "h2", "a").union(longer.select("h2", "h3", "a")).toDF("h1", "h2", "a").groupBy("h1", "h2").agg(F.max("a").alias("most"))
        pairs = self.pairs.join(floors, "lang").where("score >= floor").join(inside, ["h1", "h2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
        columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
        return self.scratch.write(pairs.withColumn("h3", F.lit(None).cast("long")).select(columns).union(longer.where("score >= floor").select(columns)))

    def named(self, rows: DataFrame) -> DataFrame:
        for k in (1, 2, 3):
            rows = rows.join(self.words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
        return rows.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))


def collocations(spark: SparkSession, docs: DataFrame, top: int = 2000, least: int = 10, percent: int = 50, rank: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases.

    least: how often a phrase must occur; percent: a phrase goes if one that holds it occurs
    in so many hundredths of its places; rank: that of the pair whose score is the first floor."""
    counts = Counts(spark, docs, least)
    rank = rank or 2 * top
    floors = counts.scratch.write(counts.floors(rank))
    settled = []
    while True:
        found = counts.survivors(floors, percent)
        enough = found.groupBy("lang").agg(F.count("*").alias("found"))
        state = counts.scratch.write(floors.join(enough, "lang", "left").select("lang", (F.col("floor") == 0) | (F.coalesce("found", F.lit(0)) >= top)).toDF("lang", "done"))
        settled.append(found.join(state.where("done").select("lang"), "lang"))
        if state.where("not done").isEmpty():
            break
        rank *= 4
        floors = counts.scratch.write(counts.floors(rank).join(state.where("not done").select("lang"), "lang"))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    rows = counts.named(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(counts.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
