"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams of 1
to 3 bytes that both have, over the root of the product of how many each has; n-grams
are those of the text with A-Z lower-cased and other ASCII turned to spaces, hashed to
2**16 bins.  A Nystroem map takes a text's kernels with `landmarks` training texts as
its features, and one-versus-rest kernel ridge regression on them scores the languages:
a batch of texts is scored by two matrix products.

The model is fitted on a bounded sample: at most `rows` labelled texts that have a
letter.  Languages share them evenly, and what small languages leave goes to the others,
so that a language of no more than its share keeps all its texts; within a language those
of least hash of doc_id are taken.  Of more than `rows` languages, those with the most texts
are learned.  The sample's features (not its texts) come to the driver, `rows * landmarks` numbers.

Defined results: null texts and texts without a letter are `und` with score 0; so is
every text when there is nothing to learn from; equal scores go to the language that
sorts first.  Repeated doc_ids count once in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import Texts, in_pieces, texts_of
from .scratch import Scratch

BINS = 1 << 16
_SEED, _PARTS = 20011, 1 << 40
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)

_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def presence(t: Texts, low: int, high: int) -> np.ndarray:
    """Flags of the bins that texts low:high have, one row a text."""
    a, b = int(t.offset[low]), int(t.offset[high])
    buf = _FOLD[t.buf[a:b]].astype(np.uint32)
    flags = np.zeros((high - low) * BINS, np.uint8)
    off = t.offset[low : high + 1] - a
    row = np.repeat(np.arange(high - low, dtype=np.int64) * BINS, np.diff(off))
    inside = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))  # bytes from here to the text's end
    code = np.zeros(len(buf), np.uint32)
    for n in (1, 2, 3):
        m = len(buf) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(256) + buf[n - 1 :]
        bins = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(16)
        at = row[:m] + bins
        flags[at if n == 1 else at[inside[:m] >= n]] = 1
    return flags.reshape(high - low, BINS)


def _rows_at_once(t: Texts, most: int = 192, most_bytes: int = 2 << 20):
    low = 0
    while low < len(t):
        high = min(low + most, max(low + 1, int(np.searchsorted(t.offset, t.offset[low] + most_bytes, "right")) - 1))
        yield low, high
        low = high


class Landmarks:
    def __init__(self, bins: list[bytes]):
        sets = [np.frombuffer(b, np.uint16) for b in bins]
        self.columns = np.unique(np.concatenate(sets))
        self.matrix = np.zeros((len(self.columns), len(sets)), np.float32)
        for k, s in enumerate(sets):
            self.matrix[np.searchsorted(self.columns, s), k] = 1 / np.sqrt(len(s))

    def kernels(self, flags: np.ndarray) -> np.ndarray:
        n = np.maximum(flags.sum(axis=1, dtype=np.int64), 1)
        return (flags[:, self.columns].astype(np.float32) @ self.matrix) / np.sqrt(n)[:, None].astype(np.float32)


class Model:
    """Languages in order and a weight of each landmark for each."""

    def __init__(self, marks: Landmarks, languages: list[str], weights: np.ndarray):
        self.marks, self.languages, self.weights = marks, languages, weights.astype(np.float32)

    def scores(self, t: Texts) -> np.ndarray:
        return self.evidence(t)[0]

    def evidence(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the languages, and the share of each text's n-grams that any landmark has."""
        out, known = np.zeros((len(t), len(self.languages)), np.float32), np.zeros(len(t))
        for low, high in _rows_at_once(t):
            flags = presence(t, low, high)
            out[low:high] = self.marks.kernels(flags) @ self.weights
            known[low:high] = flags[:, self.marks.columns].sum(axis=1, dtype=np.int64) / np.maximum(flags.sum(axis=1, dtype=np.int64), 1)
        return out, known


def _bins(batches):
    for table in in_pieces(batches):
        t, found = texts_of(table.column("text")), []
        for low, high in _rows_at_once(t):
            found += [np.flatnonzero(x).astype(np.uint16).tobytes() for x in presence(t, low, high)]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("doc_id", "lang")), pa.array(found, pa.binary())], names=["doc_id", "lang", "bins"])


def _kernel_rows(marks: Landmarks):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flags = np.zeros((part.num_rows, BINS), np.uint8)
                for k, x in enumerate(part.column("bins").to_pylist()):
                    flags[k, np.frombuffer(x, np.uint16)] = 1
                rows = [x.tobytes() for x in marks.kernels(flags)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(rows, pa.binary())], names=["lang", "k"])

    return run


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of `rows` each language gets: even shares, what some leave going to those that have more."""
    out, left = {}, rows
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], left // (len(counts) - k))
        left -= out[lang]
    return out


def _picked(spark: SparkSession, ids: DataFrame, rows: int) -> list:
    """At most `rows` of ids (doc_id, lang; no doc_id twice), with their place in the language by a hash."""
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return []
    # a threshold on the hash leaves somewhat more than the quota before anything is sorted
    share = [(lang, q, min(_PARTS, _PARTS * (2 * q + 64) // counts[lang])) for lang, q in quotas(counts, rows).items()]
    share = F.broadcast(spark.createDataFrame(share, "lang string, quota long, below long"))
    some = ids.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(_PARTS))).join(share, "lang").where("h < below")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return some.withColumn("turn", turn).where("turn <= quota").select("doc_id", "lang", "turn").collect()


def fit(spark: SparkSession, docs: DataFrame, rows: int = 4096, landmarks: int = 192, ridge: float = 1e-3) -> Model | None:
    """A model of docs (doc_id, text, lang); those held out are not looked at."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    scratch = Scratch(spark, "langid")
    turn = _picked(spark, scratch.write(known.groupBy("doc_id").agg(F.min(F.col("lang").cast("string")).alias("lang"))), rows)
    if not turn:
        return None
    picked = spark.createDataFrame([(r.doc_id,) for r in turn], "doc_id long")
    sample = known.join(F.broadcast(picked), "doc_id", "left_semi")
    sample = sample.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(_bins, "doc_id long, lang string, bins binary")
    sample = scratch.write(sample.groupBy("doc_id").agg(F.min(F.struct("lang", "bins")).alias("x")).select("doc_id", "x.lang", "x.bins"))
    place = {r.doc_id: (r.turn, r.lang) for r in turn}
    order = sorted(((place[r.doc_id], r.doc_id) for r in sample.select("doc_id").collect()))
    chosen = [k for _, k in order[:landmarks]]
    if not chosen:
        return None
    marks = {r.doc_id: r.bins for r in sample.where(F.col("doc_id").isin(chosen)).collect()}
    marks = Landmarks([marks[k] for k in chosen])
    found = sample.mapInArrow(_kernel_rows(marks), "lang string, k binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.k)))
    languages = sorted({r.lang for r in found})
    k = np.stack([np.frombuffer(r.k, np.float32) for r in found]).astype(np.float64)
    which = np.searchsorted(languages, [r.lang for r in found])
    share = len(found) / (len(languages) * np.bincount(which, minlength=len(languages)))[which]  # languages weigh the same
    own = marks.matrix.T.astype(np.float64) @ marks.matrix
    target = (which[:, None] == np.arange(len(languages))).astype(np.float64)
    left = (k * share[:, None]).T @ k + ridge * len(found) * own + 1e-6 * np.eye(len(own))
    return Model(marks, languages, np.linalg.solve(left, (k * share[:, None]).T @ target))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks * BINS

    def run(batches):
        names = pa.array([*sent.value.languages, "und"], pa.string())
        for table in in_pieces(batches):
            scores = sent.value.scores(texts_of(table.column("text")))
            best = scores.argmax(axis=1)
            known = table.column("letters").to_numpy()
            top = np.where(known, np.clip(scores[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), names.take(pa.array(np.where(known, best, len(names) - 1))), pa.array(top)], names=_OUT.names)

    return docs.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, _OUT)


def keep_known(docs: DataFrame, model: Model | None, least: float, known: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose text has a letter, a language of score `least` or more, and a share of `known` n-grams that landmarks have; all rows with a letter where there is no model.

    Scores add up to about 1 for any text in familiar letters, and are low for texts of a word; the share of known n-grams tells random letters and foreign scripts (0.1 to 0.5) from short clean texts (nearly 1)."""
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if model is None:
        return lettered
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for table in in_pieces(batches):
            scores, share = sent.value.evidence(texts_of(table.column("text")))
            yield from table.filter(pa.array((scores.max(axis=1) >= least) & (share >= known))).to_batches()

    return lettered.mapInArrow(run, docs.schema)
