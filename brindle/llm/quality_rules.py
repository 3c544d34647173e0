"""Quality rules as a learned decision list.

Statistics of every whole text are counted in one pass.  From those of labelled texts a
sequential covering learns rules for low quality: a conjunction of thresholds grows by
information gain on two thirds of the rows, loses trailing conditions while that helps
on the other third, is kept if it is precise there, and the rows it covers leave.
The rules become one ordered Spark conditional expression, first match first.

Learning takes at most `rows` labelled texts (by a hash of doc_id); only their numbers
come to the driver.  Defined results: null texts have no words, lines or symbols;
labels without a value are not learned from, of repeated labels the lowest counts;
without labelled rows of both kinds there are no rules and every text is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACE, class_table, find_words, hash_spans, in_pieces, mix, texts_of, window_hashes, window_starts
from .sampling import bounded_sample

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
_SYMBOLS, _MARKS = class_table(b"#*$%&|<>"), class_table(b"!?")
_UPPER, _DIGITS = class_table(bytes(range(65, 91))), class_table(bytes(range(48, 58)))

#: What rules may test: a name and the Spark expression of it.
FEATURES: dict[str, Column | str] = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}


def counts(table: pa.Table) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    t = texts_of(table.column("text"))
    w = find_words(t, SPACE)
    n, text = len(t), w.text
    within = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][t.offset])
    lead = np.r_[0, np.cumsum((t.buf & 0xC0) != 0x80)]
    out = {"n_words": np.diff(w.first), "word_chars": np.bincount(text, lead[w.end] - lead[w.start], n).astype(np.int64), "n_symbols": within(_SYMBOLS[t.buf]), "n_upper": within(_UPPER[t.buf]), "n_digits": within(_DIGITS[t.buf]), "n_marks": within(_MARKS[t.buf])}
    # lines with a word
    newline = np.flatnonzero(t.buf == 10)
    start = np.union1d(t.offset[:-1], newline + 1)
    start = start[start < len(t.buf)]
    end = np.r_[start[1:], len(t.buf)]
    words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    start, end = start[words > 0], end[words > 0]
    end = end - (t.buf[end - 1] == 10)
    home = np.searchsorted(t.offset, start, "right") - 1
    key = mix(hash_spans(t.buf, start, end) ^ mix(home.astype(np.uint64) + np.uint64(1)))
    out["n_lines"] = np.bincount(home, minlength=n)
    out["n_dup_lines"] = np.bincount(home[pd.Series(key).duplicated().to_numpy()], minlength=n)
    # words in 3-word windows that come twice
    at = window_starts(w.first, 3)
    key = mix(window_hashes(hash_spans(t.buf, w.start, w.end), 3)[at] ^ mix(text[at].astype(np.uint64) + np.uint64(1))) if len(at) else np.zeros(0, np.uint64)
    again = at[pd.Series(key).duplicated(keep=False).to_numpy()]
    step = np.zeros(len(w) + 1, np.int64)
    step[again] += 1
    step[again + 3] -= 1
    out["n_repeat_words"] = np.bincount(text[np.cumsum(step)[:-1] > 0], minlength=n)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of docs."""

    def run(batches):
        for table in in_pieces(batches):
            found = counts(table)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _holds(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.test(x) for c in rule), np.ones(n, bool))


def _best_condition(x, bad, inside) -> tuple[float, Condition | None]:
    """The condition of most FOIL gain among rows `inside` a rule so far."""
    p0, n0 = int(bad[inside].sum()), int(inside.sum())
    best: tuple[float, Condition | None] = (1e-9, None)
    for name in FEATURES:
        order = np.argsort(x[name][inside], kind="stable")
        value, hit = x[name][inside][order], bad[inside][order]
        edge = np.flatnonzero(value[1:] != value[:-1])
        if not len(edge):
            continue
        below_p, below_n = np.cumsum(hit)[edge], edge + 1
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0 / n0))
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, float((value[edge[k]] + value[edge[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.9, least: int = 5) -> list[list[Condition]]:
    """Rules for `bad`, in order. turn: a pseudo-random integer of each row; every third row prunes."""
    n = len(bad)
    grow, left, rules = turn % 3 != 0, np.ones(n, bool), []
    while len(rules) < max_rules and bad[left & grow].any():
        inside, rule = left & grow, []
        while len(rule) < max_conditions and not bad[inside].all():
            _, c = _best_condition(x, bad, inside)
            if c is None:
                break
            rule.append(c)
            inside = inside & c.test(x)

        def worth(r, rows=left & ~grow):
            covered = _holds(r, x, n) & rows
            p = int(bad[covered].sum())
            return (2 * p - int(covered.sum())) / max(1, int(covered.sum()))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = _holds(rule, x, n) & left
        if not rule or covered.sum() < least or bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(stats: DataFrame, labels: DataFrame, rows: int = 20_000, **how) -> list[list[Condition]]:
    """Rules from stats and labels (doc_id, quality: 0 is low)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = stats.join(known, "doc_id").select(F.xxhash64("doc_id").alias("turn"), *COUNTS, "quality", *(F.expr(e).alias(f"f_{k}") for k, e in FEATURES.items()))
    found = bounded_sample(some, "turn", rows).toPandas()
    bad = (found["quality"] == 0).to_numpy()
    if not len(found) or bad.all() or not bad.any():
        return []
    return learn({k: found[f"f_{k}"].to_numpy(np.float64) for k in FEATURES}, bad, np.abs(found["turn"].to_numpy() >> 8), **how)


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as a Spark expression: false where a rule fires, true at its end."""
    found = None
    for r in rules:
        fires = reduce(lambda a, b: a & b, (c.column() for c in r))
        found = F.when(fires, False) if found is None else found.when(fires, False)
    return F.lit(True) if found is None else found.otherwise(True)


def fired(rules: list[list[Condition]]) -> Column:
    """The first rule that fires, as text; null if none does."""
    found = None
    for r in rules:
        fires, name = reduce(lambda a, b: a & b, (c.column() for c in r)), " and ".join(map(str, r))
        found = F.when(fires, name) if found is None else found.when(fires, name)
    return F.lit(None).cast("string") if found is None else found
