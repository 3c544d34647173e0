"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("brindle.llm")

from brindle.llm import collocations as phrases  # noqa: E402
from brindle.llm.queries import QUERIES  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000, least=10, percent=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], a)
        found = []
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not (most[p] and 100 * most[p] >= percent * a):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def some_rows(seed=1):
    rng = random.Random(seed)
    words = ["of", "The", "new", "York", "é", "zz", "in", "a", "b"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(400):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            text += " new york city hall; a a a a b"
        rows.append((rng.choice(["en", "fr", "en", None, "und"]), text if i % 17 else None))
    return rows + rows[:30]


@pytest.mark.parametrize("top, rank", [(2000, None), (20, 3), (5, 1), (1, 40)])
def test_collocations(spark, top, rank):
    """All phrases, and few of them with frontiers that must be expanded once and again; nulls, repeated rows, ties, words that overlap themselves."""
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, h1 string, n long").repartition(3)
    assert got(phrases.collocations(spark, df, top=top, rank=rank)) == brute(rows, top)


def test_low_thresholds(spark):
    rows = some_rows(2)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert got(phrases.collocations(spark, df, top=50, least=3, percent=80)) == brute(rows, 50, 3, 80)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Filters that let nearly all through only cost time."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 10)
    rows = some_rows(3)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert got(phrases.collocations(spark, df, top=30, least=2)) == brute(rows, 30, 2)


def test_scores_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(a, a + d, a + 3 * d) for a in (10, 3_037_000_500, 9_000_000_000_000_000) for d in (0, 1, 12345)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r.s for r in df.select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_filter(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 3000)
    held = phrases.make_filter(spark, spark.createDataFrame([(int(x),) for x in h[:1000]], "h long"), 1000).value.holds(h.view(np.uint64))
    assert held[:1000].all() and held[1000:].mean() < 0.05


def test_empty(spark):
    assert got(phrases.collocations(spark, spark.createDataFrame([], "lang string, text string"))) == []
    assert got(phrases.collocations(spark, spark.createDataFrame([("en", None), (None, "")], "lang string, text string"))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(QUERIES["op13_collocations"](spark, sf)) == brute(rows)
