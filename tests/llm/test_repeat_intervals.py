"""Byte repeats (interval trees) against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("brindle.llm")

from brindle.llm import repeat_intervals as intervals  # noqa: E402
from brindle.llm.queries import QUERIES  # noqa: E402

WINDOW = 60


def brute(rows, window):
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is left, by counting every window."""
    seen = Counter(b[i : i + window] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        over = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                over[i : i + window] = [True] * window
        runs = sum(1 for i, x in enumerate(over) if x and (i == 0 or not over[i - 1]))
        out.append((doc_id, len(raw), sum(over), runs, hashlib.sha256(bytes(b for b, x in zip(raw, over, strict=True) if not x)).hexdigest()))
    return sorted(out, key=repr)


def removed(df, **options):
    out = intervals.remove_repeats(df.sparkSession, df, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()), key=repr)


def some_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(1, 200)] for _ in range(rng.randint(0, 6)))
        if i % 7 == 0:
            text = "ab" * rng.randint(10, 100) + text  # repeats within one text, which overlap
        if i % 9 == 0:
            text = "".join(x if rng.random() > 0.01 else "z" for x in text)
        rows.append((i if i % 11 else None, text if i % 13 else None))
    return [*rows, *rows[:5]]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("options", [{}, {"contexts": 1}, {"contexts": 3, "piece": 500}])
def test_removed_bytes(spark, seed, options):
    """Nulls, empty texts, repeated rows, ties of hashes in periodic text; large grams by windows, small pieces."""
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(df, window=WINDOW, **options) == brute(rows, WINDOW)


def test_copies_near_copies_and_long_texts(spark, monkeypatch):
    """A passage in very many documents, a group of near copies, and a text of several chunks."""
    monkeypatch.setattr(intervals, "_CHUNK", 1 << 20)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, template = letters(700), letters(900)
    rows = [(i, letters(rng.randint(0, 500)) + passage + letters(200)) for i in range(40)]
    rows += [(100 + i, "".join(x if rng.random() > 0.004 else "#" for x in template)) for i in range(40)]
    rows += [(200, letters(2_300_000) + passage[:450]), (201, "x" * 5000), (202, letters(399)), (203, passage[100:499]), (204, passage[100:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df) == brute(rows, 400)
    assert removed(df, contexts=8) == brute(rows, 400)


@pytest.mark.parametrize("contexts", [1000, 2])
def test_groups_list_all_occurrences(spark, contexts):
    rows = [(i, t) for i, (_, t) in enumerate(some_rows(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = defaultdict(set)
    for r in intervals.repeat_groups(spark, df, WINDOW, contexts).collect():
        groups[r.group, r.length, r.n].add((r.doc_id, r.start))
    raw = {d: (t or "").encode() for d, t in rows}
    over = {d: [False] * len(b) for d, b in raw.items()}
    for (_, length, n), places in groups.items():
        found = {raw[d][s : s + length] for d, s in places}
        assert len(found) == 1 and length >= WINDOW and n == len(places) > 1
        text = found.pop()
        assert places == {(d, i) for d, b in raw.items() for i in range(len(b) - length + 1) if b[i : i + length] == text}
        for d, s in places:
            over[d][s : s + length] = [True] * length
    assert {d: sum(x) for d, x in over.items()} == {d: n for d, _, n, _, _ in brute(rows, WINDOW)}


def test_intervals_by_stack_scan():
    texts = sorted([b"banana", b"anana", b"nana", b"ana", b"na", b"a"])
    order, common = intervals._sorted_with_common(texts)
    found = {(length, texts[order[low]][:length], high - low) for length, low, high in intervals.intervals(common, 1)}
    assert found == {(1, b"a", 3), (3, b"ana", 2), (2, b"na", 2)}


def test_empty_and_clashing(spark):
    schema = "doc_id long, text string, key string, rank string, tag string, n string, spans string, wanted string"
    assert removed(spark.createDataFrame([], schema)) == []
    rows = [(1, "x" * 500, *"kktnsw"), (1, "y", *"kktnsw"), (None, None, *"kktnsw")]
    assert removed(spark.createDataFrame(rows, schema)) == brute([r[:2] for r in rows], 400)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op11_repeat_intervals"](spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, 400)
