"""Language ID against plain Python: n-grams, sample, landmarks, kernels and ridge regression, each found another way."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

pytest.importorskip("brindle.llm")

from brindle.llm import langid  # noqa: E402
from brindle.llm.queries import QUERIES  # noqa: E402


def _letters(text):
    return text is not None and regex.search(r"\p{L}", text) is not None


def _grams(text: str) -> frozenset[int]:
    """The hashed bins of a text's n-grams, one gram at a time."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    seen = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    return frozenset(((int.from_bytes(g, "big") + (len(g) << 24)) * 2654435761 % 2**32) >> 16 for g in seen)


def _place(doc_id: int) -> int:
    """Spark's xxhash64 of the id and the seed, each value seeding the next."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", 20011), first)
    return (h - 2**64 if h >= 2**63 else h) % 2**40


def _kernel(a, b):
    return len(a & b) / (max(len(a), 1) * max(len(b), 1)) ** 0.5


class Brute:
    def __init__(self, rows, limit=4096, landmarks=192, ridge=1e-3):
        best = {}
        for doc_id, text, lang in rows:
            if doc_id is None or lang is None or zlib.crc32(str(doc_id).encode()) % 5 == 0 or not _letters(text):
                continue
            grams = _grams(text)
            at = (lang, np.array(sorted(grams), np.uint16).tobytes(), grams)
            if doc_id not in best or at[:2] < best[doc_id][:2]:
                best[doc_id] = at
        by_lang = defaultdict(list)
        for doc_id, (lang, *_) in best.items():
            by_lang[lang].append((_place(doc_id), doc_id))
        left, turn, todo = limit, {}, sorted(by_lang, key=lambda x: (len(by_lang[x]), x))
        for k, lang in enumerate(todo):
            take = min(len(by_lang[lang]), left // (len(todo) - k))
            left -= take
            for n, (_, doc_id) in enumerate(sorted(by_lang[lang])[:take]):
                turn[doc_id] = (n, lang)
        chosen = sorted(turn, key=lambda d: (turn[d], d))[:landmarks]
        self.marks = [best[d][2] for d in chosen]
        self.languages = sorted({best[d][0] for d in turn})
        texts = [best[d] for d in sorted(turn)]
        k = np.array([[_kernel(t[2], m) for m in self.marks] for t in texts])
        size = Counter(t[0] for t in texts)
        weigh = np.sqrt([len(texts) / (len(self.languages) * size[t[0]]) for t in texts])
        own = np.array([[_kernel(a, b) for b in self.marks] for a in self.marks])
        values, vectors = np.linalg.eigh(own)
        root = (vectors * np.sqrt(np.maximum(values, 0))).T  # root.T @ root is the landmarks' kernel
        target = np.array([[float(t[0] == x) for x in self.languages] for t in texts])
        # ridge regression as least squares with rows for the penalties, not by normal equations
        rows = np.concatenate([k * weigh[:, None], (ridge * len(texts)) ** 0.5 * root, 1e-3 * np.eye(len(own))])
        goal = np.concatenate([target * weigh[:, None], np.zeros((2 * len(own), len(self.languages)))])
        self.weights = np.linalg.lstsq(rows, goal, rcond=None)[0]
        self.covered = frozenset().union(*self.marks)

    def scores(self, text):
        grams = _grams(text)
        return np.array([_kernel(grams, m) for m in self.marks]) @ self.weights, len(grams & self.covered) / max(len(grams), 1)


def _same(brute, rows, got):
    """Predictions are the best language, or one as good to the precision of single floats; scores agree."""
    for doc_id, text, lang, score in ((*r, *got[r[0]]) for r in rows):
        if not _letters(text):
            assert (lang, score) == ("und", 0.0), doc_id
            continue
        want = brute.scores(text)[0]
        assert lang in brute.languages and want[brute.languages.index(lang)] > want.max() - 2e-3, doc_id
        assert abs(score - min(max(want.max(), 0), 1)) < 2e-3, doc_id


def _rows(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_presence_is_the_set_of_hashed_grams():
    import pyarrow as pa

    from brindle.llm.bytewords import texts_of

    texts = ["", "a", "AB", "Ab c", "aaaa", "é1é2", "\x00\x7f~", "день и ночь", "x" * 1000]
    flags = langid.presence(texts_of(pa.chunked_array([pa.array(texts)])), 0, len(texts))
    assert [frozenset(map(int, np.flatnonzero(f))) for f in flags] == [_grams(t) for t in texts]


def test_query(spark, sf):
    rows = _rows(spark, sf)
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in QUERIES["op9_language_id"](spark, sf).collect()}
    assert {d: g[2] for d, g in got.items()} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    _same(Brute(rows), [r[:2] for r in rows], {d: g[:2] for d, g in got.items()})


def test_small_samples_and_repeated_ids(spark, sf):
    """A bounded sample, fewer landmarks than texts, and ids that are there again with another language or text."""
    rows = _rows(spark, sf)
    langs = sorted({r[2] for r in rows if r[2]})
    more = [(d, t, langs[0]) for d, t, lang in rows[:40] if lang] + [(d, "zweimal " + (t or ""), lang) for d, t, lang in rows[40:60]]
    more += [(None, "no id", langs[1]), (10**12, None, langs[1]), (-(2**63), "minus infinity", langs[1]), (2**63 - 1, "...", langs[1])]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    model = langid.fit(spark, docs, rows=90, landmarks=24)
    brute = Brute(rows + more, 90, 24)
    assert model.languages == brute.languages and len(brute.marks) == 24
    assert {int(x) for x in model.marks.columns} == set(brute.covered)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    _same(brute, [r[:2] for r in rows], got)


def test_ties_go_to_the_first_language(spark):
    marks = langid.Landmarks([np.array(sorted(_grams("same text")), np.uint16).tobytes()])
    model = langid.Model(marks, ["aa", "bb", "cc"], np.array([[0.25, 0.5, 0.5]]))
    got = langid.predict(spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "12"), (4, None)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in got} == {1: ("bb", 0.5), 2: ("bb", 0.5), 3: ("und", 0.0), 4: ("und", 0.0)}


def test_pipeline_stage(spark, sf):
    import corpus_pipeline

    rows = _rows(spark, sf)
    brute = Brute(rows)
    found = {d: brute.scores(t) for d, t, _ in rows if _letters(t)}
    near = {d for d, (s, share) in found.items() if abs(s.max() - corpus_pipeline.MIN_SCORE) < 2e-3 or abs(share - corpus_pipeline.MIN_KNOWN) < 1e-6}
    want = {d for d, (s, share) in found.items() if s.max() >= corpus_pipeline.MIN_SCORE and share >= corpus_pipeline.MIN_KNOWN}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert len(near) < 3 and kept - near == want - near
