"""Alignment of two tokenizers against brute force over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("brindle.llm")

from brindle.llm import token_alignment as alignment  # noqa: E402
from brindle.llm.queries import QUERIES, tokenizer  # noqa: E402

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tokens():
    """Whole texts to (ids, bytes) of both tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer(B))
    level = {c: i for i, c in enumerate(_byte_alphabet())}

    def of(text):
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return (x, [bytes(level[c] for c in a.id_to_token(i)) for i in x]), (y, [piece(i) for i in y])

    return of


def _byte_alphabet():
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(more)) for b in range(256)]


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows, tokens):
    found, held = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        (x, xs), (y, ys) = tokens(text)
        if b"".join(xs) != b"".join(ys) or b"".join(xs) != (" " + text).encode():
            found.append((doc_id, None))
            continue
        p, q = spans(xs), spans(ys)
        common = sorted({e for _, e in p} & {e for _, e in q})
        links = [(x[i], y[j]) for i, (s, e) in enumerate(p) for j, (t, f) in enumerate(q) if s < f and t < e]
        held.update(set(links))
        groups, low = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, z, strict=True) if low < e <= end) for ids, z in ((x, p), (y, q))))
            low = end
        found.append((doc_id, (len(x), len(y), groups, links)))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(held[z] == most[z[0]] for z in links), sum(held[z] for z in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows():
    rng = random.Random(4)
    parts = ["the", "Tokenization", " ", "  ", "\n", "\n\n", "\t", "é", "日本語", "don't", "1234567", " ", "　", " ", "\x1c", "<|endoftext|>", "<s>", "<0x41>", "...", "naïve", "🙂", "x" * 40, "­", "\x00", "ﬁ", "internationalisation"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    rows += [(None, "no id here"), (300, None), (301, ""), (302, " "), (303, "a "), (304, "a ▁ b"), (305, "▁"), (306, " lead"), (307, "end  "), (308, "same"), (308, "same"), (309, "ab" * 1500)]
    return rows


def got(df):
    assert df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment(spark, tokens, head):
    """With all counts in the tasks, with the most frequent ones, and with none."""
    rows = some_rows()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, pair string").repartition(3)
    assert got(alignment.align(spark, df, tokenizer(A), tokenizer(B), head)) == brute(rows, tokens)


def test_groups_are_given(spark):
    df = spark.createDataFrame([(1, "Tokenization"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in alignment.align(spark, df, tokenizer(A), tokenizer(B), groups=True).collect()}
    assert hashlib.sha256(out[1].groups.encode()).hexdigest() == out[1].groups_sha256
    assert out[1].groups.count(";") + 1 == out[1].n_groups and out[2].groups == ""


def test_forgets(tokens):
    few = alignment.Aligner(tokenizer(A), tokenizer(B), most=10)
    import pyarrow as pa

    for _, text in some_rows()[:60]:
        slots, first = few.slots(pa.array([text]))
        (x, _), (y, _) = tokens(text)
        assert few.sizes[slots, 0].sum() in (len(x), 0) and len(first) == 2


def test_galloping():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(60), rng.randint(0, 60))) for _ in range(2))
        assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted({*a} & {*b})]


def test_galloping_in_step():
    rng = random.Random(3)
    short, long, s_at, l_at, low = [], [], [0], [0], 0
    want = []
    for k in range(200):
        size = 400 if k % 50 == 0 else 30
        values = range(low, low + size)
        low += size
        a, b = sorted((sorted(rng.sample(values, rng.randint(0, size))) for _ in range(2)), key=len)
        want += [(len(short) + i, len(long) + j) for i, j in alignment.common_ends(a, b)]
        short += a
        long += b
        s_at.append(len(short))
        l_at.append(len(long))
    s_at, l_at = np.array(s_at), np.array(l_at)
    i, j = alignment.gallop(np.array(short), s_at[:-1], s_at[1:], np.array(long), l_at[:-1], l_at[1:])
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_empty(spark):
    assert alignment.align(spark, spark.createDataFrame([], "doc_id long, text string"), tokenizer(A), tokenizer(B)).collect() == []


def test_query(spark, sf, tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op12_token_alignment"](spark, sf)) == brute_fast(rows, tokens)


def brute_fast(rows, tokens):
    """As brute, with links found among neighbours only, for texts of full length."""
    cut = []
    for doc_id, text in rows:
        if not text:
            cut.append((doc_id, None))
            continue
        (x, xs), (y, ys) = tokens(text)
        if b"".join(xs) != b"".join(ys) or b"".join(xs) != (" " + text).encode():
            cut.append((doc_id, None))
            continue
        p, q = spans(xs), spans(ys)
        common = sorted({e for _, e in p} & {e for _, e in q})
        owner_a, owner_b = [None] * p[-1][1], [None] * p[-1][1]
        for z, owner in ((p, owner_a), (q, owner_b)):
            for k, (s, e) in enumerate(z):
                owner[s:e] = [k] * (e - s)
        links = [(x[i], y[j]) for i, j in sorted(set(zip(owner_a, owner_b, strict=True)))]
        ends_a, ends_b = [e for _, e in p], [e for _, e in q]
        groups, i, j = [], 0, 0
        for end in common:
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        cut.append((doc_id, (len(x), len(y), groups, links)))
    held = Counter(z for _, f in cut if f for z in set(f[3]))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = [(d, 0, 0, 0, 0, 0, 0, "") if f is None else (d, f[0], f[1], len(f[2]), len(f[3]), sum(held[z] == most[z[0]] for z in f[3]), sum(held[z] for z in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for d, f in cut]
    return sorted(out, key=repr)
