"""Operators of the llm subpackage against brute force, round trips and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import same_as_sql
from pyspark.sql import functions as F

pytest.importorskip("brindle.llm")

from brindle.llm import bytewords, components, decontaminate, langid, near_dedup, quality_rules, quotations, sentence_pieces, substring_dedup, token_counts, token_records, url_filter  # noqa: E402
from brindle.llm.queries import ORACLE_SQL, QUERIES, SPACE_WORDS, tokenizer  # noqa: E402
from brindle.llm.sampling import bounded_sample  # noqa: E402
from brindle.llm.scratch import Scratch  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, near copies, and columns with names that operators use."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (60, 80, 40, 200)]
    near = base[1].split()
    near[5] = "changed"
    shared = base[3].split()[50:80]
    rows = [
        (1, base[0]), (2, base[0]), (2, base[0]), (3, base[1]), (4, " ".join(near).upper()), (5, ""), (6, None), (7, " \n\t "), (8, "one two"), (9, "one two"), (10, "One  two"),
        (11, base[2]), (12, base[3]), (13, "\n".join(["x y z"] * 30)), (None, base[0]), (None, None), (14, "start " + " ".join(shared) + " end"), (15, " ".join(shared[:12])),
        (16, " ".join(shared[3:16]) + " tail " + base[2]), (12, "another text with the same id " + base[1]), (17, " ".join(rng.choice(vocabulary) for _ in range(6000))), (18, "é ñ 日本 \u00a0 x"),
    ]
    schema = "doc_id long, text string, lang string, part string, rep string, node string, n_words string, n_chars long, kept_text string"
    return spark.createDataFrame([(*r, "xx", "p", "r", "n", "w", len(r[1] or ""), "k") for r in rows], schema).repartition(3)


# word scanning


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\tabAé.,日0") for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", "x" * 3_000_000 + " y", "a", "a"]
    column = pa.array([*texts, None])
    for table, find, lower in ((bytewords.SPACE, words, False), (bytewords.PUNCT, bench_words, True)):
        t, w, h = bytewords.words_hashed(column, table, lower)
        got = [t.buf[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
        want = [find(x) for x in [*texts, None]]
        assert got == [x for ws in want for x in ws]
        assert np.diff(w.first).tolist() == [len(x) for x in want]
        same = {}
        for word, value in zip(got, h.tolist(), strict=True):
            assert same.setdefault(word, value) == value
        assert len(set(same.values())) == len(same)
    sliced = bytewords.texts_of(pa.array(["aa", "b", "cc"]).slice(1))
    assert sliced.buf.tobytes() == b"bcc" and sliced.offset.tolist() == [0, 1, 3]
    assert bytewords.texts_of(pa.chunked_array([], pa.string())).offset.tolist() == [0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.v: r.c for r in components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for e in edges if e[0] != e[1] for v in e}
    assert components.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# 1 quotation linking


def test_quotation_parsing():
    clean, found = quotations.parse("> > Old  text\n>> more\n> Reply\n\nMine\nhere\n\n> \nend\n")
    assert clean == "\nMine\nhere\n\nend".strip("\n")
    assert found == [(2, "old text more"), (1, "reply"), (0, "mine here"), (0, "end")]


def test_quotation_links(spark):
    rows = [(1, 0, "Hello all"), (1, 1, "> Hello all\nAnswer one"), (1, 2, ">> Hello all\n> Answer one\n\nAnswer two"), (1, 3, "> hello   ALL\nLate answer"), (2, 0, "> Answer two\nElsewhere"), (1, 4, "> Never said\nNew"), (3, 0, None), (None, 1, "> Hello all"), (3, 1, ""), (3, 1, "> Hello all")]
    found = quotations.conversations(spark, spark.createDataFrame(rows, "scope long, place long, text string")).collect()
    out = {(r.scope, r.place, r.clean_text): r for r in found}
    to = {k: (r.to_scope, r.to_place, r.root_scope, r.root_place, r.depth) for k, r in out.items()}
    assert len(found) == len(rows) and to[3, 1, ""] == (1, 0, 1, 0, 1)
    assert to[1, 1, "Answer one"] == (1, 0, 1, 0, 1) and to[1, 2, "Answer two"] == (1, 1, 1, 0, 2) and to[1, 3, "Late answer"] == (1, 0, 1, 0, 1)
    assert to[2, 0, "Elsewhere"][:2] == (None, None)  # what it quotes is not earlier
    assert to[1, 4, "New"] == (None, None, 1, 4, 0) and to[3, 0, ""][4] == 0 and to[None, 1, ""] == (None, None, None, None, 0)
    empty = spark.createDataFrame([], "scope long, place long, text string")
    assert quotations.conversations(spark, empty).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)] + [(2, 0, "alone")]
    out = quotations.conversations(spark, spark.createDataFrame(rows, "scope long, place long, text string")).collect()
    assert {(r.scope, r.place): (r.root_place, r.depth) for r in out} == {(1, i): (0, i) for i in range(40)} | {(2, 0): (0, 0)}


# 2 pieces


def _brute_pieces(p, text, n):
    s = "▁" + text.replace(" ", "▁") if text else ""
    look = {p.text[i]: (int(x), int(i)) for i, x in zip(p.ids, p.scores, strict=True)}
    out = []

    def go(i, score, key, ids):
        if i == len(s):
            out.append((-score, tuple(reversed(key)), ids))
            return
        if s[i] not in look:
            go(i + 1, score + int(p.unknown_score), (*key, -1), ids + p.bytes_of(ord(s[i])))
        for size in range(1, p.longest + 1):
            x = s[i : i + size]
            if len(x) == size and x in look:
                go(i + size, score + look[x][0], (*key, -size), [*ids, look[x][1]])

    go(0, 0, (), [])
    out.sort()
    return [(-a, ids) for a, _, ids in out[:n]]


def test_pieces_are_the_n_best():
    p = sentence_pieces.pieces_of(tokenizer("piece_bpe_32k.model"))
    texts = ["", "a", "the of", " hi  you", "éa ñ\nx", "\n\n a", "日本 𝒳", "abc def", "\t", "on the on"]
    _, ids, at, score, many = sentence_pieces.encode_table(p, pa.chunked_array([pa.array(texts)]), 4)
    for k, text in enumerate(texts):
        want = _brute_pieces(p, text, 4)
        real = [float(-(-s // (1 << 20))) for s, _ in want]
        assert ids[at[k] : at[k + 1]].tolist() == want[0][1] and many[k][: len(real)] == real and score[k] == real[0]
    for chunk in ("▁thntti", "▁ereading", "▁éeaux"):
        codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        assert sentence_pieces.Lattice(p, codes, np.array([0, len(codes)])).n_best(0, 6) == _brute_pieces(p, chunk[1:], 6)


def test_pieces_round_trip(spark, odd):
    model = tokenizer("piece_bpe_32k.model")
    out = sentence_pieces.encode(odd, model).cache()
    assert out.count() == odd.count() and out.where("not round_trip").count() == 0
    back = sentence_pieces.decode(out.where("doc_id is not null"), model)
    have = Counter((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect() if r.doc_id is not None)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == have
    nothing = out.where("doc_id = 6").first()
    assert nothing.ids == [] and nothing.score == 0 and nothing.nbest_scores == [0]
    assert sentence_pieces.encode(odd.where("false"), model).count() == 0


# 3 token counts


def test_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, "en", "t1", None)], "source string, lang string, tokenizer string, n long")
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.apply("1", token_counts.insert(rows, F.col("n"))) and not r.apply("1", token_counts.insert(rows, F.col("n")))
    r.apply("2", token_counts.delete(rows.where("n = 5"), F.col("n")))
    r.apply("3", token_counts.revise(rows.where("n = 7"), F.col("n"), F.lit(9)))
    (tmp_path / "r" / "half").mkdir()
    want = {("a", 1, 9), (None, 1, 0)}
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()} == want
    small = r.compact(str(tmp_path / "s"), ["1", "2"])
    assert {(x.source, x.n_docs, x.n_tokens) for x in small.totals().collect()} == want
    assert not small.apply("2", token_counts.delete(rows, F.col("n"))) and small.batches() == ["1", "2", "3", "base"]
    r.apply("4", token_counts.delete(rows.where("source is null"), F.col("n")))
    assert r.totals().count() == 1
    r.apply("5", token_counts.insert(rows.where("false"), F.col("n")))
    assert r.totals().count() == 1


# 4 quality rules


def _stats(text):
    w, seen, again = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    windows, over = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            over |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(over)


def test_statistics(spark, odd):
    texts = [r.text for r in odd.select("text").collect()] + ["a b\na b\r\na b", "###\n\n###\n|", "\nx\n\nx\nx ", "a b c a b c", "a a a a"]
    got = quality_rules.counts(pa.table({"text": pa.array(texts)}))
    assert [tuple(int(got[c][i]) for c in quality_rules.COUNTS[:5]) for i in range(len(texts))] == [_stats(t) for t in texts]
    assert quality_rules.statistics(odd.where("false")).count() == 0


def test_learned_rules(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality_rules.statistics(docs).cache()
    rules = quality_rules.fit(stats, labels)
    judged = stats.withColumn("kept", quality_rules.verdict(rules)).withColumn("rule", quality_rules.fired(rules)).join(labels, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in judged)
    assert rules and right >= 0.9 * len(judged)
    assert all((r.rule is None) == r.kept for r in judged)
    none = quality_rules.fit(stats, labels.where("false"))
    assert none == [] and stats.where(~quality_rules.verdict(none)).count() == 0


def test_learning_finds_a_planted_conjunction():
    rng = np.random.default_rng(1)
    x = {k: rng.random(3000) for k in quality_rules.FEATURES}
    bad = ((x["symbols_per_word"] > 0.7) & (x["repeated_words"] > 0.5)) | (x["upper_per_char"] > 0.9)
    rules = quality_rules.learn(x, bad, rng.integers(0, 1 << 30, 3000))
    found = np.zeros(3000, bool)
    for r in rules:
        found |= quality_rules._holds(r, x, 3000)
    assert (found == bad).mean() > 0.98


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("turn"), "id")
    df = df.union(df.where("id < 2000"))
    some = bounded_sample(df, "turn", 300).collect()
    by_turn = sorted((r.turn % (1 << 40), r.id) for r in df.distinct().collect())
    assert sorted((r.turn % (1 << 40), r.id) for r in some) == by_turn[:300]
    assert bounded_sample(df, "turn", 9000).count() == 5000 and bounded_sample(df.where("false"), "turn", 5).count() == 0


# 5 url filters


def _url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def test_urls(spark):
    from brindle.llm.queries import URL_RULES

    urls = ["http://A.Example.ORG/es/1?x=/en/", "https://example.org/en/12#a", "https://example.org/en/2", "http://x.com/de/", "http://x.com", "http://com/fr/", "http://notexample.org/es/", "no scheme", None, "", "a://b://c/d", "http://user@h.com:80/fr/x", "http://x.org", "http://É.org/a\nb"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").crossJoin(spark.createDataFrame([("x", "y")], "host string, rule string"))
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    for k, u in enumerate(urls):
        assert (got[k].host, got[k].path) == _url(u)
        fits = [(len(t), t, v) for t, v in URL_RULES for h, _, rest in [t.partition("/")] if (got[k].host == h or got[k].host.endswith("." + h)) and got[k].path.startswith("/" + rest)]
        if fits:
            assert (got[k].rule, got[k].verdict) == max(fits)[1:]
        else:
            assert got[k].rule is None and got[k].verdict in ("allow", "block")
    assert url_filter.judge(pages.where("false"), URL_RULES).count() == 0


def test_url_model_generalises(spark, sf):
    rng = random.Random(2)
    make = lambda bad: f"http://{rng.choice('abcdef')}{rng.randint(0, 999)}.{'cheap-pills' if bad else 'library'}.net/{rng.randint(0, 99)}"
    rows = [(make(i % 2 == 0), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, blocked boolean").select(url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"), "blocked")
    out = url_filter.classify(df.limit(200), df.limit(100)).collect()
    assert all((r.p_block > 0.5) == r.blocked for r in out)
    one = url_filter.classify(df, df.where("blocked")).select("p_block").distinct().collect()
    assert [r.p_block for r in one] == [1.0]


# 6 records


def test_chunks_encode_like_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, chunks = Tokenizer.from_file(path), token_records.Chunks(path, most=200)
    rng = random.Random(1)
    texts = ["", "a", "  a  b\n\n c", "a\tb", "don't it's  'll", "a<|endoftext|> b", " a\x1c b", "1 2  3\r\n4 ", "  ", "a   b"] + ["".join(rng.choice(" \n\t \u00a0\u3000ab1'é.$\r\x0b") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for some in (texts[:1500], texts[1500:], texts[:10]):
        ids, at = chunks.encode(pa.chunked_array([pa.array(some)]))
        for i, t in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_records(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = token_records.write_records(spark, odd, path, 0, str(tmp_path / "records"))
    rows = sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = Counter(), 0
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, token_records.read_records(spark, manifest).collect())) == want
    file = manifest.where("n_docs > 1").first()
    listed = list(token_records.records_of(file.path, at_most=100))
    for k in (0, len(listed) - 1):
        d, ids = token_records.record_at(file.path, k)
        assert d == listed[k][0] and ids.tolist() == listed[k][1].tolist()
    raw = bytearray(open(f"{file.path}.rec", "rb").read())
    raw[20] ^= 1
    open(f"{file.path}.rec", "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(token_records.records_of(file.path))
    assert token_records.read_records(spark, token_records.write_records(spark, odd.where("false"), path)).count() == 0


# 7 substring dedup


def _brute_repeats(rows, k):
    first = {}
    rank = lambda d: float("inf") if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, float("inf")), rank(d))
    out = Counter()
    for d, t in rows:
        w, over = words(t), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < rank(d):
                over |= set(range(i, i + k))
        out[d, len(w), len(over), " ".join(x for i, x in enumerate(w) if i not in over)] += 1
    return out


def test_substring_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for window in (13, 4):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(spark, odd, window).collect())
        assert got == _brute_repeats(rows, window)
    cut = substring_dedup.cut_repeats(spark, odd)
    assert cut.schema == odd.schema and cut.count() == len(rows)
    assert cut.where("doc_id = 1").first().text == odd.where("doc_id = 1").first().text and cut.where("doc_id = 6").first().text is None
    assert substring_dedup.remove_repeats(spark, odd.where("false")).count() == 0


def test_substring_dedup_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in _brute_repeats(rows, 13).elements())
    assert Counter(map(tuple, QUERIES["op7_substring_dedup"](spark, sf).collect())) == want


# 8 decontamination


def _brute_hits(docs, items, k=10):
    windows = {}
    for name, t in items:
        w = bench_words(t)
        n = min(k, len(w))
        for i in range(len(w) - n + 1) if w and name is not None else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = Counter()
    for d, t in docs:
        w, over, names = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    names |= found
                    over |= set(range(i, i + n))
        out[d, len(w), len(over), tuple(sorted(names))] += 1
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_decontamination(spark, odd, block_words):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    long = next(t for d, t in docs if d == 12 and not t.startswith("another"))
    items = [(1, " ".join(long.split()[10:60])), (2, "One, TWO!"), (3, ""), (4, None), (5, "not there at all"), (6, "one"), (None, "one two"), (7, " ".join(long.split()[20:35])), (8, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_hits(spark, odd, bench, block_words=block_words)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect()) == _brute_hits(docs, items)
    clean = decontaminate.remove_affected(spark, odd, bench, block_words=block_words)
    assert clean.schema == odd.schema and clean.count() == sum(n for (_, _, hit, _), n in _brute_hits(docs, items).items() if not hit)
    assert decontaminate.find_hits(spark, odd, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(spark, odd.where("false"), bench).count() == 0


def test_longest_matches(spark):
    text = "x " + " ".join(f"w{i}" for i in range(40)) + " y"
    bench = spark.createDataFrame([(1, "q " + " ".join(f"w{i}" for i in range(5, 30)) + " z")], "item_id long, text string")
    r = decontaminate.find_hits(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert (r.n_hit, r.longest, r.spans) == (25, 25, [[6, 31]])


def test_decontamination_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = Counter((d, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0) for d, n, hit, names in _brute_hits(docs, items).elements())
    assert Counter(tuple(r)[:6] for r in QUERIES["op8_decontaminate"](spark, sf).collect()) == want


# 9 language ID


def test_language_id_on_held_out_rows(spark, sf):
    out = QUERIES["op9_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_id_edges(spark, odd, sf):
    model = langid.fit(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[5].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[6].score == 0
    assert langid.predict(odd, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.fit(spark, odd.withColumn("lang", F.lit(None).cast("string"))) is None
    kept = langid.keep_known(odd, model, 0.0)
    assert kept.schema == odd.schema and kept.where("doc_id in (5, 6, 7)").count() == 0
    t = bytewords.texts_of(pa.array(["abcab", "", "é"]))
    flags = langid.presence(t, 0, 3)
    assert flags.sum(axis=1).tolist() == [3 + 3 + 3, 0, 2 + 1]


# 10 near dedup


def _brute_near(rows, size, percent=80):
    sets = []
    for d, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else ())))
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return Counter((d, len(x), None if d is None else top(d), d is None or top(d) == d) for d, x in sets)


def test_near_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert Counter(map(tuple, near_dedup.near_duplicates(spark, odd, shingle=4).collect())) == _brute_near(rows, 4)
    first = near_dedup.keep_first(spark, odd)
    assert first.schema == odd.schema
    ids = [r.doc_id for r in first.collect()]
    want = {d for d, _, _, kept in _brute_near(rows, 5) if kept and d is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
    assert near_dedup.near_duplicates(spark, odd.where("false")).count() == 0


def test_near_dedup_of_a_hot_group_in_small_nodes(spark):
    """A base with many variants, some of them linked through others only; nodes are kept tiny, so that every level and the blocks are used."""
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(120)], []
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"n{k}_{rng.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(f"s{k}_{i}" for i in range(50))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute_near(rows, 4)
    assert Counter(map(tuple, near_dedup.near_duplicates(spark, df, shingle=4).collect())) == want
    assert Counter(map(tuple, near_dedup.near_duplicates(spark, df, shingle=4, bound=8, depth=1).collect())) == want


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 50, 200, 120)]
    got = near_dedup.intersections(sets, sets[1:], width=64)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]


def test_near_dedup_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op10_near_dedup"](spark, sf).collect())) == _brute_near(rows, 4)


# queries


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same_as_sql(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.fit(spark, docs)
    known = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    rows = [r for r in rows if r[0] in known]
    kept = {d for d, _, _, k in _brute_near(rows, corpus_pipeline.SHINGLE) if k}
    rows = [r for r in rows if r[0] in kept]
    cut = {d: (text, gone) for d, _, gone, text in _brute_repeats(rows, corpus_pipeline.WINDOW)}
    rows = [(d, cut[d][0] if cut[d][1] else t) for d, t in rows]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not _brute_hits([(d, t)], items).most_common(1)[0][0][2]]
    want = sentence_pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("piece_bpe_32k.model"))
    want = want.select("doc_id", F.size("ids").cast("long"), F.xxhash64("ids"), "score", "round_trip")
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_pieces", "ids_hash", "score", "round_trip")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "sentence_pieces"]


def test_word_pattern_is_the_contract():
    assert SPACE_WORDS == r"[^\x20\x09-\x0D]+"
