"""Registered queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mails: each turn quotes the turn before it, and that one's predecessor within."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    said = turns.groupBy("scope", "place").agg(F.min("text").alias("said"))
    mail = turns
    for back, marks in ((1, ">"), (2, ">>")):
        earlier = said.select("scope", (F.col("place") + back).alias("place"), F.concat(F.lit(f"{marks} "), F.regexp_replace("said", "\n", f"\n{marks} "), F.lit("\n")).alias(f"back{back}"))
        mail = mail.join(earlier, ["scope", "place"], "left")
    return mail.select("scope", "place", F.concat(F.coalesce("back2", F.lit("")), F.coalesce("back1", F.lit("")), F.lit("\n"), F.col("text")).alias("text"))


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotations import conversations

    out = conversations(spark, mails(spark, sf_dir))
    return out.select(F.col("scope").alias("conv_id"), F.col("place").alias("turn"), "n_quoted", F.col("to_place").alias("answers_turn"), F.col("root_place").alias("root_turn"), "depth", "position", F.sha2("clean_text", 256).alias("clean_sha256"))


OP1_SQL = """
with recursive turns as (
  select conv_id, turn, coalesce(text, '') as text,
    trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g'), ' ') as words
  from conversations),
said as (select conv_id, turn, min(text) as text from turns group by all),
norm as (
  select conv_id, turn, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g'), ' ') as words
  from said),
firsts as (select conv_id, words, min(turn) as turn from norm where words <> '' group by all),
quoted as (
  select n.conv_id, n.turn + b.back as turn, b.back as level, n.words
  from norm n cross join (values (1), (2)) b(back) where n.words <> ''),
hits as (
  select q.conv_id, q.turn, q.level, f.turn as original
  from (select conv_id, turn, words, min(level) as level from quoted group by all) q
  join firsts f on f.conv_id = q.conv_id and f.words = q.words and f.turn < q.turn),
links as (
  select conv_id, turn, max(original) as answers
  from (select *, min(level) over (partition by conv_id, turn) as least from hits) where level = least group by all),
chain(conv_id, turn, root, depth) as (
  select conv_id, turn, answers, 1 from links
  union all
  select c.conv_id, c.turn, l.answers, c.depth + 1 from chain c join links l on l.conv_id = c.conv_id and l.turn = c.root),
ends as (select conv_id, turn, arg_max(root, depth) as root, max(depth) as depth from chain group by all)
select t.conv_id, t.turn, cast((select count(*) from quoted q where q.conv_id = t.conv_id and q.turn = t.turn) as bigint) as n_quoted,
  l.answers as answers_turn, coalesce(e.root, t.turn) as root_turn, cast(coalesce(e.depth, 0) as bigint) as depth,
  dense_rank() over (partition by t.conv_id, coalesce(e.root, t.turn) order by coalesce(e.depth, 0), t.turn) - 1 as position,
  sha256(trim(t.text, chr(10))) as clean_sha256
from turns t left join links l using (conv_id, turn) left join ends e using (conv_id, turn)
"""

SPACE_WORDS, TABLE_WORDS, ALNUM_WORDS = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D|]+", r"[0-9A-Za-z]+"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go in under two tokenizer versions; later copies of a text go out; the texts with tables are counted anew; one batch comes twice."""
    from .scratch import Scratch
    from .token_counts import Rollup, delete, insert, revise

    scratch = Scratch(spark, "counts")
    n = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("key"), n(SPACE_WORDS).alias("space"), n(TABLE_WORDS).alias("table"), n(ALNUM_WORDS).alias("alnum"), F.coalesce(F.contains(F.col("text"), F.lit(" | ")), F.lit(False)).alias("has_table"))
    counted = scratch.write(counted)
    least = scratch.write(counted.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    again = counted.join(least, "key").where("doc_id > first").select(counted.columns)
    versions = lambda rows: rows.select("source", "lang", F.explode(F.array(F.struct(F.lit("space-1").alias("tokenizer"), F.col("space").alias("n")), F.struct(F.lit("alnum-1").alias("tokenizer"), F.col("alnum").alias("n")))).alias("v")).select("source", "lang", "v.tokenizer", "v.n")
    tables = counted.where("has_table").withColumn("tokenizer", F.lit("space-1"))
    gone = again.where("has_table").withColumn("tokenizer", F.lit("space-1"))
    rollup = Rollup(spark, f"{scratch.folder}/rollup")
    rollup.apply("1-all", insert(versions(counted), F.col("n")))
    rollup.apply("2-copies", delete(versions(again), F.col("n")))
    rollup.apply("3-tables", revise(tables, F.col("space"), F.col("table")).unionByName(revise(gone, F.col("table"), F.col("space"))))
    rollup.apply("2-copies", delete(versions(again), F.col("n")))
    return rollup.totals()


OP3_SQL = r"""
with d as (
  select *, min(doc_id) over (partition by text) as first from documents),
kept as (select * from d where text is null or doc_id <= first),
v as (
  select source, lang, 'space-1' as tokenizer,
    case when contains(text, ' | ') then len(regexp_extract_all(text, '[^ 	-
|]+')) else len(regexp_extract_all(text, '[^ 	-
]+')) end as n from kept
  union all
  select source, lang, 'alnum-1', len(regexp_extract_all(text, '[0-9A-Za-z]+')) from kept)
select source, lang, tokenizer, count(*) as n_docs, cast(sum(coalesce(n, 0)) as bigint) as n_tokens from v group by all
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as rules
    from .scratch import Scratch

    stats = Scratch(spark, "quality").write(rules.statistics(table(spark, sf_dir, "documents")))
    learned = rules.fit(stats, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", *rules.COUNTS[:5], failed.alias("base_failed"), (~failed & rules.verdict(learned)).alias("kept"), rules.fired(learned).alias("rule"))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_token_records(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from .token_records import read_records, write_records

    return read_records(spark, write_records(spark, table(spark, sf_dir, "documents"), tokenizer_path or tokenizer("byte_bpe_50k.json"), end_id=0))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_hits

    out = find_hits(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.col("longest").alias("longest_match"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(spark, docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from .sentence_pieces import encode

    out = encode(table(spark, sf_dir, "documents"), model_path or tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "nbest_scores", F.transform("nbest_ids", lambda x: F.xxhash64(x)).alias("nbest_hashes"), "round_trip")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=4)


def op11_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeat_intervals import remove_repeats

    out = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    from .token_alignment import align

    return align(spark, table(spark, sf_dir, "documents"), a_path or tokenizer("byte_bpe_50k.json"), b_path or tokenizer("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quotation_links, op2_sentence_pieces, op3_token_counts, op4_quality_rules, op5_url_filter, op6_token_records, op7_substring_dedup, op8_decontaminate, op9_language_id, op10_near_dedup, op11_repeat_intervals, op12_token_alignment, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op1_quotation_links": OP1_SQL, "op3_token_counts": OP3_SQL}
