"""Chat formatting by quotation linking.

A message's lines are read with their quote level (the number of `>` they begin with);
lines of one level in a row, blank ones apart, are a passage.  A passage's hash is that
of its words, A-Z lower-cased, joined by single spaces.  Passages of level 0 are what a
message says itself; each hash's first such message (by order) in its scope, and over
all scopes, is its original.  Quoted passages join originals by hash, one row a hash, so
that a phrase that everybody says is no bottleneck.  A message answers the latest
earlier original of its outermost linked passages (of its own scope, if any is there).
Pointer doubling turns these parents into conversations: root and depth of each message,
and its position: messages of a conversation are numbered from 0 by depth and then place,
so that every reply comes after what it answers.  Numbers are given in ranges of
(conversation, depth, place), and what lies before a range is added, so that a
conversation of very many messages is no bottleneck; `in_order` deals the rows out so.
The clean text is level 0 alone, without blank lines at its ends.

Defined results: null texts are empty; a message without a linked quotation begins a
conversation; repeated (scope, place) rows count as one message, of which each row keeps
its own clean text, and which answers what any of them does; null scopes or places are left as
messages on their own (root null, depth 0, position 0).  Messages that share place and depth
in a conversation (of other scopes) go by scope.  Columns other than scope, place and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions

_QUOTE = re.compile(r"((?:>[ \t]?)*)(.*)", re.S)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\n", "abcdefghijklmnopqrstuvwxyz   ")
_THREAD = "scope long, place long, to_scope long, to_place long, root_scope long, root_place long, depth long, part int, position long"


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The clean text, and (level, words) of each passage."""
    clean, passages, level, held = [], [], 0, []

    def close():
        words = " ".join(filter(None, "\n".join(held).translate(_FOLD).split(" ")))
        if words:
            passages.append((level, words))
        held.clear()

    for line in text.split("\n"):
        now, rest = 0, line
        if line.startswith(">"):
            marks, rest = _QUOTE.match(line).groups()
            now = marks.count(">")
        else:
            clean.append(line)
        if now != level or not rest.strip(" \t\r"):
            close()
        level = now
        held.append(rest)
    close()
    return "\n".join(clean).strip("\n"), passages


def passages(messages: DataFrame) -> DataFrame:
    """scope, place, clean_text, n_quoted and passages (level, key) of every row of messages (scope, place, text)."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.binary())]))

    def run(batches):
        for b in batches:
            clean, found = [], []
            for text in b.column("text").to_pylist():
                c, p = parse(text or "")
                clean.append(c)
                found.append([{"level": k, "key": hashlib.md5(w.encode()).digest()} for k, w in p])
            quoted = [sum(x["level"] > 0 for x in p) for p in found]
            yield pa.RecordBatch.from_arrays([b.column("scope"), b.column("place"), pa.array(clean, pa.string()), pa.array(quoted, pa.int64()), pa.array(found, kind)], names=["scope", "place", "clean_text", "n_quoted", "passages"])

    return messages.select(F.col("scope").cast("long"), F.col("place").cast("long"), F.col("text").cast("string")).mapInArrow(run, "scope long, place long, clean_text string, n_quoted long, passages array<struct<level:int,key:binary>>")


def link(scratch: Scratch, parsed: DataFrame) -> DataFrame:
    """scope, place and the scope and place of what it answers, for messages that answer one. Originals are ordered by (place, scope)."""
    rows = parsed.where("scope is not null and place is not null").select("scope", "place", F.explode("passages").alias("p")).select("scope", "place", "p.level", "p.key")
    own = rows.where("level = 0")
    near = scratch.write(own.groupBy("scope", "key").agg(F.min("place").alias("near")))
    far = scratch.write(own.groupBy("key").agg(F.min(F.struct("place", "scope")).alias("far")))
    quoted = scratch.write(rows.where("level > 0").groupBy("scope", "place", "key").agg(F.min("level").alias("level")))
    found = quoted.join(near, ["scope", "key"], "left").withColumn("near", F.when(F.col("near") < F.col("place"), F.col("near")))
    rest = found.where("near is null").drop("near")
    here = found.where("near is not null").select("scope", "place", "level", F.lit(True).alias("same"), F.struct(F.col("near").alias("place"), F.col("scope")).alias("to"))
    there = rest.join(far, "key").where("far.place < place").select("scope", "place", "level", F.lit(False).alias("same"), F.col("far").alias("to"))
    best = here.union(there).groupBy("scope", "place").agg(F.max(F.struct(F.col("same"), (-F.col("level")).alias("l"), F.col("to"))).alias("best"))
    return best.select("scope", "place", F.col("best.to.scope").alias("to_scope"), F.col("best.to.place").alias("to_place"))


def roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Pointer doubling: scope, place, root_scope, root_place and depth of every message that answers another. Those that have come to their root drop out of the next round."""
    columns = ["scope", "place", "root_scope", "root_place", "depth"]
    moving = scratch.write(links.select("scope", "place", F.col("to_scope").alias("root_scope"), F.col("to_place").alias("root_place"), F.lit(1).cast("long").alias("depth")))
    arrived = None
    while not moving.isEmpty():
        known = moving if arrived is None else arrived.union(moving)
        up = known.select(F.col("scope").alias("root_scope"), F.col("place").alias("root_place"), F.col("root_scope").alias("up_scope"), F.col("root_place").alias("up_place"), F.col("depth").alias("more"))
        step = moving.join(up, ["root_scope", "root_place"], "left")
        new = scratch.write(step.select("scope", "place", F.coalesce("up_scope", "root_scope").alias("root_scope"), F.coalesce("up_place", "root_place").alias("root_place"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")))
        done = new.where("not moved").select(columns)
        arrived = done if arrived is None else arrived.union(done)
        moving = new.where("moved").select(columns)
    return moving if arrived is None else arrived


def _numbered(batches):
    """Rows in order with their partition and their number among the partition's rows of a conversation."""
    last, n, part = None, 0, TaskContext.get().partitionId()
    for b in batches:
        if not b.num_rows:
            continue
        root = np.stack([b.column(c).to_numpy() for c in ("root_scope", "root_place")])
        edge = np.r_[0, np.flatnonzero((root[:, 1:] != root[:, :-1]).any(axis=0)) + 1]
        number = np.arange(b.num_rows) - np.repeat(edge, np.diff(np.r_[edge, b.num_rows]))
        if last is not None and (root[:, 0] == last).all():
            number[: edge[1] if len(edge) > 1 else None] += n
        last, n = root[:, -1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(number)], names=[*b.schema.names, "part", "position"])


def positions(scratch: Scratch, threads: DataFrame) -> DataFrame:
    """threads (scope, place, to_scope, to_place, root_scope, root_place, depth; nothing null but to_*) with position."""
    order = ["root_scope", "root_place", "depth", "place", "scope"]
    dealt = threads.repartitionByRange(shuffle_partitions(scratch.spark), *order).sortWithinPartitions(*order)
    rows = scratch.write(dealt.mapInArrow(_numbered, _THREAD))
    root = F.struct("root_scope", "root_place")
    ends = rows.groupBy("part").agg(F.min(root).alias("first"), F.max(root).alias("last"), F.max(F.struct(root, "position")).alias("end")).orderBy("part").collect()  # a row a partition
    carried, before = None, []
    for r in ends:
        offset = carried[1] if carried and carried[0] == r["first"] else 0
        if offset:
            before.append((r.part, *r["first"], offset))
        carried = (r["last"], r.end.position + 1 + (offset if r["first"] == r["last"] else 0))
    before = F.broadcast(scratch.spark.createDataFrame(before, "part int, root_scope long, root_place long, offset long"))
    return rows.join(before, ["part", "root_scope", "root_place"], "left").withColumn("position", F.col("position") + F.coalesce("offset", F.lit(0))).drop("part", "offset")


def conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """Every row of messages (scope, place, text) with clean_text, n_quoted, the message it answers (to_scope, to_place), its conversation (root_scope, root_place), depth and position in it."""
    scratch = Scratch(spark, "quotes")
    parsed = scratch.write(passages(messages))
    links = scratch.write(link(scratch, parsed))
    threads = parsed.where("scope is not null and place is not null").select("scope", "place").distinct().join(links, ["scope", "place"], "left").join(roots(scratch, links), ["scope", "place"], "left")
    threads = threads.select("scope", "place", "to_scope", "to_place", F.coalesce("root_scope", "scope").alias("root_scope"), F.coalesce("root_place", "place").alias("root_place"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    threads = scratch.write(positions(scratch, threads))
    scratch.drop_others(parsed, threads)
    none = F.lit(0).cast("long")
    out = parsed.select("scope", "place", "clean_text", "n_quoted").join(threads, ["scope", "place"], "left")
    return out.select("scope", "place", "clean_text", "n_quoted", "to_scope", "to_place", "root_scope", "root_place", F.coalesce("depth", none).alias("depth"), F.coalesce("position", none).alias("position"))


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows dealt out by ranges and sorted, so that files written from them hold conversations one after another, replies after what they answer."""
    order = ["root_scope", "root_place", "position", "scope", "place"]
    return conversations.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
