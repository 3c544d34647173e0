"""Findings of round 3."""

from __future__ import annotations

import random
import uuid

import numpy as np

from brindle.llm import sentence_pieces as sp
from brindle.llm.components import components
from brindle.llm.queries import tokenizer
from brindle.llm.scratch import Scratch


def test_short_chunks_are_ranked_all_at_once():
    """op2: as each chunk's own A* search ranks them, ties and characters without a piece included."""
    rng = random.Random(5)
    pieces = sp.pieces_of(tokenizer("piece_bpe_32k.model"))
    chunks = ["▁" + "".join(rng.choice(kind) for _ in range(rng.randint(1, 24))) for kind in ("ab", "the ing", "é漢\U0001F600x", "aeinrst") for _ in range(60)] + ["x", "\U0001F600", "▁"]
    codes = sp._code_points("".join(chunks))
    first = np.cumsum([0, *map(len, chunks)])
    for n in (1, 2, 4):
        lattice = sp.Lattice(pieces, codes, first)
        assert lattice.all_ranked(n) == [lattice.ranked(k, n) for k in range(len(chunks))]


def test_substring_worker_memory():
    """pipeline: what a worker holds to find repeats within a piece of text, as remove_repeats cuts pieces."""
    import inspect
    import tracemalloc

    import pyarrow as pa

    from brindle.llm import substring_dedup

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 8) for _ in range(400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["rank", "text"])
    piece = inspect.signature(substring_dedup.remove_repeats).parameters["piece"].default
    tracemalloc.start()
    for _ in substring_dedup._probes(13, 7, 8, 9, piece)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_components_compute_their_edges_once_and_few_rows_take_few_files(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def note(batches):
        for b in batches:
            (made / uuid.uuid4().hex).touch()
            yield b

    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long").coalesce(1).mapInArrow(note, "a long, b long")
    scratch = Scratch(spark, "t")
    labels = components(scratch, edges, 20)
    assert {(r.v, r.c) for r in labels.collect()} == {(k, 0) for k in range(21)}
    assert len(list(made.iterdir())) == 1  # it was computed for each direction
    most = max(spark.sparkContext.defaultParallelism, 1)
    wide = scratch.write(spark.range(1000).repartition(most + 20), 1000)
    assert wide.count() == 1000 and len(wide.inputFiles()) <= most


def test_pieces_worker_memory():
    """pipeline: what a worker holds to encode a batch of texts, and that pieces of text change no row."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(4500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    path = tokenizer("piece_bpe_32k.model")
    pieces = sp.pieces_of(path)
    sums = []
    tracemalloc.start()
    for out in sp._encoded(path, 4)(iter([batch])):
        sums += [sum(x) for x in out.column("ids").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    _, ids, at, *_ = sp.encode_n_best(pieces, pa.chunked_array([batch.column("text")]), 4)
    assert sums == [int(ids[a:b].sum()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert peak < 150 << 20
