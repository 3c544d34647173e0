"""Token ids as length-delimited binary records.

A file is a sequence of records, each `length` (u64), the masked checksum of those 8
bytes (u32), the payload, the masked checksum of the payload (u32), all little-endian;
a checksum is crc32, masked as rotate-right-15 plus 0xA282EAD8, so that a checksum over
data that holds checksums stays sound.  A payload is one document: doc_id (i64), flags
(u8: 1 for a null doc_id, 2 for ids of 2 bytes instead of 4), then its ids, the end id
last.  Beside each file an index of (doc_id i64, offset u64, ids u32) entries lets a
loader shuffle and seek.

Documents are dealt out by ranges of doc_id, so that files in order hold ascending ids;
a task writes one file under a name of its own, and only the files that the written
manifest names count: a lost or repeated task leaves nothing that is read.

Text is cut at places that the byte-level pre-tokenizer always cuts at, and each
distinct chunk is encoded once per worker (within a bound), by the tokenizers library.

Defined results: null text is empty (the end id alone); equal doc_ids follow each
other in order of their texts, each a record; null doc_ids come first.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import SPACE, Texts, class_table, hash_spans, in_pieces, texts_of
from .scratch import Scratch, shared_folder, shuffle_partitions

_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u4")])
_MANIFEST = "part int, path string, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(buf: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at `at`, and where the next one begins."""
    head = bytes(buf[at : at + 8])
    if int.from_bytes(buf[at + 8 : at + 12], "little") != masked(head):
        raise ValueError(f"record length at {at} is damaged")
    end = at + 12 + int.from_bytes(head, "little")
    payload = buf[at + 12 : end]
    if int.from_bytes(buf[end : end + 4], "little") != masked(payload):
        raise ValueError(f"record at {at} is damaged")
    return payload, end + 4


def _unicode_space(buf: np.ndarray) -> np.ndarray:
    """Flags of the bytes of white space beyond ASCII."""
    out = np.zeros(len(buf), bool)
    for lead in np.flatnonzero(_LEADS[buf]).tolist():
        for size in (2, 3):
            c = buf[lead : lead + size].tobytes()
            if len(c) == size and (c in _SPACES):
                out[lead : lead + size] = True
    return out


_LEADS = class_table(b"\xc2\xe1\xe2\xe3")
_SPACES = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def chunk_starts(t: Texts) -> np.ndarray:
    """Where a byte-level BPE with contraction, letter, number and other runs always begins a new pre-token: at each run of white space, before the run's last character, and after that unless it is a space."""
    n = len(t.buf)
    if not n:
        return np.zeros(0, np.int64)
    space = SPACE[t.buf] | _unicode_space(t.buf)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = space[1:] & ~space[:-1]
    last = np.flatnonzero(space & np.r_[~space[1:], False])
    last = last[~np.isin(last + 1, t.offset)]  # a run at a text's end stays whole
    cut[last[t.buf[last] != 32] + 1] = True
    for _ in range(2):
        last = np.where((t.buf[last] & 0xC0) == 0x80, last - 1, last)
    cut[last] = True
    cut[t.offset] = True
    return np.flatnonzero(cut[:n])


class Chunks:
    """Ids of chunks of text, by hash; forgets all once it holds `most` chunks."""

    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.starts_space = np.array([self.tokenizer.id_to_token(i).startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        self.forget()

    def forget(self):
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = [np.zeros(0, np.uint16 if len(self.starts_space) <= 1 << 16 else np.uint32)], np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Encode new chunks: those of a space and a word many at a time, as a space before a word starts a new pre-token whatever comes before."""
        joined = [i for i, c in enumerate(chunks) if c[:1] == b" " and len(c) > 1 and c.translate(None, b" \t\n\x0b\x0c\r") == c[1:]]
        joined = joined if len(joined) > 1 else []
        alone = np.ones(len(chunks), bool)
        alone[joined] = False
        groups = [joined[i : i + 64] for i in range(0, len(joined), 64)]
        kind = self.ids[0].dtype
        found: list = [None] * len(chunks)
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b"".join(map(chunks.__getitem__, g)).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, kind)
            for i, x in zip(group, np.split(ids, np.flatnonzero(self.starts_space[ids])[1:]), strict=True):
                found[i] = x
        alone = np.flatnonzero(alone).tolist()
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, kind)
        slot = np.arange(len(found)) + len(self.at) - 1
        self.ids = [np.concatenate([*self.ids, *found])]
        self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in found])]
        hashes, slot = np.r_[self.hashes, hashes], np.r_[self.slot, slot]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.slot = hashes[order], slot[order]

    def encode(self, column: pa.ChunkedArray):
        """Ids of all texts, one after another, and where each text's begin."""
        t = texts_of(column)
        starts = chunk_starts(t)
        if not len(starts):
            return self.ids[0][:0], np.zeros(len(t) + 1, np.int64)
        ends = np.r_[starts[1:], len(t.buf)]
        which, unique = pd.factorize(hash_spans(t.buf, starts, ends))
        if len(self.hashes) > self.most:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            own = np.empty(len(unique), np.int64)
            own[which[::-1]] = np.arange(len(which))[::-1]
            whole = t.buf.tobytes()
            self.learn(unique[new], [whole[a:b] for a, b in zip(starts[own[new]].tolist(), ends[own[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, unique)
        slot = self.slot[at][which]
        low = self.at[slot]
        n = self.at[slot + 1] - low
        place = np.r_[0, np.cumsum(n)]
        ids = self.ids[0][np.repeat(low - place[:-1], n) + np.arange(place[-1])]
        return ids, place[np.searchsorted(starts, t.offset)]


@lru_cache(1)
def chunks_of(path: str) -> Chunks:
    return Chunks(path)


def _open(uri: str):
    found, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")
    return found, path


def _write(folder: str, tokenizer_path: str, end_id: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        store, path = _open(name)
        chunks = chunks_of(tokenizer_path)
        wide = len(chunks.starts_space) > 1 << 16 or end_id >= 1 << 16
        kind = "<u4" if wide else "<u2"
        tail = np.array([end_id], kind).tobytes()
        index, at, total = [], 0, 0
        with store.open_output_stream(f"{path}.rec") as out:
            for table in in_pieces(batches):
                ids, first = chunks.encode(table.column("text"))
                raw = ids.astype(kind, copy=False).tobytes()
                size = 4 if wide else 2
                held = []
                for d, a, b in zip(table.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    record = frame(b"".join(((d or 0).to_bytes(8, "little", signed=True), bytes(((d is None) + (0 if wide else 2),)), raw[a * size : b * size], tail)))
                    index.append((d or 0, at, b - a + 1))
                    held.append(record)
                    at += len(record)
                    total += b - a + 1
                out.write(b"".join(held))
        with store.open_output_stream(f"{path}.idx") as out:
            out.write(np.array(index, _INDEX).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return run


def write_records(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id order; the manifest of files: part, path (without .rec or .idx), n_docs, n_tokens."""
    name = f"brindle-records-{uuid.uuid4().hex[:12]}"
    folder = folder or f"{shared_folder(spark)}/{name}"
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return Scratch(spark, "manifest").write(dealt.mapInArrow(_write(folder, tokenizer_path, end_id), _MANIFEST))


def records_of(path: str, at_most: int = 16 << 20):
    """(doc_id or None, ids) of each record of a file, checksums verified, about at_most bytes held at a time."""
    store, base = _open(path)
    with store.open_input_stream(f"{base}.rec") as source:
        held, done = b"", False
        while not done or held:
            more = source.read(at_most)
            done = not more
            held, at = held + more, 0
            view = memoryview(held)
            while len(view) - at >= 12:
                size = int.from_bytes(view[at : at + 8], "little")
                if len(view) - at < size + 16:
                    break
                payload, at = unframe(view, at)
                doc_id, flags = int.from_bytes(payload[:8], "little", signed=True), payload[8]
                yield (None if flags & 1 else doc_id), np.frombuffer(payload[9:], "<u2" if flags & 2 else "<u4")
            held = held[at:]
            if done and held:
                raise ValueError(f"{path} ends within a record")


def record_at(path: str, k: int):
    """The k-th record of a file, found by its index."""
    store, base = _open(path)
    with store.open_input_file(f"{base}.idx") as source:
        entry = np.frombuffer(source.read_at(_INDEX.itemsize, k * _INDEX.itemsize), _INDEX)[0]
    with store.open_input_file(f"{base}.rec") as source:
        head = source.read_at(12, int(entry["offset"]))
        payload, _ = unframe(memoryview(source.read_at(int.from_bytes(head[:8], "little") + 16, int(entry["offset"]))), 0)
    return (None if payload[8] & 1 else int(entry["doc_id"])), np.frombuffer(payload[9:], "<u2" if payload[8] & 2 else "<u4")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 of every record of the files that manifest names."""
    before, files = 0, []
    for r in manifest.orderBy("part").collect():  # a row a file
        files.append((len(files), r.path, before))
        before += r.n_tokens

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows = []
                for doc_id, ids in records_of(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    listed = spark.createDataFrame(files, "part int, path string, start long")
    return listed.repartitionById(max(1, len(files)), F.col("part")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
