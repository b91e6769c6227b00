"""Packing by concatenate and cut.

All documents stand one after another in one stream of token ids, which is cut into windows of a
fixed length; only the last window is not full. Two passes: the first encodes each partition once,
stores the ids in the shared folder with each document's place in its partition, and totals the
partitions; a prefix sum over these totals (one row a partition) then gives every partition its
place in the stream, and the second pass cuts each document at the window boundaries independently
of all others. A document that crosses a boundary gives one record for each window it touches.

Defined results: a null text is empty and still gives its end id; rows repeated or with a null id
are documents of their own; an empty table gives no pieces; other columns are not read. Texts are
encoded whole, however long: one that the fast encoder refuses goes to the tokenizers library.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._store import spill

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=4)
def byte_bpe(json_path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder for the byte-level BPE vocabulary of a tokenizer file, ids as the tokenizers library gives them.

    The vocabulary and special tokens are read from the file; the merges run in tiktoken, which is
    about five times as fast for the same ids, if the file is plain byte-level BPE, and in
    tokenizers itself otherwise.
    """
    import json

    from tokenizers import Tokenizer

    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    reference = Tokenizer.from_file(json_path)
    slow = lambda texts: [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    ranks = _ranks(spec)
    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    probe = ["", " a", "Don't  stop \n\n 12 é　x", "".join(map(chr, range(1, 400))), *special]
    if [fast.encode(t, allowed_special="all") for t in probe] != slow(probe):
        return slow

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            try:
                out.append(fast.encode(t, allowed_special="all"))
            except ValueError:  # its pattern gives up on white space of about a million characters
                out += slow([t])
        return out

    return encode


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings to ids, where ids are in the order of the merges; None for another kind of file."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("unk_token"):
        return None
    # byte-level files write byte b as a printable character: itself where printable, else 256 onwards
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocab.get(a + b) for a, b in merges]
    if None in order or any(x >= y for x, y in zip(order, order[1:])):
        return None
    return {bytes(byte_of[c] for c in w): i for w, i in vocab.items()}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document: its ids (little-endian unsigned 32-bit) and its place in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4")
        run = byte_bpe(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                ids = [np.append(np.array(x, dtype="<u4"), end) for x in run(texts)]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                places = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(places), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "part", "place", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, part int, place bigint, doc_tokens bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents of `docs` (doc_id, text) in sequences of `length` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.
    """
    tokens, _ = spill(encode_documents(docs, tokenizer, end_id), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the input; the window sees nothing else
    bases, _ = spill(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "packing-bases")
    placed = tokens.join(F.broadcast(bases), "part") if bases.count() <= 200_000 else tokens.join(bases, "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, at, total, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start = 0
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    n = min(total - start, length - offset)
                    piece = ids[4 * start : 4 * (start + n)]
                    out.append((doc_id, start, n, zlib.crc32(piece), total, sequence, offset, piece))
                    start += n
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.select("doc_id", (F.col("base") + F.col("place")).alias("at"), "doc_tokens", "ids").mapInArrow(cut, PIECES + ", ids binary")
