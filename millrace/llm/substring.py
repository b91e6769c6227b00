"""Substring dedup: every word inside a run of words that also occurs elsewhere is removed.

A window is `window` consecutive words of one document; it is repeated if its word sequence starts
anywhere else. Equal windows hold the same runs of `run` words, so they have their minimizer - the
run of smallest hash, leftmost among equals - at the same place. The number of places that are the
minimizer of some window, counted by the minimizer's hash, is therefore never less than the number
of occurrences of any window that has it.

Pass 1: each block of texts sketches these places by count-min, and the sketches are merged. A place's
shard follows from its hash, and a shard has `ROWS` rows of `2 ** bits` counters, of which one bit each (two
or more, or not) is kept. There is a shard for every `SHARD_PLACES` places, reckoned from the counted bytes, so a place that is
not repeated passes by chance in about 3 % of cases whatever the input (more where places are denser than one in `PLACE_BYTES` bytes, which costs work only).
Pass 2: windows whose minimizer is estimated repeated - an estimate can only be too high, so none is lost - go to an
exact grouping by minimizer and window hash. Where the sketch is at most `BROADCAST` bytes it is broadcast and windows are filtered where
they are made; a larger one stays in its shards, windows are dealt to them and filtered there.

Of copies that a task meets the first two travel at most, the others are known to be repeated, so a passage that a third of all documents share gives
two rows a task. A minimizer with more than one in `HEAVY` of the rows, by the edges of such a passage, is dealt by its single windows, of which
the commonest are known to be repeated from their counts alone.
Words are compared by 64-bit hashes of the minimizer and of the window, 128 bits together.

Defined results: null and empty texts and texts of fewer words than a window lose nothing; very long texts are blocks of their own; rows
that are repeated count as documents of their own, and two windows of one document as two; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._store import spill
from millrace.llm._words import Block, blocks, mix, run_hashes

RUN = 16
#: Counters of a row of a shard (as a power of two), rows, places for which there is a shard, bytes of text for which there is a place.
BITS, ROWS, SHARD_PLACES, PLACE_BYTES = 22, 2, 800_000, 50
#: Bytes of a sketch that is broadcast.
BROADCAST = 64 << 20
#: Groups of windows remembered by a task.
REMEMBERED = 500_000
#: Minimizers of more than one in so many rows are dealt by window: there are fewer of them, and of their windows
#: with as many rows no more than this times the windows of a place.
HEAVY = 1000
_SEEDS = [np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D)]


def _columns(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(13)) % np.uint64(shards)).astype(np.int64)


def _repeated(h: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Which places a shard's bitmap estimates to be repeated."""
    ok = np.ones(len(h), dtype=bool)
    for row in range(ROWS):
        c = _columns(h, row, bits)
        ok &= (sketch[(row << (bits - 3)) + (c >> 3)] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
    return ok


def _windows(block: Block, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in a block, grouped by minimizer place: first window, number, minimizer hash; then words and window hashes."""
    words = block.hashes()
    every, grams = run_hashes(words, window), run_hashes(words, run)
    empty = np.zeros(0, dtype=np.int64)
    if not len(every):
        return empty, empty, np.zeros(0, dtype=np.uint64), words, every
    span = window - run + 1
    best = np.arange(len(grams))
    width = 1
    while width < span:  # leftmost smallest of ever wider ranges
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    best = best[: len(every)]
    # windows must not run into the next document
    ends = np.repeat(block.word_offsets[1:], block.counts())[: len(every)]
    valid = np.arange(len(every)) + window <= ends
    doc = block.doc_of_words()[: len(every)]
    change = np.ones(len(every), dtype=bool)
    change[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    keep = np.flatnonzero(valid)
    if not len(keep):
        return empty, empty, np.zeros(0, dtype=np.uint64), words, every
    new = change[keep]
    new[0] = True
    new[1:] |= keep[1:] != keep[:-1] + 1
    at = np.flatnonzero(new)
    first = keep[at]
    number = np.diff(np.append(at, len(keep)))
    return first, number, grams[best[first]], words, every


def merged_sketch(docs: DataFrame, window: int, run: int, bits: int, shards: int) -> DataFrame:
    """shard, bits: for each shard a bitmap of its rows' counters that count two or more. Written as a table."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch):
                h = _windows(block, window, run)[2]
                own = _shard(h, shards) * ROWS
                shard, columns, counts = [], [], []
                for row in range(ROWS):
                    c, n = np.unique(((own + row) << bits) + _columns(h, row, bits), return_counts=True)
                    which, starts = np.unique(c >> bits, return_index=True)
                    c, n = (c & ((1 << bits) - 1)).astype("<u4"), np.minimum(n, 2).astype("u1")
                    shard += which.tolist()
                    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
                        columns.append(c[a:b].tobytes())
                        counts.append(n[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(columns, pa.binary()), pa.array(counts, pa.binary())], names=["row", "columns", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(0, dtype=np.uint8)

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at // ROWS], pa.int64()), pa.array([at % ROWS], pa.int32()), pa.array([np.packbits(sums >= 2).tobytes()], pa.binary())], names=["shard", "row", "bits"])

        for batch in batches:
            for row, columns, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row != at:
                    if at is not None:
                        yield written()
                    at, sums = row, np.zeros(1 << bits, dtype=np.uint8)
                c = np.frombuffer(columns, dtype="<u4")
                sums[c] = np.minimum(sums[c] + np.frombuffer(counts, dtype="u1"), 2)
        if at is not None:
            yield written()

    sketches = docs.select("text").mapInArrow(partial, "row bigint, columns binary, counts binary")
    parts = max(1, min(ROWS * shards, max(2 * docs.sparkSession.sparkContext.defaultParallelism, shards // 8)))
    rows = sketches.repartition(parts, "row").sortWithinPartitions("row").mapInArrow(merge, "shard bigint, row int, bits binary")
    return spill(rows, "sketch")[0]


def _in_order(found: list, size: int) -> np.ndarray:
    """The bitmaps of a shard's rows, those that counted nothing as zeros."""
    have = {row: data for row, data in found}
    return np.frombuffer(b"".join(have.get(row, bytes(size)) for row in range(ROWS)), dtype=np.uint8)


_ROWS_OF_WINDOWS = "h bigint, key bigint, at bigint, windows array<bigint>, weight bigint, mask bigint"


def _filtered_in_shards(rows: DataFrame, sketch: DataFrame, bits: int, shards: int) -> DataFrame:
    """The rows that their shard's sketch estimates repeated; rows and sketches are dealt by shard, the sketches first."""
    parts = max(1, min(shards, 100_000))
    names = ["h", "key", "at", "windows", "weight", "mask"]
    shard = F.expr(f"cast(shiftrightunsigned(h, 13) % {shards} as bigint)")  # as in _shard
    both = rows.withColumn("shard", shard).withColumn("kind", F.lit(ROWS)).unionByName(sketch.select("shard", F.col("row").alias("kind"), F.col("bits")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (kind < ROWS) | (np.diff(kind, prepend=0) != 0)).tolist()
            for start, stop in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if shard[start] != at:
                    at, found = shard[start], []
                if kind[start] < ROWS:
                    found.append((int(kind[start]), batch.column(2)[start].as_py()))
                    continue
                some = batch.slice(start, stop - start)
                ok = _repeated(some.column(3).to_numpy().view(np.uint64), _in_order(found, 1 << (bits - 3)), bits)
                yield some.select(names).filter(pa.array(ok))

    known = rows.filter("h is null")
    dealt = both.filter("kind < %d or h is not null" % ROWS).select("shard", "kind", "bits", *names).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    return known.unionByName(dealt.mapInArrow(run, _ROWS_OF_WINDOWS))


def repeated_windows(docs: DataFrame, window: int, run: int = RUN, bits: int = BITS) -> DataFrame:
    """key, at, mask: of the windows that start at word `at` + i, those repeated (bit i). `docs` has key and text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (PLACE_BYTES * SHARD_PLACES)))
    sketch = merged_sketch(docs, window, run, bits, shards)
    here = shards * ROWS << (bits - 3) <= BROADCAST
    shared = spark.sparkContext.broadcast([(r.shard, r.row, bytes(r.bits)) for r in sketch.collect()] if here else None)  # at most BROADCAST bytes

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, list] = {}
        for shard, row, data in shared.value or []:
            maps.setdefault(shard, []).append((row, data))
        sketches = {shard: _in_order(found, 1 << (bits - 3)) for shard, found in maps.items()}
        none = np.zeros(ROWS << (bits - 3), dtype=np.uint8)
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for start, stop, block in blocks(batch):
                first, number, h, _, every = _windows(block, window, run)
                if here and len(h):
                    own, ok = _shard(h, shards), np.zeros(len(h), dtype=bool)
                    for s in np.unique(own).tolist():
                        ok[own == s] = _repeated(h[own == s], sketches.get(s, none), bits)
                    first, number, h = first[ok], number[ok], h[ok]
                doc = np.searchsorted(block.word_offsets, first, side="right") - 1
                # groups of windows that are the same throughout: the first two that a task meets travel at most
                offsets = np.concatenate([[0], np.cumsum(number)])
                flat = np.repeat(first - offsets[:-1], number) + np.arange(offsets[-1])
                values = every[flat]
                whole = np.add.reduceat(mix(values + (flat - np.repeat(first, number)).astype(np.uint64)), offsets[:-1]) + number.astype(np.uint64) if len(number) else h
                _, once, inverse, copies = np.unique(np.stack([h, whole]), axis=1, return_index=True, return_inverse=True, return_counts=True) if len(h) else (None, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
                groups = list(zip(h[once].tolist(), whole[once].tolist(), strict=True))
                before = np.array([seen.get(g, 0) for g in groups], dtype=np.int64)
                weight = np.where(before >= 2, 0, np.where(before == 1, 1, np.minimum(copies, 2)))
                seen.update(zip(groups, np.minimum(before + copies, 2).tolist(), strict=True))
                if len(seen) > REMEMBERED:
                    seen.clear()
                many = (before + copies > 1)[inverse.ravel()]
                travels, weights = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
                travels[once], weights[once] = weight > 0, weight
                rows, local = np.flatnonzero(travels), np.flatnonzero(many)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number[rows])]), pa.int32()), pa.array(values[np.repeat(travels, number)].view(np.int64)))
                masks = (np.left_shift(np.uint64(1), number[local].astype(np.uint64)) - np.uint64(1)).view(np.int64)
                size = len(rows), len(local)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h[rows].view(np.int64), np.zeros(size[1], dtype=np.int64)]), mask=np.repeat([False, True], size)),
                        pa.array(keys[start:stop][doc[np.concatenate([rows, local])]], pa.int64()),
                        pa.array((first - block.word_offsets[doc])[np.concatenate([rows, local])], pa.int64()),
                        pa.concat_arrays([lists, pa.nulls(size[1], lists.type)]),
                        pa.array(np.concatenate([weights[rows], np.zeros(size[1], dtype=np.int64)]), pa.int64()),
                        pa.array(np.concatenate([np.zeros(size[0], dtype=np.int64), masks]), pa.int64()),
                    ],
                    names=["h", "key", "at", "windows", "weight", "mask"],
                )

    rows = docs.select("key", "text").mapInArrow(second, _ROWS_OF_WINDOWS)
    if not here:
        rows = _filtered_in_shards(spill(rows, "all-windows")[0], sketch, bits, shards)
    rows, _ = spill(rows, "windows")
    known = rows.filter("h is null").select("key", "at", "mask")
    rows = rows.filter("h is not null").select("h", "key", "at", "weight", "windows")
    many = rows.groupBy("h").count()
    total = rows.count()
    heavy = many.filter(F.col("count") * HEAVY > total).select("h", F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(heavy), "h", "left")
    each = [*("h", "key", "at", "weight"), F.posexplode("windows").alias("i", "w")]
    light, single = rows.filter("heavy is null").repartition("h").select(*each), rows.filter("heavy").select(*each)
    # windows with so many rows themselves are repeated; the rest of their minimizers is dealt by window
    hot = single.groupBy("h", "w").count().filter((F.col("count") > 1) & (F.col("count") * HEAVY > total)).select("h", "w", F.lit(True).alias("hot"))
    single = single.join(F.broadcast(hot), ["h", "w"], "left")
    same = F.sum("weight").over(Window.partitionBy("h", "w"))
    found = [x.withColumn("n", same).filter("n >= 2").select("key", "at", "i") for x in (light, single.filter("hot is null"))]
    found.append(single.filter("hot").select("key", "at", "i"))
    found = found[0].unionByName(found[1]).unionByName(found[2])
    return known.unionByName(found.select("key", "at", F.expr("shiftleft(1L, i)").alias("mask")))


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the places."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n_words), -1)
    return np.cumsum(change)[:n_words] > 0


def dedup_substrings(docs: DataFrame, window: int = 35, run: int = RUN, bits: int = BITS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and kept where asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    if bits < 3:
        raise ValueError("a row of the sketch holds whole bytes")
    if not 0 <= window - run < 63:
        raise ValueError("a window is as long as a run or up to 62 words longer")
    repeated = repeated_windows(rows.select("key", "text"), window, run, bits)
    places = repeated.groupBy("key", "at").agg(F.bit_or("mask").alias("mask"))
    lists = places.groupBy("key").agg(F.collect_list("at").alias("at"), F.collect_list("mask").alias("mask"))  # of one document each
    joined = rows.join(lists, "key", "left").select("doc_id", "text", "at", "mask")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, masks = batch.column(2), batch.column(3)
            for start, stop, block in blocks(batch):
                out: list[tuple] = []
                for d in range(block.docs):
                    a, b = block.word_offsets[d], block.word_offsets[d + 1]
                    spans = list(zip(block.starts[a:b].tolist(), block.ends[a:b].tolist(), strict=True))
                    gone = 0
                    if places[start + d].is_valid:
                        at = np.array(places[start + d].as_py(), dtype=np.int64)
                        mask = np.array(masks[start + d].as_py(), dtype=np.int64)
                        bit = np.arange(window - run + 1)
                        hits = (mask[:, None] >> bit) & 1 > 0
                        away = covered((at[:, None] + bit)[hits], len(spans), window)
                        gone = int(away.sum())
                        spans = [s for s, x in zip(spans, away.tolist(), strict=True) if not x]
                    kept = b" ".join([block.data[x:y].tobytes() for x, y in spans]) if gone else b" ".join(block.text(d).split())
                    out.append((gone, kept))
                counts = block.counts()
                columns = [batch.column(0).slice(start, stop - start), pa.array(counts, pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in out], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([x[1].decode() for x in out], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
