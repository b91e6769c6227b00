"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. The probability of the next byte
is its share in the longest retained context, or, where it was not seen there, the escape probability
t / (n + t) (t different bytes seen in n) times its probability in the next shorter context, down to
a uniform one over 256 bytes. Bytes that no training text has are alike in every context and share one
symbol, which changes no probability. The statistics are frozen after training, so the cost of every byte in every retained
context is a table entry, in whole 1/256 bits: code lengths are exact sums and do not depend on
batches. The language of the shortest code wins (the first in order of name among equals).

Training reads a bounded sample: whole texts of each language in the order of
a hash of id and text, at most `docs_per_language` of them and, but for the first, `bytes_per_language` bytes. Contexts of three bytes
that the sample has fewer than `LEAST` times in all are not retained. This bounds the broadcast model: no more contexts than
the sample has bytes, one entry of two bytes for each context, symbol and language. Everything is scored over whole texts, however long.

Defined results: `und` with score 0 for null, empty and letterless texts, and for every text if
nothing could be learned; repeated rows give repeated rows and are learned from once; rows with a null id are scored, not
learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._words import text_buffers

ORDER, LEAST = 3, 3
#: Cost units a bit.
UNITS = 256
BLOCK_BYTES = 1 << 20


@dataclass
class Model:
    langs: list[str]
    class_of: np.ndarray  # symbol of each byte; the last stands for all bytes that were never seen
    pair_of: np.ndarray  # of each history of two symbols: its number among the retained ones, else how many these are
    base: np.ndarray  # of each history of two symbols: the longest retained context
    deep: np.ndarray  # (retained pair, symbol before): the context of three, or -1
    cost: np.ndarray  # (context * symbols + symbol, language)

    @property
    def symbols(self) -> int:
        return int(self.class_of.max()) + 1


def learn(texts: dict[str, list[bytes]], least: int = LEAST) -> Model | None:
    """Trees of all languages over the same symbols and the same set of contexts."""
    langs = sorted(texts)
    if not langs:
        return None
    joined = {x: np.frombuffer(b"\n\n\n".join([b"", *texts[x]]), dtype=np.uint8) for x in langs}
    seen = np.flatnonzero(sum(np.bincount(v, minlength=256) for v in joined.values()))
    size = len(seen) + (len(seen) < 256)
    class_of = np.full(256, size - 1, dtype=np.int64)
    class_of[seen] = np.arange(len(seen))
    codes = {x: class_of[v] for x, v in joined.items() if len(v) > ORDER}

    def histories(c: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(max(0, len(c) - ORDER), dtype=np.int64)
        for i in range(k, 0, -1):
            out = out * size + c[ORDER - i : len(c) - i]
        return out

    every = [np.concatenate([np.zeros(0, dtype=np.int64), *(histories(c, k) for c in codes.values())]) for k in (2, 3)]
    pairs = np.unique(every[0])
    triples, times = np.unique(every[1], return_counts=True)
    triples = triples[times >= least]
    # contexts: the root, all of one symbol, the pairs seen, the triples retained
    starts = [0, 1, 1 + size, 1 + size + len(pairs), 1 + size + len(pairs) + len(triples)]
    shorter = np.zeros(starts[4], dtype=np.int64)
    shorter[starts[2] : starts[3]] = starts[1] + pairs % size
    shorter[starts[3] :] = starts[2] + np.searchsorted(pairs, triples % size**2)
    pair_of = np.full(size**2, len(pairs), dtype=np.int64)
    pair_of[pairs] = np.arange(len(pairs))
    base = starts[1] + np.arange(size**2) % size
    base[pairs] = starts[2] + np.arange(len(pairs))
    deep = np.full((len(pairs) + 1, size), -1, dtype=np.int32)
    deep[pair_of[triples % size**2], triples // size**2] = starts[3] + np.arange(len(triples))
    cost = np.empty((starts[4] * size, len(langs)), dtype=np.int16)
    for column, x in enumerate(langs):
        c = codes.get(x, np.zeros(0, dtype=np.int64))
        now = c[ORDER:]
        probability = np.empty((starts[4], size), dtype=np.float64)
        for k in range(ORDER + 1):
            first, last = starts[k], starts[k + 1]
            at, symbols = histories(c, k), now
            if k >= 2:
                known = (pairs, triples)[k - 2]
                place = np.searchsorted(known, at)
                ok = place < len(known)
                ok[ok] = known[place[ok]] == at[ok]
                at, symbols = place[ok], now[ok]
            counts = np.bincount(at * size + symbols, minlength=(last - first) * size).reshape(-1, size)
            n, t = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            below = probability[shorter[first:last]] if k else np.full((1, size), 1 / 256)
            escape = np.where(n > 0, t / np.maximum(n + t, 1), 1.0)
            probability[first:last] = np.where(counts > 0, counts / np.maximum(n + t, 1), escape * below)
        cost[:, column] = np.minimum(np.round(-np.log2(probability) * UNITS), np.iinfo(np.int16).max).ravel()
    return Model(langs, class_of, pair_of, base.astype(np.int32), deep, cost)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length of each text under each language, in 1/256 bits."""
    docs, sizes, symbols = len(offsets) - 1, np.diff(offsets), model.symbols
    # three line ends stand before each text, as in training
    codes = np.full(len(data) + ORDER * docs, model.class_of[10], dtype=np.int64)
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(docs), sizes) + 1)
    codes[at] = model.class_of[data]
    pair = codes[at - 2] * symbols + codes[at - 1]
    context = model.deep[model.pair_of[pair], codes[at - 3]]
    context = np.where(context < 0, model.base[pair], context).astype(np.int64)
    costs = model.cost[context * symbols + codes[at]]
    out = np.zeros((docs, len(model.langs)), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(costs, offsets[:-1][full] - offsets[0], axis=0, dtype=np.int64)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, docs_per_language: int = 300, bytes_per_language: int = 2 << 20) -> Model | None:
    """Learn from the rows of `docs` (doc_id, text, lang) that are not held out.

    Candidates are the rows below a bound on the hash that leaves each language about four times the texts asked for;
    equal rows count once, and no task sees all rows of a language.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    if not counts:
        return None
    share = lambda n: min(1.0, 4 * docs_per_language / max(1, n))
    bounds = [(r.lang, min((1 << 63) - 1, int(share(r.n) * (1 << 64)) - (1 << 63))) for r in counts]
    near = rows.join(F.broadcast(spark.createDataFrame(bounds, "lang string, most bigint")), "lang").filter("h <= most")
    sized = near.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("bytes")).collect()  # about four times the sample, without its texts
    chosen: dict[str, list[int]] = {}
    left = {r.lang: bytes_per_language for r in counts}
    for r in sorted(sized, key=lambda r: (r.lang, r.bytes > bytes_per_language // 4, r.h)):
        mine = chosen.setdefault(r.lang, [])
        if len(mine) < docs_per_language and (not mine or r.bytes <= left[r.lang]):
            mine.append(r.h)
            left[r.lang] -= r.bytes
    wanted = spark.createDataFrame([(x, h) for x, mine in chosen.items() for h in mine], "lang string, h bigint")
    sample = rows.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.lower("text")).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.h)):  # the sample
        texts.setdefault(r.lang, []).append(r.text.encode())
    return learn(texts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior under equal priors) and bits (code length of the winner)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            rows, langs, scores, bits = batch.num_rows, [], [], []
            letters = batch.column(3).to_pylist()
            start = 0
            while start < rows:
                stop = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, side="right")) - 1
                stop = min(rows, max(stop, start + 1))
                known = m is not None
                lengths = code_lengths(m, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]) if known else None
                for k in range(stop - start):
                    if not known or not letters[start + k]:
                        langs.append("und")
                        scores.append(0.0)
                        bits.append(0.0)
                        continue
                    best = int(lengths[k].argmin())
                    gap = (lengths[k] - lengths[k, best]) / UNITS
                    langs.append(m.langs[best])
                    scores.append(float(1 / np.exp2(-np.minimum(gap, 1000)).sum()))
                    bits.append(float(lengths[k, best] / UNITS))
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, bits double")
