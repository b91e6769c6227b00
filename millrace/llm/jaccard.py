"""Exact n-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets of shingles are put in bands of size in which the largest is at most 1/threshold times the
smallest, so linked sets lie in the same or in adjacent bands. Within the sizes of such a pair of
bands, linked sets differ in at most k elements. The feature domain is cut into groups of three
partitions by hash: with floor(k / 2) + 1 + p groups, at least p + 1 groups hold at most one
difference, and in each of them two of the three partitions agree. Every set gives one signature for
each choice of two partitions of each group, so linked sets share more than p of those of their pair of bands.

Of each set the p commonest signatures of each pair of bands are then left out, as the prefix filter of set joins does: in one order
of all signatures, sets that share more than p share one of the rest. p grows with k, as does the number of signatures of no or
few elements, which unrelated sets share in numbers that grow with the square of the table: these are the commonest. A passage
of many documents makes none of them candidates by itself either.

Sets that share a signature are candidates, and links are decided on the whole sets. Equal sets are
one class throughout. Components come first, and for them candidates already connected are not compared
again: first each set is compared with the most frequent first set of its buckets; then, round by
round, in each bucket that still holds several components, a few sets of each component (four times
as many every round) are compared with the rest and leave the bucket, until none is left. Work
beyond the first round is spent on unconnected candidates only, and no bucket is capped. A bucket's
sets are compared by parity bits where they meet, in blocks if they are many: the comparisons grow with the
square of a group that holds many components, the rows only with the pairs that bits don't prove apart.

`join_links` then decides every pair of sets of a component, once: links never leave a component, so
this is every candidate pair that can link. The sets of a large component are dealt into chunks, and
every pair of chunks is compared for itself. Links are counted where they are found; the pairs, whose number
grows with the square of a group, are made only when they are read.

Defined results: null, empty and wordless texts have empty sets and are components of their own;
a text of fewer words than a shingle is one element; repeated rows give repeated rows; a null id
never becomes a component's id unless all its ids are null (such components are told apart all the same); an empty table gives no rows; other
columns are not read; very long texts are blocks of their own. Elements are compared by 64-bit hashes, sets by 64-bit sums of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._store import clean_shuffles, discard, spill
from millrace.llm._words import Block, blocks, mix, run_hashes

#: Groups beyond those needed to share one signature, at least: linked sets share more than CORE, long ones still more.
CORE = 4
#: 64-bit words of a set's parity bits.
PARITY = 24
#: The same of sets of more than LONG elements, whose differences would fill the others.
WIDE, LONG = 192, 1000
#: Buckets that a set's rows list: all that it ever had if they are fewer, else the first of those that are left.
LISTED = 32
#: Sets up to which their names are broadcast, so that the elements of no others are shuffled.
NAMED = 200_000
_SUM = np.uint64(0x2545F4914F6CDD1D)
#: Sets remembered by a task, so that equal sets in it give their signatures once.
REMEMBERED = 200_000
#: Sets, and elements, of a chunk of a component on average at most.
CHUNK, CHUNK_ELEMENTS = 256, 500_000
#: Elements by which two chunks are compared at once.
COLUMNS = 4096
#: Rows, and hubs, of a bucket that are compared in one task on average at most; pairs of them looked at at once.
BLOCK, CELLS = 4096, 1 << 18
#: One row in so many is looked at for the commonest signatures, which more than one in `COMMON` of these sets give.
LOOKED, COMMON = 64, 200
#: Parts in which elements are counted, one after another, so that each shuffles its share only.
TILES = 4
#: Parts that the sets of a common signature are dealt to; members of a component in a bucket that are numbered in one task.
SALTS, NUMBERED = 64, 10_000


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, sorted within each; offsets of the texts."""
    words, counts = block.hashes(), block.counts()
    grams = run_hashes(words, n)
    doc = block.doc_of_words()[: len(grams)]
    ends = np.repeat(block.word_offsets[1:], counts)[: len(grams)]
    ok = np.arange(len(grams)) + n <= ends
    grams, doc = grams[ok], doc[ok]
    short = [d for d in np.flatnonzero((counts > 0) & (counts < n)).tolist()]
    whole = [run_hashes(words[block.word_offsets[d] : block.word_offsets[d + 1]], counts[d])[0] + np.uint64(counts[d]) for d in short]
    grams = np.concatenate([grams, np.array(whole, dtype=np.uint64)])
    doc = np.concatenate([doc, np.array(short, dtype=doc.dtype)])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(block.docs + 1))


def digests(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for each set, whatever the order of its elements."""
    sums = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(mix(grams ^ _SUM), out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def parities(grams: np.ndarray, offsets: np.ndarray, words: int = PARITY) -> np.ndarray:
    """For each set, whether each of 64 * words cells holds an odd number of elements, as bits.

    Two sets differ in no fewer elements than these bits.
    """
    docs, some = len(offsets) - 1, 12_288 // words
    if docs > some:  # bounded memory for many short texts
        cuts = range(0, docs, some)
        return np.concatenate([parities(grams[offsets[c] : offsets[min(docs, c + some)]], offsets[c : min(docs, c + some) + 1] - offsets[c], words) for c in cuts])
    cell = (mix(grams + np.uint64(1)) >> np.uint64(20)).astype(np.int64) % (64 * words)
    counts = np.bincount(np.repeat(np.arange(docs), np.diff(offsets)) * (64 * words) + cell, minlength=docs * 64 * words)
    bits = np.packbits((counts & 1).astype(np.uint8).reshape(docs, 64 * words), axis=1)
    return np.ascontiguousarray(bits).view(np.int64)


@lru_cache(maxsize=8)
def bands(numerator: int, denominator: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Last size of each band up to `largest`; the most differences of a pair whose smaller set is in the band."""
    last, most, at = [], [], 1
    while not last or last[-1] < largest:
        last.append(at * denominator // numerator)
        partner = last[-1] * denominator // numerator
        most.append((denominator - numerator) * (last[-1] + partner) // (denominator + numerator))
        at = last[-1] + 1
    return np.array(last), np.array(most)


def signatures(grams: np.ndarray, offsets: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set each is of. The last byte tells the pair of bands from its neighbours, and p: linked sets share more than p of one last byte."""
    sizes = np.diff(offsets)
    last, most = bands(numerator, denominator, 1 << max(4, int(sizes.max(initial=1)).bit_length()))
    own = np.searchsorted(last, sizes)
    out, of = [], []
    weights = mix(grams + _SUM)
    for key in (own, own - 1):  # as the smaller and as the larger of a pair
        k = np.where((key >= 0) & (sizes > 0), most[np.maximum(key, 0)], 0)
        # where no difference is allowed, linked sets are equal and need no signature
        spare = CORE + 1 + -(-(k // 2 + 1) // 10)
        groups = np.where(k > 0, k // 2 + 1 + spare, 0)
        base = np.concatenate([[0], np.cumsum(groups)])
        if not base[-1]:
            continue
        doc = np.repeat(np.arange(len(sizes)), sizes)
        take = groups[doc] > 0
        doc, h, w = doc[take], grams[take], weights[take]
        place = 3 * base[:-1][doc] + ((h >> np.uint64(17)) % (3 * groups[doc]).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(3 * base[-1], dtype=np.uint64)
        np.add.at(sums, place, w)
        sums = sums.reshape(-1, 3)
        two = sums.sum(1, dtype=np.uint64)[:, None] - sums
        owner = np.repeat(np.arange(len(sizes)), groups)
        group = np.arange(base[-1]) - base[:-1][owner]
        salt = mix((key[owner].astype(np.uint64) << np.uint64(40)) + (group.astype(np.uint64) << np.uint64(2)))
        last_byte = (2 * np.minimum(spare, 127) + (key & 1)).astype(np.uint64)[owner]
        out.append(((mix(two + salt[:, None] + np.arange(3, dtype=np.uint64)) & ~np.uint64(255)) | last_byte[:, None]).ravel())
        of.append(np.repeat(owner, 3))
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(of)


def _byte(sig: str | Column) -> Column:
    """The last byte of a signature."""
    return (F.col(sig) if isinstance(sig, str) else sig).bitwiseAND(F.lit(255))


def _spare(byte: Column) -> Column:
    """p of a last byte."""
    return F.shiftright(byte, 1)


def _key(doc_id: str | Column, text: str | Column) -> Column:
    """One number for an id, null or not, and a text."""
    return F.xxhash64(doc_id, text)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, block in blocks(batch, lower=True):
                grams, offsets = shingle_sets(block, n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start) for c in (0, 1)), pa.array(np.diff(offsets), pa.int64()), pa.array(digests(grams, offsets).view(np.int64))], names=["doc_id", "key", "n", "digest"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key bigint, n bigint, digest bigint")


def _signature_rows(docs: DataFrame, n: int, numerator: int, denominator: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, block in blocks(batch, lower=True):
                grams, offsets = shingle_sets(block, n)
                names = digests(grams, offsets).view(np.int64)
                listed = names.tolist()
                fresh = np.array([not (x in seen or seen.add(x)) for x in listed], dtype=bool)
                if len(seen) > REMEMBERED:
                    seen.clear()
                sizes = np.where(fresh, np.diff(offsets), 0)
                grams = grams[np.repeat(fresh, np.diff(offsets))]
                sig, of = signatures(grams, np.concatenate([[0], np.cumsum(sizes)]), numerator, denominator)
                for at in range(0, len(sig), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + 100_000].view(np.int64)), pa.array(names[of[at : at + 100_000]])], names=["sig", "digest"])

    return docs.select("text").mapInArrow(run, "sig bigint, digest bigint")


def _common(docs: DataFrame, n: int, numerator: int, denominator: int) -> DataFrame:
    """The commonest signatures of a sample of the rows: at most `COMMON` times as many as a set has. They only decide how rows are dealt."""
    rows, _ = spill(_signature_rows(docs.filter(F.pmod("key", F.lit(LOOKED)) == 0), n, numerator, denominator).distinct(), "looked")
    sets = rows.select("digest").distinct().count()
    return rows.groupBy("sig").count().filter((F.col("count") > 2) & (F.col("count") * COMMON > sets)).select("sig", F.lit(True).alias("common"))


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (sig, root, digest) with `turn`, their number within (sig, root), without a task that sees more than about NUMBERED of one."""
    large = rows.groupBy("sig", "root").count().withColumn("parts", F.ceil(F.col("count") / NUMBERED)).filter("parts > 1").select("sig", "root", "parts")
    dealt = rows.join(large, ["sig", "root"], "left").withColumn("part", F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1))))
    own = F.row_number().over(Window.partitionBy("sig", "root", "part").orderBy("digest"))
    sizes = dealt.filter("parts is not null").groupBy("sig", "root", "part").count()
    sum_before = F.coalesce(F.sum("count").over(Window.partitionBy("sig", "root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("sig", "root", "part", sum_before.alias("before"))
    return dealt.withColumn("own", own).join(before, ["sig", "root", "part"], "left").withColumn("turn", F.col("own") + F.coalesce("before", F.lit(0))).drop("own", "before", "part", "parts")


def _elements(docs: DataFrame, n: int) -> DataFrame:
    """Parity bits and elements of the texts whose digest, computed anew, is the given one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, block in blocks(batch, lower=True):
                grams, offsets = shingle_sets(block, n)
                long = np.diff(offsets) > LONG
                wide = parities(grams[np.repeat(long, np.diff(offsets))], np.concatenate([[0], np.cumsum(np.diff(offsets)[long])]), WIDE).ravel() if long.any() else np.zeros(0, dtype=np.int64)
                given = batch.column(0).slice(start, stop - start)
                columns = [
                    given,
                    pa.FixedSizeListArray.from_arrays(pa.array(parities(grams, offsets).ravel()), PARITY).cast(pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long * WIDE)]), pa.int32()), pa.array(wide)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "parity", "wide", "elements"]).filter(pc.equal(given, pa.array(digests(grams, offsets).view(np.int64))))

    return docs.select("digest", "text").mapInArrow(run, "digest bigint, parity array<bigint>, wide array<bigint>, elements array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of `edges` (a, b), by large-star and small-star rounds."""
    spark = edges.sparkSession
    now, path = spill(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new, to = spill(small, "edges")
        # stars only: no root is another's leaf and no leaf has two roots
        done = new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and new.groupBy("a").count().filter("count > 1").isEmpty()
        discard(spark, path)
        now, path = new, to
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def intersections(elements: np.ndarray, offsets: np.ndarray, split: int) -> np.ndarray:
    """Number of common elements of each set before `split` with each set from it on; of all with all where none are."""
    sets = len(offsets) - 1
    values, place, counts = np.unique(elements, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    several = counts[place] > 1
    owner, column = owner[several], (np.cumsum(counts > 1) - 1)[place[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = (slice(0, split), slice(split, sets)) if split < sets else (slice(0, sets), slice(0, sets))
    out = np.zeros((left.stop, right.stop - right.start), dtype=np.int64)
    for at in range(0, int((counts > 1).sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        has = np.zeros((sets, int(column[some][-1]) - at + 1), dtype=np.float32)  # sums of up to COLUMNS ones are exact
        has[owner[some], column[some] - at] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _may_link(ranked: DataFrame, lists: DataFrame, hubs: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b, n of both) of different roots that share a bucket in which one has a turn up to `hubs`, and that sizes, bits and lists don't prove unlinked.

    `ranked` has the rows of the buckets (sig, byte, digest, n, shared, root, turn), `lists` has sigs, whole and parity by digest and byte. A bucket is
    one block; the rows and the hubs of one of more than `BLOCK` rows are dealt into parts, and each part of the hubs meets each part of the rows in a block.
    """
    hub, columns = F.col("turn") <= hubs, ["digest", "n", "shared", "root", "sigs", "whole", "parity"]
    listed = ranked.join(lists, ["digest", "byte"])
    large = ranked.groupBy("sig").agg(F.count("*").alias("rows"), F.count_if(hub).alias("hubs")).filter(F.col("rows") > BLOCK)
    large, large_path = spill(large.select("sig", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("rows", "hubs")]), "large")
    if large.isEmpty():
        discard(ranked.sparkSession, large_path)
        dealt = listed.select("sig", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("member"), hub.alias("hub"), *columns)
    else:
        small = listed.join(F.broadcast(large), "sig", "left_anti").select("sig", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("member"), hub.alias("hub"), *columns)
        parted = listed.join(F.broadcast(large), "sig")
        as_member = parted.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("hubs") - 1)))
        as_member = as_member.select("sig", "x", F.pmod(F.xxhash64("digest"), F.col("rows")).cast("int").alias("y"), F.lit(True).alias("member"), F.lit(False).alias("hub"), *columns)
        as_hub = parted.filter(hub).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        as_hub = as_hub.select("sig", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("hubs")).cast("int").alias("x"), "y", F.lit(False).alias("member"), F.lit(True).alias("hub"), *columns)
        dealt = small.unionByName(as_member).unionByName(as_hub)
    block = ["sig", "x", "y"]
    dealt = dealt.repartition(*block).sortWithinPartitions(*block)

    def compared(sig: int, parts: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        digest, n, shared, root = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("digest", "n", "shared", "root"))
        member, hub, whole = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("member", "hub", "whole"))
        # bits of signed numbers would be counted in their absolute values
        parity = np.concatenate([p.column("parity").flatten().to_numpy() for p in parts]).view(np.uint64).reshape(len(digest), -1)
        lengths = np.concatenate([p.column("sigs").value_lengths().to_numpy() for p in parts]).astype(np.int64)
        filled = np.arange(lengths.max()) < lengths[:, None]
        sigs = np.zeros(filled.shape, dtype=np.int64)
        sigs[filled] = np.concatenate([p.column("sigs").flatten().to_numpy() for p in parts])
        rows, hubs_in = np.flatnonzero(member), np.flatnonzero(hub)
        some = max(1, CELLS // max(1, len(rows)))
        for at in range(0, len(hubs_in) if len(rows) else 0, some):
            h = hubs_in[at : at + some, None]
            fits = (root[h] != root[rows]) & (denominator * np.minimum(n[h], n[rows]) >= numerator * np.maximum(n[h], n[rows]))
            fits &= (denominator + numerator) * np.minimum(shared[h], shared[rows]) >= numerator * (n[h] + n[rows])
            x, y = np.nonzero(fits)
            a, b = h[x, 0], rows[y]
            for cut in range(0, len(a), CELLS // 8):
                i, j = a[cut : cut + CELLS // 8], b[cut : cut + CELLS // 8]
                apart = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
                may = apart <= (denominator - numerator) * (n[i] + n[j]) // (denominator + numerator)
                i, j = i[may], j[may]
                for to in range(0, len(i), CELLS // 128):
                    yield taken(sig, i[to : to + CELLS // 128], j[to : to + CELLS // 128], digest, n, whole, sigs, filled)

    def taken(sig: int, i: np.ndarray, j: np.ndarray, digest: np.ndarray, n: np.ndarray, whole: np.ndarray, sigs: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, ...]:
        # a pair whose sets list every bucket of a last byte that they ever had shares more than p of them, or it can't link by them. One
        # whose sets list a part is taken up in the first of these that it still shares, if that is among those of both, else in all
        both = ((sigs[i][:, :, None] == sigs[j][:, None, :]) & filled[j][:, None, :]).any(2) & filled[i]
        first = np.where(both, sigs[i], np.iinfo(np.int64).max).min(1)
        take = np.where(whole[i] & whole[j], both.sum(1) > (sig & 255) >> 1, whole[i] | whole[j] | ~both.any(1) | (first == sig))
        i, j = i[take], j[take]
        less = digest[i] < digest[j]
        a, b = np.where(less, i, j), np.where(less, j, i)
        return digest[a], digest[b], n[a], n[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def written() -> Iterator[pa.RecordBatch]:
            for found in compared(key[0], held):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "na", "nb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in block])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                new = tuple(keys[:, start].tolist())
                if held and new != key:
                    yield from written()
                    held = []
                key = new
                held.append(batch.slice(start, stop - start))
        if held:
            yield from written()

    return dealt.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def _decided(members: DataFrame, elements: DataFrame, numerator: int, denominator: int, pairs: bool) -> DataFrame:
    """All links between the sets of each component, as pairs (a, b) or as digest, links (to be added up; weighted by copies).

    `members` has root, digest, n and copies.
    """
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).cast("int").alias("chunks")).filter("chunks > 1")
    placed = members.join(F.broadcast(sizes), "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")).join(elements.select("digest", "elements"), "digest")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = ["root", "low", "high"]
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "digest", "copies", "elements")
    dealt = dealt.repartition(*block).sortWithinPartitions(*block, "side")

    def compared(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        side, digest, copies = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("side", "digest", "copies"))
        sets = [p.column("elements") for p in parts]
        lengths = np.concatenate([x.value_lengths().to_numpy() for x in sets]).astype(np.int64)
        split = int(np.searchsorted(side, 1))
        same = parts[0].column("low")[0].as_py() == parts[0].column("high")[0].as_py()
        if not same and split in (0, len(side)):  # one of the chunks has no set
            return digest[:0], digest[:0]
        common = intersections(np.concatenate([x.flatten().to_numpy() for x in sets]), np.concatenate([[0], np.cumsum(lengths)]), split)
        one, two = (slice(None), slice(None)) if same else (slice(0, split), slice(split, None))
        ok = denominator * common >= numerator * (lengths[one][:, None] + lengths[two][None, :] - common)
        if same:
            np.fill_diagonal(ok, False)
        if pairs:
            x, y = np.nonzero(np.triu(ok) if same else ok)
            return np.minimum(digest[one][x], digest[two][y]), np.maximum(digest[one][x], digest[two][y])
        links = ok @ copies[two]
        return (digest, links) if same else (digest, np.concatenate([links, copies[one] @ ok]))

    names = ["a", "b"] if pairs else ["digest", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, out, size = None, [], 0

        def written() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([x[i] for x in out]) for i in (0, 1))
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in block])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                new = tuple(keys[:, start].tolist())
                if held and new != key:
                    out.append(compared(held))
                    held, size = [], size + len(out[-1][0])
                    if size > 100_000:
                        yield from written()
                        out, size = [], 0
                key = new
                held.append(batch.slice(start, stop - start))
        if held:
            out.append(compared(held))
        if out:
            yield from written()

    return dealt.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def join_links(docs: DataFrame, n: int = 4, numerator: int = 85, denominator: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links between the rows of `docs` (doc_id, text), in three tables.

    doc_id, n_shingles, component_id and n_links (the number of other rows with which the row links, rows of equal
    sets among them) of every row; the linked pairs (a, b) of different classes of equal sets, each once with a < b;
    and the rows of each class (digest, doc_id). Two texts link when denominator * intersection >= numerator * union
    of their sets of n-word shingles.
    """
    sets, elements, roots = _connected(docs, n, numerator, denominator)
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "digest")
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min("n").alias("n"), F.count("*").alias("copies"))
    members, _ = spill(whole.join(classes, "digest"), "members")
    none = F.lit(None).cast("bigint").alias("root")
    marks = _decided(members, elements, numerator, denominator, pairs=False).select("digest", none, "links")
    marks = marks.unionByName(members.select("digest", "root", F.lit(0).cast("bigint").alias("links")))
    marks = marks.unionByName(classes.filter("copies > 1").select("digest", none, (F.col("copies") - 1).alias("links")))
    marks, _ = spill(marks.groupBy("digest").agg(F.max("root").alias("root"), F.sum("links").alias("links")), "marks")
    placed = _components_of(sets, marks)
    placed = placed.select("doc_id", "n_shingles", "component_id", F.when(F.col("n_shingles") > 0, F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))
    return placed, _decided(members, elements, numerator, denominator, pairs=True), sets.filter("n > 0").select("digest", "doc_id")


def join_components(docs: DataFrame, n: int = 4, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text), as in `join_links`, without deciding all links."""
    sets, _, roots = _connected(docs, n, numerator, denominator)
    return _components_of(sets, roots.withColumnRenamed("node", "digest")).select("doc_id", "n_shingles", "component_id")


def _components_of(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with n_shingles, root and component_id; `roots` has digest and root of sets that have one."""
    found = sets.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = found.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).withColumnRenamed("n", "n_shingles")


def _connected(docs: DataFrame, n: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows; the elements of the candidates; node, root of the sets that are linked."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("key", _key("doc_id", "text"))
    sets, _ = spill(_sets(rows, n), "sets")

    # buckets of two or more different sets, sorted by signature and set; those of common signatures are dealt by set too and kept unseen
    common = _common(rows, n, numerator, denominator)
    given = _signature_rows(rows, n, numerator, denominator).join(F.broadcast(common), "sig", "left")
    given = given.withColumn("salt", F.when(F.col("common"), F.pmod("digest", F.lit(SALTS))).otherwise(0))
    order = Window.partitionBy("sig", "salt").orderBy("digest")
    near = given.select("sig", "digest", "common", F.lag("digest").over(order).alias("before"), F.lead("digest").over(order).alias("next"))
    buckets, bucket_path = spill(near.filter("before <> digest or next <> digest or (common and before is null)").select("sig", "digest"), "buckets")
    clean_shuffles(spark)
    # linked sets share more than p signatures: sets that share fewer with all others together leave
    core = buckets.distinct().withColumn("byte", _byte("sig"))
    enough = core.groupBy("digest", "byte").count().filter(F.col("count") > _spare(F.col("byte"))).select("digest", "byte")
    core = core.join(enough, ["digest", "byte"], "left_semi").select("sig", "digest")
    several = core.groupBy("sig").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("sig")
    core, core_path = spill(core.join(several, "sig", "left_semi"), "buckets")
    discard(spark, bucket_path)
    # without the p commonest of each set, by one order of all signatures, linked sets still share one
    common = core.groupBy("sig").agg(F.count("*").alias("sets"))
    turn = F.row_number().over(Window.partitionBy("digest", "byte").orderBy(F.desc("sets"), "sig"))
    rarer = core.join(common, "sig").withColumn("byte", _byte("sig")).withColumn("turn", turn).filter(F.col("turn") > _spare(F.col("byte"))).select("sig", "digest")
    several = rarer.groupBy("sig").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("sig")
    rarer, rarer_path = spill(rarer.join(several, "sig", "left_semi"), "buckets")
    candidates = rarer.select("digest").distinct()
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min("n").alias("n"), F.min("key").alias("key"))
    chosen = classes.join(candidates, "digest").select("key", "digest")
    # ids may be null, or repeated with another text: rows are found by id and text, and their digest is computed anew and compared
    elements = _elements(rows.join(chosen, "key").select("digest", "text"), n)
    elements, elements_path = spill(elements.dropDuplicates(["digest"]), "elements")
    clean_shuffles(spark)

    def linked(pairs: DataFrame) -> tuple[DataFrame, str]:
        """a, b, ok of the pairs (a, b, n of both), decided on the whole sets.

        Parity bits go first: they prove most pairs that don't link to be too different, at a tenth of the bytes.
        """
        at_most = F.floor((denominator - numerator) * (F.col("na") + F.col("nb")) / (denominator + numerator))
        apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda u, v: u + v)

        def by(bits: str, pairs: DataFrame) -> DataFrame:
            left, right = (elements.select(F.col("digest").alias(x), F.col(bits).alias(f"p{x}")) for x in "ab")
            return pairs.join(left, "a").join(right, "b").withColumn("may", apart <= at_most).select("a", "b", "na", "nb", "may")

        near, near_path = spill(by("parity", pairs), "close")
        both_long = (F.col("na") > LONG) & (F.col("nb") > LONG)
        close, close_path = spill(by("wide", near.filter("may").filter(both_long)).unionByName(near.filter(~F.col("may") | ~both_long)), "close")
        discard(spark, near_path)
        named = close.filter("may").select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        wanted = elements.select("digest", "elements")
        if named.limit(NAMED + 1).count() <= NAMED:
            wanted = wanted.join(F.broadcast(named), "digest", "left_semi")
        left, right = (wanted.select(F.col("digest").alias(x), F.col("elements").alias(f"e{x}")) for x in "ab")
        both = close.filter("may").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ea", "eb")))
        ok = denominator * F.col("common") >= numerator * (F.size("ea") + F.size("eb") - F.col("common"))
        both = both.select("a", "b", ok.alias("ok")).unionByName(close.filter("not may").select("a", "b", F.lit(False).alias("ok")))
        out = spill(both, "compared")
        discard(spark, close_path)
        return out

    sizes = classes.join(candidates, "digest").select("digest", "n")
    live, live_path = spill(rarer.join(sizes, "digest"), "live")
    discard(spark, rarer_path)

    # elements that no other candidate has can't be shared: sets with too few others link to nothing and leave
    alone = None
    for t in range(TILES):
        # a lambda's second parameter, a default one too, would be given the place in the array
        inside = elements.select("digest", F.explode("elements").alias("element")).filter(F.pmod("element", F.lit(TILES)) == t)
        single = inside.groupBy("element").agg(F.count("*").alias("sets"), F.min("digest").alias("digest")).filter("sets = 1").groupBy("digest").agg(F.count("*").alias("own"))
        single, _ = spill(single, "alone")
        alone = single if alone is None else alone.unionByName(single)
    alone = alone.groupBy("digest").agg(F.sum("own").alias("own"))
    shared = live.join(alone, "digest", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    able = shared.filter(denominator * F.col("shared") >= numerator * F.col("n"))
    several = able.groupBy("sig").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("sig")
    kept, kept_path = spill(able.join(several, "sig", "left_semi"), "live")
    discard(spark, live_path)
    live_path = kept_path
    stay = kept.select("digest").distinct()
    if 2 * stay.count() < elements.count():  # else a second copy costs more than it saves
        elements, _ = spill(elements.join(stay, "digest", "left_semi"), "elements")
        discard(spark, elements_path)
    every = core.join(kept.select("digest").distinct(), "digest", "left_semi").groupBy("digest", _byte("sig").alias("byte")).agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LISTED).alias("every"))
    every, _ = spill(every.filter(F.size("every") < LISTED), "listed")
    discard(spark, core_path)
    # buckets of the same sets and last byte count once: a pair is judged by those of one last byte
    content = kept.groupBy("sig").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    live, kept_path = spill(kept.join(content.groupBy("sets", "x", "y", _byte("sig")).agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi"), "live")
    discard(spark, live_path)
    live_path = kept_path
    fits = denominator * F.least("n", "hub_n") >= numerator * F.greatest("n", "hub_n")
    fits &= (denominator + numerator) * F.least("shared", "hub_shared") >= numerator * (F.col("n") + F.col("hub_n"))

    # first round: each set and the hub it shares most signatures with
    first = live.groupBy("sig").agg(F.min(F.struct((-F.col("shared") / F.col("n")).alias("own"), "digest", "n", "shared")).alias("first"))
    first = first.select("sig", F.col("first.digest").alias("hub"), F.col("first.n").alias("hub_n"), F.col("first.shared").alias("hub_shared"))
    star = live.join(first, "sig").filter((F.col("hub") != F.col("digest")) & fits)
    best = star.groupBy("digest", "hub").agg(F.count("*").alias("count"), F.first("n").alias("n"), F.first("hub_n").alias("hub_n")).groupBy("digest").agg(F.max_by(F.struct("hub", "hub_n", "n"), "count").alias("best"))
    compared, _ = linked(best.select(F.col("best.hub").alias("a"), F.col("digest").alias("b"), F.col("best.hub_n").alias("na"), F.col("best.n").alias("nb")))
    links = compared.filter("ok").select("a", "b")
    failed = compared.filter("not ok").select("a", "b")
    roots = components(links)
    hubs_each = 1
    while True:
        placed = live.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        # rows of buckets that still hold several components; those taken as hubs before are gone
        several = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("sig")
        open_, open_path = spill(placed.join(several, "sig").select("sig", "digest", "n", "shared", "root"), "live")
        ranked, ranked_path = spill(_numbered(open_).select("sig", "digest", "n", "shared", "root", "turn"), "live")
        discard(spark, live_path, open_path)
        if ranked.isEmpty():
            discard(spark, ranked_path)
            break
        # sets are compared by bits within their buckets, so that only pairs that may link become rows
        ranked_by = ranked.withColumn("byte", _byte("sig"))
        lists = ranked_by.groupBy("digest", "byte").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LISTED).alias("left")).join(every, ["digest", "byte"], "left")
        lists = lists.select("digest", "byte", F.coalesce("every", "left").alias("sigs"), F.col("every").isNotNull().alias("whole")).join(elements.select("digest", "parity"), "digest")
        pairs, pairs_path = spill(_may_link(ranked_by, lists, hubs_each, numerator, denominator).distinct(), "pairs")
        compared, _ = linked(pairs.join(failed, ["a", "b"], "left_anti"))
        links = links.unionByName(compared.filter("ok").select("a", "b"))
        failed = failed.unionByName(compared.filter("not ok").select("a", "b"))
        if not compared.filter("ok").isEmpty():
            roots = components(links)
        discard(spark, pairs_path)
        live, live_path = ranked.filter(F.col("turn") > hubs_each).select("sig", "digest", "n", "shared"), ranked_path
        hubs_each *= 4

    return sets, elements, roots


def one_of_each(docs: DataFrame, n: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row of `docs` of each component, that of the smallest id (null last) and key of id and text; columns as they are.

    Rows without a word are components of their own and stay.
    """
    sets, _, roots = _connected(docs, n, numerator, denominator)
    found = _components_of(sets, roots.withColumnRenamed("node", "digest"))
    first = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias("_j_key")).withColumn("_j_worded", F.lit(True)).unionByName(found.filter("n_shingles = 0").select(F.col("key").alias("_j_key")).distinct().withColumn("_j_worded", F.lit(False)))
    again = sets.filter("n > 0").groupBy("key").count().filter("count > 1").select(F.col("key").alias("_j_key"), F.lit(True).alias("_j_again"))
    kept, _ = spill(kept.join(again, "_j_key", "left"), "kept")
    rows = docs.withColumn("_j_key", _key(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # only rows whose id and text are repeated are dealt by them once more
    once = rows.join(kept.filter("_j_again is null or not _j_worded").select("_j_key"), "_j_key", "left_semi")
    repeated = rows.join(kept.filter("_j_again and _j_worded").select("_j_key"), "_j_key", "left_semi").dropDuplicates(["_j_key"])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
