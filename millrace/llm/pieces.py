"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of the adjacent symbol pairs that form a vocabulary piece and always
merges the pair of the best score, leftmost first among equals. A text is first cut where no piece
of the vocabulary can span the cut, so equal chunks are encoded once: short chunks run through the
agenda together, one merge a round for all rows of a matrix; long ones have an agenda of their own
(a heap). Every chunk encoded is checked against the sentencepiece library in the same Arrow
batch; a difference is an error. Only models with identity normalisation are taken.

Defined results: null and empty texts have no ids and decode to the empty string; repeated rows
give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks of at most so many characters are encoded together.
SHORT = 32
#: Chunks remembered between batches by each Python worker.
REMEMBERED = 800_000


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.id_of = {pieces[i]: i for i in plain}
        self.unknown = sp.unk_id()
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if any(sp.is_unused(i) for i in range(n)) or sp.encode("ﬁ x", out_type=str)[:2] != [SPACE, "ﬁ"]:
            raise ValueError("only vocabularies without unused pieces and with identity normalisation")
        self.decoded = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.decoded[self.unknown] = " ⁇ ".encode()
        for b, i in self.byte_id.items():
            self.decoded[i] = bytes([b])
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.decimal = [str(i) for i in range(n)]
        self._index(plain, pieces)
        self.seen: dict[str, tuple[int, ...]] = {}

    def _index(self, plain: list[int], pieces: list[str]) -> None:
        """Symbols get numbers; a pair of symbols whose concatenation is a piece gets the rank of its score."""
        symbols = {p: k for k, p in enumerate(pieces[i] for i in plain)}
        scores = np.array([self.library.get_score(i) for i in plain])
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rank = [order[s] for s in scores]
        self.number, self.symbol_id = symbols, np.array(plain, dtype=np.int64)
        table = []
        for p, k in symbols.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    table.append((a << 32 | b, rank[k], k))
        table.sort()
        self.pair_keys = np.array([x[0] for x in table] or [0], dtype=np.int64)
        self.pair_rank = np.array([x[1] for x in table] or [0], dtype=np.int64)
        self.pair_to = np.array([x[2] for x in table] or [0], dtype=np.int64)
        self.pairs = {x[0]: (x[1], x[2]) for x in table}
        # a piece may hold a word mark only in a leading run of them, and never a line end beside another character
        many = [p for p in symbols if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in many):
            self.cut = re.compile(r"(?s).+")
        elif any("\n" in p for p in many):
            self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

    def _ids(self, symbol: str) -> tuple[int, ...]:
        if (i := self.id_of.get(symbol)) is not None:
            return (i,)
        if self.byte_id:
            return tuple(self.byte_id[b] for b in symbol.encode())
        return (self.unknown,)

    def agenda(self, chunk: str) -> tuple[int, ...]:
        """One chunk, with a heap of (rank of score, place) over linked symbols."""
        n = len(chunk)
        symbol = [self.number.get(c, -1) for c in chunk]
        text = list(chunk)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (found := self.pairs.get(symbol[i] << 32 | symbol[j])):
                heapq.heappush(heap, (found[0], i, symbol[i], symbol[j]))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            symbol[i] = self.pairs[a << 32 | b][1]
            text[i] += text[j]
            symbol[j], text[j] = -2, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            propose(before[i], i)
            propose(i, after[i])
        return tuple(chain.from_iterable((int(self.symbol_id[s]),) if s >= 0 else self._ids(t) for s, t in zip(symbol, text, strict=True) if s != -2))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the rank of no piece is the largest number."""
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_rank[at], np.iinfo(np.int64).max), self.pair_to[at]

    def together(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Short chunks, each a row of symbols; every round merges each row's best pair."""
        if not chunks:
            return []
        out: list[tuple[int, ...] | None] = [None] * len(chunks)
        sizes = np.array([len(c) for c in chunks])
        for width in np.unique((sizes + 7) // 8) * 8:
            rows = np.flatnonzero((sizes <= width) & (sizes > width - 8))
            codes = np.frombuffer("".join(chunks[r].ljust(width, "\0") for r in rows).encode("utf-32-le"), dtype=np.uint32)
            values, inverse = np.unique(codes, return_inverse=True)
            lone = np.array([self.number.get(chr(v), -1) for v in values], dtype=np.int64)
            s = lone[inverse].reshape(len(rows), width)
            s[np.arange(width) >= sizes[rows][:, None]] = -9
            source = np.tile(np.arange(width), (len(rows), 1))
            worst = np.iinfo(np.int64).max
            keys = (s[:, :-1] << 32) | s[:, 1:]
            rank, to = self._find(np.where((s[:, :-1] < 0) | (s[:, 1:] < 0), -1, keys))
            live, final, from_ = np.arange(len(rows)), s.copy(), source.copy()
            while len(live):
                best = rank.argmin(axis=1)
                here = np.arange(len(live))
                going = rank[here, best] < worst
                done = ~going
                final[live[done]], from_[live[done]] = s[done], source[done]
                live, s, rank, to, source, best = live[going], s[going], rank[going], to[going], source[going], best[going]
                if not len(live):
                    break
                here = np.arange(len(live))
                s[here, best] = to[here, best]
                column = np.arange(width)
                take = np.minimum(column + (column > best[:, None]), width - 1)
                s, source = np.take_along_axis(s, take, 1), np.take_along_axis(source, take, 1)
                s[:, -1] = -9
                pair = np.minimum(column[:-1] + (column[:-1] > best[:, None]), width - 2)
                rank, to = np.take_along_axis(rank, pair, 1), np.take_along_axis(to, pair, 1)
                rank[:, -1] = worst
                for side in (best - 1, best):  # only the pairs beside the merged symbol are new
                    ok = (side >= 0) & (side < width - 1)
                    r, c = here[ok], side[ok]
                    a, b = s[r, c], s[r, c + 1]
                    rank[r, c], to[r, c] = self._find(np.where((a < 0) | (b < 0), -1, (a << 32) | b))
            known = np.where(final >= 0, self.symbol_id[np.maximum(final, 0)], -1)
            lens = (final != -9).sum(1)
            plain = (final >= 0).sum(1) == lens
            for k, r in enumerate(rows):
                if plain[k]:
                    out[r] = tuple(known[k, : lens[k]].tolist())
                else:
                    out[r] = tuple(chain.from_iterable((i,) if i >= 0 else self._ids(chunks[r][p]) for i, p in zip(known[k, : lens[k]].tolist(), from_[k, : lens[k]].tolist(), strict=True)))
        return out  # type: ignore[return-value]

    def check(self, chunks: list[str], ids: list[tuple[int, ...]]) -> None:
        """Against the library; a line end before the chunk keeps the library's leading word mark apart from it."""
        start = self._ids(SPACE) + self._ids("\n")
        if self.cut.pattern[0] != "\n":
            return  # chunks can't be given to the library one by one; whole texts are checked instead
        theirs = self.library.encode(["\n" + c.replace(SPACE, " ") if c != "\n" else c for c in chunks], num_threads=1)
        for chunk, a, b in zip(chunks, ids, theirs, strict=True):
            if (a if chunk != "\n" else start) != tuple(b[len(start) :] if chunk != "\n" else b):
                raise ValueError(f"ids differ from the library's for {chunk[:100]!r}: {a[:20]} and {b[:20]}")

    def encode_batch(self, texts: list[str], check: bool = True) -> list[list[int]]:
        """Ids of each text, without begin or end ids."""
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(cut)).difference(self.seen))
        if len(self.seen) + len(fresh) > REMEMBERED:
            keep = set(chain.from_iterable(cut))
            self.seen = {c: self.seen[c] for c in keep if c in self.seen}
        short = [c for c in fresh if len(c) <= SHORT]
        long = [c for c in fresh if len(c) > SHORT]
        ids = [*self.together(short), *map(self.agenda, long)]
        if check:
            self.check([*short, *long], ids)
        self.seen.update(zip([*short, *long], ids, strict=True))
        out = [list(chain.from_iterable(map(self.seen.__getitem__, row))) for row in cut]
        if check and self.cut.pattern[0] != "\n" and out != [list(x) for x in self.library.encode(texts, num_threads=1)]:
            raise ValueError("ids differ from the library's")
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, word marks as spaces, without the leading one; bytes that form no character become U+FFFD each."""
        raw = b"".join(map(self.decoded.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mend(ids)
        return text[1:] if text.startswith(" ") else text

    def _mend(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.decoded[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i >= 0:
                out.append(self.decoded[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(docs: DataFrame, model: str, with_ids: bool = True, rows_at_once: int = 1024) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(start, rows_at_once)
                ids = m.encode_batch([t or "" for t in rows.column(1).to_pylist()])
                columns = [
                    rows.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(m.decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(m.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
