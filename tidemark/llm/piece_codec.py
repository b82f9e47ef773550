"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Encoding keeps an agenda of adjacent symbol pairs, highest score first and
leftmost first among equals, and merges until the agenda is empty. No piece of a
vocabulary accepted here has the space mark after another character, so merges
never cross the place before a run of space marks; texts are cut there, and each
distinct stretch is merged once per worker and kept in a bounded memo. The agendas of
many short stretches are one matrix of pair scores whose rows give up their best pair
together; a long stretch has a heap. Every stretch that enters the memo is checked
against the sentencepiece library in the Arrow batch that brought it;
``verify="texts"`` checks whole texts as well. Decoding is the library's decode(ids).

Defined results: null text counts as empty, an empty text has no ids and decodes
to the empty string, equal rows give equal rows, columns beyond the named ones
are ignored by the queries and kept by ``append_ids``, whose own columns replace
those of the same names. A text of any length is one row and is encoded whole.
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

from .common import texts

MARK = "▁"
#: Stretches that a worker keeps before the older ones go; characters up to which stretches share a matrix.
MEMO, SHORT = 500_000, 32
#: Texts that are encoded together.
STEP = 512
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCodec:
    """One vocabulary: merge agenda, byte fallback, library check."""

    def __init__(self, model: str):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_file=model)
        sp, n = self.sp, self.sp.get_piece_size()
        self.score, self.id = {}, {}
        for i in range(n):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                self.score[piece], self.id[piece] = -sp.get_score(i), i
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses a space; its vocabulary cannot be cut at spaces")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = sp.unk_id()
        self.fallback = sp.is_byte(self.byte[0])
        #: ids of a stretch as bytes of int32, which take a third of what a tuple does; and each id as decimal text
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(n)]
        self.pairs = PairTable(self.score, self.id)

    def merge(self, stretch: str) -> tuple[int, ...]:
        """Ids of one stretch, space marks already in place."""
        score, sym = self.score, list(stretch)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((s, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, size = pop(agenda)
            a, b = sym[i], sym[j]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = a + b, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                s = score.get(sym[i] + sym[k])
                if s is not None:
                    push(agenda, (s, i, k, size + len(sym[k])))
            h = left[i]
            if h >= 0:
                s = score.get(sym[h] + sym[i])
                if s is not None:
                    push(agenda, (s, h, i, len(sym[h]) + size))
        out, unknown = [], False
        for x in sym:
            if not x:
                continue
            i = self.id.get(x)
            if i is not None:
                out.append(i)
                unknown = False
            elif self.fallback:
                out += [self.byte[b] for b in x.encode()]
            elif not unknown:
                out.append(self.unk)
                unknown = True
        return tuple(out)

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The independent parts of a text; each but in odd texts is a word without its space mark."""
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return _STRETCH.findall(MARK + text.replace(" ", MARK))
        return text.split(" ")

    def merge_all(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """Ids of each stretch, space marks already in place."""
        out: list[tuple[int, ...] | None] = [None] * len(stretches)
        short = [k for k, x in enumerate(stretches) if len(x) <= SHORT]
        short.sort(key=lambda k: len(stretches[k]))
        for at in range(0, len(short), 4096):  # of about one length
            part = short[at : at + 4096]
            for k, ids in zip(part, self.pairs.merge([stretches[k] for k in part]), strict=True):
                out[k] = ids
        # characters outside the vocabulary need bytes, long stretches a heap
        return [self.merge(x) if ids is None else ids for x, ids in zip(stretches, out, strict=True)]

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Merge stretches that the memo lacks, and check each against the library."""
        new = list(wanted)
        ids = self.merge_all([x if x[:1] == MARK else MARK + x for x in new])
        # the library puts a mark of its own before a text, so one is taken away
        for x, mine, its in zip(new, ids, self.sp.encode([x[1:] if x[:1] == MARK else x for x in new], num_threads=1), strict=True):
            if mine != tuple(its) and x != MARK and x:
                raise ValueError(f"agenda and library differ on {x!r}: {mine} and {tuple(its)}")
        flat = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        return {x: flat[a:e] for x, a, e in zip(new, [0, *ends[:-1]], ends, strict=True)}

    def encode_batch(self, batch: list[str]) -> list[list[int]]:
        """Ids of each text, as the library's encode() without begin and end."""
        parts = [self.stretches(t) if t else [] for t in batch]
        memo, old = self.memo, self.old
        lacking = {x for p in parts for x in p if x not in memo}
        known = {x: old[x] for x in lacking if x in old}
        memo.update(known)
        memo.update(self.learn(lacking.difference(known)))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, p)), "<i4").tolist() for p in parts]
        if len(memo) > MEMO:  # what was used lately outlives one change of generation
            self.old, self.memo = memo, {}
        return out

    def forget(self) -> None:
        """Free the memo; a worker that goes on to other work does not keep it."""
        self.memo, self.old = {}, {}


class PairTable:
    """Merges many short stretches together: every pair of symbols that makes a piece, in a table of open addressing."""

    def __init__(self, score: dict[str, float], ids: dict[str, int]):
        symbols = dict(ids)
        for c in {c for piece in ids for c in piece}:
            symbols.setdefault(c, len(symbols) + max(ids.values(), default=0) + 1)
        self.base = max(symbols.values(), default=0) + 1  # characters that no piece holds are numbered from here
        self.piece = np.zeros(self.base, bool)
        self.piece[list(ids.values())] = True
        self.score = np.full(self.base + 1, np.inf)
        self.score[[ids[p] for p in score]] = list(score.values())
        self.char = np.arange(0x110000, dtype=np.int64) + self.base
        for x, k in symbols.items():
            if len(x) == 1:
                self.char[ord(x)] = k
        self.width = self.base + 0x110000
        key, made = [], []
        for piece in score:
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    key.append(a * self.width + b)
                    made.append(ids[piece])
        key_, made_ = np.array(key, np.int64), np.array(made, np.int32)
        self.bits = max(8, int(4 * len(key) + 1).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.base, np.int32)
        left, slot = np.arange(len(key_)), self.slot(key_)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = key_[free]
            mine = free[self.keys[slot[free]] == key_[free]]
            self.made[slot[mine]] = made_[mine]
            left = np.setdiff1d(left, mine)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or base; a negative symbol makes none."""
        key = np.where((a < 0) | (b < 0), -2, a * self.width + b)
        slot = self.slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.made[slot], self.base)
        left = np.flatnonzero((seen != key) & (seen >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.made[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out

    def merge(self, stretches: list[str]) -> list[tuple[int, ...] | None]:
        """Ids of each stretch; None where a symbol is no piece."""
        size = np.array([len(x) for x in stretches])
        most, n = int(size.max()), len(stretches)
        inside = (np.arange(most)[None] < size[:, None]).ravel()
        sym = np.full(n * most + 1, -1)  # row by row; the last cell stands beyond all ends
        sym[:-1][inside] = self.char[np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")]
        end, cell = n * most, np.arange(n * most + 1)
        after, before = np.append(np.where(np.append(inside[1:], False) & (cell[1:] % most > 0), cell[:-1] + 1, end), end), cell - 1
        before[:-1:most] = before[-1] = end
        made = np.full(n * most + 1, self.base, np.int64)  # by each symbol and the one after it
        pair = np.flatnonzero(inside & (after[:-1] < end))
        made[pair] = self.join(sym[pair], sym[pair + 1])
        rank = self.score[made]
        agenda, row = rank[:-1].reshape(n, most), np.arange(n) * most
        while True:
            i = row + agenda.argmin(1)  # the leftmost of equals
            i = i[rank[i] < np.inf]
            if not len(i):
                break
            j = after[i]
            k, h = after[j], before[i]
            sym[i], sym[j], rank[j] = made[i], -1, np.inf
            after[i], before[k] = k, i
            for x, y in ((i, k), (h, i)):
                made[x] = self.join(sym[x], sym[y])  # a cell beyond the ends makes no piece
                rank[x] = self.score[made[x]]
            sym[end], rank[end], after[end], before[end] = -1, np.inf, end, end
        left = sym[:-1].reshape(n, most)
        kept = left >= 0
        good = (~kept | (self.piece[np.minimum(left, self.base - 1)] & (left < self.base))).all(1).tolist()
        flat, ends = left[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[e:f]) if ok else None for e, f, ok in zip([0, *ends[:-1]], ends, good, strict=True)]


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    """One codec per worker process and vocabulary file."""
    return PieceCodec(model)


def encode_texts(docs: DataFrame, model: str, verify: str = "stretches") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for every row of docs (doc_id, text)."""
    return texts(docs).mapInArrow(_coder(model, verify, digest=False), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, verify: str = "stretches") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text)."""
    return texts(docs).mapInArrow(_coder(model, verify, digest=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def append_ids(docs: DataFrame, model: str) -> DataFrame:
    """All columns of docs, ids (array of int; null text: none) and n_tokens long; the text becomes what the ids decode to."""
    docs = docs.drop("ids", "n_tokens")
    schema = docs.withColumn("ids", F.array(F.lit(0))).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for big in batches:
            for at in range(0, big.num_rows, STEP):
                b = big.slice(at, STEP)
                body = b.column(b.schema.get_field_index("text")).to_pylist()
                ids = c.encode_batch([t or "" for t in body])
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                cols["text"] = pa.array([None if t is None else c.sp.decode(x) if x else "" for t, x in zip(body, ids, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*cols.values(), _lists(ids), pa.array([len(x) for x in ids], pa.int64())], [*cols, "ids", "n_tokens"])
        c.forget()

    return docs.mapInArrow(run, schema)


def _lists(ids: list[list[int]]) -> pa.ListArray:
    flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))


def _coder(model: str, verify: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for big in batches:
            for at in range(0, big.num_rows, STEP):
                b = big.slice(at, STEP)
                body = b.column(1).to_pylist()
                ids = c.encode_batch(body)
                if verify == "texts" and ids != c.sp.encode(body, num_threads=1):
                    raise ValueError("agenda and library differ on a whole text")
                back = [c.sp.decode(x) if x else "" for x in ids]
                if digest:
                    cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hexed(",".join(map(c.decimal.__getitem__, x))) for x in ids]), pa.array([hexed(x) for x in back])]
                    yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
        c.forget()

    return run
