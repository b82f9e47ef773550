"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are lower-cased word sequences (runs of letters, digits and
underscores). A window of a document has as many words as an item, or is the
whole document where that is shorter. Its SimHash is the majority of its
five-word shingles' hashes, each weighted by how often it occurs. Item
fingerprints lie in a multi-index: eight blocks of eight bits, each listing the
items within two bits of a value, so every item within a radius of 23 bits is
found. Candidates of the window's length are verified by the exact weighted
Jaccard similarity of their shingles, sum of least over sum of greatest counts.

A window without any shingle of any item has similarity zero, so windows are only
fingerprinted where they hold one; no window that can pass is left out.

Items are read in blocks of a bounded number of bytes, each block's index is sent
to the tasks, and documents are read once for each block, so the benchmark may be
of any size; documents are never moved.

Defined results: null texts and items count as empty; an item without words is
never found; an item or text of fewer than five words is one shingle of all its
words; repeated rows and items, those of one item_id among them, are reported each;
of equally similar windows the first counts; a text of any length is read whole;
further columns are ignored by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Bytes of item texts in one index; more items mean more blocks.
INDEX_BYTES = 8_000_000
MEMO = 300_000
_WORD = re.compile(r"\w+")
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Codes:
    """64-bit codes of words; memo bounded."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.uint64)
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxh64_intdigest(w)
            return np.array([memo[w] for w in words], np.uint64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(codes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash for each run of width codes; of all codes if there are fewer."""
    width = min(width, len(codes))
    n = len(codes) - width + 1
    if not len(codes):
        return codes
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ codes[k : k + n]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Sums of the hashes' bits before each position, (n + 1, 64)."""
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=out[1:])
    return out


def window_prints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of size hashes from each start."""
    bits = 2 * (sums[starts + size] - sums[starts]) > size
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


class Index:
    """Items, their shingles, and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = SHINGLE):
        self.width, self.ids, self.words, prints, every = width, [], [], [], []
        codes = Codes()
        for item_id, text in items:
            if words := words_of(text):
                h = shingles(codes.of(words), width)
                self.ids.append(item_id)
                self.words.append(words)
                prints.append(int(window_prints(bit_sums(h), np.array([0]), len(h))[0]))
                every.append(h)
        self.prints = np.array(prints, np.uint64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        owner = np.repeat(np.arange(len(every)), [len(h) for h in every])
        flat = np.concatenate([np.zeros(0, np.uint64), *every])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], owner[order]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) < width:
                self.short.setdefault(tuple(w), []).append(i)
        self.short_sizes = sorted({len(w) for w in self.short})
        values = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(values[:, None] ^ values[None]) <= RADIUS // 8
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        #: for each block and value, the items that may lie within the radius
        self.lists = [[np.flatnonzero(near[v][blocks[:, k]]) for v in values] for k in range(8)] if len(prints) else []

    def within(self, print_: np.uint64) -> np.ndarray:
        """Items within the radius of a fingerprint."""
        v = np.array([print_], np.uint64).view(np.uint8)
        some = np.unique(np.concatenate([self.lists[k][v[k]] for k in range(8)]))
        return some[np.bitwise_count(self.prints[some] ^ print_) <= RADIUS]


def similarity(a: list[str], b: list[str], width: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of shingle counts."""
    x, y = (Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) for w in (a, b))
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 0.0


def find_items(words: list[str], h: np.ndarray, hit: np.ndarray, index: Index, least: float) -> list[tuple[int, float, int, int]]:
    """(place of the item, similarity, first word, words) of each item in one document, at its best window; h: shingles, hit: those of some item."""
    width, n = index.width, len(words)
    lo, hi = np.searchsorted(index.hashes, h[hit], "left"), np.searchsorted(index.hashes, h[hit], "right")
    wanted = np.unique(np.concatenate([index.owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
    sums = bit_sums(h)
    best: dict[int, tuple[float, int, int]] = {}
    for size in np.unique(index.sizes[wanted]).tolist():
        length = min(size, n)
        count = max(1, length - width + 1)
        # starts whose window holds a hit
        mark = np.zeros(len(h) + 1, np.int32)
        np.add.at(mark, np.maximum(hit - count + 1, 0), 1)
        np.add.at(mark, hit + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[: len(h) - count + 1])
        if not len(starts):
            continue
        prints = window_prints(sums, starts, count)
        distinct, back = np.unique(prints, return_inverse=True)
        found = {k: c for k, p in enumerate(distinct) if len(c := (c := index.within(p))[index.sizes[c] == size])}
        for s, k in zip(starts.tolist(), back.tolist(), strict=True):
            for item in found[k].tolist() if k in found else ():
                sim = similarity(words[s : s + length], index.words[item], width)
                if sim >= least and (item not in best or (-sim, s) < (-best[item][0], best[item][1])):
                    best[item] = (sim, s, length)
    return [(i, *v) for i, v in sorted(best.items())]


def short_items(words: list[str], index: Index) -> list[tuple[int, float, int, int]]:
    """Items of fewer words than a shingle: a window of as many words equals them or shares nothing."""
    out = {}
    for k in index.short_sizes:
        for at in range(len(words) - k + 1):
            for item in index.short.get(tuple(words[at : at + k]), ()):
                out.setdefault(item, (item, 1.0, at, k))
    return list(out.values())


SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _scan(index: Index, least: float, column: int, flag: str | None):
    """Rows of SCHEMA, or with a flag's name, the input's columns and whether any item was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                body = [words_of(t) for t in b.column(column).to_pylist()]
                flat = codes.of([w for ws in body for w in ws])
                ends = np.cumsum([len(ws) for ws in body])
                h = shingles(flat, index.width) if len(flat) >= index.width else np.zeros(0, np.uint64)
                if len(index.hashes) and len(h):
                    place = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
                    hits = np.flatnonzero(index.hashes[place] == h)
                    docs = set(np.searchsorted(ends, hits, side="right").tolist())
                else:
                    docs = set()
                out = {}
                # hits across two documents and texts shorter than a shingle are looked at again below
                for i in sorted(docs | {i for i, ws in enumerate(body) if index.short or len(ws) < index.width}):
                    a, e = int(ends[i]) - len(body[i]), int(ends[i])
                    own = shingles(flat[a:e], index.width)
                    if not len(own) or not len(index.hashes):
                        continue
                    place = np.minimum(np.searchsorted(index.hashes, own), len(index.hashes) - 1)
                    hit = np.flatnonzero(index.hashes[place] == own)
                    found = find_items(body[i], own, hit, index, least) if len(hit) else []
                    if index.short:
                        found = sorted({r[0]: r for r in [*found, *short_items(body[i], index)]}.values())
                    if found:
                        out[i] = [(index.ids[r[0]], *r[1:]) for r in found]
                if flag:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i in out for i in range(b.num_rows)])], [*b.schema.names, flag])
                else:
                    ids = b.column(0).to_pylist()
                    rows = [(ids[i], *r) for i, f in out.items() for r in f]
                    cols = zip(*rows, strict=True) if rows else [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def indexes(benchmark: DataFrame, width: int = SHINGLE, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over blocks of items, each of about limit bytes at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // limit))
    for k in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Index([(r.item_id, r.text) for r in rows.collect()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, width: int = SHINGLE, limit: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: every item in every document, at its best window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(benchmark, width, limit):
        part = rows.mapInArrow(_scan(index, least, 1, None), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, width: int = SHINGLE, limit: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs that hold no item."""
    for index in indexes(benchmark, width, limit):
        flag = fresh(docs, "contaminated")
        schema = docs.withColumn(flag, F.lit(False)).schema
        docs = docs.mapInArrow(_scan(index, least, docs.columns.index("text"), flag), schema).where(~F.col(flag)).drop(flag)
    return docs
