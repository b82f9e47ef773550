"""All pairs of similar word-shingle sets, by prefixes in order of rarity.

Two sets with a Jaccard similarity of at least ``least`` share an element among
the ``n - ceil(least * n) + 1`` first ones of each, whatever total order all sets
are listed in. Listed from the rarest, nearly all first elements of unlike texts
occur in one text only and need not be sent anywhere; a text whose prefix is all its
own has no similar text, which settles it without one comparison.

1. Texts are packed into chunks, one row each, of a bounded number of bytes.
2. Each chunk counts its texts by element and sends sorted columns of elements,
   40 bits each and pre-counted, to buckets of elements; a bucket adds the counts
   and tells each chunk which of its elements occur in two texts or more.
3. A chunk lists its texts' elements by rarity; the shared ones among the first
   become signature rows (element, text, size, place).
4. Texts that meet under one element are candidates if their sizes allow the
   similarity and if what follows the two places can still hold the overlap needed.

Elements are 48-bit hashes here. They only choose candidates; whoever calls this
compares the texts themselves. Chunks and buckets are of bounded size at any input;
an element in very many texts is one entry a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, scratch
from .decontaminate import Codes, shingles

#: Text bytes and texts of a chunk; elements of a bucket, about; bits of an element, and of what is left of it in one of the least number of buckets.
CHUNK_BYTES, CHUNK_TEXTS, BUCKET, BITS, REST = 3_000_000, 50_000, 2_000_000, 48, 40
#: Stands for the set of a text without words, so that such texts meet.
NOTHING = np.uint64(1)


def text_sets(bodies: list[bytes], width: int, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element) of every distinct element of every text, in that order."""
    words = [b.translate(LOWER).split() for b in bodies]
    flat = codes.of([w for ws in words for w in ws])
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    owner, element = [], []
    if len(flat) >= width:
        h = shingles(flat, width)
        first = np.repeat(np.arange(len(words)), sizes)[: len(h)]
        ok = np.arange(len(h)) + width <= ends[first]
        owner.append(first[ok])
        element.append(h[ok])
    for i in np.flatnonzero(sizes < width).tolist():  # one shingle of all words
        owner.append(np.array([i]))
        element.append(shingles(flat[ends[i] - sizes[i] : ends[i]], width) if sizes[i] else np.array([NOTHING << np.uint64(64 - BITS)]))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    o, e = np.concatenate(owner), np.concatenate(element) >> np.uint64(64 - BITS)
    order = np.lexsort((e, o))
    o, e = o[order], e[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (e[1:] != e[:-1])])
    return o[new], e[new]


def pack_chunks(bodies: DataFrame, path: str) -> DataFrame:
    """Rows (id, text) as rows (chunk, ids, sizes, z): the texts of a chunk compressed together; written at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, number, c = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            number += 1
            cols = [pa.array([(part << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([c.compress(b"".join(held))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "sizes", "z"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if held and (size + len(t) > CHUNK_BYTES or len(held) >= CHUNK_TEXTS):
                    yield flush()
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(t)
                size += len(t)
        if held:
            yield flush()

    bodies.select("id", "text").mapInArrow(run, "chunk long, ids array<string>, sizes array<long>, z binary").write.option("compression", "uncompressed").parquet(path)
    return bodies.sparkSession.read.parquet(path)


def unpack_chunk(sizes: list[int], z: bytes) -> list[bytes]:
    import zstandard

    flat = zstandard.ZstdDecompressor().decompress(z) if sum(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def to_planes(x: np.ndarray) -> bytes:
    """Sorted values below 2**40, byte by byte from the lowest, so that the high bytes of neighbours compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REST // 8].T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // (REST // 8), 8), np.uint8)
    out[:, : REST // 8] = np.frombuffer(raw, np.uint8).reshape(REST // 8, -1).T
    return out.view("<u8").ravel()


def shift_of(buckets: int) -> int:
    """Bits of an element that its bucket does not tell."""
    return BITS - int(math.log2(buckets))


def shared_elements(chunks: DataFrame, width: int, buckets: int) -> DataFrame:
    """chunk, bucket, rest, rank: elements of a chunk that occur in two texts or more, and how common they are (bytes, 8 * log2 of the count)."""
    shift = shift_of(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            for chunk, sizes, z in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                _, e = text_sets(unpack_chunk(sizes, z), width, codes)
                h, n = np.unique(e, return_counts=True)
                bucket = (h >> np.uint64(shift)).astype(np.int64)
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, np.int64)
                ends = np.append(at[1:], len(h))
                rest = h & np.uint64((1 << shift) - 1)
                cols = [pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), chunk, np.int64)), pa.array([to_planes(rest[x:y]) for x, y in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array([n[x:y].astype("<u2").tobytes() for x, y in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "rest", "n"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        bucket, chunk = key[0].as_py(), t["chunk"].to_numpy()
        rest = [from_planes(x) for x in t["rest"].to_pylist()]
        sizes = [len(x) for x in rest]
        flat = np.concatenate(rest)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        n = np.concatenate([np.frombuffer(x, "<u2") for x in t["n"].to_pylist()])[order].astype(np.int64)
        total = np.add.reduceat(n, np.flatnonzero(new))
        every = np.empty(len(flat), np.int64)
        every[order] = total[np.cumsum(new) - 1]
        rank = np.minimum(8 * np.log2(every), 255).astype(np.uint8)
        ends, out = np.cumsum(sizes).tolist(), ([], [], [])
        for c, size, e in zip(chunk.tolist(), sizes, ends, strict=True):
            often = np.flatnonzero(every[e - size : e] > 1) + e - size
            if len(often):
                out[0].append(c)
                out[1].append(to_planes(flat[often]))
                out[2].append(rank[often].tobytes())
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "bucket": pa.array([bucket] * len(out[0]), pa.int32()), "rest": pa.array(out[1], pa.binary()), "rank": pa.array(out[2], pa.binary())})

    rows = chunks.select("chunk", "sizes", "z").mapInArrow(count, "bucket int, chunk long, rest binary, n binary")
    return rows.groupBy("bucket").applyInArrow(add, "chunk long, bucket int, rest binary, rank binary")


def signatures(bodies: DataFrame, width: int, least: float) -> DataFrame:
    """h, id, size, place for the shared elements in the prefix of each row (id, text)."""
    spark, path = bodies.sparkSession, scratch(bodies.sparkSession, "chunks")
    chunks = pack_chunks(bodies, path)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = 1 << max(BITS - REST, math.ceil(math.log2(max(total / 6 / BUCKET, 1))))
    shift = shift_of(buckets)
    found = shared_elements(chunks, width, buckets).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "rest", "rank")).alias("found"))
    # chunks meet what was found of them in plain exchanges; both sides are one row a chunk
    met = chunks.join(found, "chunk").select("ids", "sizes", "z", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            for ids, sizes, z, some in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                owner, e = text_sets(unpack_chunk(sizes, z), width, codes)
                some.sort(key=lambda x: x["bucket"])
                known = np.concatenate([from_planes(x["rest"]) | np.uint64(x["bucket"] << shift) for x in some])
                rank = np.concatenate([np.frombuffer(x["rank"], np.uint8) for x in some])
                at = np.minimum(np.searchsorted(known, e), len(known) - 1)
                level = np.where(known[at] == e, rank[at], 0)  # 0: in this text alone
                order = np.lexsort((e, level, owner))
                n = np.bincount(owner, minlength=len(ids))
                place = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
                size = n[owner]
                prefix = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
                keep = order[(place < prefix) & (level[order] > 0)]
                spot = np.empty(len(e), np.int64)
                spot[order] = place
                yield pa.RecordBatch.from_arrays([pa.array(e[keep].astype(np.int64)), pa.array([ids[i] for i in owner[keep].tolist()], pa.string()), pa.array(size[keep].astype(np.int32)), pa.array(spot[keep].astype(np.int32))], ["h", "id", "size", "place"])

    return met.mapInArrow(run, "h long, id string, size int, place int")


def possible(size_a, place_a, size_b, place_b, least: float):
    """May two sets that meet at these places be similar enough? For numpy arrays."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    overlap = np.ceil((size_a + size_b) * (least / (1 + least)) - 1e-9)
    return (small >= least * large - 1e-9) & (np.minimum(size_a - place_a, size_b - place_b) >= overlap)


def star_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a, b: each row's text and the most central one under its element, if they may be similar; rows: h, id, size, place.

    The text with the fewest rarer elements before the common one differs least from the others, so that in a group of
    copies nearly all members are similar to it.
    """
    first = rows.groupBy("h").agg(F.min(F.struct("place", "size", "id")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h", "f")
    met = rows.join(first, "h").where("id <> f.id")
    share = least / (1 + least)
    fits = (F.least("size", "f.size") >= F.lit(least) * F.greatest("size", "f.size") - 1e-9) & (F.least(F.col("size") - F.col("place"), F.col("f.size") - F.col("f.place")) >= F.ceil((F.col("size") + F.col("f.size")) * share - 1e-9))
    return met.where(fits).select(F.least("id", "f.id").alias("a"), F.greatest("id", "f.id").alias("b")).distinct()


def apart_pairs(rows: DataFrame, least: float, step: int = 512) -> DataFrame:
    """a, b: all pairs of texts under one element that may be similar and differ in label; rows: h, id, label, size, place."""

    def handle(ids: np.ndarray, label: np.ndarray, size: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        # the most frequent label's texts are compared with the others, and the others with each other
        kinds, number, n = np.unique(label, return_inverse=True, return_counts=True)
        order = np.argsort(number == n.argmax(), kind="stable")
        ids, label, size, place = ids[order], label[order], size[order], place[order]
        for at in range(0, len(ids) - int(n.max()), step):
            i = np.arange(at, min(at + step, len(ids) - int(n.max())))
            ok = (label[i, None] != label[None, at:]) & (np.arange(at, len(ids))[None] > i[:, None])
            x, y = np.nonzero(ok & possible(size[i, None], place[i, None], size[None, at:], place[None, at:], least))
            if len(x):
                x, y = ids[i[x]], ids[at + y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            mixed = np.minimum.reduceat(cols[2], starts) != np.maximum.reduceat(cols[2], starts)
            for k in np.flatnonzero(mixed[:-1]).tolist():
                yield from handle(*[c[starts[k] : starts[k + 1]] for c in cols[1:]])
            held = [c[starts[-1] :] for c in cols]  # the last element may go on in the next batch
        if held and len(np.unique(held[2])) > 1:
            yield from handle(*held[1:])

    mixed = rows.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    met = rows.join(mixed, "h", "left_semi")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = met.repartition(n, "h").sortWithinPartitions("h").select("h", "id", "label", "size", "place")
    return runs.mapInArrow(run, "a string, b string").distinct()
