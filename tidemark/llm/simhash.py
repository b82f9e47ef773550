"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Each distinct fingerprint gets its Hamming distances to many reference
fingerprints (pivots) once. By the triangle inequality two fingerprints within
the radius differ by no more than the radius in every coordinate; all other
pairs are discarded by their largest coordinate difference, and the survivors
are verified bit by bit.

A coordinate of a random pivot lets about half of all pairs pass, so coordinates
alone give no key to meet on. Pairs therefore meet by block keys: of ``blocks``
blocks of bits, at least ``blocks - radius`` agree in any pair within the radius,
so each fingerprint is sent once for each choice of that many blocks, and no
pair is missed. Within a key, sorted runs are compared by pivots. A dense key is
treated by its own members as pivots: members within the radius of one are linked
to it at once, and only pairs not yet connected are compared, in row blocks. A key
of more than about ``tile`` members, as a sample tells, is dealt out as pairs of
tiles, each in a task of bounded size. Only links that connect something new leave a task, so a group of
copies yields as many links as members and not all its pairs; no link between
different components of the result is lost.

Defined results: null text counts as empty; texts without words have fingerprint
zero and are linked like any other; equal rows appear as often as they are in the
input; the smallest doc_id of a component names it (rows with a null doc_id keep
their group's); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, scratch, texts
from .components import components
from .prefix_join import apart_pairs, signatures, star_pairs

RADIUS, BLOCKS, PIVOTS, TILE = 4, 6, 24, 65_536
#: Rows of a key up to which all its pairs are compared by shifts; one fingerprint in how many is sampled for dense keys.
SMALL, SAMPLE = 48, 64


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of lower-cased words, repeats included; fewer words: one of the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    return np.array([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        count += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, width)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def pivots(count: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """Reference fingerprints: pseudo-random, the same everywhere."""
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot table: (rows, pivots) Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


class Forest:
    """Union-find over positions of a sorted run."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def dense_links(fps: np.ndarray, table: np.ndarray, radius: int, split: int = 0) -> list[tuple[int, int]]:
    """Links that connect all of a key's members that are connected within it; with split, only pairs across that position count."""
    n, forest, out = len(fps), Forest(len(fps)), []

    def add(i: int, j: int) -> None:
        if forest.join(i, j):
            out.append((i, j))

    if not split:  # own members as pivots: each takes those within the radius that none has taken
        left = np.arange(n)
        heads = []
        while len(left) and len(heads) < 64:
            i = int(left[0])
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            for j in left[near].tolist():
                add(i, j)
            heads.append(i)
            left = left[~near]
    roots = np.array([forest.root(i) for i in range(n)])
    step = 512
    for at in range(0, split or n, step):
        rows = slice(at, min(at + step, split or n))
        first = split or at
        apart = roots[rows][:, None] != roots[None, first:]
        if not apart.any():
            continue
        # one coordinate at a time, each on what the ones before it left
        i, j = np.nonzero(apart & (np.abs(table[rows, :1] - table[None, first:, 0]) <= radius))
        for p in range(1, table.shape[1]):
            if not len(i):
                break
            ok = np.abs(table[at + i, p] - table[first + j, p]) <= radius
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[at + i] ^ fps[first + j]) <= radius
        found = list(zip((at + i[ok]).tolist(), (first + j[ok]).tolist(), strict=True))
        for x, y in found:
            add(x, y)
        if found:
            roots = np.array([forest.root(i) for i in range(n)])
    return out


def _links(radius: int, count: int):
    """Links within runs of equal (key, tile pair) of rows sorted by them; columns key, tile, side, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(count)

        def handle(key: np.ndarray, side: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            """Whole keys only. Short ones by shifts all at once, others one by one."""
            table = distances(fps, refs)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            a, b = [], []
            short = np.repeat(sizes <= SMALL, sizes)
            most = int(sizes[sizes <= SMALL].max(initial=1))
            at = np.flatnonzero(short)
            place = np.arange(len(key)) - np.repeat(starts, sizes)
            room = np.repeat(sizes, sizes)
            for shift in range(1, most):
                at = at[place[at] + shift < room[at]]
                i, j = at, at + shift
                ok = (np.abs(table[i] - table[j]) <= radius).all(1)  # the largest coordinate difference
                i, j = i[ok], j[ok]
                ok = (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & ((side[i] == 2) | (side[i] != side[j]))
                a.append(fps[i[ok]])
                b.append(fps[j[ok]])
            for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                f, t, d = fps[s : s + n], table[s : s + n], side[s : s + n]
                split = 0 if d[0] == 2 else int((d == 0).sum())
                if pairs := dense_links(f, t, radius, split) if d[0] == 2 or 0 < split < n else []:
                    x, y = np.array(pairs).T
                    a.append(f[x])
                    b.append(f[y])
            x, y = (np.concatenate([np.zeros(0, np.uint64), *v]).view(np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(3)]
            cols[2] = cols[2].view(np.uint64)
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            if last:
                yield handle(*[c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held and len(held[0]):
            yield handle(*held)

    return run


#: Bytes up to which a list of ids is sent to all tasks, after a count; beyond, it is joined by a shuffle. Bytes of an id there.
SENT, ID_BYTES = 64_000_000, 64


def sent_if_small(ids: DataFrame, size: int) -> DataFrame:
    """Broadcast a list whose size has been counted, if it is within the bound."""
    return F.broadcast(ids) if size <= SENT else ids


def keyed_runs(distinct: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """key, side and the columns of distinct (fp and others): rows by block key, dense keys dealt out as pairs of tiles; sorted by key and side."""
    columns = distinct.columns
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    # a key is a hash of choice and bits; two keys in one run would only add comparisons
    keyed = distinct.select(*columns, F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)])).alias("key"))
    # dense keys show in a sample of the fingerprints; one that does not is a larger run for its task, and loses nothing
    some = keyed.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(SAMPLE)) == 0).groupBy("key").count()
    large = cut(some.where(F.col("count") * 4 * SAMPLE > tile).select("key", (F.ceil(F.col("count") * SAMPLE / tile) + 1).cast("int").alias("tiles")))
    if dense := large.count():
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        side = lambda o: F.when(own == o, F.lit(2)).when(own < o, F.lit(0)).otherwise(F.lit(1))
        alone = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(2).alias("side")))
        tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), side(o).alias("side")))
        dealt = keyed.join(sent_if_small(large, dense * ID_BYTES), "key", "left").select("key", *columns, F.explode(F.when(F.col("tiles").isNull(), alone).otherwise(tiles)).alias("p"))
        rows = dealt.select(F.when(F.col("p.i") < 0, F.col("key")).otherwise(F.xxhash64("key", "p.i", "p.j")).alias("key"), F.col("p.side").alias("side"), *columns)
    else:
        rows = keyed.select("key", F.lit(2).alias("side"), *columns)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "side").select("key", "side", *columns)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, count: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """a, b: pairs of fingerprints of column fp within the radius that connect all that are connected."""
    return keyed_runs(distinct.select("fp"), radius, blocks, tile).mapInArrow(_links(radius, count), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text)."""
    every = cut(fingerprints(docs, width))
    small = cut(every.groupBy("fp").agg(F.min("doc_id").alias("least")))
    vertex = components(links(small.select("fp"), radius, blocks))
    named = small.join(vertex, small.fp == vertex.vertex, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return every.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For deduplication by similarity: words of the shingles that fingerprints are made of; words of the shingles that are
#: compared, and least Jaccard similarity of them.
PRINT_WIDTH, WIDTH, SIMILARITY = 2, 5, 0.8


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingle hashes; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def similar_links(bodies: DataFrame, edges: DataFrame, width: int, least: float) -> DataFrame:
    """The edges (a, b: ids of bodies) whose texts are similar enough; bodies: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                memo: dict[str, np.ndarray] = {}
                for t in {*b.column(2).to_pylist(), *b.column(3).to_pylist()}:
                    memo[t] = shingle_hashes(t, width)
                ok = pa.array([jaccard(memo[x], memo[y]) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in b.columns[:2]], ["a", "b"])

    # texts without a link stay where they are while the ids of those with one are few enough to be sent to them
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bodies = bodies.join(sent_if_small(ends, edges.count() * 2 * ID_BYTES), "id", "left_semi")
    left = edges.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return left.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a string, b string")


def keep_representatives(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, print_width: int = PRINT_WIDTH, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (nulls last), all columns kept.

    Equal texts (null counts as empty) are one to begin with; of rows with one doc_id
    and text, that with the least hash of its other columns stays. Groups are the
    components of all pairs of texts whose shingle sets are similar enough. Fingerprints
    within the radius propose links, as ``links`` finds them. A similar pair can lie
    beyond any radius that block keys can afford, so rare-first prefixes propose one link
    for each text and element too, and then every other pair that may be similar and that
    verified links do not join. All proposals are verified on the whole texts.
    An edited word changes fewer short shingles than long ones, so fingerprints are made
    of shorter ones than those that are compared. Texts without words are one group.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and f.dataType.typeName() != "map"]
    rank = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(*plain).alias("tie")).alias("rank")
    named = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("id"), rank, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    path = scratch(docs.sparkSession, "distinct-texts")
    named.groupBy("id").agg(F.min("rank").alias("rank"), F.min_by("row", "rank").alias("row")).write.option("compression", "zstd").parquet(path)
    one = docs.sparkSession.read.parquet(path)
    bodies = one.select("id", F.coalesce("row.text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, print_width)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    def verified(proposed: DataFrame) -> DataFrame:
        return cut(similar_links(bodies, cut(proposed), width, least))

    def labels(held: DataFrame) -> DataFrame:
        """id, label: the component of each text that verified links join to another one."""
        return components(held).select(F.col("vertex").alias("id"), F.col("component").alias("label"))

    prints = cut(bodies.mapInArrow(run, "id string, fp long"))
    first = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("texts"))
    found = cut(links(first, radius, blocks))
    # texts of one fingerprint are linked to its first, and firsts to each other as fingerprints are
    within = prints.join(first.where("texts > 1"), "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    ends = [first.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_id")) for k in "ab"]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    near = within.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    rows = cut(signatures(bodies, width, least))
    held = verified(near.unionByName(star_pairs(rows, least)).distinct())
    labelled = rows.join(labels(held), "id", "left").withColumn("label", F.xxhash64(F.coalesce("label", "id")))
    groups = labels(held.unionByName(verified(apart_pairs(cut(labelled), least))))
    ranked = groups.join(one.select("id", "rank"), "id")
    least_of = ranked.groupBy("label").agg(F.min(F.struct("rank", "id")).alias("best"))
    losers = ranked.join(least_of, "label").where("id <> best.id").select("id")
    return one.join(sent_if_small(losers, groups.count() * ID_BYTES), "id", "left_anti").select("row.*")
