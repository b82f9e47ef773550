"""Removal of long byte strings that occur more than once, by sorted suffixes.

A byte goes if it lies in a ``length``-byte string that starts at two places of
the corpus. Sorting a suffix for every byte would move the corpus hundreds of
times, so suffixes are first chosen by content: of the ``gram``-byte strings
inside a window of ``length`` bytes, the one with the least hash is the window's
anchor (the leftmost of equals). Equal windows have equal anchors at equal
offsets, and windows with one anchor form a run. Windows whose anchor occurs once
cannot repeat. The remaining runs are the suffixes that are sorted:

1. anchors of all windows are counted by hash;
2. runs with a repeated anchor are cut out of their texts and range-partitioned
   by their leading bytes from the anchor, with splitters sampled from the input;
3. a bucket sorts its runs by anchor. Equal runs repeat as a whole. Where an
   anchor has different runs, their windows are sorted by multikey quicksort: eight
   bytes at a time, only those still tied go on, and windows tied to the end repeat.

Equal leading bytes never lie on two sides of a splitter, so nothing has to be
compared across a bucket's boundaries; only an anchor of over ``hot`` runs is taken
out of its bucket: equal runs become one with its count, its windows become suffixes
of their own, whose sorted order may be cut anywhere, and are compared across the
boundaries by partial counts of their 128-bit hashes. Anchors and windows that are
very frequent meet their counts without a shuffle by them: the counts are sent to the
rows while they are small, as a count of them tells, and are salted beyond. Texts are
moved twice, compressed; anchors and runs in proportion.

Defined results: null text counts as empty; a row that is repeated with the same
doc_id repeats itself; texts below ``length`` bytes lose nothing; equal texts lose
the same bytes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, texts

LENGTH, GRAM, HOT = 200, 60, 65_536
#: Rows of an anchor from which it meets its count apart from the others; leading bytes that buckets are cut by; bytes of a key that is sent, and up to which all are; salts beyond.
FREQUENT, LEAD, KEY_BYTES, SENT, SALTS = 2_000, 32, 64, 64_000_000, 32
#: Documents from which splitters are sampled, at most; and bytes that a step holds at once.
SAMPLE_DOCS, HOLD = 2_000, 12_000_000
_BASE, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width bytes from each position."""
    n = len(flat) - width + 1
    up, down = _powers(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * up, out=sums[1:])
    h = (sums[width:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    return h


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes, the position of the least one, leftmost of equals."""
    n = len(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    full[:n] = key
    rows = full.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(tail[:m], head[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(bodies: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, windows, anchor's place in the run, anchor's hash."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    if len(flat) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    h = gram_hashes(flat, gram)
    least = least_positions(h, length - gram + 1)
    doc = np.searchsorted(ends, np.arange(len(least)), side="right")
    ok = np.arange(len(least)) + length <= ends[doc]
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(change)
    count = np.diff(np.append(starts, len(least)))
    live = ok[starts]
    starts, count = starts[live], count[live]
    d = doc[starts]
    return d, starts - (ends[d] - sizes[d]), count, least[starts] - starts, h[least[starts]]


def _held(bodies: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about limit bytes together, and the first one's number."""
    first, size = 0, 0
    for i, b in enumerate(bodies):
        size += len(b)
        if size >= limit:
            yield first, bodies[first : i + 1]
            first, size = i + 1, 0
    if first < len(bodies):
        yield first, bodies[first:]


#: A run in one long: 16 bits of the text's crc, 31 of its first window, 8 of its windows, 8 of the anchor's place.
def pack_runs(crc: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (crc.astype(np.int64) << 47) | (start << 16) | (count << 8) | place


def unpack_runs(x: np.ndarray) -> tuple[np.ndarray, ...]:
    return (x >> 47) & 0xFFFF, (x >> 16) & 0x7FFFFFFF, (x >> 8) & 0xFF, x & 0xFF


def keyed(docs: DataFrame) -> DataFrame:
    """key (a hash of doc_id and text), doc_id, text of every row."""
    return texts(docs).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """h, key, run for every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, bodies = np.asarray(b.column(0)), b.column(1).cast(pa.binary()).to_pylist()
            for first, some in _held(bodies):
                crc = np.array([zlib.crc32(x) & 0xFFFF for x in some], np.int64)
                d, start, count, place, h = runs_of(some, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[first + d]), pa.array(pack_runs(crc[d], start, count, place))], ["h", "key", "run"])

    return rows.select("key", "text").mapInArrow(run, "h long, key long, run long")


def packed_texts(rows: DataFrame, *keep: str) -> DataFrame:
    """key, kept columns and z, the text compressed for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [c.compress(x) for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z, pa.binary())], [*b.schema.names[:-1], "z"])

    kinds = dict(rows.dtypes)
    return rows.select("key", *keep, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in ("key", *keep)), "z binary"]))


def _inflate(column: pa.Array) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in column.to_pylist()]


def sampled_splitters(rows: DataFrame, buckets: int, length: int, gram: int, most: int = SAMPLE_DOCS) -> np.ndarray:
    """Leading bytes of anchors in a bounded sample of texts, those of the least hashes, at even ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead = []
            for body in b.column(0).cast(pa.binary()).to_pylist():
                _, start, _, place, _ = runs_of([body], length, gram)
                at = (start + place).tolist()
                lead.append([body[p : p + LEAD] for p in at[:: max(1, len(at) // 64)]])
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.list_(pa.binary()))], ["lead"])

    long = rows.where(F.octet_length("text") >= length)
    share = long.select("key").where(F.pmod(F.xxhash64("key"), F.lit(64)) == 0).count() * 64
    some = long.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.lit(max(1, min(1_000_003, 1_000_003 * most // max(share, 1))))).select("text")
    lead = sorted(x for r in some.mapInArrow(run, "lead array<binary>").toArrow()["lead"].to_pylist() for x in r)
    return np.array([lead[len(lead) * k // buckets] for k in range(1, buckets)] if lead else [], f"S{LEAD}")


def met_by(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows joined with the rows of few (key and others, each key once), without dealing rows by a key that may be very frequent."""
    if few.count() * KEY_BYTES <= SENT:
        return rows.join(F.broadcast(few), key)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns, F.lit(5)), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def cut_runs(joined: DataFrame, splitters: np.ndarray, length: int) -> DataFrame:
    """bucket, h, key, run, body for the wanted runs of rows (key, z, want)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                keys, bodies, wants = np.asarray(b.column(0)), _inflate(b.column(1)), b.column(2).to_pylist()
                h, key, packed, body, lead = [], [], [], [], []
                for k, text, want in zip(keys.tolist(), bodies, wants, strict=True):
                    crc = zlib.crc32(text) & 0xFFFF
                    runs = np.array([w["run"] for w in want], np.int64)
                    c, start, count, place = unpack_runs(runs)
                    for i in np.flatnonzero(c == crc).tolist():
                        s = int(start[i])
                        p = s + int(place[i])
                        h.append(want[i]["h"])
                        key.append(k)
                        packed.append(int(runs[i]))
                        body.append(text[s : s + int(count[i]) - 1 + length])
                        lead.append(text[p : p + LEAD])
                bucket = np.searchsorted(splitters, np.array(lead, f"S{LEAD}"), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h, pa.int64()), pa.array(key, pa.int64()), pa.array(packed, pa.int64()), pa.array(body, pa.binary())], ["bucket", "h", "key", "run", "body"])

    return joined.select("key", "z", "want").mapInArrow(run, "bucket int, h long, key long, run long, body binary")


def tied(group: np.ndarray, at: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the strings (length bytes from at) that equal another one of their group: multikey quicksort, eight bytes a step."""
    live = np.arange(len(at))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if len(live) < 2:
            return live[:0]
        w = words[at[live] + k]
        order = np.lexsort((w, group))
        g, w, live = group[order], w[order], live[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        single = new & np.append(new[1:], True)
        group = np.cumsum(new)[~single]
        live = live[~single]
    return live


def repeated_windows(h: np.ndarray, count: np.ndarray, place: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last) of windows that occur twice among runs sorted by anchor hash; windows count from the run's start."""
    n = len(h)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    anchor = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
    # equal runs first: numbered by content
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(b, len(number)) for b in bodies])
    times, first = np.bincount(same), np.full(len(number), n)
    np.minimum.at(first, same, np.arange(n))
    whole = times[same] > 1
    kinds = np.bincount(anchor[first])
    open_ = first[kinds[anchor[first]] > 1]  # one run for each content, where an anchor has more than one
    out_run, out_a, out_b = [np.flatnonzero(whole)], [np.zeros(int(whole.sum()), np.int64)], [count[whole] - 1]
    if len(open_):
        start = np.cumsum([0, *(len(bodies[i]) for i in open_[:-1])])
        raw = b"".join(bodies[i] for i in open_) + bytes(8)
        words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        # windows at one distance before the anchor are compared with each other
        windows = count[open_]
        owner = np.repeat(np.arange(len(open_)), windows)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        before = place[open_][owner] - step
        group = anchor[open_][owner] * 512 + before + 256
        hit = np.zeros(len(owner), bool)
        hit[tied(group, start[owner] + step, words, length)] = True
        hit &= ~whole[open_][owner]  # those go as a whole
        # maximal stretches of hits within a run
        at = np.flatnonzero(hit)
        if len(at):
            new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
            a, b = at[new], at[np.append(new[1:], True)]
            out_run.append(open_[owner[a]])
            out_a.append(step[a])
            out_b.append(step[b])
    return tuple(np.concatenate(x) for x in (out_run, out_a, out_b))


def _resolve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            h, key, packed = (t.column(c).to_numpy() for c in ("h", "key", "run"))
            _, start, count, place = unpack_runs(packed)
            r, a, b = repeated_windows(h, count, place, t.column("body").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(key[r]), pa.array(start[r] + a), pa.array(start[r] + b + length)], ["key", "a", "b"])

        held, size = [], 0
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                held.append(b)
                size += b.nbytes
                if size > HOLD:
                    h = b.column(1).to_numpy()
                    cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0  # an anchor's runs stay together
                    if cut or len(held) > 1 and held[-2].column(1)[-1].as_py() != h[-1]:
                        yield handle([*held[:-1], b.slice(0, cut)])
                        held, size = [b.slice(cut)], 0
        if held:
            yield handle(held)

    return run


def hot_windows(runs: DataFrame, length: int) -> DataFrame:
    """key, a, b of repeated windows of very frequent anchors: each window of a different run is a suffix of its own, counted by its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                whole, times, start, mark = [], [], [], []
                for w, n, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    for i in range(len(body) - length + 1):
                        whole.append(w)
                        times.append(n)
                        start.append(i)
                        mark.append(hashlib.blake2b(body[i : i + length], digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), pa.array(times, pa.int64()), pa.array(start, pa.int64()), pa.array(mark, pa.binary())], ["whole", "times", "at", "mark"])

    spark = runs.sparkSession
    path = scratch(spark, "hot-runs")
    named = runs.select("key", F.shiftrightunsigned("run", 16).bitwiseAND(F.lit(0x7FFFFFFF)).alias("start"), F.unhex(F.md5("body")).alias("whole"), "body")
    named.write.option("compression", "zstd").parquet(path)
    named = spark.read.parquet(path)
    different = named.groupBy("whole").agg(F.count("*").alias("times"), F.min("body").alias("body"))
    different.mapInArrow(run, "whole binary, times long, at long, mark binary").write.option("compression", "zstd").parquet(f"{path}-windows")
    windows = spark.read.parquet(f"{path}-windows")
    # a run that occurs twice repeats as a whole; of the others, windows that also occur elsewhere
    often = windows.groupBy("mark").agg(F.sum("times").alias("n")).where("n > 1").select("mark")
    often.write.parquet(f"{path}-often")
    found = met_by(windows, spark.read.parquet(f"{path}-often"), "mark")
    # a run's windows as maximal stretches, one row for each different run
    stretches = found.groupBy("whole").agg(F.array_sort(F.collect_set("at")).alias("at"))  # at most as many as an anchor has windows
    stretches.write.parquet(f"{path}-stretches")
    met = met_by(named.select("key", "start", "whole"), spark.read.parquet(f"{path}-stretches"), "whole")
    ends = met.select("key", "start", F.explode(stretch_ends("at")).alias("s"))
    return ends.select("key", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + length).alias("b"))


def stretch_ends(at: str):
    """First and last of each maximal stretch of consecutive numbers in a sorted array column."""
    number = F.transform(at, lambda x, i: F.struct(x.alias("x"), (x - i).alias("g")))
    firsts = F.array_distinct(F.transform(number, lambda s: s.g))
    mine = lambda g: F.transform(F.filter(number, lambda s: s.g == g), lambda s: s.x)
    return F.transform(firsts, lambda g: F.struct(F.array_min(mine(g)).alias("a"), F.array_max(mine(g)).alias("b")))


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed runs."""
    parts, done, removed, runs = [], 0, 0, 0
    last = -1
    for a, b in sorted(spans):
        if a > last:
            runs += 1
        if a > done:
            parts.append(text[done:a])
        if b > done:
            removed += b - max(a, done)
            done = b
        last = max(last, b)
    return b"".join([*parts, text[done:]]), removed, runs


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, a, b: byte ranges that go, for rows as ``keyed`` names them."""
    spark = docs.sparkSession
    rows = keyed(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "anchors")
    anchors(rows, length, gram).write.option("compression", "zstd").parquet(path)
    every = spark.read.parquet(path)
    every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").write.option("compression", "zstd").parquet(f"{path}-repeated")
    often = spark.read.parquet(f"{path}-repeated")
    # very frequent anchors, of which there are few, meet their counts where they are; the others by a shuffle
    frequent = often.where(F.col("n") > FREQUENT)
    apart = met_by(every, frequent, "h")
    rest = every.join(F.broadcast(frequent.select("h")), "h", "left_anti") if frequent.count() * KEY_BYTES <= SENT else every
    wanted = apart.unionByName(rest.join(often.where(F.col("n") <= FREQUENT), "h")).select("key", F.struct("h", "run").alias("w"), (F.col("n") > hot).alias("hot"))
    splitters = sampled_splitters(rows, n, length, gram)

    def runs(want: DataFrame) -> DataFrame:
        lists = want.groupBy("key").agg(F.collect_set("w").alias("want"))  # as many as a text has runs
        return cut_runs(packed_texts(rows).join(lists, "key"), splitters, length)

    spans = runs(wanted.where("not hot")).repartitionById(n, F.col("bucket")).sortWithinPartitions("h").mapInArrow(_resolve(length), "key long, a long, b long")
    if not often.where(F.col("n") > hot).isEmpty():
        spans = spans.unionByName(hot_windows(runs(wanted.where("hot")), length))
    return spans


def dedup_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text)."""
    spans = repeated_spans(docs, length, gram, hot).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                out = []
                for text, found in zip(_inflate(b.column(1)), b.column(2).to_pylist(), strict=True):
                    kept, removed, count = remove_spans(text, [(s["a"], s["b"]) for s in found or ()])
                    out.append((len(text), removed, count, hashlib.sha256(kept).hexdigest()))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in cols)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = packed_texts(keyed(docs), "doc_id").join(spans, "key", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
