"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token's class is predicted, then the token within its class, each by a softmax
over hashed features of the text before it: the token before (n-gram) and the one
before that (skip). Frequent tokens (the head) are members of classes of about equal
mass and are told apart by features too; every other token is in a class of tokens
that end alike, which is predicted from the features, and is told apart in it by its
smoothed count. Features are hashed into buckets: a frequent token before has one of
its own, others go by their last two bytes. The head, the classes of endings and the
buckets grow with the number of distinct training tokens, as its fifth root, so that
weights fit in a task at any input; the counts grow as the vocabulary does.

Training counts are exact and cover all training texts. For the weights, tokens are
first counted by (bucket before, bucket two before, token): these counts carry
everything that the likelihood needs, so each update, a distributed sum of gradients
over the counts' partitions, equals one over all training tokens. Scoring looks up
batches of tokens in numpy tables.

Tokens meet their counts by 64-bit hash. Tokens of at least ``1 / HEAVY`` of all
training tokens, of which there cannot be more than HEAVY, are sent to the tasks;
all others are joined.

Defined results: null text counts as empty and has the end alone; without training
texts all tokens are unknown and the model is uniform; rows with a null doc_id are
training rows; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, held_out, scratch, texts

HEAVY, CLASSES = 500_000, 32
SKIPS = 16
PARTS, STEPS, RATE, DAMPING = 16, 10, 0.8, 3.0
#: Text bytes that a task looks at together, distinct tokens that it counts before it hands them on, and cells that it counts in one array.
CHUNK, COUNTED, DENSE = 4_000_000, 1_000_000, 24_000_000
END = b"\n"  # no token holds white space


def token_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(word)
    return h - 2**64 if h >= 2**63 else h


def tokens(text: str) -> list[bytes]:
    return [*text.encode().translate(LOWER).split(), END]


def count_tokens(rows: DataFrame) -> DataFrame:
    """w (token hash), c (occurrences), e (how it ends) in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([token_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.array(ending(list(seen)), pa.int32())], ["w", "c", "e"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > COUNTED:
                    yield flush()
        if seen:
            yield flush()

    return rows.select("text").mapInArrow(run, "w long, c long, e int").groupBy("w").agg(F.sum("c").alias("c"), F.min("e").alias("e"))


@dataclass(frozen=True)
class Sizes:
    """Predicted tokens, of which the last is the end; classes of endings; buckets of the token before: own ones, then by ending; one more begins a text."""

    head: int
    rest: int
    own: int
    endings: int

    @classmethod
    def of(cls, distinct: int) -> Sizes:
        head = max(1024, int(77 * distinct**0.2))
        return cls(head, head // 8, 3 * head // 8, head // 8 - 1)

    @property
    def before(self) -> int:
        return self.own + self.endings + 1

    @property
    def contexts(self) -> int:
        return self.before * SKIPS

    @property
    def columns(self) -> int:
        """Predicted tokens and classes of endings."""
        return self.head + self.rest


def ending(words: list[bytes]) -> np.ndarray:
    """A number for how each token ends."""
    return np.array([zlib.crc32(w[-2:]) & 0x7FFFFFFF for w in words], np.int64)


@dataclass
class Vocabulary:
    """Heavy tokens sorted by hash, their counts, their head numbers (sizes.head stands for all others), and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    head: np.ndarray
    total: int
    distinct: int
    rest_total: np.ndarray  # training tokens and distinct ones outside the head, by class of endings
    rest_distinct: np.ndarray
    classes: np.ndarray  # of each head number
    sizes: Sizes

    def look(self, h: np.ndarray) -> np.ndarray:
        """Places among heavy tokens, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def vocabulary(counts: DataFrame, heavy: int = HEAVY) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = Sizes.of(distinct)
    # tokens of at least this count: heavy of them at most
    rows = counts.where(F.col("c") * heavy >= total).toArrow() if total else counts.limit(0).toArrow()
    h, c, e = rows["w"].to_numpy(), rows["c"].to_numpy(), rows["e"].to_numpy()
    order = np.argsort(h)
    h, c, e = h[order], c[order], e[order]
    end = token_hash(END)
    ranked = [i for i in np.lexsort((h, -c)).tolist() if h[i] != end][: sizes.head - 1]
    head = np.full(len(h), sizes.head)
    head[ranked] = np.arange(len(ranked))
    head[h == end] = sizes.head - 1
    mass = np.zeros(sizes.head)
    mass[head[head < sizes.head]] = c[head < sizes.head]
    # classes of about equal mass, by falling count; the end is in a class of its own
    part = np.cumsum(mass[:-1]) / max(mass[:-1].sum(), 1)
    classes = np.append(np.minimum((part * (CLASSES - 1)).astype(np.int64), CLASSES - 2), CLASSES - 1)
    inside = head < sizes.head
    rest_total, rest_distinct = np.zeros(sizes.rest, np.int64), np.zeros(sizes.rest, np.int64)
    for r in counts.groupBy((F.col("e") % sizes.rest).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        rest_total[r.e], rest_distinct[r.e] = r.c, r.n
    np.subtract.at(rest_total, e[inside] % sizes.rest, c[inside])
    np.subtract.at(rest_distinct, e[inside] % sizes.rest, 1)
    return Vocabulary(h, c, head, int(total), int(distinct), rest_total, rest_distinct, classes, sizes)


class Chunk:
    """Texts as arrays: text number, distinct-token number and context of each token, and facts of each distinct token."""

    def __init__(self, bodies: list[str], v: Vocabulary):
        number: dict[bytes, int] = {}
        ids: list[int] = []
        sizes = []
        for t in bodies:
            ws = tokens(t)
            ids += [number.setdefault(w, len(number)) for w in ws]
            sizes.append(len(ws))
        words = list(number)
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.hash = np.array([token_hash(w) for w in words], np.int64)
        self.heavy = v.look(self.hash)
        z, e = v.sizes, ending(words)
        self.head = np.where(self.heavy >= 0, v.head[self.heavy], z.head) if len(v.head) else np.full(len(words), z.head)
        self.rest = e % z.rest
        self.column = np.where(self.head < z.head, self.head, z.head + self.rest)  # what is predicted
        before = np.where(self.head < z.own, self.head, z.own + e % z.endings)[self.ids]
        skip = (e // z.endings % (SKIPS - 1))[self.ids]
        first = np.cumsum(self.sizes) - self.sizes
        b, s = np.roll(before, 1), np.roll(skip, 2)
        b[first], s[first] = z.before - 1, SKIPS - 1
        s[(first + 1)[self.sizes > 1]] = SKIPS - 1
        self.context = b * SKIPS + s
        self.text = np.repeat(np.arange(len(bodies)), self.sizes)


def chunks(bodies: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(bodies):
        size += len(t)
        if size >= CHUNK:
            yield first, bodies[first : i + 1]
            first, size = i + 1, 0
    if first < len(bodies):
        yield first, bodies[first:]


def cells(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """context, w (column), n: how often; the sufficient counts of all rows. At most contexts * columns of them."""
    columns, room = v.sizes.columns, v.sizes.contexts * v.sizes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, times = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((at // columns).astype(np.int32)), pa.array((at % columns).astype(np.int32)), pa.array(n.astype(np.int64))], ["context", "w", "n"])

        for batch in batches:
            for _, some in chunks(batch.column(0).to_pylist()):
                c = Chunk(some, v)
                at, n = np.unique(c.context * columns + c.column[c.ids], return_counts=True)
                if room <= DENSE:
                    table = np.zeros(room, np.int32) if table is None else table
                    table[at] += n.astype(np.int32)
                    continue
                # too many cells for one array: sorted cells are merged, and handed on when there are many
                every, back = np.unique(np.concatenate([keys, at]), return_inverse=True)
                keys, times = every, np.bincount(back, np.concatenate([times, n])).astype(np.int64)
                if len(keys) > DENSE // 4:
                    yield flush(keys, times)
                    keys, times = keys[:0], times[:0]
        if table is not None:
            yield flush(at := np.flatnonzero(table), table[at])
        elif len(keys):
            yield flush(keys, times)

    return rows.select("text").mapInArrow(run, "context int, w int, n long").groupBy("context", "w").agg(F.sum("n").alias("n"))


@dataclass
class Weights:
    """For tokens within classes, or for classes: bias, by bucket before, by bucket two before."""

    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def zeros(cls, columns: int, before: int) -> Weights:
        return cls(np.zeros(columns), np.zeros((before, columns)), np.zeros((SKIPS, columns)))

    def logits(self, before: np.ndarray) -> np.ndarray:
        """(buckets before, SKIPS, columns)."""
        return self.bias + self.near[before][:, None, :] + self.far[None]


def runs_of_classes(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where classes begin among head tokens, which lie in order of them, and each token's run."""
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    return starts, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(classes))))


def log_sums(word: Weights, group: Weights, classes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P(class | context), and ln of the sum over a class's tokens, for some buckets before."""
    g = group.logits(before)
    g -= g.max(-1, keepdims=True)
    g -= np.log(np.exp(g).sum(-1, keepdims=True))
    w, (starts, own) = word.logits(before), runs_of_classes(classes)
    top = np.maximum.reduceat(w, starts, axis=-1)
    return g, np.log(np.add.reduceat(np.exp(w - top[..., own]), starts, axis=-1)) + top


def log_shares(word: Weights, group: Weights, classes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P(class | context) and ln P(token | class, context) for some buckets before."""
    g, sums = log_sums(word, group, classes, before)
    return g, word.logits(before) - sums[..., runs_of_classes(classes)[1]]


def train(counts: DataFrame, v: Vocabulary, steps: int = STEPS) -> tuple[Weights, Weights]:
    """Distributed full gradients over the counts' partitions; each coordinate's step is scaled by its own counts."""
    z, classes, spark = v.sizes, v.classes, counts.sparkSession
    groups = CLASSES + z.rest
    word, group = Weights.zeros(z.head, z.before), Weights.zeros(groups, z.before)
    start = np.ones(z.columns)
    for r in counts.groupBy("w").agg(F.sum("n").alias("n")).collect():
        start[r.w] += r.n
    by_group = np.concatenate([np.bincount(classes, start[: z.head], CLASSES), start[z.head :]])
    word.bias, group.bias = np.log(start[: z.head]), np.log(by_group + 1e-9)
    parts = counts.withColumn("b", F.expr(f"context div {SKIPS}").cast("int"))

    for _ in range(steps):
        sent = spark.sparkContext.broadcast((word, group))

        def pull(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            """Observed and expected sums: for each bucket before, and over all of them for each bucket two before."""
            tabs = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
            if not tabs:
                return
            context, w, n = (np.concatenate(x) for x in zip(*tabs, strict=True))
            order = np.argsort(context, kind="stable")
            context, w, n = context[order], w[order], n[order]
            word, group = sent.value
            every = np.unique(context // SKIPS)
            far = np.zeros((2, SKIPS, z.head + groups))
            for at in range(0, len(every), 32):
                before = every[at : at + 32]
                lo, hi = np.searchsorted(context, [before[0] * SKIPS, (before[-1] + 1) * SKIPS])
                seen = np.zeros((len(before), SKIPS, z.columns))
                np.add.at(seen, (np.searchsorted(before, context[lo:hi] // SKIPS), context[lo:hi] % SKIPS, w[lo:hi]), n[lo:hi])
                g, t = log_shares(word, group, classes, before)
                by_class = np.zeros((*seen.shape[:2], groups))
                for c in range(CLASSES):
                    by_class[..., c] = seen[..., : z.head][..., classes == c].sum(-1)
                by_class[..., CLASSES:] = seen[..., z.head :]
                expected = np.concatenate([by_class[..., classes] * np.exp(t), by_class.sum(-1, keepdims=True) * np.exp(g)], -1)
                observed = np.concatenate([seen[..., : z.head], by_class], -1)
                far += np.stack([observed.sum(0), expected.sum(0)])
                near = np.stack([observed.sum(1), expected.sum(1)], 1)  # (before, 2, columns)
                yield _rows(before, near)
            yield _rows(-1 - np.arange(SKIPS), far.transpose(1, 0, 2))

        sums = parts.repartition(PARTS, "b").select("context", "w", "n").mapInArrow(pull, "id int, v binary").toArrow()
        near, far = np.zeros((z.before, 2, z.head + groups)), np.zeros((SKIPS, 2, z.head + groups))
        for i, x in zip(sums["id"].to_pylist(), sums["v"].to_pylist(), strict=True):
            x = np.frombuffer(x, np.float32).reshape(2, -1)
            if i >= 0:
                near[i] += x
            else:
                far[-1 - i] += x
        for weights, cols in ((word, slice(0, z.head)), (group, slice(z.head, None))):
            for what, x in ((weights.near, near[..., cols]), (weights.far, far[..., cols])):
                what += RATE / 2 * (x[:, 0] - x[:, 1]) / (np.maximum(x[:, 0], x[:, 1]) + DAMPING)
        sent.destroy()
    return word, group


def _rows(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array([x.astype(np.float32).tobytes() for x in v], pa.binary())], ["id", "v"])


DOC = "struct<doc_id:bigint,held_out:boolean,n_tokens:bigint>"


def score(rows: DataFrame, counts: DataFrame, v: Vocabulary, word: Weights, group: Weights) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for rows (doc_id, text, held_out)."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast((v, word, group))
    base_under, rest_under = float(np.log10(v.total + v.distinct + 1)), np.log10(v.rest_total + v.rest_distinct + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, word, group = sent.value
        z, classes = v.sizes, v.classes
        run_of = runs_of_classes(classes)[1]
        by_group, within = np.empty((z.before, SKIPS, CLASSES + z.rest), np.float32), np.empty((z.before, SKIPS, run_of[-1] + 1), np.float32)
        for at in range(0, z.before, 32):
            before = np.arange(at, min(at + 32, z.before))
            by_group[before], within[before] = log_sums(word, group, classes, before)
        by_group, within = by_group.reshape(z.contexts, -1), within.reshape(z.contexts, -1)

        def model_logs(context: np.ndarray, column: np.ndarray) -> np.ndarray:
            """log10 P of each column in its context."""
            head = column < z.head
            out = np.empty(len(column))
            c, k = context[head], column[head]
            b, far = c // SKIPS, c % SKIPS
            out[head] = by_group[c, classes[k]] + (word.bias[k] + word.near[b, k] + word.far[far, k] - within[c, run_of[k]])
            out[~head] = by_group[context[~head], column[~head] - z.head + CLASSES]
            return out / np.log(10)

        for big in batches:
            row, docs, out, bodies = big.column(0).to_numpy(), big.column(1).to_pylist(), big.column(2).to_pylist(), big.column(3).to_pylist()
            for first, some in chunks(bodies):
                c = Chunk(some, v)
                n = len(some)
                sums = lambda x, at=c.text, n=n: np.bincount(at, x, n)
                known = c.heavy >= 0
                logs = np.where(known, np.log10(np.where(known, v.counts[c.heavy] if len(v.counts) else 0, 0) + 1.0), 0.0)
                base = sums(logs[c.ids]) - c.sizes * base_under
                outside = (c.head == z.head)[c.ids]
                model = sums(model_logs(c.context, c.column[c.ids])) + sums(np.where(outside, logs[c.ids] - rest_under[c.rest][c.ids], 0.0))
                n_known = np.bincount(c.text, known[c.ids], n).astype(np.int64)
                # tokens whose counts are elsewhere, once for each text
                rare = np.flatnonzero(~known[c.ids])
                pair, times = np.unique(c.text[rare] * len(c.hash) + c.ids[rare], return_counts=True)
                owner, token = np.divmod(pair, max(len(c.hash), 1))
                carrier = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
                alone = np.setdiff1d(np.arange(n), owner)
                owner, carrier = np.concatenate([owner, alone]), np.concatenate([carrier, np.ones(len(alone), bool)])
                # a text without such tokens is one row that meets no count (n = 0), spread by its row number
                w = np.concatenate([c.hash[token], row[first + alone] * -0x61C8864680B583EB if len(alone) else np.zeros(0, np.int64)]).astype(np.int64)
                times = np.concatenate([times, np.zeros(len(alone), np.int64)])
                at = first + owner
                fields = [pa.array([docs[i] for i in at.tolist()], pa.int64()), pa.array([out[i] for i in at.tolist()], pa.bool_()), pa.array(c.sizes[owner])]
                doc = pa.StructArray.from_arrays(fields, ["doc_id", "held_out", "n_tokens"], mask=pa.array(~carrier))
                part = lambda x, o=owner, k=carrier: pa.array(np.where(k, x[o], 0))
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(w), pa.array(times), doc, part(n_known), part(base), part(model)], ["row", "w", "n", "doc", "known", "base", "model"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    found = numbered.mapInArrow(run, f"row long, w long, n long, doc {DOC}, known long, base double, model double").join(counts.select("w", "c"), "w", "left")
    logs = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))
    sums = found.groupBy("row").agg(
        F.max("doc").alias("doc"),
        F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + logs).alias("base_score"),
        F.sum(F.col("model") + logs).alias("score"),
    )
    return sums.select("doc.doc_id", "doc.held_out", "doc.n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, folds: int = 7) -> DataFrame:
    """Train on the rows outside the held-out fold and score all of them."""
    rows = texts(docs).select("doc_id", "text", held_out("doc_id", folds).alias("held_out"))
    learn = rows.where("not held_out")
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "token-counts")
    count_tokens(learn).write.parquet(path)
    counts = spark.read.parquet(path)
    v = vocabulary(counts)
    word, group = train(cut(cells(learn, v)), v)
    return score(rows, counts, v, word, group)
