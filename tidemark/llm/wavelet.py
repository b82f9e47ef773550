"""Token files: one wavelet matrix per shard of documents.

A shard is one file (one binary row of a Parquet table in the shared folder)
that holds the token ids of consecutive documents:

    magic "WVLM", levels uint32, tokens uint64, documents uint64, tokens before it in its part uint64
    zeros of each level, uint64
    doc_id of each document, int64; first token of each document in the shard, uint64
    for each level: bit-plane words uint64, then uint32 ranks before each block of 512 bits
    (all little-endian), so that a token takes its levels in bits and a sixteenth more

Level by level, from the highest bit, ids are divided stably into zeros and ones.
Access, rank (how often an id occurs before a position) and select (where the
k-th occurrence lies) read only the planes. Reading a whole shard walks all
positions through the planes at once; ``read_shards`` also looks up every document's
last token by access and counts end ids by rank, and fails on a file that disagrees.

Shards are cut by ranges of doc_id, so that reading them in order gives ascending
doc_id; equal doc_ids are ordered by text. Texts are cut between a word and one
following space or line end, where the pre-tokenizer always cuts; the distinct pieces
of a batch are told apart in Arrow, and each is encoded once by the tokenizers library
and kept in a bounded memo, which a worker keeps from task to task until it reads
files. Words of Latin letters, with or without signs after them, go straight to the
library's model, since the pre-tokenizer leaves them whole. A text of any length is
encoded whole.

Defined results: null text counts as empty and holds the end id alone; an empty
table has no shards; null doc_ids come first; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, texts

MAGIC, HEAD = b"WVLM", 32
#: Words of a block that has one rank.
BLOCK = 8
#: Pieces that a worker keeps before the older ones go.
MEMO = 450_000
#: Text bytes and documents that a shard takes; a longer document has a shard of its own.
SHARD_BYTES, SHARD_DOCS = 4_000_000, 65_536
#: Text bytes that are encoded at once.
STEP_BYTES = 5_000_000
_ODD = re.compile(r"\s\s|^\s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: The same as _ODD or a NUL, with the white space that Python knows spelt out.
_WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_RE2 = rf"(?s){_WHITE}{_WHITE}|\A{_WHITE}|{_WHITE}\z|\x00"
#: How the byte-level alphabet writes a space and a line end.
SPACE, LINE = chr(256 + 32), chr(256 + 10)
#: UTF-8 bytes, read as Latin-1, in the byte-level alphabet, as far as letters have them; a word of Latin letters, which the pre-tokenizer keeps whole, and signs after it, which it cuts off as one.
LETTERS = {b: 256 + 33 + b - 127 for b in range(127, 161)} | {173: 256 + 67}
_LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]{0,3})")


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.uint64)


def _raw(ids: list[int]) -> bytes:
    """Ids as little-endian uint32."""
    return array("I", ids).tobytes()


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, planes: list[tuple[np.ndarray, np.ndarray]], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        if len(ids) >= 2**32:
            raise ValueError("a shard holds fewer than 2**32 tokens")
        planes, zeros, now = [], [], np.asarray(ids, np.uint32 if levels > 16 else np.uint16)
        for level in range(levels - 1, -1, -1):
            one = (now >> level).astype(np.uint8)
            one &= 1
            raw = np.packbits(one, bitorder="little").tobytes()
            one = one.view(bool)
            words = np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")
            counts = _popcount(words)
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, np.arange(0, len(words), BLOCK)))]).astype("<u4") if len(words) else np.zeros(1, "<u4")
            low, high = np.compress(~one, now), np.compress(one, now)
            planes.append((words, ranks))
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(planes, zeros, len(ids))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before each position."""
        words, ranks = self.planes[level]
        if not len(words):
            return np.zeros(len(at), np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        first = word // BLOCK * BLOCK
        out = ranks[word // BLOCK].astype(np.int64)
        for k in range(BLOCK - 1):  # whole words of the block before the position's own
            mine = first + k < word
            out += np.where(mine, np.bitwise_count(words[np.minimum(first + k, len(words) - 1)]), 0)
        inside = np.where(bit > 0, words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1)), np.uint64(0))
        return out + np.bitwise_count(inside).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            words, _ = self.planes[level]
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def read(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest to the highest."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        out, back = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in range(levels - 1, -1, -1):
            one = np.unpackbits(self.planes[level][0].view(np.uint8), bitorder="little", count=self.n).view(bool)
            z = self.zeros[level]
            out[z:] |= kind(1 << (levels - 1 - level))
            back[np.flatnonzero(one)] = out[z:]  # fails if the zeros of the file disagree
            back[np.flatnonzero(~one)] = out[:z]
            out, back = back, out
        return out.astype(np.uint32)

    def rank(self, symbol: int, upto: int) -> int:
        """Occurrences of symbol before a position."""
        lo, hi = 0, upto
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, np.array([lo, hi])).tolist()
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        if not 0 <= k < self.rank(symbol, self.n):
            return -1
        starts, lo = [], 0
        for level, zeros in enumerate(self.zeros):
            starts.append(lo)
            ones = int(self._ones(level, np.array([lo]))[0])
            lo = zeros + ones if symbol >> (len(self.zeros) - 1 - level) & 1 else lo - ones
        at = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            zeros, bit = self.zeros[level], symbol >> (len(self.zeros) - 1 - level) & 1
            want, low, high = (at - zeros if bit else at), 0, self.n
            while low < high:  # the first position with want + 1 such bits up to it
                mid = (low + high) // 2
                ones = int(self._ones(level, np.array([mid + 1]))[0])
                low, high = (mid + 1, high) if (ones if bit else mid + 1 - ones) <= want else (low, mid)
            at = low
        return at


def pack(matrix: WaveletMatrix, doc_ids: np.ndarray, starts: np.ndarray, first: int = 0) -> bytes:
    """The file of a shard."""
    head = MAGIC + np.array([len(matrix.planes)], "<u4").tobytes() + np.array([matrix.n, len(doc_ids), first], "<u8").tobytes()
    body = [np.array(matrix.zeros, "<u8"), np.asarray(doc_ids, "<i8"), np.asarray(starts, "<u8"), *(x for p in matrix.planes for x in p)]
    return head + b"".join(x.tobytes() for x in body)


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, int]:
    """matrix, doc_ids, starts, first token of a shard's file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
    n, docs, first = np.frombuffer(data, "<u8", 3, 8).tolist()
    at = [HEAD]

    def take(kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(data, kind, count, at[0])
        at[0] += out.nbytes
        return out

    zeros, ids, starts = take("<u8", levels).tolist(), take("<i8", docs), take("<u8", docs)
    words = (n + 63) // 64
    return WaveletMatrix([(take("<u8", words), take("<u4", -(-words // BLOCK) + 1)) for _ in range(levels)], zeros, n), ids, starts, first


class PieceMemo:
    """Ids of texts by the tokenizers library, each distinct piece encoded once.

    A piece is a word with the space before it, kept under the word alone, or with the
    line end before it, kept as it is; other pieces (a text's first, odd texts) are kept
    under a leading NUL and their whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.levels = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros((2, max(vocabulary.values(), default=0) + 1), bool)  # does a token begin with a space, with a line end?
        for row, sign in zip(self.begins, (SPACE, LINE), strict=True):
            row[[k for x, k in vocabulary.items() if x[:1] == sign]] = True
        # words that could hold an added token, whose sides are matched otherwise, go alone
        signs = "".join({x.content[0] for x in self.tokenizer.get_added_tokens_decoder().values()})
        self.odd = re.compile(rf"[\s{re.escape(signs)}\0]")
        # words of letters need no pre-tokenizer where it is the plain one and no added token begins like them
        spec = json.loads(self.tokenizer.to_str())
        cutter, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.direct = (
            not spec["normalizer"] and cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True)
            and model["type"] == "BPE" and not model.get("dropout") and not any(_LATIN.match(x) or x in ".,;:!?" for x in signs)
        )
        self.signs: dict[str, bytes] = {"": b""}

    def learn(self, lacking: list[str]) -> list[bytes]:
        """Ids of some pieces. Words of Latin letters go to the model; other words of visible characters go to the library as one text, since each token that begins with a space, or with a single line end, begins a word."""
        out: list[bytes | None] = [None] * len(lacking)
        plain: tuple[list[int], list[int]] = ([], [])
        latin, model = _LATIN.fullmatch if self.direct else lambda _: None, self.tokenizer.model
        line = _raw([t.id for t in model.tokenize(LINE)]) if self.direct else b""
        for k, x in enumerate(lacking):
            lead = x[:1] if x[:1] in "\n\0" else " "
            w = x if lead == " " else x[1:]
            if m := latin(w):
                word, signs = m.groups()
                body = word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
                if signs not in self.signs:
                    self.signs[signs] = _raw([t.id for t in model.tokenize(signs)])
                ids = (self.memo.get(word) or self.old.get(word)) if signs and lead == " " else None
                if ids is None:
                    ids = _raw([t.id for t in model.tokenize(SPACE + body if lead == " " else body)])
                out[k] = line + ids + self.signs[signs] if lead == "\n" else ids + self.signs[signs]
            elif lead != "\0" and w.isprintable() and w and not self.odd.search(w):
                plain[lead == "\n"].append(k)
        for lead, mine, begins in zip((" ", ""), plain, self.begins, strict=True):
            for at in range(0, len(mine), 1000):
                some = mine[at : at + 1000]
                ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join([lacking[k] for k in some])], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(begins[ids]).tolist()
                if len(cuts) != len(some):
                    raise ValueError("words and tokens that begin with white space differ in number")
                raw = ids.tobytes()
                for k, a, b in zip(some, cuts, [*cuts[1:], len(ids)], strict=True):
                    out[k] = raw[4 * a : 4 * b]
        # an ordinary word's piece has a leading space; NUL marks all others but those of a line end
        other = [k for k, x in enumerate(out) if x is None]
        bodies = [x[1:] if x[:1] == "\0" else x if x[:1] == "\n" else " " + x for x in (lacking[k] for k in other)]
        for k, e in zip(other, self.tokenizer.encode_batch_fast(bodies, add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each piece."""
        memo = self.memo
        out = list(map(memo.get, pieces))
        holes = [k for k, x in enumerate(out) if x is None]
        if holes:
            new = dict.fromkeys([pieces[k] for k in holes])
            kept = {x: self.old[x] for x in new if x in self.old} if self.old else {}
            lacking = [x for x in new if x not in kept]
            memo.update(kept)
            memo.update(zip(lacking, self.learn(lacking), strict=True))
            for k in holes:
                out[k] = memo[pieces[k]]
            if len(memo) > MEMO:  # what was used lately outlives one change of generation
                self.old, self.memo = memo, {}
        return out

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts as they are kept; only a single space or line end between two visible characters is cut at."""
        p = _CUT.split(text)
        p[0] = "\0" + p[0]
        if "\0" in text:  # a word that begins with NUL would be taken for another kind of piece
            p[1:] = ["\0 " + x if x[:1] == "\0" else x for x in p[1:]]
        return p

    def encode_texts(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; no text is null."""
        odd = pc.match_substring_regex(bodies, _ODD_RE2).to_numpy(zero_copy_only=False) | (pc.binary_length(bodies).to_numpy() == 0)
        words = pc.split_pattern(pc.replace_substring(bodies, "\n", " \n"), " ")
        offsets, flat = words.offsets.to_numpy(), words.flatten()
        offsets = offsets - offsets[0]
        whole = [self.pieces(t) if t else [] for t in bodies.filter(pa.array(odd)).to_pylist()]
        # which piece stands where: a text's own first piece, ordinary words by their number, odd texts' pieces at last
        first = np.zeros(len(flat), bool)
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        plain = np.repeat(~odd, np.diff(offsets))
        coded = flat.filter(pa.array(plain & ~first)).dictionary_encode()
        kinds = [*coded.dictionary.to_numpy(zero_copy_only=False).tolist(), *("\0" + x for x in flat.filter(pa.array(plain & first)).to_pylist()), *(x for p in whole for x in p)]
        n_words, n_first = len(coded.dictionary), int((plain & first).sum())
        number = np.empty(len(flat), np.int64)
        number[plain & ~first] = coded.indices.to_numpy()
        number[plain & first] = n_words + np.arange(n_first)
        counts = np.where(odd, 0, np.diff(offsets))
        counts[odd] = [len(p) for p in whole]
        order = np.empty(int(counts.sum()), np.int64)
        at_odd = np.repeat(odd, counts)
        order[~at_odd] = number[plain]
        order[at_odd] = n_words + n_first + np.arange(int(at_odd.sum()))
        found = self.encode(kinds)
        size = np.array([len(x) // 4 for x in found], np.int64)
        table, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        take = size[order]
        ends = np.cumsum(take)
        ids = table[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[order] - (ends - take), take)]
        cuts = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])[cuts]
        return ids, np.diff(upto)


@lru_cache(maxsize=2)
def piece_memo(path: str) -> PieceMemo:
    return PieceMemo(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, partitions: int | None = None) -> None:
    """Write docs (doc_id, text) as wavelet shards: Parquet rows (part, shard, n_tokens, file) below path."""
    rows = texts(docs)
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, memo, END = TaskContext.get().partitionId(), 0, piece_memo(tokenizer), np.array([end_id], "<u4")
        held, doc_ids, counts, size, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(held)
            starts = np.cumsum([0, *counts[:-1]])
            levels = max(memo.levels, int(end_id).bit_length())
            file = pack(WaveletMatrix.build(flat, levels), np.array(doc_ids, np.int64), starts, before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([file], pa.binary())], ["part", "shard", "n_tokens", "file"])

        for b in batches:
            n_bytes = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(1)).to_numpy())])
            at = 0
            while at < b.num_rows:  # some texts at once, or one longer text
                upto = max(at + 1, int(np.searchsorted(n_bytes, n_bytes[at] + STEP_BYTES, side="right")) - 1)
                ids, n_tokens = memo.encode_texts(b.column(1).slice(at, upto - at))
                ends = np.cumsum(n_tokens).tolist()
                for doc_id, n, e in zip(b.column(0).slice(at, upto - at).to_pylist(), n_tokens.tolist(), ends, strict=True):
                    if held and (4 * (size + n + 1) > SHARD_BYTES or len(doc_ids) >= SHARD_DOCS):
                        yield flush()
                        before += sum(counts)
                        held, doc_ids, counts, size, shard = [], [], [], 0, shard + 1
                    held += [ids[e - n : e], END]
                    doc_ids.append(NULL_ID if doc_id is None else doc_id)
                    counts.append(n + 1)
                    size += n + 1
                at = upto
        if held:
            yield flush()

    ordered.mapInArrow(run, "part int, shard int, n_tokens long, file binary").write.parquet(path)


#: Stands for a null doc_id in a file.
NULL_ID = -(2**63)


def read_shards(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, in the order of the files; each document must end in end_id."""
    files = spark.read.parquet(path)
    # a file says how many tokens precede it in its part; one sum per part, as many as the writer had tasks, gives the rest
    sums = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part] = total
        total += sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_memo.cache_clear()  # a worker that wrote files keeps its memo from task to task, one that reads them does not
        for b in batches:
            for file, part in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                matrix, ids, starts, first = unpack(file.as_buffer().to_pybytes())
                first += base[part]
                ids_ = matrix.read().astype("<u4")
                flat, cuts = ids_.tobytes(), [*starts.tolist(), matrix.n]
                if (matrix.access(np.array(cuts[1:]) - 1) != end_id).any() or matrix.rank(end_id, matrix.n) != int((ids_ == end_id).sum()):
                    raise ValueError("a shard's planes disagree with its documents")
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if i == NULL_ID else i for i in ids.tolist()], pa.int64()), pa.array([first + x for x in cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int64()),
                    pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents as shards in the shared folder and return what is read back from them."""
    path = scratch(docs.sparkSession, "wavelet")
    write_shards(docs, tokenizer, end_id, path)
    return read_shards(docs.sparkSession, path, end_id)
