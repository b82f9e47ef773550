"""Each operator on a small table with nulls, empty, long and repeated rows and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import decontaminate, html_template, maxent_lm, media, pii_crf, piece_codec, prefix_join, quality, simhash, suffix_dedup, wavelet
from tidemark.llm.queries import QUERIES, tokenizer_path

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def corpus():
    """(doc_id, text): prose, exact and near copies, shared passages, odd characters, a long text, nulls and repeats."""
    r = random.Random(4)
    words = ["the", "of", "Inon", "thing", "eau", "ciónes", "über", "reon", "tiles", "hand", "ver", "st", "ble", "and", "ouné", "ßer", "kin", "lor"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    base = prose(120)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(70)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, prose(40) + " " + passage + " " + prose(30)), (5, passage + "\n" + prose(20)), (6, None), (7, ""), (8, " "), (9, "  two  spaces \n"), (10, "一 二　三 🙂🙂 é\x00x ▁y"), (11, prose(6000)), (12, "x" * 700), (13, "one"), (13, "one"), (None, "no id " + prose(50)), (14, "call +1 (743) 555-3824 or a.b@mail5.example.com 10.20.30.40 4556737586899855 4556737586899856 token = \"" + "0123456789abcdef" * 2 + "01234567\""), (15, "a@b.c@d.e +x@y.z 1.2.3.4.5 256.1.1.1 3 4"), (16, "it's <s> </s> <|endoftext|> 'll"), (17, prose(30)), (18, "A B A B A B")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "k", 1, "h") for i, t in corpus()]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row long, id string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def by_id(df):
    """Rows by doc_id; repeated ones must agree."""
    out = {}
    for r in df.collect():
        d = r.asDict()
        assert out.setdefault(d["doc_id"], d) == d
    assert df.count() == len(corpus())
    return out


def test_pieces_equal_the_library(docs, nothing):
    model = tokenizer_path("piece_bpe_32k.model")
    got = by_id(piece_codec.encode_digests(docs, model, verify="texts"))
    sp = piece_codec.codec(model).sp
    for i, t in corpus():
        ids = sp.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_digests(nothing, model).count() == 0
    kept = piece_codec.append_ids(docs, model)
    assert kept.columns == [*docs.columns, "ids", "n_tokens"]
    assert [r.text for r in kept.where("doc_id = 6").collect()] == [None]
    r, codec = random.Random(1), piece_codec.codec(model)
    odd = ["".join(r.choice(" ab▁the\n.é日") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    assert codec.encode_batch(odd) == sp.encode(odd)


def test_html_keeps_the_article_alone(spark):
    page = lambda n, extra="": f'<html><head><title>T{n}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="main"><article><h1>Head {n}</h1><p>First &amp; only&nbsp;{n}{" word" * 40}<p>Second {n} <b>bold</b>{" more" * 40}</p>{extra}</article></div><section class="comments"><p>Nice post {n}</p></section><form><p>Mail</p></form><footer>&copy; site</footer><script>var a="<p>no</p>";</script></body>'
    rows = [(n, "http://a.example.com/x", page(n)) for n in range(6)] + [(7, "http://b.example.org/", page(7)), (8, None, None), (9, "odd", ""), (10, "http://a.example.com/y", "plain text"), (11, "http://a.example.com/x", page(1)), (12, "http://c.example/", "<p>a<p>b")]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, main string, constant int")
    got = {r.page_id: r for r in html_template.extract(pages).collect()}
    assert len(got) == len(rows)
    want = lambda n: f"Head {n}\nFirst & only {n}{' word' * 40}\nSecond {n} bold{' more' * 40}"
    for n in (*range(6), 7):
        assert got[n].text == want(n) and got[n].n_chars == len(want(n))
    assert (got[8].text, got[9].text, got[10].text, got[11].text, got[12].text) == ("", "", "plain text", want(1), "a\nb")
    assert html_template.extract(pages.where("false")).count() == 0


def test_token_files_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    got = wavelet.token_files(docs, path, 2).collect()
    tk, start = Tokenizer.from_file(path), 0
    ordered = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(ordered)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), ordered, strict=True):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.token_files(nothing, path, 2).count() == 0


def test_pieces_are_cut_at_line_ends_and_words_go_to_the_model():
    memo = wavelet.PieceMemo(tokenizer_path("byte_bpe_50k.json"))
    library = memo.tokenizer
    texts = ["One two.\nThree two.\nThree", "a b.\nC\nd"]
    ids, counts = memo.encode_texts(wavelet.pa.array(texts))
    assert {"two.", "\nThree", "\nC", "\nd", "b."} < set(memo.memo) and not any("\n" in x[1:] for x in memo.memo)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)

    calls = []

    class Counting:
        model = library.model

        def encode_batch_fast(self, x, **kw):
            calls.extend(x)
            return library.encode_batch_fast(x, **kw)

    memo.tokenizer = Counting()
    words = ["Straße", "été.", "naïve?!", "\nŒuvre", "\0First,", "plain", "\nplain.", "don't", "x1", "日本", "\n9", "...", "a<|endoftext|>b", "a....", "\0 x"]
    got = memo.learn(words)
    assert not any(w in c for c in calls for w in ("Straße", "été", "naïve", "Œuvre", "First", "plain"))
    for w, raw in zip(words, got, strict=True):
        text = w[1:] if w[0] == "\0" else w if w[0] == "\n" else " " + w
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_lines_and_signs_equal_the_library():
    r, memo = random.Random(7), wavelet.PieceMemo(tokenizer_path("byte_bpe_50k.json"))
    parts = ["word", "Été", "ß", "ÿ", "ɏa", "don't", "'s", "I'll", ".", ",", "!?", "...", " ", " ", " ", "\n", "\n", "\r\n", "\t", "\x85", "\xa0", "\u2028", "\u3000", "\0", "\x1c", "7", "½", "ª", "日本", "🙂", "<|endoftext|>", "\u0301", "\u180e", "\u200b"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    ids, counts = memo.encode_texts(wavelet.pa.array(texts))
    want = [e.ids for e in memo.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("n", [0, 1, 64, 5000])
def test_wavelet_access_rank_select(n):
    x = np.random.default_rng(n).integers(0, 300, n)
    m, ids, starts, first = wavelet.unpack(wavelet.pack(wavelet.WaveletMatrix.build(x, 9), np.arange(2), np.array([0, n]), 7))
    assert (m.read() == x).all() and first == 7 and ids.tolist() == [0, 1] and starts.tolist() == [0, n]
    if n:
        assert (m.access(np.arange(n)) == x).all()
        for s in (int(x[0]), 299, 5):
            at = np.flatnonzero(x == s)
            assert m.rank(s, n) == len(at) and m.rank(s, n // 2) == (x[: n // 2] == s).sum()
            assert [m.select(s, k) for k in range(min(4, len(at)))] == at[:4].tolist() and m.select(s, len(at)) == -1


def test_quality_learns_preferences(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "er", "th", "in"]) for _ in range(r.randint(1, 3)))
    good = [(k, " ".join(word() for _ in range(80)) + ".", 1) for k in range(0, 300, 2)]
    bad = [(k, " ".join(word().upper() + "!!" for _ in range(80)), 0) for k in range(1, 300, 2)]
    rows = [*good, *bad, (301, None, None), (302, "", None), (303, "x " * 9000, None), (0, good[0][1], 1)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:300] if q is not None] + [(0, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    truth = {i: q for i, _, q in rows if q is not None}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.95
    assert {x.score for x in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def brute_print(text):
    import xxhash

    w = (text or "").encode().translate(LOW).split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if bin(a ^ b).count("1") <= 4:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def test_simhash_components(docs, nothing):
    some = docs.where("doc_id is not null")
    got = {r.doc_id: r for r in simhash.near_duplicates(some).collect()}
    prints = [(i, brute_print(t)) for i, t in corpus() if i is not None]
    want = brute_components(prints)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(prints)
    assert {i: r.component_id for i, r in got.items()} == want
    assert simhash.near_duplicates(docs).count() == len(corpus())
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("tile", [10, 65_536])
def test_links_lose_nothing_in_dense_groups(spark, tile):
    r = random.Random(9)
    centre = r.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    fps = {flip(centre, r.randint(0, 4)) for _ in range(150)} | {flip(flip(centre, 4), 4) for _ in range(60)} | {r.getrandbits(64) for _ in range(100)}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile).collect()
    at = {x: k for k, (x,) in enumerate(signed)}
    f, g = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    for e in found:
        assert bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 4
        f.join(at[e.a], at[e.b])
    for i, (x,) in enumerate(signed):
        for j, (y,) in enumerate(signed[:i]):
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 4:
                g.join(i, j)
    assert [f.root(i) for i in range(len(fps))] == [g.root(i) for i in range(len(fps))]


def test_representatives(docs, nothing):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    dropped = {1: False, 2: True, 6: False, 7: True}
    assert all(((False, i) not in ids) == gone for i, gone in dropped.items())
    assert ids.count((False, 13)) == 1 and (True, None) in ids and (False, 11) in ids
    assert simhash.keep_representatives(nothing).count() == 0


def edited_copies():
    """(doc_id, text): several hundred copies of one text with one to four words edited, and copies of those."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    base = [word() for _ in range(150)]
    out = [base]
    for _ in range(400):
        copy = list(r.choice(out) if r.random() < 0.5 else base)
        for at in r.sample(range(150), r.randint(1, 4)):
            copy[at] = word()
        out.append(copy)
    r.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def brute_representatives(rows):
    """The smallest id of each component of all pairs at the similarity, by comparing every pair."""
    grams = [simhash.shingle_hashes(t or "", simhash.WIDTH) for _, t in rows]
    forest = simhash.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if forest.root(i) != forest.root(j) and simhash.jaccard(grams[i], grams[j]) >= simhash.SIMILARITY:
                forest.join(i, j)
    return sorted({rows[forest.root(i)][0] for i in range(len(rows))})


def test_representatives_miss_no_pair(spark):
    rows = edited_copies()
    r = random.Random(8)
    passage = " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(60))
    for k in range(120):  # texts around one passage, and short ones
        rows.append((len(rows), f"{r.random()} " * r.randint(0, 24) + passage))
        rows.append((len(rows), " ".join(r.choice("ab") for _ in range(r.randint(0, 11)))))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", " ", "\n", "A b", "a B"])]
    want = brute_representatives(rows)
    assert 1 < len(want) < len(rows)
    got = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_representatives_of_a_small_table_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    assert sorted(r.doc_id for r in simhash.keep_representatives(table).collect()) == brute_representatives(rows)


def test_representatives_of_equal_rows_do_not_follow_input_order(spark):
    rows = [(4, "a b", 2), (4, "a b", 1), (None, "c", 5), (None, "c", 6), (None, None, 1), (None, "", 2)]
    kept = [sorted(map(tuple, simhash.keep_representatives(spark.createDataFrame(x, "doc_id long, text string, extra int")).collect()), key=str) for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_rare_first_places_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "CHUNK_BYTES", 2000)
    rows = edited_copies()[:150]
    df = spark.createDataFrame([(str(i), t) for i, t in rows], "id string, text string")
    got = {(r.h, r.id): (r.size, r.place) for r in prefix_join.signatures(df, 5, 0.8).collect()}
    codes = decontaminate.Codes()
    sets = {str(i): set(prefix_join.text_sets([t.encode()], 5, codes)[1].tolist()) for i, t in rows}
    often = Counter(h for s in sets.values() for h in s)
    want = {}
    for i, s in sets.items():
        order = sorted(s, key=lambda h: (min(int(8 * math.log2(often[h])), 255), h))
        want |= {(h, i): (len(s), k) for k, h in enumerate(order[: len(s) - math.ceil(0.8 * len(s)) + 1]) if often[h] > 1}
    assert got == want and len(got) > 100


def test_base_spans_and_field(docs, nothing):
    def naive(t):
        luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and luhn(d)]
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]

    got = by_id(pii_crf.find(docs))
    for i, t in corpus():
        want = naive(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii_crf.KINDS] == [sum(x[0] == k for x in want) for k in pii_crf.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i]["spans"].split(","))
    assert "secret:" in got[14]["spans"] and got[11]["spans"] == "" and got[6]["spans"] == ""
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(["a@b.c", "1", "+1 ", ".", "-", " ", "4556737586899855", "é", "@", "10.0.0.1", "(", ")", "x"]) for _ in range(r.randint(0, 25)))
        assert pii_crf.base_spans(t) == naive(t)
    masked = {r.doc_id: r.text for r in pii_crf.mask_documents(docs).collect()}
    assert masked[6] is None and masked[1] == corpus()[0][1] and "<secret>" in masked[14] and "555-3824" not in masked[14]
    assert pii_crf.find(nothing).count() == 0 and pii_crf.mask_documents(nothing).count() == 0


def test_shapes_read_whole_tokens():
    assert pii_crf.shape("a" * 500) == ("plain",)
    assert {"mixed", "count=16"} <= set(pii_crf.shape("a" * 450 + "0123456789abcdef" * 2)) and "at" in pii_crf.shape("a" * 450 + "@b")
    assert "quad" not in pii_crf.shape("1.2.3." + "4" * 5000) and "quad" in pii_crf.shape("1.2.3.004")
    old = re.compile(r"[^0-9A-Za-z+(@]*(.*?)[^0-9A-Za-z)]*$", re.S)
    r = random.Random(2)
    for _ in range(3000):
        word = "".join(r.choice("a0+(@).!é,") for _ in range(r.randint(1, 9)))
        assert pii_crf.core_of(word) == old.match(word).group(1)


def test_viterbi_is_exact():
    import itertools

    f, rng = pii_crf.trained(), np.random.default_rng(3)
    for _ in range(15):
        sizes = rng.integers(1, 5, 4)
        ends, e = np.cumsum(sizes), rng.normal(0, 2, (int(sizes.sum()), len(pii_crf.LABELS)))
        e[:, 0] += rng.choice([0, 0, 12], len(e))
        got, a = f.decode(e, ends), 0
        for z in ends.tolist():
            score = lambda p, a=a: sum(e[a + i, x] for i, x in enumerate(p)) + sum(f.turn[x, y] for x, y in zip(p, p[1:], strict=False))
            best = max(itertools.product(range(len(pii_crf.LABELS)), repeat=z - a), key=score)
            assert tuple(got[a:z]) == best
            a = z


def test_lm_counts_and_probabilities(docs, nothing):
    got = by_id(maxent_lm.lm_scores(docs))
    rows = corpus()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tok = [(i, [*(t or "").encode().translate(LOW).split(), b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in tok if not out(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    for i, ws in tok:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        assert -1e6 < r["score"] < 0
    assert maxent_lm.lm_scores(nothing).count() == 0


def test_lm_beats_counts_on_held_out_texts(spark):
    r = random.Random(2)
    tongues = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    rows = [(i, " ".join(r.choices(tongues[i % 4], range(60, 0, -1), k=120))) for i in range(280)]
    got = [x for x in maxent_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    assert got and all(x.score > x.base_score for x in got)
    assert sum(x.score for x in got) > 0.9 * sum(x.base_score for x in got)


def test_lm_scores_equal_a_plain_version(spark):
    r = random.Random(6)
    words = [f"{c}{k}" for c in "pqrs" for k in range(600)]
    rows = [(i, " ".join(r.choices(words, range(2400, 0, -1), k=r.randint(0, 40)))) for i in range(400)] + [(400, None), (401, "never seen words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = maxent_lm.count_tokens(docs.where("text is not null").unionByName(spark.createDataFrame([(400, "")], docs.schema)).where(~maxent_lm.held_out("doc_id", 7)))
    v = maxent_lm.vocabulary(counts)
    learn = spark.createDataFrame([(i, t or "") for i, t in rows if not out(i)], docs.schema)
    word, group = maxent_lm.train(maxent_lm.cells(learn, v), v)
    c = Counter(w for i, t in rows if not out(i) for w in maxent_lm.tokens(t or ""))
    assert (v.total, v.distinct) == (sum(c.values()), len(c)) and v.sizes.head < len(c)
    z = v.sizes
    number = {int(h): int(k) for h, k in zip(v.hashes, v.head, strict=True)}
    head = lambda w: number.get(maxent_lm.token_hash(w), z.head)
    end = lambda w: zlib.crc32(w[-2:]) & 0x7FFFFFFF
    rest = [[w for w in c if head(w) == z.head and end(w) % z.rest == k] for k in range(z.rest)]
    assert v.rest_distinct.tolist() == [len(x) for x in rest] and v.rest_total.tolist() == [sum(c[w] for w in x) for x in rest]

    def plain(t):
        ws, total = maxent_lm.tokens(t or ""), 0.0
        for k, w in enumerate(ws):
            b = z.before - 1 if k == 0 else head(ws[k - 1]) if head(ws[k - 1]) < z.own else z.own + end(ws[k - 1]) % z.endings
            s = maxent_lm.SKIPS - 1 if k < 2 else end(ws[k - 2]) // z.endings % (maxent_lm.SKIPS - 1)
            g = np.exp(group.bias + group.near[b] + group.far[s])
            x, e = head(w), end(w) % z.rest
            if x < z.head:
                e_ = np.exp(word.bias + word.near[b] + word.far[s])
                total += math.log10(g[v.classes[x]] / g.sum() * e_[x] / e_[v.classes == v.classes[x]].sum())
            else:
                total += math.log10(g[maxent_lm.CLASSES + e] / g.sum() * (c[w] + 1) / (sum(c[y] for y in rest[e]) + len(rest[e]) + 1))
        return total

    got = {x.doc_id: x.score for x in maxent_lm.lm_scores(docs).collect()}
    assert all(math.isclose(got[i], plain(t), rel_tol=1e-5) for i, t in rows)


def test_lm_cells_are_the_same_in_sorted_form(spark, docs, monkeypatch):
    rows = maxent_lm.texts(docs)
    v = maxent_lm.vocabulary(maxent_lm.count_tokens(rows))
    read = lambda: Counter({(r.context, r.w): r.n for r in maxent_lm.cells(rows, v).collect()})
    want = read()
    monkeypatch.setattr(maxent_lm, "DENSE", 40)
    assert read() == want and sum(want.values()) == v.total


def test_lm_sizes_grow_with_the_vocabulary():
    sizes = [maxent_lm.Sizes.of(n) for n in (0, 10**3, 10**6, 10**8, 10**10)]
    assert [x.head for x in sizes] == sorted(x.head for x in sizes) and sizes[0].head == 1024 < sizes[-1].head
    assert all(x.endings > 0 and x.rest > 0 for x in sizes)


def test_lm_shares_sum_to_one():
    z = maxent_lm.Sizes.of(10**5)
    classes = np.append(np.minimum(np.arange(z.head - 1) // 40, maxent_lm.CLASSES - 2), maxent_lm.CLASSES - 1)
    rng = np.random.default_rng(0)
    w, g = maxent_lm.Weights.zeros(z.head, z.before), maxent_lm.Weights.zeros(maxent_lm.CLASSES + z.rest, z.before)
    w.bias, g.bias = rng.normal(size=w.bias.shape), rng.normal(size=g.bias.shape)
    a, b = maxent_lm.log_shares(w, g, classes, np.arange(3))
    assert np.allclose(np.exp(a).sum(-1), 1)
    assert np.allclose((np.exp(a[..., classes] + b)).sum(-1), np.exp(a[..., np.unique(classes)]).sum(-1))


def test_contamination_equals_brute_force(spark, docs, nothing):
    texts = dict(corpus())
    words = decontaminate.words_of(texts[4])
    items = [(1, " ".join(words[45:80])), (2, " ".join([*words[45:60], "other", *words[61:120]])), (3, "one"), (4, None), (5, ""), (6, "never seen in any of the texts at all"), (7, texts[1]), (None, " ".join(words[50:75]))]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, bench).collect()}
    want = {}
    for i, t in corpus():
        w = decontaminate.words_of(t)
        for k, x in items:
            v = decontaminate.words_of(x)
            sims = [decontaminate.similarity(w[s : s + len(v)], v) for s in range(max(1, len(w) - len(v) + 1))] if v and w else []
            if sims and max(sims) >= 0.8:
                want[(i, k)] = max(sims)
    assert got == pytest.approx(want)
    blocks = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, bench, limit=100).collect()}
    assert blocks == pytest.approx(want)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, _ in corpus() if i not in {k[0] for k in want})
    assert decontaminate.contamination(nothing, bench).count() == 0 and decontaminate.contamination(docs, bench.where("false")).count() == 0


def test_media_round_trip(docs, nothing):
    got = by_id(media.text_media(docs))
    for i, t in corpus():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1]["feature"] == got[2]["feature"] and len(got[1]["feature"]) == 16
    assert media.text_media(nothing).count() == 0


def test_media_are_read_back_from_a_table(docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/media"
    monkeypatch.setattr(media, "scratch", lambda spark, name: path, raising=False)
    got = media.text_media(docs).collect()
    stored = docs.sparkSession.read.parquet(path).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert Counter((r.media_sha256, r.tile_sha256) for r in got) == Counter((sha(r.media), sha(r.tile)) for r in stored)
    assert len(stored) == len(corpus())


def test_image_formats():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert (media.decode_netpbm(media.encode_pgm(x.tobytes(), 4)) == x).all()
    assert (media.decode_netpbm(b"P2 # c\n4 3\n255\n" + b" ".join(b"%d" % v for v in x.ravel())) == x).all()
    assert media.decode_netpbm(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]] and media.decode_netpbm(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_netpbm(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode_netpbm(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    import struct

    bmp = b"BM" + struct.pack("<IHHI", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([3, 2, 1, 0, 6, 5, 4, 0])
    assert media.decode_bmp(bmp).tolist() == [[[4, 5, 6]], [[1, 2, 3]]]
    assert media.decode_image(None) is None and media.decode_image(b"P5\n4 4\n255\nx") is None and media.decode_image(b"GIF") is None
    big = np.random.default_rng(0).integers(0, 255, (40, 24)).astype(np.uint8)
    assert np.allclose(media.area_resize(big, 8, 6), big.reshape(8, 5, 6, 4).mean((1, 3)))
    assert np.isclose(media.area_resize(big, 7, 5).mean(), big.mean())


def brute_dedup(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 65_536])
def test_suffix_dedup_equals_brute_force(docs, nothing, hot):
    got = by_id(suffix_dedup.dedup_digests(docs, hot=hot))
    want = brute_dedup(corpus(), 200)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.dedup_digests(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_are_found_in_dense_groups(spark, seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab") for _ in range(40)) for _ in range(5)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 14)))[r.randint(0, 9) :]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup_digests(docs).collect()}
    assert got == brute_dedup(rows, 200)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
