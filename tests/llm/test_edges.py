"""Very long texts, clashing columns, repeated items and empty tables through every operator."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, html_template, maxent_lm, media, pii_crf, piece_codec, quality, simhash, suffix_dedup, wavelet
from tidemark.llm.queries import tokenizer_path

N = 300_000


@pytest.fixture(scope="module")
def long_texts(spark):
    """One sign or word, very often; an unbroken run of digits, of letters, of spaces; one with everything in it."""
    bodies = ["1" * N, "a" * N, " " * N, "1." * (N // 2), "a@" * (N // 2), "ab " * (N // 3), "\n" * N, "é" * (N // 2), "<div>" * (N // 5), "the " * 400 + "x" * N]
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("run", [
    lambda d: piece_codec.encode_digests(d, tokenizer_path("piece_bpe_32k.model")), lambda d: wavelet.token_files(d, tokenizer_path("byte_bpe_50k.json"), 2),
    lambda d: quality.score_quality(d, quality.fit_ranker(quality.np.zeros((0, len(quality.NAMES))), quality.np.zeros(0, bool))), simhash.near_duplicates, simhash.keep_representatives,
    pii_crf.find, pii_crf.mask_documents, maxent_lm.lm_scores, media.text_media, suffix_dedup.dedup_digests,
], ids="op1 op3 op4 op5 near_dedup op6 mask op7 op9 op10".split())
def test_long_texts_are_read_whole(long_texts, run):
    # the text of spaces and that of line ends have no words, so they are copies
    assert run(long_texts).count() == (9 if run is simhash.keep_representatives else 10)


def test_long_page_is_read_whole(spark, long_texts):
    pages = long_texts.selectExpr("doc_id page_id", "'http://a.example/' url", "text html")
    got = {r.page_id: r.n_chars for r in html_template.extract(pages).collect()}
    assert got[0] == N and got[1] == N and got[2] == 0 and got[8] == 0


LAYOUTS = {
    "plain": "<html><head><title>T{n}</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{a}</article><footer>Imprint of us</footer></body></html>",
    "divs": "<body><div id=top><div class='site-header'>Name of the site</div><div class=menu-main>One two three</div></div><div id=wrap><div class=col>{a}</div><div class='col side'>Archive {n}</div></div><div class='comments'><p>Reader {n} writes a long comment here</div></body>",
    "no body": "<head><title>T{n}</title><article><header><h1>Title {n}</h1></header>{b}</article><aside>other {n}</aside>",
    "unclosed": "<body><main><div class=entry-content>{a}<form><input>Mail us</form></main><div class=newsletter>Subscribe {n}",
    "neutral": "<body><div class=a1>We use no cookies at all, read on.</div><div class=b2><div class=c3>{a}</div><div class=d4>Always the same line under each text, of any length: " + "word " * 120 + "</div></div></body>",
}
CLASSES = ["post-12 post type-post tag-news", "legal-opinion", "side-effects", "product-header", "comments-open post", "entry-content social", "tags", "notice"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_articles_of_many_layouts(spark, layout):
    r = random.Random(layout)
    words = lambda k: " ".join(r.choice(["ano", "bel", "cid", "dor", "eff"]) + r.choice("xyz") for _ in range(k))
    rows, want = [], {}
    for n in range(9):
        blocks = [words(r.randint(20, 60)) for _ in range(r.randint(2, 5))]
        body = "".join(f"<p>{x}" for x in blocks)
        rows.append((n, f"http://{layout.replace(' ', '')}.example/{n}", LAYOUTS[layout].replace("{a}", f"<h1>Title {n}</h1>{body}").replace("{b}", body).replace("{n}", str(n))))
        want[n] = "\n".join([f"Title {n}", *blocks])
    got = {x.page_id: x.text for x in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_two_kinds_of_pages_have_two_templates_and_near_copies_stay(spark):
    r = random.Random(12)
    words = lambda k: " ".join(r.choice(["ano", "bel", "cid", "dor", "eff"]) + r.choice("xyz") for _ in range(k))
    rows, want = [], {}
    for n in range(20):
        a, b = words(60), words(40)
        kind = "<div class=k1><p>Only news have this line.<div class=t1><p>{a}<p>{b}</div></div>" if n % 5 < 3 else "<section class=k2><div class=u2><p>{a}<p>{b}</div><p>Only reports end so.</section>"
        rows.append((n, "http://two.example/x", "<body><div class=z0>Site of two kinds</div>" + kind.format(a=a, b=b) + "</body>"))
        want[n] = f"{a}\n{b}"
    same = [words(50) for _ in range(6)]
    for n in range(20, 28):  # edited copies of one article, with an advert that differs
        text = [*same[:5], f"{words(30)} {n}", same[5]]
        rows.append((n, "http://copies.example/x", f"<body><div class=ad>Buy {n}</div><article>" + "".join(f"<p>{x}" for x in text) + "</article></body>"))
        want[n] = "\n".join(text)
    got = {x.page_id: x.text for x in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("name", CLASSES)
def test_an_article_s_own_names_do_not_remove_it(name):
    assert html_template.main_text(f"<body><nav>m</nav><article class='{name}'><p>Text of it</article>", frozenset(), frozenset()) == "Text of it"


def test_classes_are_nested_and_valid():
    rows = [  # path: parent, pages, vector, n
        (0, (0, 10, 100, 1)), (1, (0, 10, 100, 1)), (2, (1, 10, 100, 1)), (3, (2, 6, 60, 1)), (4, (3, 6, 60, 1)), (5, (2, 4, 40, 1)), (6, (4, 6, 60, 3)),
    ]
    got = {(c.vector, tuple(c.paths)): c.inside for c in html_template.nested_classes(dict(rows))}
    assert got == {((10, 100), (0, 1, 2)): None, ((6, 60), (3, 4)): (10, 100), ((4, 40), (5,)): (10, 100), ((6, 60), (6,)): (10, 100)}


def test_the_slot_is_that_of_the_innermost_class(spark):
    r = random.Random(13)
    words = lambda k: " ".join(r.choice(["ano", "bel", "cid", "dor", "eff"]) + r.choice("xyz") for _ in range(k))
    rows, want = [], {}
    for n in range(20):  # reports have their text in an element of their own, after the slot of the news with a teaser in it
        a, b, t = words(50), words(60), words(4)
        report = n % 10 > 6
        main = f"<p>{t}</div></div><div class=kc><p>{a}<p>{b}</div>" if report else f"<p>{a}<p>{b}</div></div>"
        rows.append((n, "http://slots.example/x", f"<body><div class=ka><div class=kb>{main}</body>"))
        want[n] = f"{a}\n{b}"
    got = {x.page_id: x.text for x in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_blocks_are_template_with_the_elements_of_their_own_slot_alone(spark):
    r = random.Random(14)
    words = lambda k: " ".join(r.choice(["ano", "bel", "cid", "dor", "eff"]) + r.choice("xyz") for _ in range(k))
    rows, want = [], {}
    same = words(30)
    for n in range(24):
        own = [words(30) for _ in range(4)]
        box = "<div class=kb><em>Of it</em>" + ("<div class=kc>Once more</div>" if n in (0, 2, 4) else "") + "</div>" if n % 2 == 0 else ""
        rate = "<div class=kd>Rated</div>" if n % 3 == 0 else ""
        line = "<p>All ratings follow our rules." if n % 3 == 0 else ""  # goes: one class with kd, both in the article's slot
        text = [own[0], *([same] if n in (0, 2, 4) else []), *own[1:]]  # stays: kc lies in the slot of kb
        rows.append((n, "http://chance.example/x", f"<body>{box}<article>{rate}" + "".join(f"<p>{x}" for x in text) + f"{line}</article></body>"))
        want[n] = "\n".join(text)
    got = {x.page_id: x.text for x in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_classes_hold_blocks_and_know_their_depth():
    elements = {0: (0, 9, 90, 1), 1: (0, 9, 90, 1), 2: (1, 9, 200, 4), 3: (1, 5, 50, 1), 4: (3, 3, 30, 1)}  # 2 is a row of paragraphs
    got = html_template.nested_classes(elements, [(2, 11, 5, 50), (2, 12, 3, 30), (4, 13, 3, 30), (1, 14, 9, 90)])
    assert {(c.vector[0], c.level, tuple(c.paths), tuple(m for _, m in c.blocks)) for c in got} == {
        (9, 0, (0, 1), (14,)), (9, 1, (2,), ()), (5, 1, (3,), (11,)), (3, 2, (4,), (13,)), (3, 1, (), (12,)),
    }
    deep = {k: (max(0, k - 1), 5, 50, 1) for k in range(200_000)}
    assert len(html_template.nested_classes(dict(reversed(deep.items())))) == 1


def test_long_texts_are_searched_whole(spark, long_texts):
    bench = spark.createDataFrame([(1, "the the the the the the"), (2, "the x")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(long_texts, bench).collect()} == {9}


def test_clashing_columns_are_kept_or_replaced(spark):
    rows = [(1, "a b c d e f", 5, [9], 0.5, True), (2, "nothing", 6, [8], 0.25, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids array<int>, score double, contaminated boolean")
    got = piece_codec.append_ids(docs, tokenizer_path("piece_bpe_32k.model"))
    assert sorted(got.columns) == sorted(docs.columns) and all(r.n_tokens == len(r.ids) for r in got.collect())
    bench = spark.createDataFrame([(1, "b c d e f a"), (2, "a b c d e f")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench).collect()
    assert [tuple(r) for r in left] == [(2, "nothing", 6, [8], 0.25, False)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    assert quality.score_quality(docs, model, "other").columns == [*docs.columns, "other"]


def test_items_of_one_id_are_reported_each(spark):
    docs = spark.createDataFrame([(1, "one two and three four five six seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two"), (7, "three four five six seven"), (7, "two"), (None, "two"), (8, "two one")], "item_id long, text string")
    got = sorted(((r.item_id is None, r.item_id or 0, r.first_word, r.n_words) for r in decontaminate.contamination(docs, bench).collect()))
    assert got == [(False, 7, 0, 2), (False, 7, 1, 1), (False, 7, 3, 5), (True, 0, 1, 1)]


def test_odd_digits_and_long_numbers_do_not_stop_the_patterns():
    for t in ("1" * 5000 + ".1.1.1", "1.2²3.4.5", "0" * 5000 + "1.2.3.4", "٣.٣.٣.٣", "a@" * 50, "x@b.c@d.e", "a@b", "@b.c"):
        base = pii_crf.base_spans(t)
        pii_crf.added_spans(pii_crf.trained(), [t], [base])
        assert [s[0] for s in base] == {"0": ["ip"], "x": ["email"]}.get(t[0], [])
    cover = pii_crf.Cover([("a", 5, 9), ("b", 1, 3), ("c", 8, 12)])
    assert [cover.touches(a, b) for a, b in [(0, 1), (0, 2), (3, 5), (4, 6), (11, 20), (12, 20)]] == [False, True, False, True, True, False]


def test_images_above_their_maxval_are_malformed():
    for raw in (b"P2 1 1 9\n300", b"P2 1 1 9\n-3", b"P5 1 1 9\n\xff", b"P2 1 1 255\n" + b"9" * 6000, b"P5 99999999999999999999 1 255\nx", b"P", b""):
        assert media.decode_image(raw) is None


def test_pipeline_runs_on_whole_and_on_empty_tables(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "er", "th", "in", "ou"]) for _ in range(r.randint(1, 3)))
    rows = [(k, " ".join(word() if k % 2 else word().upper() + "!!" for _ in range(60)), "en", "s", 9) for k in range(200)]
    rows += [(300, rows[1][1], "en", "s", 9), (301, None, "en", "s", None), (302, "", "en", "s", 0), (303, rows[3][1] + " x", "en", "s", 9), (304, rows[5][1] + " +1 (743) 555-3824", "en", "s", 9)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, names).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(k, k % 2, 0) for k in range(200)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, " ".join(rows[7][1].split()[10:40]))] if some else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()}
    good = {k for k in range(200) if k % 2}
    assert good - {7} <= set(got) and not {7, 300, 303} & set(got) and len(set(got) & (set(range(200)) - good)) < 5
    assert all(x.n_tokens == len(x.ids) for x in got.values()) and 304 not in got  # a near copy of 5
    empty = corpus_pipeline.run(spark, f"file://{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == [*(x.split()[0] for x in names.split(", ")), "ids", "n_tokens"]


