"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, pii_crf, quality, simhash
from tidemark.llm.common import table
from tidemark.llm.piece_codec import codec
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every stage's input and output, written and read again, as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a clashing column, a null and an exact copy go through all stages
    docs = docs.unionByName(docs.limit(1)).withColumn("score", docs.doc_id * 2).unionByName(spark.createDataFrame([(-1, None, "en", "s", None, 0)], "doc_id long, text string, lang string, source string, n_chars long, score long"))
    out, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect())
        if name != "tokenize":
            assert after.columns == columns
        docs = after
    return out


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_quality_keeps_rows_at_or_above_the_cut(spark, results):
    before, after = results["quality"]
    docs = spark.createDataFrame(before)
    model = quality.fit_quality(docs, table(spark, SF, "labels", "doc_id", "quality"))
    x = np.array([quality.features(r.text or "") for r in before], float)
    kept = [r for r, s in zip(before, model.score(x), strict=True) if s >= quality.CUT]
    assert ids(after) == ids(kept) and 0 < len(after) < len(before)
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    right = sum((r.doc_id in ids(after)) == bool(truth[r.doc_id]) for r in before if r.doc_id in truth)
    assert right / sum(r.doc_id in truth for r in before) > 0.95


def test_near_copies_leave_one_document(results):
    before, after = results["near_dedup"]
    grams = {r.doc_id: np.unique(simhash.shingle_hashes(r.text or "", 5)) for r in before}
    kept = ids(after)
    assert max(kept.values()) == 1 and len({r.text or "" for r in after}) == len(after)
    for r in before:
        if r.doc_id not in kept:  # what goes has a close copy among the rest of the input
            assert any(simhash.jaccard(grams[r.doc_id], g) >= 0.8 for d, g in grams.items() if d < r.doc_id)
    alone = [d for d, g in grams.items() if all(e == d or simhash.jaccard(g, h) < 0.8 for e, h in grams.items())]
    assert set(alone) <= set(kept)
    left = [grams[d] for d in kept]  # no two of those that stay are near copies
    assert not any(simhash.jaccard(g, h) >= 0.8 for i, g in enumerate(left) for h in left[:i])


def test_no_item_is_left(spark, results):
    before, after = results["decontaminate"]
    items = [decontaminate.words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 5]) for w in items for i in range(len(w) - 4)}

    def found(text):
        w = decontaminate.words_of(text)
        if not any(tuple(w[i : i + 5]) in grams for i in range(len(w) - 4)):
            return False
        return any(decontaminate.similarity(w[s : s + len(v)], v) >= 0.8 for v in items for s in range(max(1, len(w) - len(v) + 1)))

    assert ids(after) == ids([r for r in before if not found(r.text)])


def test_personal_data_is_masked_and_nothing_else(results):
    before, after = results["mask_pii"]
    texts = {r.doc_id: r.text for r in after}
    assert ids(before) == ids(after)
    for r in before:
        base = pii_crf.base_spans(r.text or "")
        assert not any((r.text[a:b]) in texts[r.doc_id] for _, a, b in base)
        if not base and not re.search(r"[0-9]{13}|[0-9a-fA-F]{20}|\+[0-9]", r.text or ""):
            assert texts[r.doc_id] == r.text


def test_ids_are_the_library_s(results):
    before, after = results["tokenize"]
    sp, got = codec(tokenizer_path("piece_bpe_32k.model")).sp, {r.doc_id: r for r in after}
    assert len(before) == len(after)
    for r in before:
        want = sp.encode(r.text or "")
        assert (got[r.doc_id].ids, got[r.doc_id].n_tokens, got[r.doc_id].text) == (want, len(want), None if r.text is None else sp.decode(want))
