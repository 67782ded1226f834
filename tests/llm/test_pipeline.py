"""The pipeline's stages, each on its own input, against brute force."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import mixing, pieces, quality, registry, suffixes
from tests.llm.test_operators import brute_components, brute_repeats, brute_set, prose

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DIR).persist()
        out.append((docs, after))
        docs = after
    return out


def test_quality_keeps_what_it_accepts(spark, stages):
    before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, model).collect() if r.score >= quality.THRESHOLD}
    assert rows(after) == rows(before.filter(before.doc_id.isin(list(good)))) and after.columns == before.columns
    assert 0.6 * before.count() < after.count() < before.count()


def test_jaccard_keeps_one_of_each_group(stages):
    before, after = stages[1]
    docs = sorted(before.collect(), key=lambda r: r.doc_id)
    sets = [brute_set(r.text, 5) for r in docs]
    comp = brute_components(len(docs), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert rows(after) == sorted((tuple(r) for i, r in enumerate(docs) if comp[i] == i), key=str) and after.columns == before.columns


def test_suffixes_remove_repeats(stages):
    before, after = stages[2]
    docs = before.collect()
    want = {r.doc_id: n - gone for r, (n, gone, _, _) in zip(docs, brute_repeats([r.text for r in docs], suffixes.PASSAGE), strict=True)}
    got = {r.doc_id: r for r in after.collect()}
    assert after.columns == before.columns and all(0 <= want[i] - len(r.text.encode()) <= 6 and r.n_chars == len(r.text) for i, r in got.items())
    assert all(want[i] == 0 or i in got or want[i] < 40 for i in want)


def test_mixing_meets_its_targets(stages):
    before, after = stages[3]
    size = lambda t: len(t.encode().split())
    had, has = Counter(), Counter()
    for r in before.collect():
        had[r.source] += size(r.text)
    for r in after.collect():
        has[r.source] += size(r.text)
    order = sorted(had, key=lambda s: s.encode())
    target = mixing.fill_targets([had[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))], 1.5 * sum(had.values()), 2.0)
    texts, largest = Counter(r.text for r in before.collect()), Counter()
    for r in before.collect():
        largest[r.source] = max(largest[r.source], size(r.text))
    assert all(abs(has[s] - t) <= largest[s] for s, t in zip(order, target, strict=True)) and after.columns == before.columns
    assert all(n <= 2 * texts[t] for t, n in Counter(r.text for r in after.collect()).items())


def test_sentencepiece_encodes_the_mix(stages):
    sentencepiece = pytest.importorskip("sentencepiece")
    before, after = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted((r.doc_id, tuple(sp.encode(r.text))) for r in before.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in after.collect())


def test_odd_rows_pass_through(spark):
    """Nulls in every column, ties, repeated rows, empty texts, extra columns, and empty tables."""
    texts = [prose(90) for _ in range(40)]
    data = [(i, t, "en", None if i % 3 else "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (50, "", "en", "s", 0), (51, None, "en", "s", 0)] + [(5, texts[5], "en", None, 9)] * 2 + [(None, texts[7], None, None, None)]
    df = spark.createDataFrame(data, COLUMNS).selectExpr("*", "'x' as size", "1 as score", "'y' as `row`", "array(1) as draws")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DIR)
        assert name == "sentencepiece" or set(out.columns) == set(df.columns)
        assert out.count() > 0 and stage(spark, df.limit(0), DIR).count() == 0, name


def test_jaccard_stage_judges_rows_by_their_texts(spark):
    """Rows without an id go where their text has come; different texts under one id both stay."""
    a, b, c = prose(60), prose(60), prose(60)
    df = spark.createDataFrame([(1, a), (1, b), (None, a), (None, c), (None, c), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "'y' as `row`")
    out = corpus_pipeline.ngram_jaccard_join(spark, df, DIR)
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, a), (1, b), (None, c), (2, None), (3, "")])) and out.columns == df.columns


def test_registry_names():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "sentencepiece"]
    assert np.isfinite(quality.THRESHOLD)
