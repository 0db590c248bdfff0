"""What term statistics leave in the shared folder, and rows that share a key."""

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazlake.operators import bayes, bayes_passes, postings, severity
from hazlake.operators.similar import build_index
from hazlake.session import shared_dir


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(i, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300))) for i in range(150)]


def written(spark, run):
    top = shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = size()
    run()
    return size() - before


def test_index_writes_little_more_than_its_texts(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, cleaned_text string")
    assert written(spark, lambda: build_index(frame, max_features=50)) < 3 * sum(len(t) for _, t in texts)


def test_naive_bayes_writes_a_few_times_its_texts(spark, texts):
    frame = spark.createDataFrame(texts, "key long, text string").selectExpr("key", "text", "if(key % 2 = 0, 'I', 'II') AS label", "CAST(key % 3 AS INT) AS part")
    corpus = lambda: severity.corpus_of(frame, "key", "label", "text")
    assert written(spark, lambda: bayes.fit(corpus(), ["I", "II"], [0])) < 10 * sum(len(t) for _, t in texts)


def test_index_merges_rows_that_share_a_key(spark):
    frame = spark.createDataFrame([(1, "gas leak"), (1, "gas"), (2, "gas leak"), (None, None)], "doc_id long, cleaned_text string")
    index = build_index(frame)
    names = {r["i"]: r["term"] for r in index.vocabulary.collect()}
    got = {r["key"]: sorted((names[i], round(w, 9)) for i, w in zip(r["idx"], r["val"])) for r in index.vectors.collect()}
    idf = {"gas": math.log(5 / 4) + 1, "leak": math.log(5 / 3) + 1, "gas leak": math.log(5 / 3) + 1}
    for key, terms in {1: ["gas", "gas", "gas leak", "leak"], 2: ["gas", "gas leak", "leak"], None: []}.items():
        norm = math.sqrt(sum(idf[t] ** 2 for t in terms))
        assert got[key] == [(t, round(idf[t] / norm, 9)) for t in terms]


def test_scales_are_joined_by_shuffle_beyond_their_limit(spark, texts, monkeypatch):
    frame = spark.createDataFrame(texts[:20], "key long, text string").selectExpr("key", "text", "if(key % 2 = 0, 'I', 'II') AS label", "CAST(key % 3 AS INT) AS part")
    corpus = severity.corpus_of(frame, "key", "label", "text")
    run = lambda: {r["key"]: [round(v, 9) for v in r["logs"]] for r in bayes.scores(*bayes.fit(corpus, ["I", "II"], [0])).collect()}
    few = run()
    monkeypatch.setattr(bayes, "SCALES", 3)
    assert run() == few and len(few) == 20 and corpus.filter(F.size("counts") > 0).count() == 20


def test_five_folds_write_hardly_more_than_one_model(spark, texts, monkeypatch):
    monkeypatch.setattr(postings, "HEAVY", 5)
    frame = spark.createDataFrame(texts, "key long, text string").selectExpr("key", "text", "if(key % 2 = 0, 'I', 'II') AS label", "CAST(key % 5 AS INT) AS part")
    corpus = severity.corpus_of(frame, "key", "label", "text")
    one, five = (written(spark, lambda: bayes.scores(*bayes.fit(corpus, ["I", "II"], range(n))).count()) for n in (1, 5))  # noqa: B023
    assert five < 1.5 * one


@pytest.mark.parametrize("heavy, scales", [(20_000, 10**6), (2, 10**6), (2, 0), (20_000, 0)])
def test_rows_that_share_a_key_or_have_none(spark, monkeypatch, heavy, scales):
    monkeypatch.setattr(postings, "HEAVY", heavy)
    monkeypatch.setattr(bayes, "SCALES", scales)
    rows = [(1, "I", 1, "gas leak"), (2, "II", 1, "pump"), (3, None, 0, "gas pump"), (3, None, 0, "gas pump"), (4, None, 0, "unheard"), (None, "I", 1, "gas"), (5, "II", 1, None)]
    corpus = severity.corpus_of(spark.createDataFrame(rows, "key long, label string, part int, text string"), "key", "label", "text")
    got = {}
    for r in bayes.scores(*bayes.fit(corpus, ["I", "II"])).collect():
        got.setdefault(r["key"], []).append([round(v, 9) for v in r["logs"]])
    idf = {"gas": math.log(5 / 3) + 1, "leak": math.log(5 / 2) + 1, "gas leak": math.log(5 / 2) + 1, "pump": math.log(5 / 2) + 1}
    norm = math.sqrt(sum(v * v for t, v in idf.items() if t != "pump"))
    sums = {"I": {t: v / norm for t, v in idf.items() if t != "pump"}, "II": {"pump": 1.0}}
    log = lambda v, t: math.log(sums[v].get(t, 0) + 0.1) - math.log(sum(sums[v].values()) + 0.4)
    # both copies' entries count, in the length as in the score
    scale = 2 / math.sqrt(2 * (idf["gas"] ** 2 + idf["pump"] ** 2))
    assert got[3] == [[round(math.log(0.5) + 2 * scale * (idf["gas"] * log(v, "gas") + idf["pump"] * log(v, "pump")), 9) for v in ("I", "II")]] * 2
    assert got[4] == got[5] == got[None] == [[round(math.log(0.5), 9)] * 2]


def test_terms_go_on_in_the_next_batch():
    rows = [("a", 0), ("a", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 5)]
    for size in range(1, 8):
        batches = [pa.RecordBatch.from_pydict({"term": [t for t, _ in b], "r": [r for _, r in b]}) for b in (rows[i:i + size] for i in range(0, 6, size))]
        got = [row for out in bayes_passes.grouped(iter(batches)) for row in out.to_pylist()]
        assert got == [{"term": "a", "r": [0, 1]}, {"term": "b", "r": [2, 3, 4]}, {"term": "c", "r": [5]}]
