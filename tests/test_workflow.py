"""Folds against step-by-step updates, streams against batch, retrieval against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hazlake.functions.stopwords import ENGLISH
from hazlake.operators import governance as gov
from hazlake.operators import linear, metrics, severity, similar, splits
from hazlake.operators.quality import deduplicate
from hazlake.operators.rollup import location_rollup
from hazlake.operators.similar import find_similar
from hazlake.operators.tfidf import char_terms
from hazlake.sources.stores import append_batch, fold_log, merge_buckets, read_buckets
from hazlake.streaming import live

SCHEMA = "event_id long, ts timestamp, action_id string, alert_id string, status string, officer_name string, officer_id string, notes string"


def events(statuses, n=400, seed=1):
    import datetime

    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        # one id takes a third of all events
        target = "hot" if rng.random() < 0.33 else f"id{rng.randrange(25)}"
        rows.append((i, start + datetime.timedelta(minutes=i // 2), target, target, rng.choice(statuses),
                     rng.choice([None, "", "Ann", "Bo"]), rng.choice([None, "H1"]), rng.choice([None, "", f"n{i}"])))
    return rows


def follow_actions(rows):
    state = {}
    for _, ts, target, _, status, name, badge, notes in rows:
        status = status.strip().upper()
        if status not in gov.ACTION_STATUSES:
            continue
        s = state.setdefault(target, dict(completed_at=None, verified_at=None, notes=None, name=None, badge=None))
        s["status"] = status
        s["notes"], s["name"], s["badge"] = notes or s["notes"], name or s["name"], badge or s["badge"]
        if status == "OPEN":
            s["completed_at"] = s["verified_at"] = None
        if status in ("COMPLETED", "VERIFIED"):
            s["completed_at"] = s["completed_at"] or ts
        if status == "VERIFIED":
            s["verified_at"] = ts
    return state


def plain(df):
    return {
        r["action_id"]: dict(completed_at=r["completed_at"], verified_at=r["verified_at"], notes=r["tracking_notes"],
                             name=r["verified_by_officer"], badge=r["officer_id"], status=r["status"])
        for r in df.collect()
    }


def test_action_fold_follows_the_updates(spark):
    rows = events(["OPEN", "in_progress", " completed ", "VERIFIED", "BOGUS"])
    frame = spark.createDataFrame(rows, SCHEMA).drop("alert_id")
    expected = follow_actions(rows)
    assert plain(gov.action_state(frame)) == expected
    kept = gov.compact_action_events(frame)
    assert plain(gov.action_state(kept)) == expected
    assert kept.count() <= 7 * len(expected)


@pytest.mark.parametrize("seed", range(3))
def test_action_fold_over_many_slices(spark, seed):
    # months apart, an hour apart and at the same moment, with events of no time first
    import datetime

    rng = random.Random(seed)
    now, rows = datetime.datetime(2023, 12, 31, 22), []
    for i, r in enumerate(events(["OPEN", "COMPLETED", "VERIFIED", "IN_PROGRESS"], 300, seed)):
        now += datetime.timedelta(minutes=rng.choice([0, 0, 1, 59, 60, 50_000]))
        rows.append((i, None if i < 4 else now, *r[2:]))
    frame = spark.createDataFrame(rows, SCHEMA).drop("alert_id")
    expected = follow_actions(rows)
    assert plain(gov.action_state(frame.repartition(5))) == expected
    assert plain(gov.action_state(gov.compact_action_events(frame))) == expected
    assert gov.action_state(frame.limit(0)).collect() == []


def test_action_fold_reads_its_events_once(spark, tmp_path):
    spark.createDataFrame(events(["OPEN", "VERIFIED"]), SCHEMA).drop("alert_id").write.parquet(str(tmp_path / "e"))
    shown = gov.action_state(spark.read.parquet(str(tmp_path / "e")))._jdf.queryExecution().executedPlan().toString()
    assert shown.count("FileScan") == 1 and "Join" not in shown


def test_current_records_take_what_events_changed(spark):
    records = spark.createDataFrame([("A", "NEW", "r", None), ("B", "NEW", "r", None)], "alert_id string, alert_status string, report_id string, resolved_by string")
    state = spark.createDataFrame([("A", "RESOLVED", "Ann"), ("Z", "NEW", None)], "alert_id string, alert_status string, resolved_by string")
    got = gov.current_records(records, state, "alert_id")
    assert got.columns == records.columns
    assert sorted(map(tuple, got.collect())) == [("A", "RESOLVED", "r", "Ann"), ("B", "NEW", "r", None)]


def test_action_stream_touches_only_buckets_of_its_ids(spark, tmp_path):
    rows = events(["OPEN", "in_progress", "COMPLETED", "VERIFIED"], 300)
    frame = spark.createDataFrame(rows, SCHEMA).drop("alert_id")
    late = spark.createDataFrame([(900, rows[-1][1], "id3", "VERIFIED", "Cy", "H9", "end")], frame.schema)
    folder, store = str(tmp_path / "in"), str(tmp_path / "kept")
    parts = [frame.filter("event_id < 100"), frame.filter("event_id BETWEEN 100 AND 299"), late]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = live.watch(spark, folder, frame.schema)
        live.fold_stream(stream, store, gov.compact_action_events, "action_id", str(tmp_path / "c"), buckets=8).awaitTermination()
    assert spark.read.parquet(store).filter("batch = 2").select("bucket").distinct().count() == 1
    got = plain(live.read_state(spark, store, "action_id", gov.action_state))
    assert got == plain(gov.action_state(frame.unionByName(late)))
    assert got["id3"]["notes"] == "end"


def test_event_log_folds_only_what_is_new(spark, tmp_path):
    rows = events(["OPEN", "COMPLETED", "VERIFIED"], 200)
    frame = spark.createDataFrame(rows, SCHEMA).drop("alert_id")
    log, store = str(tmp_path / "log"), str(tmp_path / "state")
    assert read_buckets(spark, store, frame.schema).count() == 0

    def add(part, number):
        append_batch(part, log, number)
        return fold_log(spark, log, store, gov.compact_action_events, "action_id", 4)

    assert add(frame.filter("event_id < 120"), 0) == 0
    assert add(frame.limit(0), 1) == 0  # an empty batch leaves no files
    assert add(frame.filter("event_id >= 120"), 5) == 5
    assert fold_log(spark, log, store, gov.compact_action_events, "action_id", 4) == 5
    assert plain(gov.action_state(read_buckets(spark, store))) == follow_actions(rows)
    # the last fold again, as after a failure before its versions were written
    merge_buckets(frame.filter("event_id >= 120"), store, gov.compact_action_events, "action_id", 5, 0, 4)
    assert plain(gov.action_state(read_buckets(spark, store))) == follow_actions(rows)


def test_live_trend_adds_up_and_repeats_safely(spark, tmp_path):
    from hazlake.operators import rollup
    from hazlake.plans.analysis import scored_history
    from hazlake.plans.derived import project

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    reports = project(documents, "raw_reports")
    for i in range(3):
        documents.filter(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = project(live.watch(spark, str(tmp_path / "in"), documents.schema, files_per_batch=1), "raw_reports")
    live.fold_trend(stream, str(tmp_path / "trend"), str(tmp_path / "c")).awaitTermination()
    want = sorted(map(tuple, rollup.monthly_trend(scored_history(reports)).collect()))
    assert sorted(map(tuple, live.live_trend(spark, str(tmp_path / "trend")).collect())) == want
    # the last batch runs again, as after a failure before it was committed
    (tmp_path / "c" / "commits" / "2").unlink()
    (tmp_path / "c" / "commits" / ".2.crc").unlink(missing_ok=True)
    live.fold_trend(stream, str(tmp_path / "trend"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, live.live_trend(spark, str(tmp_path / "trend")).collect())) == want


def test_alert_fold_survives_compaction(spark):
    frame = spark.createDataFrame(events(["NEW", "ACKNOWLEDGED", "RESOLVED", "odd"]), SCHEMA).drop("action_id")
    whole = sorted(map(str, gov.alert_state(frame).collect()))
    assert whole == sorted(map(str, gov.alert_state(gov.compact_alert_events(frame)).collect()))


def test_stream_of_several_batches_ends_like_the_batch(spark, tmp_path):
    rows = events(["NEW", "ACKNOWLEDGED", "RESOLVED"], 300)
    frame = spark.createDataFrame(rows, SCHEMA).drop("action_id")
    for i in range(3):
        frame.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.watch(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    live.fold_stream(stream, str(tmp_path / "kept"), gov.compact_alert_events, "alert_id", str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).select("batch").distinct().count() == 3
    got = live.read_state(spark, str(tmp_path / "kept"), "alert_id", gov.alert_state)
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(
        map(str, gov.alert_state(frame).select(*sorted(got.columns)).collect())
    )


def brute_force(queries, docs, threshold, top):
    def count(t):
        words = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in ENGLISH]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counts = [count(d) for d in docs]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1
        return {t: v / norm for t, v in w.items()}

    vectors = [vector(c) for c in counts]
    out = set()
    for q, text in enumerate(queries):
        v = vector(count(text))
        scored = [(sum(w * d.get(t, 0) for t, w in v.items()), i) for i, d in enumerate(vectors)]
        best = sorted(((-round(s, 6), i) for s, i in scored if s >= threshold))[:top]
        out |= {(q, rank, i, round(-s, 4)) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_retrieval_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(5)
    words = "valve leak pump gas crane load tank spark cable ladder the of and harness burst hose".split()
    # one word sits in nearly every text
    docs = ["valve " + " ".join(rng.choices(words, k=12)) for _ in range(60)]
    queries = [" ".join(rng.choices(words, k=8)) for _ in range(7)] + ["", "unknown words only", docs[3]]
    found = find_similar(
        spark.createDataFrame(list(enumerate(queries)), "query_id long, report_text string"),
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, cleaned_text string"),
    )
    got = {(r["query_id"], r["rank"], r["doc_id"], round(r["similarity"], 4)) for r in found.collect()}
    assert got == brute_force(queries, docs, 0.10, 3)
    assert {r for r in got if r[0] == 9 and r[1] == 1} == {(9, 1, 3, 1.0)}


def test_char_terms(spark):
    r = spark.createDataFrame([("Gas a",)], "t string").select(char_terms(F.col("t")).alias("x")).first()
    assert sorted(r["x"]) == sorted([" ga", "gas", "as ", " gas", "gas ", " gas ", " a "])


def test_published_matrix_gives_published_metrics(spark):
    # a published holdout matrix and its metrics
    grid = [[6, 0, 0, 1, 0], [1, 7, 4, 2, 0], [0, 5, 9, 2, 0], [0, 4, 4, 13, 0], [0, 0, 1, 3, 0]]
    levels = ["I", "II", "III", "IV", "V"]
    cells = [(levels[i], levels[j], n) for i, row in enumerate(grid) for j, n in enumerate(row)]
    matrix = spark.createDataFrame(cells, "y_true string, y_pred string, n long")
    m = metrics.overall_metrics(matrix).first()
    assert [round(m[k], 4) for k in ("accuracy", "macro_precision", "macro_recall", "macro_f1_score", "weighted_f1_score")] == [
        0.5645, 0.4827, 0.5077, 0.4945, 0.5485]
    f1 = {r["label"]: r["f1_score"] for r in metrics.per_class_metrics(matrix).collect()}
    assert f1 == {"I": 0.8571, "II": 0.4667, "III": 0.5294, "IV": 0.619, "V": 0.0}


def test_split_sizes_and_folds(spark):
    sizes = {"I": 50, "II": 90, "III": 105, "IV": 140, "V": 26}
    rows = [(k, f"text {k} {i}") for k, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "severity_level string, cleaned_text string")
    done = splits.stratified_split(frame)
    assert {r[0]: r[1] for r in done.groupBy("split").count().collect()} == {"train": 287, "val": 62, "test": 62}
    assert splits.split_leakage(done).count() == 0
    folds = splits.stratified_folds(frame).groupBy("severity_level", "fold").count().collect()
    assert all(abs(r["count"] - sizes[r["severity_level"]] / 5) < 1 for r in folds)


@pytest.mark.parametrize("digits", [1, 3])
def test_split_borders_are_order_statistics(spark, digits):
    rng = random.Random(digits)
    # all of one label share their first eight digits, so that borders are refined several times
    rows = [("A", f"{rng.getrandbits(32):08x}") for _ in range(300)] + [("B", f"00ff00ff{i:08x}"[:16]) for i in range(90)]
    frame = spark.createDataFrame(rows, "label string, place string")
    wanted = {"A": [1, 45, 90, 300], "B": [13, 26], "C": []}
    borders = splits.smallest(frame, "label", "place", wanted, digits)
    assert set(borders) == {(name, k) for name, ks in wanted.items() for k in ks}
    for (name, k), border in borders.items():
        mine = sorted(p for n, p in rows if n == name)
        assert [p for p in mine if p[: len(border)] <= border] == mine[:k]


def test_splits_of_few_rows_and_many_buckets(spark):
    schema = "severity_level string, cleaned_text string"
    assert splits.stratified_split(spark.createDataFrame([], schema)).count() == 0
    one = splits.stratified_split(spark.createDataFrame([("I", "a")], schema)).collect()
    assert [r["split"] for r in one] == ["test"]
    frame = spark.createDataFrame([("I" if i % 3 else "V", f"t{i}") for i in range(200)], schema)
    ranks = {r["cleaned_text"]: r["label_rank"] for r in splits.label_rank(frame, "severity_level", "cleaned_text").collect()}
    fine = {r["cleaned_text"]: r["label_rank"] for r in splits.label_rank(frame, "severity_level", "cleaned_text", bucket_rows=1).collect()}
    assert ranks == fine and sorted(ranks.values())[-1] == 133


def test_rollup_and_dedup_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"site{i % 7}", ["leakage"] if i % 2 else [], 75 if i % 2 else 0, "V" if i % 5 == 0 else "I") for i in range(900)]
    frame = spark.createDataFrame(rows, "row_index long, location string, factors array<string>, score int, severity_level string")
    hot = location_rollup(frame).filter("location = 'hot'").first()
    assert (hot["total_reports"], hot["critical_risk_reports"], hot["severity_v"]) == (600, 300, 120)
    assert hot["top_precursors"][0]["count"] == 300
    copies = spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS cleaned_text", "CAST(id % 5 AS INT) AS severity_rank", "'s' AS source_dataset", "id AS row_index")
    kept = {r["cleaned_text"]: r for r in deduplicate(copies).collect()}
    assert kept["same"]["severity_rank"] == 4 and kept["same"]["row_index"] == 9 and len(kept) == 334


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    topics = {"I": "tidy floor signed visitor", "II": "small cut finger bandage", "IV": "gas leak flange alarm"}
    rows = [(i, lv, " ".join(rng.choices(words.split(), k=6))) for i, (lv, words) in enumerate(list(topics.items()) * 20)]
    return spark.createDataFrame(rows, "id int, severity_level string, model_text string").cache()


@pytest.mark.parametrize("name", [n for n, c in severity.CANDIDATES.items() if c.learner != "bayes"])
def test_models_learn_plain_topics(spark, labelled, tmp_path, name):
    model = severity.fit_severity(labelled, severity.CANDIDATES[name], max_iter=60)
    judged = model.predict(labelled)
    assert judged.filter("raw_level = severity_level").count() >= 57
    r = judged.first()
    assert sorted(r["class_probabilities"]) == ["I", "II", "IV"] and abs(sum(r["class_probabilities"].values()) - 1) < 0.01
    assert name.startswith("Random") or "Python" not in judged._jdf.queryExecution().toString()
    model.save(spark, str(tmp_path / "m"))
    after = severity.SeverityModel.load(spark, str(tmp_path / "m")).predict(labelled).select("id", "raw_level", "raw_confidence")
    assert judged.select("id", "raw_level", "raw_confidence").exceptAll(after).count() == 0


def test_naive_bayes_predicts_plain_topics(spark, labelled):
    judged = severity.bayes_predictions(labelled.withColumn("part", F.when(F.col("id") < 6, 0).otherwise(1)), "id")
    assert judged.join(labelled, "id").filter("raw_level = severity_level").count() == 60


def test_search_filters_and_gate(spark):
    rows = [("A1", "Rig 7", "NEW", ["Fire / Gas Hazard"], "officer "), ("A2", None, "RESOLVED", ["PPE"], None)]
    frame = spark.createDataFrame(rows, "alert_id string, location string, alert_status string, detected_precursors array<string>, role string")
    assert [r[0] for r in gov.search(frame, "GAS", ["alert_id", "location"], ["detected_precursors"]).collect()] == ["A1"]
    assert gov.where_equal(frame, alert_status=" resolved ").first()["alert_id"] == "A2"
    assert [r["accepted"] for r in gov.role_gate(frame).collect()] == [True, False]
