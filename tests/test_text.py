"""Text steps that every report goes through."""

import re
import unicodedata

from pyspark.sql import functions as F

import __spark_entry__ as contract
from hazlake.functions.text import clean, sentences, shadow
from hazlake.operators.detect import rule_gate, sentence_gate, start_gate, with_sentences


def test_decomposition_is_nfkd(spark):
    known = [chr(c) for c in range(0xA1, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Zs", "Zl", "Zp")]
    texts = [f"a{c}̖́b" for c in known] + [None, "", "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["c"] for r in rows.select("id", clean(F.col("t")).alias("c")).collect()}
    want = {i: unicodedata.normalize("NFKD", t or "") for i, t in enumerate(texts)}
    # a decomposition may begin or end with a blank, which is squeezed like any other
    assert all(got[i] == re.sub(r"\s{2,}", " ", want[i]) for i in want)


def test_decomposition_keeps_what_is_around_a_run(spark):
    texts = ["\u00e9", "\u00e9a", "a\u00e9", "\u00e9 \u0301\u0316 x \ufb01", "\u4e2d\u6587 a \u2460\x01b\u00e9", "a\u0301\u0316b", "x\x01y", "\u1e9b\u0323"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["c"] for r in rows.select("t", clean(F.col("t")).alias("c")).collect()}
    assert all(got[t] == unicodedata.normalize("NFKD", t) for t in texts)


def test_reports_are_decomposed_once(spark):
    found = contract.queries()["report_sentences"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_sentences_are_made_once(spark):
    rows = spark.range(3).selectExpr("id", "concat('Gas leak. Pump ', id, ' runs') AS cleaned_text")
    long = with_sentences(rows).select("id", F.explode("sentences").alias("s"))
    assert long._jdf.queryExecution().optimizedPlan().toString().count("[.\\n;!?]+") == 1
    assert long.count() == 6


def test_sentence_gate_is_both_gates(spark):
    words = sorted({w for w in re.findall(r"[a-z0-9]{2,}", start_gate() + rule_gate())})
    texts = [f"{a}{sep}{b} x" for k, a in enumerate(words) for sep, b in ((" ", words[(7 * k + 3) % len(words)]), ("", "s"), ("-", "5 bar"), ("_", a))]
    rows = spark.createDataFrame([(t,) for t in texts] + [("Ülgas leak, 20 ppm",), ("über gas",)], "t string")
    s = rows.select(F.explode(sentences(shadow(F.col("t")))).alias("s"))
    both = F.col("s").rlike(start_gate()) & F.col("s").rlike(rule_gate())
    assert s.filter(both).count() > 50
    assert s.filter(both != F.col("s").rlike(sentence_gate())).count() == 0
