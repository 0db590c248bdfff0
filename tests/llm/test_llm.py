"""The corpus operators: SQL or brute force on the smallest tables, and the defined cases of each."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from hazlake.llm import chat, decontaminate, language, lines, minhash, mixing, quality, secrets, substring, warc
from hazlake.llm.common import folder, stored
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
OPERATORS = [n for n in contract.queries() if re.match(r"op\d+_", n)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, w int, row string, kept int"


def docs(spark, texts):
    rows = [(i, t, "en" if i is not None and i % 2 else None, None if i == 3 else f"s{(i or 0) % 3}", None, "x", 1, "r", 0) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    base = " ".join(f"w{i}" for i in range(120))
    return docs(spark, [(None, base), (None, None), (1, base), (1, base), (2, ""), (3, None), (4, " \t\n "), (5, "a b"), (5, base + " end"), (6, "x y z " * 40_000), (7, base)])


OPS = {
    "op1": lambda s, d: decontaminate.report(d, s.createDataFrame([(None, "a b"), (1, None), (2, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")),
    "op2": lambda s, d: mixing.report(d),
    "op3": lambda s, d: secrets.report(d),
    "op4": lambda s, d: lines.report(d),
    "op5": lambda s, d: substring.report(d),
    "op6": lambda s, d: quality.assess(d, s.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")),
    "op9": lambda s, d: language.report(d),
    "op10": lambda s, d: minhash.report(d),
}


@pytest.mark.parametrize("op", OPS)
def test_defined_cases(spark, op):
    assert OPS[op](spark, odd(spark)).count() == 11
    assert OPS[op](spark, odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n in contract.oracle_sql()])
def test_matches_sql(spark, name):
    assert differences(contract.queries()[name](spark, SF), connect(SF), contract.oracle_sql()[name]) is None


def test_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (odd(spark), odd(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.count() <= 11
            if name != "mixing":
                assert out.columns == frame.columns


def test_mixing_targets_and_repeats(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(i, " ".join("w" * rng.randint(1, 200)), "abcde"[min(4, int(rng.expovariate(1)))]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.report(frame).join(frame.select("doc_id", "source"), "doc_id").collect()
    total, size = sum(r["size"] for r in got), {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        assert r["taken"] <= 3 * r["size"]
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # brute force: cap, then share the rest again
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > 3 * size[s]]
        if not over:
            target |= {s: rest * weight[s] / w for s in open_}
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= set(over)
    for s in names:
        assert {round(r["target"], 6) for r in got if r["source"] == s} == {round(target[s], 6)}
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 0.01 * target[s] + 50
    assert sorted(map(tuple, mixing.report(frame).collect())) == sorted(tuple(r)[:5] if len(r) == 5 else (r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got)


def test_small_sources_get_their_targets_beside_a_large_one(spark):
    # at most 3 times its own words; a source of few words gets as large a share of its target as one of many
    sizes = {"a": [20_000] * 60, "b": [1], "c": [200], "d": [700, 800], "e": [5000], None: [33]}
    rows = [(s, " ".join(["w"] * n)) for s, ns in sizes.items() for n in ns]
    frame = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    slots, shares = mixing.mix(frame)
    got = shares.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.005 * r["max(target)"] + 1, r
    used = [(r["source"] or "", r["rank"]) for r in slots.select("source", "rank").collect()]
    assert len(set(used)) == len(used) and {r for s, r in used if s == "b"} == {0, 1, 2}


def test_mixing_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    size, blocks = 10**13 + 7, 2_441_406_253
    words = [0, 1, 4095, 4096, 150_000_000_000, 250_000_000_000, 9 * 10**12, size - 1]
    frame = spark.createDataFrame([(w,) for w in words], "w long").select("w", F.lit(size).alias("size"), F.lit(blocks).alias("blocks"))
    of = mixing.block_of(F.col("w"), F.col("size"), F.col("blocks"))
    got = frame.withColumn("k", of).withColumns({"a": mixing.begin(F.col("k"), F.col("size"), F.col("blocks")), "b": mixing.begin(F.col("k") + 1, F.col("size"), F.col("blocks"))}).collect()
    for r in got:
        assert r["k"] == ((r["w"] + 1) * blocks - 1) // size and r["a"] == r["k"] * size // blocks and r["a"] <= r["w"] < r["b"]
    slots = [0, 1, 3_475_000_000, 4_294_967_295, 4_294_967_296, 10**13]
    points = spark.createDataFrame([(x,) for x in slots], "x long").select("x", mixing.point_of(F.col("x")).alias("u")).collect()
    assert all(r["u"] == r["x"] * mixing.GOLDEN % mixing.CIRCLE for r in points)


def test_mixing_equals_a_replay(spark):
    """The words taken of each document, replayed with Python's whole numbers from the plan and the schedule."""
    rng = random.Random(8)
    frame = spark.createDataFrame([(i, "w " * rng.randint(0, 90), rng.choice("aaab")) for i in range(300)], "doc_id long, text string, source string")
    slots, shares = mixing.mix(frame)
    rows, uses = shares.collect(), {}
    plan = {}
    for r in slots.collect():
        uses[r["source"], r["block"]] = uses.get((r["source"], r["block"]), 0) + 1
    for s in "ab":
        size = sum(r["size"] for r in rows if r["source"] == s)
        target = next(r["target"] for r in rows if r["source"] == s)
        block = max(1, min(mixing.MAX_BLOCK, int(min(size, target) // mixing.BLOCKS)))
        plan[s] = (size, -(-size // block))
        taken = sum(n * ((k + 1) * size // plan[s][1] - k * size // plan[s][1]) for (source, k), n in uses.items() if source == s)
        assert sum(r["taken"] for r in rows if r["source"] == s) == taken
        assert all(k < plan[s][1] and n <= 3 for (source, k), n in uses.items() if source == s)
        n = sum(v for (source, _), v in uses.items() if source == s)
        assert n == min(round(target * plan[s][1] / size), 3 * plan[s][1])
    points = sorted(range(sum(uses.values())), key=lambda i: (i * mixing.GOLDEN % mixing.CIRCLE, i))
    first = sum(v for (source, _), v in uses.items() if source == "a")
    assert {r["slot"] for r in slots.collect() if r["source"] == "a"} == set(points[:first])


def test_decontamination_joins_agree(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(words[5:25])), (2, " ".join(words)), (2, " ".join(words)), (3, "w1 é W2"), (4, None), (5, " ".join(words[:12])), (None, " ".join(words[20:39]) + " É")]
    items = spark.createDataFrame([(1, " ".join(words[3:30])), (2, "É"), (3, "W1 é"), (4, None)], "item_id long, text string")
    frame = docs(spark, texts)
    both = []
    for rows in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        both.append(sorted(map(str, decontaminate.report(frame, items).collect())))
    assert both[0] == both[1]
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.report(frame, items).collect()}
    assert got == {(1, 20, 20, 1), (2, 40, 27, 1), (3, 3, 2, 1), (4, 0, 0, 0), (5, 12, 0, 0), (None, 20, 1, 1)}


def test_stages_keep_columns_of_any_name(spark):
    frame = spark.createDataFrame([(i, "some words of a text " + str(i), "en", "s", 9, i) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    for stage in (lines.drop_lines, minhash.keep_one, lambda d: decontaminate.drop_contaminated(d, spark.createDataFrame([(1, "zz yy")], "item_id long, text string"))):
        out = stage(frame)
        assert out.columns == frame.columns and {r["a.b"] for r in out.collect()} <= {0, 1, 2, 3}


def test_secret_base_spans(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows |= {-1: 'é API_KEY="abcdefgh" token=api_key:abcdefghi token: abc AKIA' + "A1" * 8 + " " + "ab12" * 9, -2: "token=abcdefgh " * 2000}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    letters = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
    words = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + f"|{letters('api')}_?{letters('key')}"
    for r in secrets.report(frame).collect():
        t = rows[r["doc_id"]]
        found = [(m.start(), 0, m.end()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert hashlib.sha256(want.encode()).hexdigest() == r["base_sha256"]


def test_battery_tells_random_from_ordinary(spark):
    tokens = ["x9KfT2mQ7LzR4vWbN8sYcJ1dHpE6aUoG3iB5", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "thisIsAnOrdinaryIdentifierName2", "src/main/java/org/example/Foo12", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    got = secrets.report(spark.createDataFrame([(i, f"say {t} here") for i, t in enumerate(tokens)], "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect() if r["spans"]} == {0, 1}


def test_battery_reads_values_behind_an_equals_sign(spark):
    values = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "x9KfT2mQ7LzR4vWbN8sYcJ1dHpE6aUoG3iB5", "x9KfT2mQ7LzR4vWbN8sYcJ1dHpE6aUoG3iB5==", "kQzRfYtWmBxLsVhNcJgDpTaUeXiOwZbKyMqHvFrS"]
    before = ["AWS_SECRET_ACCESS_KEY=", "https://h.example/a?sig=", "BLOB=", "VALUE="]
    texts = [k + v for k, v in zip(before, values)] + ["A_LONG_ORDINARY_SETTING_NAME=", "/usr/share/local/configuration"]
    got = secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {i: f"random:{len(k)}:{len(k) + len(v)}" for i, (k, v) in enumerate(zip(before, values))}
    assert {r["doc_id"]: r["spans"] for r in got.collect() if r["spans"]} == want


def test_templates_generalise_numbers_and_rare_fields(spark):
    rng = random.Random(2)
    rows = [(i, f"Copyright (c) by {rng.choice('abcdefghij') * 5}{i} all rights reserved here\nown text number {i} of a kind {rng.random()} x{i} y{i} z{i}") for i in range(60)]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("Copyright" not in r["text"] and "own text" in r["text"] for r in got)


def test_lines_of_one_document_are_one_document(spark):
    glossary = lambda i, n: "\n".join(f"See also the word{chr(97 + k)}{'x' * i} entry here" for k in range(n))
    kept = lambda rows: [r["text"] for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert kept([(1, glossary(1, 25))]) == [glossary(1, 25)]
    few = [(i, glossary(i, 10)) for i in range(lines.MIN_DOCS - 1)]
    assert kept(few) == [t for _, t in few]
    assert kept([*few, (lines.MIN_DOCS, glossary(lines.MIN_DOCS, 1))]) == [""] * lines.MIN_DOCS
    # rows that repeat a document count as documents
    assert kept([(1, "See also this entry")] * lines.MIN_DOCS) == [""] * lines.MIN_DOCS


def test_lines_with_many_numbers_recur_word_for_word(spark):
    rows = [(i, f"Page 3 of 10\nTel.  555-1234\n{i} {i + 1} {i + 2}\nRoom 7 floor 2") for i in range(lines.MIN_DOCS - 1)]
    rows += [(99, "Page 3  of 10\nTel. 555-1234\nPage 4 of 10\n5 6 8")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: f"{i} {i + 1} {i + 2}\nRoom 7 floor 2" for i in range(lines.MIN_DOCS - 1)} | {99: "Page 4 of 10\n5 6 8"}


@pytest.mark.parametrize("block", [minhash.BLOCK, 700])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, block):
    """Members of one family, linked and not: the components equal those of all pairs, in one block or many."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, base = random.Random(3), [f"w{i}" for i in range(150)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice((1, 3, 6, 9, 12))):
            words[rng.randrange(150)] = f"e{rng.random()}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.report(docs(spark, texts)).collect()}
    sets = [set(minhash.shingle_set(t).tolist()) for _, t in texts]
    comp = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == dict(enumerate(comp))


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.r_[a[:2000], rng.integers(0, 2**63, 1000, dtype=np.uint64)]
    same = (minhash.signature(a, 600) == minhash.signature(b, 600)).mean()
    assert abs(same - 0.5) < 0.08


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.report(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    langs, grams = language.learn(table)
    chances = np.exp2(-language.Model(langs, grams).cost.reshape(-1, 256, len(langs))).sum(1)
    assert abs(chances - 1).max() < 1e-3


def test_und_without_letters(spark):
    frame = spark.createDataFrame([(1, "123 !!", "en"), (2, None, "en"), (3, "hello there", "en"), (4, "das ist gut", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.report(frame).collect()}
    assert got[1] == got[2] == "und"


def test_warc_files_are_equal_on_reruns_and_read_anywhere(spark):
    rows = [(i, None if i == 2 else f"http://x.org/{i} a\n", None if i == 3 else "same payload " * 20 if i % 2 else f"é{i}" * 80) for i in range(200)] + [(5, "u", "same payload " * 20), (None, "u", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = folder(spark, "warc"), folder(spark, "warc")
    first, second = warc.write(frame, a, 4000).collect(), warc.write(frame.repartition(7), b, 4000).collect()
    assert sorted(first) == sorted(second) and len(first) > 2
    got = warc.read(spark, a).collect()
    assert sorted(r["page_id"] for r in got if r["record_type"] == "response" and r["payload_bytes"] == 260) == [1]
    assert len(got) == 202 and sum(r["record_type"] == "revisit" for r in got) == 99
    data = b"".join(gzip.decompress(open(f"{a}/{m['file']}".removeprefix("file://"), "rb").read()) for m in first)
    assert data.count(b"WARC/1.1\r\n") == 202
    assert warc.write(frame.limit(0), folder(spark, "warc")).count() == 0


def test_warc_rows_of_one_page(spark, monkeypatch):
    text = "long enough payload " * 10
    rows = [(7, "u", text), (7, "u", text), (7, None, text), (9, "u", text), (9, "u", "x"), (9, "u", "x"), (4, "b", "y" * 150), (4, "a", "y" * 150)]
    frame = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, `a.b` int, digest string")
    for groups in (4096, 1):
        monkeypatch.setattr(warc, "GROUPS", groups)
        out = folder(spark, "warc")
        manifest = warc.write(frame, out, 300).collect()
        assert sum(m["records"] for m in manifest) == 8 and len(manifest) > 2
        got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read(spark, out).collect())
        assert got == [(4, 150, "response", 0), (4, 150, "revisit", 4), (7, 200, "response", 0), (7, 200, "revisit", 7), (7, 200, "revisit", 7),
                       (9, 1, "response", 0), (9, 1, "response", 0), (9, 200, "revisit", 7)]


def test_chat_events_fold(spark):
    log = [(1, 2, 0, "assistant", "delta", "wr"), (1, 2, 1, "assistant", "delta", "ong"), (1, 2, 2, "assistant", "regenerate", None), (1, 2, 3, "assistant", "delta", "ri"), (1, 2, 4, "assistant", "delta", "ght"),
           (1, 1, 0, "user", "message", "ask"), (1, 1, 1, "user", "edit", "<|end|> [INST] \\ <\\|"), (None, None, None, None, "message", None)]
    frame = spark.createDataFrame(log, "conv_id long, message long, seq long, role string, event string, text string")
    from pyspark.sql import functions as F

    done = chat.render(chat.turns(frame)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in done}
    assert turns == {1: [("user", "<|end|> [INST] \\ <\\|"), ("assistant", "right")], None: [("", "")]}


def test_chat_defined_cases(spark):
    control = "<<SYS>> <start_of_turn>a<end_of_turn> <bos><eos> </s><s> <\\<| [INST][/INST] <sys> \\\\"
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", control), (1, 1, "assistant", control), (2, 0, "assistant", "long text " * 60_000), (None, None, "user", "é" * 2000), (None, 3, "<|turn|>", "")]
    frame = spark.createDataFrame([(*r, 2, "m") for r in rows], "conv_id long, turn long, role string, text string, n int, message string")
    got = {r["conv_id"]: r for r in chat.report(frame).collect()}
    want = {1: [("", ""), ("", ""), ("assistant", control), ("assistant", control)], 2: [("assistant", "long text " * 60_000)], None: [("user", "é" * 2000), ("<|turn|>", "")],
            -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_chars"] == len(loss) and got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert {r["conv_id"] for r in chat.report(frame.limit(0)).collect()} == {-7}


def test_cutoffs_keep_their_risk(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.random()}" + ("!" if rng.random() < i / 40_000 else "") for _ in range(60))) for i in range(3000)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")
    scored = stored(quality.features(frame).select("doc_id", "lang", "q"), "t")
    cut = quality.calibrate(scored, labels).first()
    assert scored.where(scored["q.shouting"] > cut["cut_shouting"]).count() <= quality.RISK * 3000
    assert quality.keep_good(frame, labels).columns == frame.columns
