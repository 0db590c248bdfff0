"""Conversation repair, periodic runs and nearest neighbours against brute force, and their defined cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as contract
from hazlake.llm import neighbours, periodic, repair

SF = "/root/testdata/sf0.001"
SETS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(kinds):
    """Least (cost, letters) by trying every edit of every row, breadth first over states."""
    said = {0: (0, "")}

    def inserted(states):
        for _ in range(3):
            for state, (cost, letters) in list(states.items()):
                to, new = (3 if state == 2 else 2), (cost + 3, letters + "I")
                states[to] = min(states.get(to, new), new)
        return states

    for initial, fault in kinds:
        new = {}
        for state, (cost, letters) in inserted(said).items():
            late = 3 * (fault == "truncated")
            options = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                options.append((3 if state == 2 else 2, 3 + late, "R"))
                if state in SETS.get(initial, {}):
                    options.append((SETS[initial][state], late, "K"))
            for to, price, letter in options:
                got = (cost + price, letters + letter)
                new[to] = min(new.get(to, got), got)
        said = new
    return min(v for k, v in inserted(said).items() if k in (0, 3))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", ""]), st.sampled_from(["", "", "truncated", "blank", "duplicate"])), max_size=14))
def test_auction_finds_the_least_cheapest_edits(kinds):
    cost, letters = repair.Lattice().solve(kinds)
    assert (cost, "".join(letters)) == cheapest(kinds)


def test_every_short_conversation():
    lattice = repair.Lattice()
    symbols = list(itertools.product(["s", "u", "a", ""], ["", "truncated", "blank"]))
    for n in range(4):
        for kinds in itertools.product(symbols, repeat=n):
            cost, letters = lattice.solve(list(kinds))
            assert (cost, "".join(letters)) == cheapest(kinds)
    assert len(lattice.known) < 1000  # columns recur, so a long conversation costs a lookup a row


def test_repair_defined_cases(spark):
    long = "word " * 100_000
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 3, "user", "a\tb"), (2, 9, "tool", long),
            (None, 0, "user", " \n"), (None, 0, "assistant", "Ok!  \n"), (3, 5, "", "x."), (4, 0, "User", "x."), (5, None, "s", "é。")]
    frame = spark.createDataFrame([(*r, "c", 1, "r") for r in rows], "conv_id long, turn long, role string, text string, cost string, `a.b` int, rows string")
    got = {r["conv_id"]: r for r in repair.repair(frame).collect()}
    facts = {k: tuple(r)[1:9] for k, r in got.items()}
    assert set(facts) == {1, 2, 3, 4, 5, None} and facts[1] == (3, 0, 0, 1, 0, 1, 4, "KKD")
    said = {k: [(t["role"], t["text"]) for t in r["repaired"]] for k, r in got.items()}
    assert said[1] == [("user", "Hi."), ("assistant", "Yes.")]
    assert facts[2][:6] == (3, 5, 1, 0, 2, 2) and facts[2][6:] == cheapest([("", "blank"), ("u", "truncated"), ("", "truncated")])
    assert facts[None][:6] == (2, 0, 1, 0, 0, 0) and facts[None][6:] == cheapest([("a", ""), ("u", "blank")])
    assert facts[3][6:] == facts[4][6:] == cheapest([("", "")]) and facts[5][6:] == cheapest([("s", "truncated")])
    assert repair.repair(frame.limit(0)).collect() == []
    copies = repair.repair(frame, 0).collect()
    assert {tuple(r)[1:9] for r in copies} == {(0, 0, 0, 0, 0, 0, 0, "")} and len(copies) == 6


def test_repaired_conversations_have_the_wanted_roles(spark):
    import re

    got = repair.repair(*repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))).collect()
    for r in got:
        roles = "".join(t["role"][0] for t in r["repaired"])
        assert re.fullmatch("(s?(ua)+)?", roles)
        if r["cost"] == 0:
            assert set(r["audit"]) <= {"K"}


def brute_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(BLOCKS, min_size=1, max_size=4), st.sampled_from([2, 3, 5, 12, 16, 31]))
def test_runs_are_those_of_brute_force(texts, least):
    texts = [[w for block, n in blocks for w in block * n] for blocks in texts]
    words, text = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, end, period = periodic.find_runs(words, text, max(map(len, texts)), least)
    offset, want = 0, []
    for t in texts:
        want += [(s + offset, s + n + offset, q) for s, n, q in brute_runs(t, least)]
        offset += len(t)
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_runs_around_a_shifted_period():
    # every odd period has a run of just twice its length around the middle
    words = [0, 1] * 60 + [1, 0] * 60
    got = list(zip(*[x.tolist() for x in periodic.find_runs(np.array(words), np.zeros(240, np.int64), 240)]))
    assert [(s, e - s, q) for s, e, q in got] == brute_runs(words, 12)


def planted_words(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_periodic_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for r in contract.queries()["op12_periodic_runs"](spark, SF).collect():
        words = planted_words(r["doc_id"], [w.decode() for w in (texts.pop(r["doc_id"]) or "").encode().split()])
        if len(words) > 3000:
            continue
        runs = brute_runs(words, 12)
        planted += bool(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert not texts and planted > 5


def test_periodic_defined_cases(spark):
    rows = [(None, "a b " * 6), (1, None), (1, ""), (2, " \t\n"), (3, "x"), (3, "x"), (4, "x y z " * 150_000), (5, "a b " * 12), (6, "é è\n" * 8)]
    frame = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id long, text string, runs string, `a.b` int")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.runs(frame).collect()), key=str)
    assert got == sorted([
        (None, 12, [(0, 12, 2)], "a b"), (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 1, [], "x"), (3, 1, [], "x"),
        (4, 450_000, [(0, 450_000, 3)], "x y z"), (5, 12, [(0, 12, 1)], "a b"), (6, 16, [(0, 16, 2)], "é è")], key=str)
    assert periodic.report(frame.limit(0)).count() == 0 and periodic.report(frame).count() == 9


def exact(rows, asks, k=10):
    out = []
    for i, (q, v) in enumerate(rows):
        if asks(q):
            near = sorted((float(np.linalg.norm(np.float64(v) - np.float64(w))), o, j) for j, (o, w) in enumerate(rows) if j != i and len(w) == len(v))
            out += [(q, r + 1, o, round(d, 9)) for r, (d, o, _) in enumerate(near[:k])]
    return sorted(out)


def test_neighbours_defined_cases(spark):
    rng = random.Random(6)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    same, two = np.float32(vector(9)).tolist(), np.float32(vector(2)).tolist()
    rows = [(i, same) for i in range(0, 3000, 25)] + [(100, same), (100, same)] + [(i, np.float32(vector(9)).tolist()) for i in range(1, 40)]
    rows += [(200, two), (7, two), (8, [0.0, 1.0])]
    odd = [(300, None), (300, []), (300, [0.0] * 9), (300, [None] + [1.0] * 8), (300, [float("nan")] * 9), (300, [float("inf")] * 9), (None, same)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows + odd], "vec_id long, embedding array<float>, point int, `a.b` string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.report(frame).collect())
    assert got == exact(rows, lambda q: q % 100 == 0)
    assert neighbours.report(frame.limit(0)).count() == 0


def test_neighbours_recall_over_many_lists_and_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 100)
    monkeypatch.setattr(neighbours, "ASKED", 7)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = exact(rows, lambda q: q % 100 == 0)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.neighbours(table, table["vec_id"] % 100 == 0, per_list=100).collect())
    assert len(got) == len(want) and len({g[:2] for g in got}) == len(got)
    hit = len({g[::2] for g in [(q, 0, v) for q, _, v, _ in got]} & {(q, v) for q, _, v, _ in want})
    assert hit >= 0.97 * len(want)


def test_error_bounds_hold():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(3000, 48)).astype(np.float32)
    index = neighbours.Index(points, 3000, 10**9)
    codes, length, fit = index.encode(points, np.zeros(3000, int))
    low, high = neighbours.estimated(index, points[:50], codes, length, fit, 0)
    true = neighbours._squares(points[:50], points)
    assert codes.shape == (3000, 6) and ((low <= true) & (true <= high)).mean() > 0.93


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_periodic_runs", "op13_neighbours"])
def test_registered(name):
    assert name in contract.queries()
