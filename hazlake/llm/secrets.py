"""Secret scan: fixed patterns, and a randomness test battery over the remaining tokens.

Base spans come from three patterns. The battery looks at every other run of 20 or more encoding characters with a
letter, also right behind an equals sign; equals signs at its end are padding unless such characters follow. Its
encoding (hex, base32, base64) is inferred from the characters, which are mapped to their alphabet's values:

* chi-squared of the alphabet's counts against uniformity,
* a runs test of values above and below the alphabet's middle,
* the lag-1 serial correlation.

A token stays a candidate while no test rejects randomness (Bonferroni over the three). Its p-value is the chance that
ordinary text of the same length and alphabet, whose symbols repeat as often as in natural language (index of
coincidence), would come as close to uniformity: a non-central chi-squared tail, so a short token needs to be closer than
a long one. Candidates are accepted by Benjamini-Hochberg within classes of length and of tokens with and without a digit
over all documents, on a fine grid of p-values; words and identifiers thus raise no limit for tokens with digits.

Defined cases: null text is empty; positions are code points of the whole text, ends exclusive; battery tokens that
touch a base span are left to it; rows are judged one by one, so repeated rows and rows without an id get their own
results; without tokens nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from hazlake.functions.mapping import once
from hazlake.llm.common import let, stored

#: Fixed patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
KINDS = (*BASE, "random")
#: The letter spares rules and tables; a run of encoding characters has one but for a chance the battery would not accept.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Chance that two symbols of ordinary text agree; the share of false discoveries; the level of the battery.
COINCIDENCE, RATE, LEVEL = {"hex": 0.1, "base32": 0.066, "base64": 0.066}, 0.01, 0.001
LENGTHS = (32, 48, 64, 128)
GRID = 20  # steps of the p-value grid per factor of ten
CHUNK = 256


def running(lengths: Column) -> Column:
    """Sums before each entry, in chunks, so that a long list costs little more than its length."""
    fold = lambda a, start: F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    chunks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK)), lambda i: F.slice(lengths, i, CHUNK))
    return let(chunks, lambda c: let(fold(F.transform(c, total), F.lit(0)), lambda starts: F.flatten(
        F.zip_with(c, F.slice(starts, F.lit(1), F.size(c)), lambda part, s: F.slice(fold(part, s), F.lit(1), F.size(part))))))


def spans(text: Column, pattern: str, keep) -> Column:
    """Leftmost matches that do not overlap, as (a, b, body): the text is split around them and lengths are added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.flatten(F.zip_with(gaps, m, lambda g, x: F.array(F.length(g), F.coalesce(F.length(x), F.lit(0)))))
        return let(running(steps), lambda s: F.filter(F.transform(m, lambda x, i: F.struct(
            F.get(s, 2 * i + 1).alias("a"), (F.get(s, 2 * i + 1) + F.length(x)).alias("b"), x.alias("body"))), keep))

    none = F.from_json(F.lit("[]"), "array<struct<a:int,b:int,body:string>>")
    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    value = lambda x: F.length(F.regexp_extract(x["body"], BASE["assign"], 2)) >= 8
    all_of = lambda x: F.lit(True)

    def of(i: int, k: str) -> Column:
        found = spans(text, BASE[k], value if k == "assign" else all_of)
        return F.transform(found, lambda x: F.struct(x["a"].alias("a"), F.lit(i).alias("kind"), x["b"].alias("b")))

    kinds = [of(i, k) for i, k in enumerate(BASE)]
    return F.array_sort(F.concat(*kinds))


def _normal_tail(z: Column) -> Column:
    """P(Z < -|z|) for a standard normal, relative error below 1e-7 (rational approximation of the scaled tail)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.5 * x)
    poly = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    acc = F.lit(0.0)
    for c in reversed(poly):
        acc = acc * t + c
    return 0.5 * t * F.exp(-x * x + acc)


def encoding(body: Column) -> Column:
    plain = F.regexp_replace(body, "=+$", "")
    return F.when(F.lower(plain).rlike("^[0-9a-f]+$") & ((F.lower(plain) == plain) | (F.upper(plain) == plain)), "hex").when(
        plain.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def _values(body: Column, kind: str) -> Column:
    plain = F.translate(F.regexp_replace(F.lower(body) if kind == "hex" else body, "=+$", ""), "-_", "+/")
    symbols = F.array(*map(F.lit, ALPHABETS[kind]))
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: (F.array_position(symbols, c) - 1).cast("double"))


def p_value(body: Column) -> Column:
    kind = encoding(body)
    values = F.when(kind == "hex", _values(body, "hex")).when(kind == "base32", _values(body, "base32")).otherwise(_values(body, "base64"))
    size = F.when(kind == "hex", 16.0).when(kind == "base32", 32.0).otherwise(64.0)
    chance = F.when(kind == "hex", COINCIDENCE["hex"]).when(kind == "base32", COINCIDENCE["base32"]).otherwise(COINCIDENCE["base64"])

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        add = lambda a, x: a + x
        sum_of = lambda a: F.aggregate(a, F.lit(0.0), add)
        ordered = F.sort_array(v)
        # squares of the counts: each symbol adds twice the number of equal ones before it, plus one
        counts = F.aggregate(ordered, F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq")), lambda a, x: let(
            F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1.0)), lambda r: F.struct(x.alias("last"), r.alias("run"), (a["sq"] + 2 * r - 1).alias("sq"))), lambda a: a["sq"])
        chi = counts * size / n - n
        shifted = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        before = F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))
        high = sum_of(F.transform(v, lambda x: F.when(x >= size / 2, 1.0).otherwise(0.0)))
        runs = 1 + sum_of(F.zip_with(before, shifted, lambda a, b: F.when((a >= size / 2) != (b >= size / 2), 1.0).otherwise(0.0)))
        mean_runs = 1 + 2 * high * (n - high) / n
        spread = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
        mid = (size - 1) / 2
        lag = sum_of(F.zip_with(before, shifted, lambda a, b: (a - mid) * (b - mid))) / ((size * size - 1) / 12) / F.sqrt(n - 1)
        df = size - 1
        uniform = (chi - df) / F.sqrt(2 * df)
        reject = lambda z: 2 * _normal_tail(z) < LEVEL / 3
        random = ~reject(uniform) & ~reject((runs - mean_runs) / spread) & ~reject(lag)
        more = n * (size * chance - 1)
        z = (chi - df - more) / F.sqrt(2 * (df + 2 * more))
        return F.when(random & (z < 0), _normal_tail(z))

    return let(values, tests)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row of documents: doc_id, base and all: arrays of (a, kind, b), kind by place in ``KINDS``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = once(docs.select("doc_id", text.alias("text")), base=base_spans(F.col("text")), tokens=spans(F.col("text"), TOKEN, lambda x: F.lit(True)))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda s: (s["a"] < t["b"]) & (t["a"] < s["b"])))
    tested = F.transform(free, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), p_value(t["body"]).alias("p"), t["body"].rlike("[0-9]").alias("digit")))
    found = stored(once(rows.select("doc_id", "base", "tokens"), tested=tested).select("doc_id", "base", "tested"), "secrets")
    group = lambda t: sum(((t["b"] - t["a"] >= x).cast("int") for x in LENGTHS), F.lit(0)) + F.when(t["digit"], len(LENGTHS) + 1).otherwise(0)
    step = lambda p: F.when(p.isNotNull(), F.ceil(F.log10(F.greatest(p, F.lit(1e-300))) * GRID))
    tokens = found.select(F.explode("tested").alias("t")).select(group(F.col("t")).alias("group"), step(F.col("t.p")).alias("step"))
    counts = tokens.groupBy("group", "step").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group").orderBy(F.col("step").asc_nulls_last())
    ranks = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("group"))})
    good = ranks.where(F.col("step").isNotNull() & (F.col("all") * F.pow(F.lit(10.0), F.col("step") / GRID) <= rate * F.col("upto")))
    limits = {r["group"]: r["step"] for r in good.groupBy("group").agg(F.max("step").alias("step")).collect()}
    limit = lambda t: F.element_at(F.array(*[F.lit(limits.get(g)).cast("bigint") for g in range(2 * (len(LENGTHS) + 1))]), group(t) + 1)
    taken = F.filter("tested", lambda t: F.coalesce(step(t["p"]) <= limit(t), F.lit(False)))
    extra = F.transform(taken, lambda t: F.struct(t["a"].alias("a"), F.lit(len(BASE)).alias("kind"), t["b"].alias("b")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("all"))


def listed(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["a"], s["b"])), ",")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
