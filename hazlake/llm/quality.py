"""Quality rules with risk-controlled cutoffs.

Each rule is a score per document, higher is worse. A labelled holdout of good documents decides how strict a rule
may be in a stratum: cutoffs are tried from loose to strict, and one is accepted while the exact binomial tail shows
that the share of good documents above it is below ``risk`` (the Clopper-Pearson upper bound). The sequence stops at
the first failure, so only strata x rules need a correction for multiple testing (Bonferroni).

Defined cases: null text has no words (base rule fails); null language is a stratum of its own; label rows without a
quality are ignored, repeated label rows count each; repeated documents count each; without labels no cutoff is
accepted and only the base rule decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.mapping import once
from hazlake.llm.common import GAP, free_name, let, stored, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Cutoffs of each rule from loose to strict.
RULES = {
    "symbols": (2.0, 1.0, 0.5, 0.25, 0.1),
    "shouting": (1.5, 1.0, 0.5, 0.25, 0.1),
    "repetition": (0.45, 0.4, 0.3, 0.2, 0.1),
    "repeated_lines": (0.8, 0.6, 0.5, 0.4, 0.3),
}
#: Largest share of good documents that one rule may reject in a stratum, and the chance that any rule exceeds it.
RISK, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT = 50, 50


#: Up to so many different repeated windows are looked up one by one; beyond that windows are sorted with their places.
FEW = 64


def _covered(places: Column, n: Column) -> Column:
    after = F.concat(F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.array(n))
    steps = F.zip_with(places, after, lambda a, b: F.least(b - a, F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def _repeated_places(hashes: Column) -> Column:
    """Places of windows that occur more than once, by sorting windows with their places."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def marked(k: Column) -> Column:
        # each window beside its neighbours; the two ends are paired, too, and differ by place if there are two
        size = F.size(k)
        pair = lambda a, b: F.when((a["h"] == b["h"]) & (a["p"] != b["p"]), a["p"])
        left = F.zip_with(k, F.concat(F.slice(k, -1, 1), F.slice(k, F.lit(1), size - 1)), pair)
        right = F.zip_with(k, F.concat(F.slice(k, F.lit(2), size - 1), F.slice(k, 1, 1)), pair)
        return F.sort_array(F.filter(F.zip_with(left, right, lambda a, b: F.coalesce(a, b)), lambda p: p.isNotNull()))

    return let(keyed, marked)


def features(docs: DataFrame, name: str = "q") -> DataFrame:
    """Adds one struct column ``name`` with the base figures and the rules' scores."""
    text = text_of(F.col("text").cast("string"))
    w, l, h, d, a = (free_name(docs, x) for x in ("words", "lines", "windows", "repeats", "base"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumns({w: words_of(text), l: lines})
    n = F.size(w)
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    one = one.withColumn(h, windows)
    twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, F.greatest(i - 1, F.lit(0)))))))
    one = one.withColumn(d, F.when(F.size(F.array_distinct(h)) < F.size(h), twice))
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda p: p.isNotNull())
    repeats = (F.when(F.col(d).isNull(), F.lit(0))
               .when(F.size(d) <= FEW, let(few, lambda p: _covered(p, n)))
               .otherwise(let(_repeated_places(F.col(h)), lambda p: _covered(p, n))))
    base = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
        repeats.cast("bigint").alias("n_repeat_words"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_shouts"),
        F.size(l).cast("bigint").alias("n_lines"),
    )
    b = F.col(a)
    share = lambda x, y: F.when(b[y] > 0, b[x] / b[y]).otherwise(F.lit(0.0))
    full = F.struct(
        *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT * b["n_words"])).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols"), share("n_shouts", "n_words").alias("shouting"),
        share("n_repeat_words", "n_words").alias("repetition"), share("n_dup_lines", "n_lines").alias("repeated_lines"),
    )
    return once(one, **{a: base}).withColumn(name, full).drop(w, l, h, d, a)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for n draws at the rate, summed in logarithms; 1 where k is at or above the expected count."""
    odds = math.log(rate / (1 - rate))
    start = n * math.log1p(-rate)
    add = lambda x, y: F.greatest(x, y) + F.log1p(F.exp(F.least(x, y) - F.greatest(x, y)))

    def step(acc: Column, j: Column) -> Column:
        term = acc["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("t"), add(acc["s"], term).alias("s"))

    folded = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), F.struct(start.alias("t"), start.alias("s")), step, lambda a: F.exp(a["s"]))
    return F.when(n == 0, F.lit(1.0)).when(k == 0, F.exp(start)).when(k >= n * rate, F.lit(1.0)).otherwise(folded)


def calibrate(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(lang, cutoffs map rule -> strictest safe cutoff) from documents with features in ``q`` and (doc_id, quality)."""
    good = labels.where(F.col("quality") == 1).select("doc_id")
    held = scored.select("doc_id", "lang", "q").where(~F.col("q.base_failed")).join(good, "doc_id")
    # how many of a rule's cutoffs a document exceeds: the cutoffs rise as they loosen
    depth = lambda rule: reduce(lambda x, y: x + y, [(F.col(f"q.{rule}") > c).cast("int") for c in RULES[rule]])
    rows = held.select("lang", F.explode(F.map_from_arrays(
        F.array(*map(F.lit, RULES)), F.array(*map(depth, RULES)))).alias("rule", "depth"))
    counts = stored(rows.groupBy("lang", "rule", "depth").agg(F.count("*").alias("n")), "quality-counts")
    strata = counts.select("lang").distinct().count()
    level = delta / max(1, strata * len(RULES))
    size = len(next(iter(RULES.values())))
    # cutoff i (loosest 0) rejects documents that exceed more than size - 1 - i cutoffs
    tried = counts.groupBy("lang", "rule").agg(F.sum("n").alias("n"), *[
        F.sum(F.when(F.col("depth") > size - 1 - i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(size)])
    passes = [binomial_tail(F.col(f"k{i}"), F.col("n"), risk) <= level for i in range(size)]
    chosen = F.lit(None).cast("double")
    for i in reversed(range(size)):
        values = F.element_at(F.create_map(*[x for r, c in RULES.items() for x in (F.lit(r), F.lit(c[i]))]), F.col("rule"))
        chosen = F.when(passes[i], F.coalesce(chosen, values))
    safe = tried.select("lang", "rule", chosen.alias("cutoff")).where(F.col("cutoff").isNotNull())
    return safe.groupBy("lang").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(scored: DataFrame, cutoffs: DataFrame, name: str = "q", kept: str = "kept") -> DataFrame:
    """Adds ``kept``: the base rule holds and no score exceeds its stratum's cutoff."""
    c = cutoffs.select(F.col("lang").alias("_stratum"), *[F.col(f"cut_{r}").alias(f"_cut_{r}") for r in RULES])
    both = scored.join(c, scored["lang"].eqNullSafe(c["_stratum"]), "left")
    over = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"{name}.{r}") > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES])
    return both.withColumn(kept, ~F.col(f"{name}.base_failed") & ~over).drop("_stratum", *[f"_cut_{r}" for r in RULES])


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row of documents: doc_id, lang, the base figures, the scores and the verdict."""
    scored = stored(features(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "q"), "quality")
    cutoffs = stored(calibrate(scored, labels, risk, delta), "quality-cutoffs")
    return judge(scored, cutoffs).select("doc_id", "lang", "q.*", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of documents that pass, with all their columns. Scores are computed twice rather than moving texts."""
    base = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text")
    cutoffs = stored(calibrate(features(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "q"), labels, risk, delta), "quality-cutoffs")
    return judge(features(base).select("row", "lang", "q"), cutoffs).where("kept").select("row.*")
