"""Alignment of a report with the prototype text of every precursor.

Prototype weights are fixed by the taxonomy and small, so they live in the plan as a constant and
each report is scored inside its row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F

from hazlake.functions.mapping import constant, once
from hazlake.functions.numbers import round_even
from hazlake.functions.stopwords import ENGLISH
from hazlake.functions.taxonomy import TAXONOMY, Precursor
from hazlake.operators.tfidf import with_terms


@lru_cache(maxsize=8)
def prototype_weights(
    taxonomy: tuple[Precursor, ...] = TAXONOMY, stop_words: tuple[str, ...] = ENGLISH
) -> tuple[tuple[str, ...], tuple[float, ...], tuple[tuple[tuple[int, float], ...], ...]]:
    """Vocabulary, inverse document frequencies, and per term its weight in each prototype."""
    stop = set(stop_words)
    counts = []
    for entry in taxonomy:
        words = [w for w in re.findall(r"\w{2,}", entry.prototype.lower()) if w not in stop]
        counts.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    vocabulary = tuple(sorted(set().union(*counts)))
    total = len(counts)
    idf = tuple(
        math.log((1 + total) / (1 + sum(t in c for c in counts))) + 1 for t in vocabulary
    )
    rows: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for position, count in enumerate(counts, 1):
        weights = {i: (1 + math.log(count[t])) * idf[i] for i, t in enumerate(vocabulary) if t in count}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for i, w in weights.items():
            rows[i].append((position, w / norm))
    return vocabulary, idf, tuple(map(tuple, rows))


def with_alignment(
    df: DataFrame,
    text: str = "cleaned_text",
    taxonomy: Sequence[Precursor] = TAXONOMY,
    stop_words: Sequence[str] = ENGLISH,
    out: str = "alignment",
) -> DataFrame:
    """Add an array with the cosine similarity to each prototype, rounded to three places."""
    vocabulary, idf, rows = prototype_weights(tuple(taxonomy), tuple(stop_words))
    table = constant(
        [
            {"idf": idf[i], "own": [{"position": p, "weight": w} for p, w in rows[i]]}
            for i in range(len(vocabulary))
        ],
        "array<struct<idf:double,own:array<struct<position:int,weight:double>>>>",
    )
    counter = CountVectorizerModel.from_vocabulary(list(vocabulary), "_terms", "_counts")
    counted = counter.transform(with_terms(df, text, "_terms", stop_words))
    sparse = F.unwrap_udt("_counts")
    weighted = F.transform(
        F.arrays_zip(sparse["indices"].alias("i"), sparse["values"].alias("n")),
        lambda z: F.struct(
            ((1 + F.ln(z["n"])) * F.element_at(table, z["i"] + 1)["idf"]).alias("w"),
            F.element_at(table, z["i"] + 1)["own"].alias("own"),
        ),
    )
    scored = counted.withColumn("_weighted", weighted).withColumn(
        "_parts",
        F.flatten(
            F.transform(
                "_weighted",
                lambda t: F.transform(
                    t["own"],
                    lambda o: F.struct(o["position"].alias("position"), (o["weight"] * t["w"]).alias("v")),
                ),
            )
        ),
    )
    norm = F.sqrt(F.aggregate("_weighted", F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))
    scored = scored.withColumn("_norm", norm)
    cosine = F.transform(
        F.sequence(F.lit(1), F.lit(len(taxonomy))),
        lambda k: F.when(
            F.col("_norm") > 0,
            F.aggregate(
                F.filter("_parts", lambda p: p["position"] == k), F.lit(0.0), lambda a, p: a + p["v"]
            )
            / F.col("_norm"),
        ).otherwise(F.lit(0.0)),
    )
    # an array of one per prototype, rounded in its own step so that each cosine is taken once
    rounded = scored.withColumn("_cosine", cosine)
    return once(rounded, **{out: F.transform("_cosine", lambda x: round_even(x, 3))}).select(*df.columns, out)
