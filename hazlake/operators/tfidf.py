"""TF-IDF over words and word pairs.

Weights follow the usual definition: tf = 1 + ln(count), idf = ln((1 + n) / (1 + df)) + 1, rows
scaled to length one. Here a row is weighed inside the row, by a vocabulary with a limit; how
vocabularies are counted and features of many models made as tables is in ``postings``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazlake.functions.mapping import constant, once
from hazlake.functions.stopwords import ENGLISH
from hazlake.functions.text import tokens, with_bigrams


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each word padded by one blank on both sides; short words count once."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def pieces(w: Column, n: int) -> Column:
        last = F.length(w) - n + 1
        starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        # a word shorter than the smallest size gives itself once
        short = F.array(w) if n == low else F.array().cast("array<string>")
        return F.when(last >= 1, F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).otherwise(short)

    def grams(w: Column) -> Column:
        return F.concat(*[pieces(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, grams))


@dataclass(frozen=True)
class Vocabulary:
    """Terms with their inverse document frequencies; its size is bounded by ``max_features``."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    documents: int


@lru_cache(maxsize=16)
def _counter(application: str, terms: tuple[str, ...], column: str) -> CountVectorizerModel:
    """Term counter for a vocabulary; handing thousands of terms to the JVM takes seconds, so once."""
    return CountVectorizerModel.from_vocabulary(list(terms), column, "_counts")


def counter(spark: SparkSession, terms: tuple[str, ...], column: str) -> CountVectorizerModel:
    """Counts of a bounded vocabulary's terms as a sparse vector ``_counts``."""
    return _counter(spark.sparkContext.applicationId, terms, column)


def vectorize(docs: DataFrame, vocabulary: Vocabulary, terms: str = "terms", sublinear: bool = True) -> DataFrame:
    """Add ``vector``: array of ``(i, w)`` scaled to length one; unknown terms are dropped."""
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_counts", outputCol="_scaled"
    )
    counted = scaler.transform(counter(docs.sparkSession, vocabulary.terms, terms).transform(docs))
    counts, scaled = F.unwrap_udt("_counts"), F.unwrap_udt("_scaled")
    weights = scaled["values"]
    if sublinear:
        weights = F.zip_with(counts["values"], weights, lambda n, s: s * (1 + F.ln(n)) / n)
    counted = once(counted, _i=counts["indices"], _w=weights)
    counted = counted.withColumn("_norm", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w)))
    unit = F.zip_with("_i", "_w", lambda i, w: F.struct(i.alias("i"), (w / F.col("_norm")).alias("w")))
    return once(counted, vector=unit).select(*docs.columns, "vector")


def with_terms(df: DataFrame, text: str, out: str = "terms", stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """Add the words of a text without stop words, then its pairs of neighbouring words."""
    # the words are a column of their own: they are used several times below
    words = df.withColumn("_words", tokens(F.col(text), stop_words))
    return once(words, **{out: with_bigrams(F.col("_words"))}).drop("_words")


def with_words(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """(key, words): every row's words without stop words, in order."""
    return df.select(F.col(key).alias("key"), F.coalesce(tokens(F.col(text), stop_words), F.array().cast("array<string>")).alias("words"))


def occurrences(words: DataFrame) -> DataFrame:
    """(term, n) of all words and pairs of neighbouring words; no two of them are equal, as words hold no blanks."""
    pairs = words.select(F.inline(neighbours(F.col("words"))).alias("a", "b")).select(F.concat("a", F.lit(" "), "b").alias("term"))
    single = words.select(F.explode("words").alias("term"))
    return single.unionByName(pairs).groupBy("term").agg(F.count("*").alias("n"))


def neighbours(words: Column) -> Column:
    """Pairs of neighbouring elements."""
    size = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, F.lit(1), size), F.slice(words, F.lit(2), size))


def term_counts(words: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(key, idx, n): which of the terms, by place, a row has, in ascending order, and how often."""
    if not terms:
        return words.select("key", F.array().cast("array<int>").alias("idx"), F.array().cast("array<int>").alias("n"))
    made = once(words, terms=with_bigrams(F.col("words")))
    counts = F.unwrap_udt("_counts")
    counted = counter(words.sparkSession, tuple(terms), "terms").transform(made)
    return counted.select("key", counts["indices"].alias("idx"), counts["values"].cast("array<int>").alias("n"))


def unit_vectors(counted: DataFrame, idf: Sequence[float]) -> DataFrame:
    """(key, idx, val) of length one. Rows that share a key are one row, which holds the entries of all of them."""
    share = constant(list(idf), "array<double>")
    each = F.zip_with("idx", "n", lambda i, n: F.struct(i.alias("i"), ((1 + F.log(n.cast("double"))) * F.get(share, i)).alias("x")))
    rows = once(counted, _all=each).select("key", "_all")
    if not counted.groupBy("key").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("_all"))).alias("_all"))
    rows = once(rows, _norm=F.sqrt(F.aggregate("_all", F.lit(0.0), lambda a, e: a + e["x"] * e["x"])))
    return rows.select("key", F.col("_all")["i"].alias("idx"), F.transform("_all", lambda e: e["x"] / F.col("_norm")).alias("val"))
