"""Retrieval of similar past reports by cosine similarity of TF-IDF vectors.

An index holds the vocabulary and the unit vectors of a corpus. A search is exact for the best ``top_n`` above a threshold.
A query's terms are ordered from rare to frequent; what its frequent terms can add to any similarity is at most their norm,
so documents are only met on the terms before the norm of the rest falls below a share of the query's bound. A first
look-up of the rarest terms gives each query ``top_n`` documents, whose exact similarities raise its bound from the
threshold. In the second, sums that stay below the bound even with the norm of the rest are dropped where they are made:
documents are placed by key once, all their products are summed there, and only pairs that can reach the bound leave the
stage. These are verified on whole vectors in the row. Queries are asked in blocks whose terms are broadcast, so a term
found in every document is spread like the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from hazlake.functions.ids import incident_ref
from hazlake.functions.mapping import once
from hazlake.functions.numbers import clamp, round_even
from hazlake.operators import postings
from hazlake.operators.tfidf import occurrences, term_counts, unit_vectors, with_words
from hazlake.session import cut, kept

METHOD = "cosine of weighted words and word pairs"
#: Terms of queries in one block (some 40 bytes each, broadcast).
BLOCK = 1_000_000
#: The first look-up's terms hold all but this norm of a query; the second's all but this share of its bound.
SEED, REST = 0.9, 0.25
#: Of summing in another order, and of ranks by similarity to six places.
SLACK, SAME = 1e-9, 1e-6


@dataclass(frozen=True)
class Index:
    """vocabulary (term, i, df, idf), bounded by its limit, and vectors (key, idx, val) of length one."""

    vocabulary: DataFrame
    vectors: DataFrame


def build_index(corpus: DataFrame, doc_text: str = "cleaned_text", doc_key: str = "doc_id", max_features: int = 20_000) -> Index:
    """Texts are split into words once, and expected to be cleaned; keys are expected to be unique.

    Of all terms only the counts are shuffled. Rows are then counted by the chosen terms alone, each in itself, and from
    that follows in how many rows a term is found.
    """
    words = kept(with_words(corpus, doc_key, doc_text))
    usage = kept(occurrences(words).filter("n > 1"))
    if usage.count() < max_features:  # terms that occur once are wanted too
        usage = kept(occurrences(words))
    chosen = postings.top_terms(usage.withColumn("model", F.lit(0)), max_features).select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i"))
    named = [r["term"] for r in chosen.orderBy("i").collect()]  # bounded by the limit
    counted = kept(term_counts(words, named))
    found = counted.select(F.explode("idx").alias("i")).groupBy("i").agg(F.count("*").alias("df"))
    weighed = F.broadcast(found.withColumn("idf", postings.idf(F.col("df"), F.lit(counted.count()))))
    vocabulary = cut(chosen.join(weighed, "i").select("term", "i", "df", "idf"))
    idf = [r["idf"] for r in vocabulary.orderBy("i").collect()]
    return Index(vocabulary, kept(unit_vectors(counted, idf)))


def _vectors(queries: DataFrame, key: str, text: str, index: Index) -> DataFrame:
    known = index.vocabulary.orderBy("i").collect()
    counted = term_counts(with_words(queries, key, text), [r["term"] for r in known])
    return kept(unit_vectors(kept(counted), [r["idf"] for r in known]))


def _asked(queries: DataFrame, index: Index) -> DataFrame:
    """query, i, wq, df, rest: the norm of this term and all more frequent ones of the query."""
    terms = queries.select(F.col("key").alias("query"), F.inline(F.arrays_zip("idx", "val")).alias("i", "wq"))
    known = terms.join(F.broadcast(index.vocabulary.select("i", "df")), "i")
    frequent_first = Window.partitionBy("query").orderBy(F.desc("df"), "i")
    return known.withColumn("rest", F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(frequent_first)))


def _open(asked: DataFrame, index: Index, blocks: int) -> DataFrame:
    """query, doc, partial, of the pairs whose sum over the asked terms, with ``left``, can reach the query's ``bound``."""
    placed = index.vectors.repartition("key").select(F.col("key").alias("doc"), F.inline(F.arrays_zip("idx", "val")).alias("i", "wd"))
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "i", "wq", "bound", "left")
        sums = placed.join(F.broadcast(own), "i").groupBy("doc", "query").agg(
            F.sum(F.col("wq") * F.col("wd")).alias("partial"), F.first("bound").alias("bound"), F.first("left").alias("left"))
        sums = sums.filter(F.col("partial") + F.col("left") >= F.col("bound")).select("query", "doc", "partial")
        found = sums if found is None else found.unionByName(sums)
    return found


def _exact(pairs: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """query, doc, similarity of the pairs, on whole vectors."""
    docs = index.vectors.select(F.col("key").alias("doc"), "idx", "val")
    asked = queries.select(F.col("key").alias("query"), F.col("idx").alias("qi"), F.col("val").alias("qw"))
    read = pairs.select("query", "doc").join(asked, "query").join(docs, "doc")
    both = F.zip_with("idx", "val", lambda i, w: F.struct(i.alias("i"), w.alias("w")))
    read = once(read, _shared=F.filter(both, lambda e: F.array_contains("qi", e["i"])))
    dot = F.aggregate("_shared", F.lit(0.0), lambda a, e: a + e["w"] * F.get("qw", F.array_position("qi", e["i"]).cast("int") - 1))
    return once(read, similarity=clamp(dot, 0.0, 1.0)).select("query", "doc", "similarity")


def search(index: Index, queries: DataFrame, query_text: str = "report_text", query_key: str = "query_id", top_n: int = 3, threshold: float = 0.10) -> DataFrame:
    """query, doc, similarity, rank: the ``top_n`` best of each query among all documents at the threshold or above."""
    vectors = _vectors(queries, query_key, query_text, index)
    asked = cut(_asked(vectors, index))
    blocks = max(1, -(-asked.count() // BLOCK))
    seeds = asked.filter(F.col("rest") >= SEED).withColumns({"bound": F.lit(0.0), "left": F.lit(0.0)})
    first = top_matches(_open(seeds, index, blocks).withColumnRenamed("partial", "similarity"), top_n, "query", "doc")
    found = _exact(first, vectors, index).groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("last"))
    raised = F.when(F.col("n") >= top_n, F.col("last") - SAME)
    bounds = found.select("query", F.greatest(F.lit(threshold), raised).alias("bound"))
    bounded = asked.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(threshold)) - SLACK)
    kept = F.col("rest") >= REST * F.col("bound")
    left = F.coalesce(F.max(F.when(~kept, F.col("rest"))).over(Window.partitionBy("query")), F.lit(0.0))
    bounded = cut(bounded.withColumn("left", left).filter(kept))
    exact = _exact(_open(bounded, index, blocks), vectors, index).filter(F.col("similarity") >= threshold)
    return top_matches(exact, top_n, "query", "doc")


def top_matches(pairs: DataFrame, top_n: int, query_key: str, doc_key: str) -> DataFrame:
    """Best ``top_n`` documents per query: score to six places descending, then document key."""
    order = Window.partitionBy(query_key).orderBy(F.desc(round_even(F.col("similarity"), 6)), doc_key)
    # a rank limit on row_number lets every task drop all but its own best before the shuffle
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def find_similar(
    queries: DataFrame,
    corpus: DataFrame,
    query_text: str = "report_text",
    doc_text: str = "cleaned_text",
    query_key: str = "query_id",
    doc_key: str = "doc_id",
    top_n: int = 3,
    threshold: float = 0.10,
    max_features: int = 20_000,
    index: Index | None = None,
) -> DataFrame:
    """Most similar corpus reports for a set of queries. Blank or unknown queries match nothing.

    Texts are expected to be cleaned. ``index`` reuses an earlier one.
    """
    index = index or build_index(corpus, doc_text, doc_key, max_features)
    return search(index, queries, query_text, query_key, top_n, threshold).withColumnsRenamed({"query": query_key, "doc": doc_key})


def incident_records(matches: DataFrame, corpus: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Matches with the details of the incident found, at the precision shown to users."""
    # matches are few per query and unique documents recur: let the planner choose the join
    joined = matches.join(corpus, doc_key)
    s = F.col("similarity")
    return joined.withColumns(
        {
            "source_id": incident_ref(F.col(doc_key)),
            "similarity_score": round_even(s, 4),
            "similarity_percentage": round_even(s * 100.0, 2),
            "retrieval_method": F.lit(METHOD),
        }
    ).drop("similarity")
