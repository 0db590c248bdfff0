"""Term statistics and features for several models at once, as tables.

Rows of a corpus have ``key``, ``label``, ``part`` and ``counts``. A row's terms are counted once, inside the row. Model m is
trained on all rows whose part is not m, so the folds of a cross-validation, or one training and one test part, need a
single pass over the terms: what a model must not see is taken off the totals. Vocabularies are tables; only those with a
limit of their own are ever broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazlake.functions.mapping import once
from hazlake.functions.text import tokens, with_bigrams
from hazlake.functions.stopwords import ENGLISH
from hazlake.operators.tfidf import char_terms

#: Terms with more than one in so many postings are joined by broadcast; by their share there are no more than that.
HEAVY = 20_000
#: Postings by which the most frequent terms are told from the others.
SAMPLE = 4_000_000
COUNTS = "array<struct<space:string,term:string,n:int>>"


def _space(df: DataFrame, terms: Column, space: str, out: str) -> DataFrame:
    """Distinct terms with the lengths of their runs in the sorted array."""
    df = once(df, _terms=F.sort_array(terms))
    size = F.size("_terms")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda i: (i < size) & ((i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1))),
    )
    df = once(df, _first=starts)
    ends = F.concat(F.slice("_first", F.lit(2), F.size("_first")), F.array(size))
    counts = F.zip_with(
        "_first", ends, lambda a, b: F.struct(F.lit(space).alias("space"), F.get("_terms", a).alias("term"), (b - a).alias("n"))
    )
    return once(df, **{out: F.when(size > 0, counts).otherwise(F.array().cast(COUNTS))}).drop("_terms", "_first")


def with_counts(df: DataFrame, text: str, chars: bool = False, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """Add ``counts``: (space, term, n) of the text's words and pairs of words, and of its character n-grams if asked."""
    df = df.withColumn("_words", tokens(F.col(text), stop_words))
    df = _space(df, with_bigrams(F.col("_words")), "word", "counts").drop("_words")
    if not chars:
        return df
    df = _space(df, char_terms(F.col(text)), "char", "_chars")
    return df.withColumn("counts", F.concat("counts", "_chars")).drop("_chars")


def term_usage(corpus: DataFrame, models: Sequence[int]) -> DataFrame:
    """(model, space, term, n, df): occurrences and rows of each term among the rows a model is trained on."""
    seen = corpus.select("part", F.inline("counts"))
    own = [f(m) for m in models for f in (
        lambda m: F.coalesce(F.sum(F.when(F.col("part") == m, F.col("n"))), F.lit(0)).alias(f"n_{m}"),
        lambda m: F.count_if(F.col("part") == m).alias(f"df_{m}"))]
    totals = seen.groupBy("space", "term").agg(F.sum("n").alias("n"), F.count("*").alias("df"), *own)
    per_model = F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col("n") - F.col(f"n_{m}")).alias("n"), (F.col("df") - F.col(f"df_{m}")).alias("df"))
        for m in models])
    return totals.select("space", "term", F.inline(per_model)).filter("df > 0")


def top_terms(usage: DataFrame, size: int) -> DataFrame:
    """The most frequent terms of each model, ties by name.

    The count that the last of them has follows from how many terms have each count. All terms above it are in; only those
    that have just this count are ranked, and each task passes on no more of them than are wanted.
    """
    per_count = usage.groupBy("model", "n").agg(F.count("*").alias("terms"))
    down = Window.partitionBy("model").orderBy(F.desc("n"))
    marks = per_count.withColumn("upto", F.sum("terms").over(down)).withColumn("above", F.col("upto") - F.col("terms"))
    last = marks.filter(F.col("above") < size).groupBy("model").agg(F.min_by(F.struct(F.col("n").alias("least"), "above"), "n").alias("x")).select("model", "x.*")
    marked = usage.join(F.broadcast(last), "model").filter("n >= least")  # a row per model
    order = Window.partitionBy("model").orderBy("term")
    tied = marked.filter("n = least").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    tied = tied.filter(F.col("rank") + F.col("above") <= size).drop("rank")
    return marked.filter("n > least").unionByName(tied).drop("least", "above")


def idf(df: Column, rows: Column) -> Column:
    return F.log((1 + rows).cast("double") / (1 + df).cast("double")) + 1


def training_rows(corpus: DataFrame, models: Sequence[int]) -> dict[int, int]:
    sizes = corpus.groupBy("part").count().collect()
    return {m: sum(r["count"] for r in sizes if r["part"] != m) for m in models}


def per_model(values: dict[int, object], default: object = None) -> Column:
    """The value of a row's model."""
    out = F.lit(default)
    for m, value in values.items():
        out = F.when(F.col("model") == m, F.lit(value)).otherwise(out)
    return out


def index_terms(usage: DataFrame, limits: dict[str, int], sizes: dict[int, int]) -> DataFrame:
    """(model, space, term, i, df, idf) for vocabularies with limits: word places first, then those of characters."""
    out, offset = None, 0
    for space, limit in limits.items():
        chosen = top_terms(usage.filter(F.col("space") == space), limit)
        place = F.row_number().over(Window.partitionBy("model").orderBy("term")) - 1 + offset
        chosen = chosen.select("model", "space", "term", place.alias("i"), "df", idf(F.col("df"), per_model(sizes)).alias("idf"))
        out, offset = chosen if out is None else out.unionByName(chosen), offset + limit
    return out


def features(corpus: DataFrame, vocabulary: DataFrame, models: Sequence[int], sublinear: bool = True) -> DataFrame:
    """(model, key, the corpus's other columns, idx, val): each row under each model's vocabulary; each space's part has length one.

    The vocabulary is bounded by its limits times the models, and broadcast. Rows stay where their key places them.
    """
    entry = F.struct("model", "i", "idf")
    always = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(-1).alias("i"), F.lit(0.0).alias("idf")) for m in models])
    spark = corpus.sparkSession
    none = spark.range(1).select(F.lit("").alias("space"), F.lit("").alias("term"), always.alias("uses"))
    known = vocabulary.groupBy("space", "term").agg(F.collect_list(entry).alias("uses")).unionByName(none)
    mark = F.array(F.struct(F.lit("").alias("space"), F.lit("").alias("term"), F.lit(1).alias("n")))
    carried = [c for c in corpus.columns if c not in ("key", "counts")]
    placed = corpus.repartition("key").select("key", *carried, F.inline(F.concat("counts", mark)))
    hits = placed.join(F.broadcast(known), ["space", "term"]).select("key", *carried, "space", "n", F.inline("uses"))
    tf = (1 + F.log(F.col("n").cast("double"))) if sublinear else F.col("n").cast("double")
    each = F.struct("i", "space", (tf * F.col("idf")).alias("x"))
    rows = hits.groupBy("key", "model").agg(*[F.first(c).alias(c) for c in carried], F.sort_array(F.collect_list(each)).alias("all"))
    rows = once(rows, _in=F.filter("all", lambda e: e["i"] >= 0))
    norm = lambda s: F.sqrt(F.aggregate("_in", F.lit(0.0), lambda a, e: a + F.when(e["space"] == s, e["x"] * e["x"]).otherwise(0.0)))
    rows = once(rows, _word=norm("word"), _char=norm("char"))
    val = F.transform("_in", lambda e: e["x"] / F.when(e["space"] == "word", F.col("_word")).otherwise(F.col("_char")))
    return rows.select("model", "key", *carried, F.transform("_in", lambda e: e["i"]).alias("idx"), val.alias("val"))


def common_terms(corpus: DataFrame, size: int) -> list[str]:
    """At most ``size`` terms that many rows have, the most frequent first, as far as some rows show.

    Which terms these are decides only where a term is counted, never its counts: callers count all terms exactly.
    """
    total = corpus.agg(F.sum(F.size("counts"))).first()[0] or 0
    share = min(1.0, SAMPLE / max(total, 1))
    some = corpus.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(share * 1_000_000))
    each = some.select(F.explode(F.col("counts")["term"]).alias("term")).groupBy("term").count().filter("count > 1")
    return [r["term"] for r in each.orderBy(F.desc("count"), "term").limit(size).collect()]


def join_terms(rows: DataFrame, table: DataFrame, on: Sequence[str], uses: str, total: int) -> DataFrame:
    """Rows joined with a table of any number of terms; ``uses`` is how many rows a term meets, ``total`` all rows.

    A term that meets more than 1 / HEAVY of all rows would make one task's work, but there are at most HEAVY of them: they
    are broadcast. All others are joined by a shuffle.
    """
    cut = max(1, total // HEAVY)
    heavy, light = table.filter(F.col(uses) > cut), table.filter(F.col(uses) <= cut)
    common = rows.join(F.broadcast(heavy), list(on))
    rare = rows.join(F.broadcast(heavy.select(*on)), list(on), "left_anti").join(light, list(on))
    return common.unionByName(rare)
