"""Benchmark decontamination by a prefix-filtered containment join.

An item window is 13 consecutive item words (a shorter item is one window). A document contains a window only if it
contains every word of it, so with a containment of 1 the necessary prefix of a window, its words ordered from rare to
frequent in the documents, is its single rarest word. Document positions are joined with windows on that word; the
window's place is bounded by the word's offset and the document's ends, and the words are then compared one by one.

Defined cases: null or wordless texts have no words and no hits; items without words have no windows; an item without
an id is listed as an empty string; items of equal text are all listed; rows that repeat id and text get the same
result each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.llm.common import doc_id_of, lower_az, small, stored, text_of, whole_row, with_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows are broadcast up to this many rows (some 200 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def item_words(text: Column) -> Column:
    whole = text_of(text)
    # a text without other letters is lowered as a whole, which is much cheaper
    low = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(lower_az(whole))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, items): the distinct windows and the ids of the items that hold them."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    each = words.where(F.size("w") > 0).select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, size))).alias("win"))
    return each.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def keyed_windows(words: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, int]:
    """Windows with their rarest word and its offset; and their count. ``words`` has one row per document word."""
    wins = stored(windows(items, size), "windows")
    vocabulary = stored(wins.select(F.explode("win").alias("word")).distinct(), "window-words")
    n_words = vocabulary.count()
    seen = words.select("word").join(small(vocabulary, n_words, BROADCAST_ROWS), "word").groupBy("word").agg(F.count("*").alias("n"))
    spots = wins.select("win", F.posexplode("win").alias("at", "word")).join(vocabulary.join(seen, "word", "left"), "word")
    # a word that no document has rules its windows out
    best = spots.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "word")).alias("rare"))
    keyed = stored(best.where("rare.n > 0").join(wins, "win").select("win", "items", F.size("win").alias("len"), F.col("rare.word").alias("word"), F.col("rare.at").alias("at")), "window-keys")
    return keyed, keyed.count()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of documents: did, th, n_words, n_hit, items (sorted ids), n_rows."""
    split = with_key(docs).select("did", "th", item_words(F.col("text")).alias("w"))
    keyed, n = keyed_windows(split.select(F.explode("w").alias("word")), items, size)
    # behind its words each document has an empty one, which no text has: it brings the document's own row in the same pass
    none = keyed.sparkSession.range(1).select(
        F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("len"), F.lit("").alias("word"), F.lit(0).alias("at"))
    keyed = keyed.unionByName(none)
    span = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"))
    start, fits = F.col("pos") - F.col("at"), (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))
    own = F.col("word") == ""
    same = F.slice("w", F.col("start") + 1, F.col("len")) == F.col("win")
    spots = split.withColumn("n_words", F.size("w"))
    each = F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word")
    if n <= BROADCAST_ROWS:
        met = spots.select("did", "th", "w", "n_words", each).join(F.broadcast(keyed), "word").withColumn("start", start)
        hits = met.where(own | (fits & same))
    else:
        # narrow rows meet the windows; the words come in once, for documents that a window may fit into
        met = spots.select("did", "th", "n_words", each).join(keyed, "word").withColumn("start", start).where(own | fits)
        texts = split.dropDuplicates(["did", "th"])
        hits = met.where(own).withColumn("w", F.lit(None).cast("array<string>")).unionByName(met.where(~own).join(texts, ["did", "th"]).where(same))
    hits = hits.select("did", "th", F.when(own, 1).otherwise(0).alias("n"), "n_words", F.when(~own, span).alias("span"), "items")
    per = hits.groupBy("did", "th").agg(
        F.sum("n").alias("n_rows"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    union = F.aggregate("spans", zero, lambda a, x: F.struct(
        (a["n"] + F.greatest(x["e"] - F.greatest(a["to"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
    return per.select("did", "th", "n_rows", "n_words", union.alias("n_hit"), "items")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit").cast("bigint") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    rows = found.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows")).alias("_row"))
    return rows.select(
        doc_id_of(F.col("did")).alias("doc_id"), F.col("n_words").cast("bigint"), F.col("n_hit").cast("bigint"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items).where(is_contaminated()).select("did", "th")
    rows = with_key(docs, whole_row(docs)).drop("text")
    return rows.join(bad, ["did", "th"], "left_anti").select("row.*")
