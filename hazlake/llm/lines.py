"""Line dedup by a log-template tree of fixed depth.

A line's tokens are its words, those with a digit masked as a variable. The tree's first level is the number of tokens,
the next levels are the leading tokens; each leaf holds lines of one shape. Within a leaf a token that fewer than
``min_docs`` documents show at its place is a variable field, too, and the template is what remains. A template is
recurring if at least ``min_docs`` documents hold it and at least ``min_constant`` of its tokens are constant; its
lines are dropped wherever they stand, the first document included. A line with too many masked words for that is a
template of its own, digits included, if ``min_docs`` documents hold it word for word.

Documents are counted, not lines: many lines of one shape within a document count once.

Only leaves that enough documents reach are looked at token by token, and equal lines are counted together before any
shuffle, so a line that a third of all documents share is a few rows.

Defined cases: null text has no lines and stays null; lines without words are never dropped; a line that repeats within
a document counts once; rows that repeat a document count as documents; rows without an id count like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.mapping import once
from hazlake.llm.common import doc_id_of, stored, whole_row, with_key

DEPTH, MIN_DOCS, MIN_CONSTANT = 3, 20, 0.6
MASK = "<*>"
#: Tells the rows of documents apart.
DOC = ("did", "th", "copy")


def masked_lines(text: Column) -> Column:
    """The lines of a text: tokens joined by one blank, those with a digit masked; empty for a line without words."""
    ink = r"[^\x20\x09-\x0D]"
    plain = F.when(text.rlike("[0-9]"), F.regexp_replace(text, rf"(?<!{ink}){ink}*?[0-9]{ink}*", MASK)).otherwise(text)
    even = F.when(plain.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(plain, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(plain)
    return F.transform(F.split(even, "\n"), lambda x: F.trim(x))


def size_of(mask: Column) -> Column:
    return F.length(mask) - F.length(F.replace(mask, F.lit(" "), F.lit(""))) + 1


def leaf_of(mask: Column, depth: int) -> Column:
    """The leaf of a line: token count and leading tokens."""
    return F.xxhash64(size_of(mask), F.substring_index(mask, " ", depth))


def split_lines(docs: DataFrame, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """did, th, lines (mask, raw): the masked lines of each text in order; raw is a hash where too much is masked for a template."""
    rows = once(with_key(docs), masks=masked_lines(F.coalesce("text", F.lit(""))))
    plain = lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " "))
    masked = lambda m: (F.length(m) - F.length(F.replace(m, F.lit(MASK), F.lit("")))) / len(MASK)
    own = lambda m, x: F.when(size_of(m) - masked(m) < min_constant * size_of(m), F.xxhash64(plain(x)))
    pairs = F.zip_with("masks", F.split(F.coalesce("text", F.lit("")), "\n"), lambda m, x: F.struct(m.alias("mask"), own(m, x).alias("raw")))
    return once(rows, lines=pairs).select("did", "th", "lines")


def held(pairs: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Keys (with docs) that at least min_docs documents hold: distinct per document first, then counted."""
    each = pairs.select(*keys, *DOC).distinct()
    return each.groupBy(*keys).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)


def common_of(units: DataFrame, spots: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Keys that at least min_docs documents hold, of units (leaf, line, n, keys): n is a line's number of documents.

    A line of min_docs documents settles its keys, and so does a sum of n below it; only the keys in between are counted
    document by document, and none of their lines is in min_docs documents.
    """
    bounds = units.groupBy(*keys).agg(F.max("n").alias("most"), F.sum("n").alias("sum")).where(F.col("sum") >= min_docs)
    bounds = stored(bounds.select(*keys, (F.col("most") >= min_docs).alias("sure")), "bounds")
    lines = units.join(bounds.where(~F.col("sure")), keys).select("leaf", "line", *[k for k in keys if k != "leaf"])
    counted = held(lines.join(spots.select("leaf", "line", *DOC).distinct(), ["leaf", "line"]), keys, min_docs)
    return bounds.where("sure").select(*keys).unionByName(counted.select(*keys))


def recurring(spots: DataFrame, depth: int, min_docs: int, min_constant: float) -> DataFrame:
    """(leaf, line, template): the lines that recurring templates cover, by hash."""
    # shape first, by hashes only, so that one-off lines are counted cheaply
    busy = stored(spots.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    # a line that repeats within a document counts once
    near = stored(spots.join(busy, "leaf").groupBy("leaf", "line", *DOC).agg(F.first("mask").alias("mask")), "near")
    shapes = stored(near.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("mask").alias("mask")), "shapes")
    tokens = shapes.select("leaf", "line", "n", F.posexplode(F.split("mask", " ")).alias("at", "token")).where(F.col("token") != MASK)
    common = common_of(tokens, near, ["leaf", "at", "token"], min_docs)
    constant = tokens.join(common, ["leaf", "at", "token"])
    fixed = constant.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("fixed"))
    shaped = shapes.join(fixed, ["leaf", "line"]).withColumn("size", F.size(F.split("mask", " ")))
    shaped = shaped.where(F.size("fixed") >= min_constant * F.col("size"))
    named = stored(shaped.select("leaf", "line", "n", F.xxhash64("leaf", F.to_json("fixed")).alias("template")), "named")
    return named.join(common_of(named, near, ["leaf", "template"], min_docs), ["leaf", "template"]).select("leaf", "line", "template")


def dropped(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(did, th, gone): for each text with such lines, their numbers from 0."""
    cut = split_lines(docs, min_constant).withColumn("copy", F.monotonically_increasing_id())
    spots = cut.select(*DOC, F.posexplode("lines").alias("at", "l")).select(*DOC, "at", "l.mask", "l.raw").where(F.col("mask") != "")
    spots = stored(spots.select(*DOC, "at", "mask", "raw", leaf_of(F.col("mask"), depth).alias("leaf"), F.xxhash64("mask").alias("line")), "lines")
    drop = stored(recurring(spots, depth, min_docs, min_constant).select("leaf", "line"), "templates")
    verbatim = stored(held(spots.where("raw IS NOT NULL"), ["raw"], min_docs).select("raw"), "verbatim")
    gone = spots.join(drop, ["leaf", "line"]).select("did", "th", "at").union(spots.join(verbatim, "raw").select("did", "th", "at"))
    return gone.groupBy("did", "th").agg(F.collect_set("at").alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the numbered lines; null stays null."""
    marks = F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains(gone, i), x))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(marks, lambda x: x.isNotNull()), "\n"))


def report(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_lines with words, n_removed, kept_sha256 of the text that stays."""
    both = with_key(docs).join(dropped(docs), ["did", "th"], "left")
    kept = F.coalesce(without_lines(F.col("text"), F.col("gone")), F.lit(""))
    return both.select(
        doc_id_of(F.col("did")).alias("doc_id"),
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
        F.sha2(kept, 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The rows of documents without such lines; n_chars follows the text where the column exists."""
    rows = with_key(docs, whole_row(docs)).join(dropped(docs), ["did", "th"], "left")
    text = without_lines(F.col("text"), F.col("gone"))
    fresh = {"text": text, "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[fresh.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
