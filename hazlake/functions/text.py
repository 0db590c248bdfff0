"""Text expressions. Everything stays in the JVM but Unicode decomposition."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from hazlake.functions.lookups import ACRONYMS

# Whitespace as the report rules understand it, for trims at both ends.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"


@F.pandas_udf(T.StringType())
def _decompose(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKD")


def sql_string(value: str) -> str:
    """Literal for SQL text that Spark reads raw, so backslashes need no doubling."""
    quote = '"' if "'" in value else "'"
    if quote in value:
        raise ValueError("text holds both kinds of quotes")
    return f"r{quote}{value}{quote}"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Some character other than a blank; looks no further than the first."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def at_least(c: Column, size: int) -> Column:
    """Whether the stripped text has at least ``size`` (two or more) characters, without stripping it."""
    ink = r"[^\s\x1c-\x1f]"
    return F.coalesce(c.rlike(rf"(?Us){ink}.{{{size - 2},}}?{ink}"), F.lit(False))


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def clean(c: Column) -> Column:
    """Decompose accents, flatten line breaks, squeeze blanks. Null becomes the empty text.

    Only runs of non-ASCII characters travel to Python, parted by a control character; ASCII characters neither change nor
    let marks pass, so the runs are decomposed alone and put back between the others.
    """
    runs = r"[^\x00-\x7F]+"
    sent = F.when(~is_ascii(c), F.array_join(F.regexp_extract_all(c, F.lit(runs), F.lit(0)), "\x01"))
    made = F.split(_decompose(sent), "\x01")
    whole = F.array_join(F.zip_with(F.split(c, runs), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    decomposed = F.coalesce(F.when(~is_ascii(c), whole), c, F.lit(""))
    flat = F.regexp_replace(decomposed, r"[\r\n\t]+", " ")
    return strip(F.regexp_replace(flat, r"(?U)\s{2,}", " "))


def clean_ascii(c: Column) -> Column:
    """``clean`` for text already known to be decomposed."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n\t]+", " ")
    return strip(F.regexp_replace(flat, r"(?U)\s{2,}", " "))


def expand_acronyms(c: Column) -> Column:
    text = F.lower(c)
    for short, full in ACRONYMS:
        text = F.regexp_replace(text, rf"(?<!{WORD}){short}(?!{WORD})", full)
    return text


def title_case(c: Column) -> Column:
    """Capital after every non-letter, not only after blanks."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def shadow(c: Column) -> Column:
    """Lower-cased text of the same length in plain ASCII, for pattern matching.

    Foreign letters and digits become ``_`` (a word character no rule contains), other foreign
    characters ``~``, foreign blanks a blank. Word boundaries then mean the same to every regex
    engine, and patterns run in the fast ASCII mode.
    """
    low = F.lower(c)
    mapped = F.regexp_replace(low, r"[\p{Z}\x1c-\x1f\x85]", " ")
    mapped = F.regexp_replace(mapped, r"[^\x00-\x7F\p{L}\p{N}]", "~")
    mapped = F.regexp_replace(mapped, r"[^\x00-\x7F]", "_")
    return F.when(is_ascii(low), low).otherwise(mapped)


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[.\n;!?]+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 3)


def excerpt(c: Column, size: int = 220) -> Column:
    return F.concat(strip(F.substring(c, 1, size)), F.when(F.length(c) > size, "...").otherwise(""))


def quote_join(items: Column, limit: int = 3) -> Column:
    first = F.slice(items, 1, limit)
    return F.array_join(F.transform(first, lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", ")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def year_month(c: Column) -> Column:
    """First ``YYYY-MM`` or ``YYYY/MM`` in a free date text, null when there is none."""
    found = F.regexp_extract(c, r"\d{4}[-/]\d{2}", 0)
    return F.when(found != "", F.translate(found, "/", "-"))


def model_text(text: Column, sector: Column, worker: Column, gender: Column) -> Column:
    return F.concat(
        F.lit("Description: "), text, F.lit(" Industry Sector: "), sector,
        F.lit(" Worker Type: "), worker, F.lit(" Gender: "), gender,
    )


def alternation(words: Iterable[str], raw_suffix: str = "") -> str:
    """One regex group matching any of the words, factored by common prefix.

    Alternatives are tried one after the other at each position, so sharing prefixes matters.
    A word may end in ``raw_suffix``, which is kept as regex text.
    """
    tree: dict = {}
    for word in words:
        suffix = raw_suffix if raw_suffix and word.endswith(raw_suffix) else ""
        node = tree
        for ch in word.removesuffix(suffix):
            node = node.setdefault(ch, {})
        if suffix:
            node = node.setdefault(suffix, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [
            (part if len(part) > 1 else re.escape(part)) + render(rest)
            for part, rest in node.items()
            if part
        ]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{body})?" if "" in node else body

    return render(tree)


def tokens(c: Column, stop_words: Iterable[str]) -> Column:
    """Words of two or more characters, lower-cased, without stop words."""
    skip = sorted(stop_words)
    words = F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD}{{2,}}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(skip)) if skip else words


def with_bigrams(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)
