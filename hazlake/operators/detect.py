"""Precursor detection.

Everything about one report is computed inside its row: sentences are an array, rules run over
array elements, and nothing is exploded or regrouped. Detection over any number of reports is
therefore one narrow stage without a shuffle, and a very long report costs only its own task.

One combined pattern keeps the common case cheap: a sentence is looked at closely only when it finds
a rule there, and it tries the rules only where one of them can start.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.mapping import constant, once
from hazlake.functions.text import alternation, sentences, shadow
from hazlake.functions.taxonomy import (
    ACTIVE_DAMAGE,
    HEADER_FACTOR,
    HEADER_PATTERN,
    MITIGATED,
    NEGATION_PREFIXES,
    NEGATION_SUFFIX,
    TAXONOMY,
    Precursor,
)
from hazlake.operators.prototype import with_alignment

EDGE = "\x01"  # marks word boundaries, so a keyword test is a plain substring test


def _mark(c: Column) -> Column:
    return F.regexp_replace(c, r"\b", EDGE)


def _marked(keyword: str) -> str:
    return re.sub(r"\b", EDGE, keyword)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def rule_gate(taxonomy: Sequence[Precursor] = TAXONOMY) -> str:
    """One pattern that matches wherever any pattern or keyword of the taxonomy does."""
    words = alternation(sorted({k for entry in taxonomy for k in entry.keywords}))
    patterns = [p for entry in taxonomy for p in entry.patterns]
    shared = [p.removeprefix(r"\b") for p in patterns if p.startswith(r"\b")]
    other = [p for p in patterns if not p.startswith(r"\b")]
    return "|".join([rf"\b(?:{'|'.join([rf'{words}\b', *shared])})", *other])


def _first_words(pattern: str) -> list[str] | None:
    """How a match of the pattern can start, as small regexes; None if that is not plain to see.

    Looks only at a leading ``\\b`` followed by one literal or one flat group of alternatives.
    """
    if not pattern.startswith(r"\b"):
        return None
    body, rest = pattern.removeprefix(r"\b"), ""
    options = [body]
    if body.startswith("(?:"):
        inside, _, rest = body.removeprefix("(?:").partition(")")
        if "(" in inside:
            return None
        options = inside.split("|")
    starts = []
    for option in options:
        literal = re.match(r"[a-z0-9]*", option).group()
        after = option[len(literal):] or rest
        if literal:
            whole_word = after.startswith((r"\s+", r"\b", "[- ]+"))
            starts.append(literal + (r"\b" if whole_word else ""))
        elif option.startswith(r"\d"):
            starts.append("[0-9]")
        else:
            return None
    return starts


def start_gate(taxonomy: Sequence[Precursor] = TAXONOMY) -> str:
    """Cheap superset of ``rule_gate``: matches where any rule could start.

    Alternatives are tried in turn at each word, so a prefix-factored list of first words rules
    out most sentences at a small part of the cost of the rules themselves.
    """
    words = {k + r"\b" for entry in taxonomy for k in entry.keywords}
    for entry in taxonomy:
        for pattern in entry.patterns:
            starts = _first_words(pattern)
            if starts is None:
                return rule_gate(taxonomy)
            words.update(starts)
    literal = sorted(w for w in words if not w.startswith("["))
    classes = sorted(w for w in words if w.startswith("["))
    return rf"\b(?:{'|'.join([alternation(literal, raw_suffix=chr(92) + 'b'), *classes])})"


def sentence_gate(taxonomy: Sequence[Precursor] = TAXONOMY) -> str:
    """``rule_gate`` for sentences of ``shadow``, whose many alternatives are tried only where ``start_gate`` matches."""
    start, gate = start_gate(taxonomy), rule_gate(taxonomy)
    if start == gate:
        return gate
    # in ASCII text a word starts where no word character stands before it, which is cheaper to see than its edge
    return rf"(?<!\w)(?={start.removeprefix(chr(92) + 'b')}){gate}"


def with_sentences(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    return once(df, sentences=sentences(shadow(F.col(text))))


def _context(s: Column) -> Column:
    """A candidate sentence with what decides whether hits in it count."""
    return F.struct(
        s.alias("text"),
        _mark(s).alias("marked"),
        (s.rlike(MITIGATED) & ~s.rlike(ACTIVE_DAMAGE)).alias("safe"),
            s.rlike(NEGATION_PREFIXES[0]).alias("negated_near"),
        s.rlike(NEGATION_PREFIXES[1]).alias("negated_far"),
        s.rlike(NEGATION_SUFFIX).alias("negated_after"),
    )


def _raw_hits(ctx: Column, taxonomy: Sequence[Precursor], keyword_table: Column) -> Column:
    """Every match in one sentence, in factor order, patterns before keywords."""
    found = F.array(
        *[
            F.struct(F.lit(pos).alias("position"), F.regexp_extract_all(ctx["text"], F.lit(p), F.lit(0)).alias("texts"))
            for pos, entry in enumerate(taxonomy, 1)
            for p in entry.patterns
        ]
    )
    by_pattern = F.flatten(
        F.transform(
            F.filter(found, lambda f: F.size(f["texts"]) > 0),
            lambda f: F.transform(
                f["texts"],
                lambda m: F.struct(f["position"].alias("position"), F.lit(False).alias("keyword"), m.alias("text")),
            ),
        )
    )
    by_keyword = F.transform(
        F.filter(keyword_table, lambda k: ctx["marked"].contains(k["marked"])),
        lambda k: F.struct(k["position"].alias("position"), F.lit(True).alias("keyword"), k["keyword"].alias("text")),
    )
    return F.concat(by_pattern, by_keyword)


def _cancelled(ctx: Column, match: Column) -> Column:
    target = _quoted(match)
    before = [F.concat(F.lit(prefix), target) for prefix in NEGATION_PREFIXES]
    return (
        (ctx["negated_near"] & F.regexp_like(ctx["text"], before[0]))
        | (ctx["negated_far"] & F.regexp_like(ctx["text"], before[1]))
        | (ctx["negated_after"] & F.regexp_like(ctx["text"], F.concat(target, F.lit(NEGATION_SUFFIX))))
    )


def _header_only(low: Column, taxonomy: Sequence[Precursor]) -> Column:
    """The header names the factor and, the header aside, none of its keywords is left."""
    words = [k for entry in taxonomy if entry.factor == HEADER_FACTOR for k in entry.keywords]
    if not words:
        return F.lit(False)
    body = F.regexp_replace(low, HEADER_PATTERN, "")
    return low.rlike(HEADER_PATTERN) & ~body.rlike(alternation(sorted(words)))


def _fold(hits: Column, entries: Column, alignment: Column, header_only: Column) -> Column:
    """Per factor: distinct evidence in order of appearance and the weighted number of hits.

    A pattern hit counts two, each time. A keyword counts one if it is the first to bring its
    text: then its first appearance in the ordered list is a keyword.
    """

    def summary(entry: Column) -> Column:
        own = F.filter(hits, lambda h: h["position"] == entry["position"])
        texts = F.transform(own, lambda h: h["text"])
        return F.struct(
            entry.alias("entry"), own.alias("own"), texts.alias("texts"), F.array_distinct(texts).alias("evidence")
        )

    def detected(s: Column) -> Column:
        new_words = F.filter(
            s["evidence"],
            lambda e: F.element_at(s["own"], F.array_position(s["texts"], e).cast("int"))["keyword"],
        )
        hit_count = 2 * F.size(F.filter(s["own"], lambda h: ~h["keyword"])) + F.size(new_words)
        similarity = F.element_at(alignment, s["entry"]["position"])
        return F.struct(
            s["entry"]["position"].alias("position"),
            s["entry"]["code"].alias("precursor_id"),
            s["entry"]["factor"].alias("factor"),
            s["entry"]["label"].alias("label"),
            s["entry"]["weight"].alias("contribution"),
            s["evidence"].alias("evidence"),
            hit_count.alias("hits"),
            similarity.alias("semantic_alignment"),
            confidence(hit_count, similarity).alias("confidence"),
        )

    seen = F.filter(
        F.transform(entries, summary),
        lambda s: (F.size(s["own"]) > 0) & ~(header_only & (s["entry"]["factor"] == HEADER_FACTOR)),
    )
    return F.transform(seen, detected)


def confidence(hits: Column, similarity: Column) -> Column:
    return (
        F.when((hits >= 4) | ((hits >= 2) & (similarity > 0.15)), 0.95)
        .when((hits >= 2) | (similarity > 0.12), 0.88)
        .otherwise(0.78)
    )


def detect_precursors(
    df: DataFrame,
    text: str = "cleaned_text",
    taxonomy: Sequence[Precursor] = TAXONOMY,
    align: bool = True,
) -> DataFrame:
    """Add ``precursors``: an array of structs in taxonomy order, empty when nothing is found.

    ``align=False`` leaves out the comparison with the prototype texts where only factors and
    scores are wanted; alignment is then 0 and confidence rests on hits alone.
    """
    keywords = constant(
        [
            {"position": pos, "keyword": k, "marked": _marked(k)}
            for pos, entry in enumerate(taxonomy, 1)
            for k in entry.keywords
        ],
        "array<struct<position:int,keyword:string,marked:string>>",
    )
    entries = constant(
        [
            {"position": pos, "code": e.code, "factor": e.factor, "label": e.label, "weight": e.weight}
            for pos, e in enumerate(taxonomy, 1)
        ],
        "array<struct<position:int,code:string,factor:string,label:string,weight:int>>",
    )
    gate = sentence_gate(taxonomy)
    work = df.withColumn("_low", shadow(F.col(text)))
    work = work.withColumn("_header_only", _header_only(F.col("_low"), taxonomy)).withColumn(
        "_context",
        F.filter(
            F.transform(F.filter(sentences(F.col("_low")), lambda s: s.rlike(gate)), _context),
            lambda ctx: ~ctx["safe"],
        ),
    )
    work = work.withColumn(
        "_hits",
        F.flatten(
            F.transform(
                "_context",
                lambda ctx: F.filter(
                    _raw_hits(ctx, taxonomy, keywords), lambda h: ~_cancelled(ctx, h["text"])
                ),
            )
        ),
    )
    if align:
        work = with_alignment(work, text, taxonomy, out="_alignment")
    else:
        work = work.withColumn("_alignment", F.array_repeat(F.lit(0.0), len(taxonomy)))
    return once(
        work, precursors=_fold(F.col("_hits"), entries, F.col("_alignment"), F.col("_header_only"))
    ).select(*df.columns, "precursors")


def precursor_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per report and precursor."""
    return df.select(*keys, F.explode("precursors").alias("p")).select(*keys, "p.*")


def precursor_records(df: DataFrame, *keys: str, taxonomy: Sequence[Precursor] = TAXONOMY) -> DataFrame:
    """Long form with the whole record of each precursor: what was found, and what the taxonomy says about it."""
    known = constant(
        [
            {"description": e.description, "hazards": list(e.hazards), "consequence": e.consequence, "controls": list(e.controls)}
            for e in taxonomy
        ],
        "array<struct<description:string,hazards:array<string>,consequence:string,controls:array<string>>>",
    )
    entry = F.element_at(known, F.col("position"))
    return precursor_rows(df, *keys).select(
        *keys, "precursor_id", "factor", "label", F.col("label").alias("precursor"), F.col("label").alias("name"),
        "evidence", "contribution", "confidence", F.lit("hybrid_contextual_semantic").alias("confidence_type"),
        F.col("semantic_alignment").alias("semantic_alignment_score"),
        entry["description"].alias("description"), entry["hazards"].alias("related_hazards"),
        entry["consequence"].alias("possible_consequence"), entry["controls"].alias("recommended_controls"),
    )
