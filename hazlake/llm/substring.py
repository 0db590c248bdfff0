"""Exact substring dedup by winnowed seeds and their extensions.

A word is removed if it lies in a window of 50 words whose word sequence also starts in a document with a smaller id.

Seeds: hashes of 20-word runs, of which winnowing keeps the smallest (the rightmost among equals) of every 31 in a
row. 31 runs of 20 words are one window of 50, so each window has exactly one anchor, which depends on nothing but the
window's words, and two equal windows have equal anchors at equal places. All windows that share an anchor make a
segment: the anchor extended to the left and right as far as its windows go.

Extension: segments are joined on their anchor, never document pairs. A segment that also occurs in a smaller document
is a repeat as a whole. Where one anchor has different segments, each one's first document contributes the hashes of its
windows, and equal windows find the smallest document. Adjacent repeated windows join to maximal repeats. Copies of a
passage therefore cost one row an anchor, however many there are.

Defined cases: null or short texts lose nothing; rows without an id come behind all others and are never the reason for
a removal; rows that share an id do not remove each other's words; rows that repeat id and text get the same result
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hazlake.llm.common import doc_id_of, stored, with_key

WINDOW, RUN = 50, 20
SPAN = WINDOW - RUN + 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _prefix(words: list[bytes], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words' hashes times powers of an odd number, and the powers of its inverse, for hashes of any run."""
    h = _mix(pd.util.hash_array(np.array(words, dtype=object), categorize=False) + np.uint64(salt))
    base = int(_ODD) if salt else 0xD1342543DE82EF95
    power = np.full(len(words) + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    return total, np.cumprod(back)


def _runs(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, length) -> np.ndarray:
    total, back = prefix
    return _mix((total[starts + length] - total[starts]) * back[starts])


def segments(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, place of the anchor, first window and number of windows, for each anchor."""
    empty = np.empty(0, np.int64)
    if len(words) < WINDOW:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    prefix = _prefix(words, 0)
    runs = _runs(prefix, np.arange(len(words) - RUN + 1), RUN)
    n = len(words) - WINDOW + 1
    step = 20_000
    chosen = np.empty(n, np.int64)
    for i in range(0, n, step):
        view = np.lib.stride_tricks.sliding_window_view(runs[i:i + step + SPAN - 1], SPAN)[: min(step, n - i)]
        chosen[i:i + len(view)] = i + np.arange(len(view)) + SPAN - 1 - view[:, ::-1].argmin(axis=1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, n])
    at = chosen[first]
    other = _prefix(words, 1)
    whole = _runs(other, first, count + WINDOW - 1)
    # the same words with the anchor elsewhere are another segment
    named = _mix(whole * _ODD + (at - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
    return runs[at], named, at, first, count


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for did, th, text in zip(pdf["did"], pdf["th"], pdf["text"]):
            anchor, seg, at, first, count = segments(_words(text))
            if len(anchor):
                out.append(pd.DataFrame({"anchor": anchor.astype(np.int64), "seg": seg.astype(np.int64), "did": did, "th": th,
                                         "start": first.astype(np.int32), "windows": count.astype(np.int32)}))
        if out:
            yield pd.concat(out, ignore_index=True)


ANCHORS = "anchor long, seg long, did long, th long, start int, windows int"


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the wanted segments of each text: a row for each window."""
    for pdf in batches:
        for did, text, wanted in zip(pdf["did"], pdf["text"], pdf["wanted"]):
            words = _words(text)
            prefix = _prefix(words, 1)
            want = np.array([(w["anchor"], w["seg"], w["start"], w["windows"]) for w in wanted], np.int64).reshape(-1, 4)
            starts = np.concatenate([np.arange(s, s + n) for _, _, s, n in want])
            times = want[:, 3]
            step = 200_000
            for i in range(0, len(starts), step):
                part = slice(i, i + step)
                yield pd.DataFrame({
                    "anchor": np.repeat(want[:, 0], times)[part], "seg": np.repeat(want[:, 1], times)[part], "did": did,
                    "offset": (starts - np.repeat(want[:, 2], times))[part].astype(np.int32),
                    "window": _runs(prefix, starts[part], WINDOW).astype(np.int64)})


def repeats(docs: DataFrame) -> DataFrame:
    """(did, th, spans): the repeated windows of each text as ranges (first window, past the last one)."""
    keyed = with_key(docs)
    anchors = stored(keyed.mapInPandas(_anchors, ANCHORS), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("did").alias("low"), F.max("did").alias("high"), F.min("seg").alias("s1"), F.max("seg").alias("s2"))
    shared = shared.where("low < high").select("anchor", (F.col("s1") != F.col("s2")).alias("several"))
    seeds = stored(anchors.join(shared, "anchor"), "seeds")
    # of each segment its first document, and in that its first place
    firsts = stored(seeds.groupBy("anchor", "seg").agg(F.min(F.struct("did", "th", "start")).alias("first"), F.max("windows").alias("windows"), F.max("several").alias("several")), "segments")
    wanted = (
        firsts.where("several").select("first.did", "first.th", F.struct("anchor", "seg", F.col("first.start").alias("start"), "windows").alias("w"))
        .groupBy("did", "th").agg(F.collect_list("w").alias("wanted"))
    )
    texts = keyed.dropDuplicates(["did", "th"]).join(wanted, ["did", "th"])
    rows = stored(texts.select("did", "text", "wanted").mapInPandas(_window_rows, "anchor long, seg long, did long, offset int, window long"), "windows")
    low = rows.groupBy("anchor", "window").agg(F.min("did").alias("low"), F.max("did").alias("high")).where("low < high").select("anchor", "window", "low")
    late = rows.join(low, ["anchor", "window"]).where("did > low").select("anchor", "seg", "offset")
    partly = late.groupBy("anchor", "seg").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    info = firsts.select("anchor", "seg", F.col("first.did").alias("first")).join(partly, ["anchor", "seg"], "left")
    spans = seeds.join(info, ["anchor", "seg"]).select(
        "did", "th", F.when(F.col("did") > F.col("first"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b"))))
        .otherwise(F.transform("offsets", lambda o: F.struct((F.col("start") + o).alias("a"), (F.col("start") + o + 1).alias("b")))).alias("s"))
    return spans.where("s IS NOT NULL").groupBy("did", "th").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("spans"))


def _removed(spans, n: int) -> np.ndarray:
    """Mask of the words in repeated windows."""
    edge = np.zeros(n + 1, np.int64)
    a = np.array([s["a"] for s in spans], np.int64)
    b = np.array([s["b"] for s in spans], np.int64) + WINDOW - 1
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for did, th, text, spans in zip(pdf["did"], pdf["th"], pdf["text"], pdf["spans"]):
            words = _words(text)
            gone = _removed(spans, len(words)) if spans is not None and len(spans) else np.zeros(len(words), bool)
            kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)
            rows.append((did, th, len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["did", "th", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept (the words that stay, joined by blanks)."""
    spans = repeats(docs)
    both = with_key(docs).join(spans, ["did", "th"], "left")
    out = both.select("did", "th", "text", "spans").mapInPandas(_kept, "did long, th long, n_words long, n_removed long, kept string")
    return out.select(doc_id_of(F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept")


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
