"""Periodic runs of words, proposed by a dictionary of basic factors.

A run is a stretch with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring word extends.
The dictionary names every factor whose length is a power of two; the name of 2 m words is the pair of the names of its
halves, and only factors that occur twice in their text keep a name. For a length m, the occurrences of a factor are walked
by their successors. Gaps of up to m / 2 are the factor's own period, so occurrences form arithmetic progressions. A
progression proposes its gap as a period; two progressions less than 2 m apart propose the differences of their members,
which form a progression again. A run of period q holds a factor of m <= q < 2 m words and its copy q words on, so it is
proposed at that length (periods below ``least`` / 2 at one where factor and copy still fit into ``least`` words).
Each proposal is extended to both sides by descending through the dictionary's lengths, and among proposals for one
stretch the smallest period stays.

All texts of a batch of at most ``BATCH`` words are named together, with names that no two texts share, so the work is
whole-array sorting. A text longer than a batch is one of its own: memory is some 150 bytes for each of its words.

Defined cases: null text, empty text and text of blanks have no words and no runs; very long texts are taken whole; rows
that repeat are each answered; an empty table gives no rows; other columns, whatever their names, are ignored; a null id
plants nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazlake.llm.common import let, words_of

LEAST = 12
BATCH = 400_000
NONE = -1
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _named(key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the factors that occur twice or more: equal keys, equal names; the others NONE."""
    names = np.full(size, NONE, np.int32)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    alone = new & np.r_[new[1:], True]
    names[at[order]] = np.where(alone, NONE, np.cumsum(new, dtype=np.int32) - 1)
    return names


def dictionary(words: np.ndarray, text: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of all factors of 1, 2, 4, ... words by their first word; ``text`` tells the texts of the words apart.

    No two texts share a name, so a factor that runs over a text's end has none.
    """
    n = len(words)
    if not n:
        return []
    levels = [_named(text.astype(np.int64) * (int(words.max()) + 1) + words, np.arange(n), n)]
    m = 1
    while 2 * m <= longest and levels[-1].max() >= 0:
        half = levels[-1]
        at = np.flatnonzero(half[:n - 2 * m + 1] >= 0)
        at = at[(half[at + m] >= 0) & (text[at] == text[at + 2 * m - 1])]
        if not len(at):
            break
        levels.append(_named(half[at].astype(np.int64) << 32 | half[at + m], at, n))
        m *= 2
    return levels


def _several(first: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first + j * step for j < count of each row: the row and the value."""
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, first[row] + j * step[row]


def proposals(names: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): places where a factor of m words has a copy ``period`` < 2 m words on.

    Each difference between two progressions is proposed once, since all its pairs lie in one stretch.
    """
    high = 2 * m - 1
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    name = names[at]
    same = name[1:] == name[:-1]
    gap = np.diff(at)
    head = np.flatnonzero(np.r_[True, ~(same & (gap <= m // 2))]) if len(at) else np.empty(0, np.int64)
    tail = np.r_[head[1:], len(at)] - 1
    step = np.where(tail > head, at[np.minimum(head + 1, len(at) - 1)] - at[head], 0) if len(at) else head
    inner = step > 0
    place, period = [at[head[inner]]], [step[inner]]
    # progressions of a factor lie more than m / 2 apart, so only the next three can be less than 2 m away
    for ahead in (1, 2, 3):
        a, b = np.arange(len(head) - ahead), np.arange(ahead, len(head))
        near = (name[head[a]] == name[head[b]]) & (at[head[b]] - at[tail[a]] <= high)
        a, b = a[near], b[near]
        first = at[head[b]] - at[tail[a]]
        pitch = np.maximum(step[a], step[b])
        members = (tail[a] - head[a]) + (tail[b] - head[b])
        more = np.where(pitch > 0, np.minimum(members, (high - first) // np.maximum(pitch, 1)), 0)
        row, differ = _several(first, pitch, more + 1)
        back = np.minimum((differ - first[row]) // np.maximum(pitch[row], 1), (tail[a] - head[a])[row])
        place.append(at[tail[a]][row] - back * pitch[row])
        period.append(differ)
    return np.concatenate(place), np.concatenate(period)


def _extended(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and the word behind the longest stretch with the period around each place."""
    n = len(levels[0])
    top = len(levels) - 1
    right, left = place.copy(), place.copy()

    def equal(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (j < n)
        found = names[np.where(inside, i, 0)]
        return inside & (found >= 0) & (found == names[np.where(inside, j, 0)])

    # the longest factors may fit several times, each shorter one at most once behind them
    for k in range(top, -1, -1):
        moving = np.arange(len(place))
        while len(moving):
            moving = moving[equal(levels[k], right[moving], right[moving] + period[moving])]
            right[moving] += 1 << k
            moving = moving if k == top else moving[:0]
        moving = np.arange(len(place))
        while len(moving):
            moving = moving[equal(levels[k], left[moving] - (1 << k), left[moving] - (1 << k) + period[moving])]
            left[moving] -= 1 << k
            moving = moving if k == top else moving[:0]
    return left, right + period


def find_runs(words: np.ndarray, text: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, sorted; words are numbers, and ``text`` is the (ascending) text of each word."""
    levels = dictionary(words, text, longest)
    found = [np.empty((0, 3), np.int64)]
    for k, names in enumerate(levels):
        place, period = proposals(names, 1 << k)
        # the largest factor that surely fits into a run of this period together with its copy
        fits = np.floor(np.log2(np.maximum(least - period, period)))
        place, period = place[fits == k], period[fits == k]
        left, right = _extended(levels, place, period)
        keep = right - left >= np.maximum(least, 2 * period)
        found.append(np.stack([left[keep], right[keep], period[keep]], 1))
    every = np.unique(np.concatenate(found), axis=0)  # sorted by start, end, period
    new = np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)][:len(every)]
    every = every[new]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _answers(ids: list, texts: list[list[bytes]], least: int) -> Iterator[tuple]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = [w for t in texts for w in t]
    words = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = find_runs(words, text, int(sizes.max(initial=0)), least)
    # behind a run's first period its words go
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge)[:-1] > 0
    of = np.searchsorted(starts + sizes, start, side="right")
    first, last = np.searchsorted(of, np.arange(len(texts)), "left"), np.searchsorted(of, np.arange(len(texts)), "right")
    for i, (doc, own) in enumerate(zip(ids, texts)):
        runs = [{"start": int(s - starts[i]), "length": int(e - s), "period": int(p)}
                for s, e, p in zip(start[first[i]:last[i]], end[first[i]:last[i]], period[first[i]:last[i]])]
        kept = own
        if runs:
            drop = gone[starts[i]:starts[i] + sizes[i]]
            kept = [w for w, d in zip(own, drop.tolist()) if not d]
        yield doc, len(own), runs, b" ".join(kept).decode("utf-8", "replace")


def _searched(least: int):
    types = [pa.int64(), pa.int64(), pa.list_(RUN), pa.string()]
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def made(ids, texts) -> pa.RecordBatch:
        columns = list(zip(*_answers(ids, texts, least)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII blanks only
                if texts and size + len(words) > BATCH:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(words)
                size += len(words)
            if texts:
                yield made(ids, texts)

    return search


def runs(docs: DataFrame, text: Column | None = None, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words kept)."""
    text = F.col("text") if text is None else text
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("string").alias("text"))
    return rows.mapInArrow(_searched(least), SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The words of a text, in a tenth of the documents with a period of their own from some word on."""
    h = F.crc32(doc_id.cast("bigint").cast("string"))
    g = F.floor(h / 10)

    def plant(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        made = F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w))
        return F.array_join(F.when((h % 10 == 0) & (n > 0), made).otherwise(words), " ")

    return let(words_of(text), plant)


def report(docs: DataFrame) -> DataFrame:
    found = runs(docs, planted(F.col("doc_id"), F.col("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
