"""Language identification by prediction by partial matching.

Each language has a context tree over bytes up to order 3. A symbol that a context has not seen escapes to the next
shorter one (method C, with exclusion of what the longer context has seen), down to equal chances of the remaining
bytes. The statistics are frozen after learning, so a text's code length under each language is a sum of fixed costs,
and the shortest one wins; the score is the winner's share of the probability.

Learning takes labelled texts outside the held-out part, at most about ``SAMPLE`` for each language, chosen by hash:
this bound, and the number of times a context of order 3 must occur, bound the model that tasks load.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, as is every text if nothing was learned;
ties go to the language that sorts first; rows without an id are neither held out nor learned from; rows are judged one
by one, so repeated rows get their own results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hazlake.llm.common import small, stored

ORDER, SAMPLE, SEEN = 3, 3000, 8
HELD_OUT, FOLDS = 2, 4
_PAD = b"\n\n\n"
_CHUNK = 1 << 20


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Context of ``order`` bytes and the byte after it, as one number, for the bytes behind the padding."""
    n = len(data) - ORDER
    key = np.zeros(n, np.uint32)
    for i in range(order, -1, -1):
        key = (key << np.uint32(8)) | data[ORDER - i:ORDER - i + n]
    return key


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(_PAD + text.encode("utf-8", "surrogatepass"), np.uint8)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            data = [_bytes(t) for t in texts]
            for order in range(ORDER + 1):
                key, n = np.unique(np.concatenate([_grams(d, order) for d in data]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "len": order, "key": key.astype(np.int64), "n": n.astype(np.int64)})


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], dict[int, np.ndarray]]:
    """Languages, and for each order the rows (gram, language, count)."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = docs.where((part != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = known.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("rate"))
    rates = stored(rates, "language-rates")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(small(rates, rates.count(), 10_000), "lang").where(draw < F.col("rate")).select("lang", F.col("text").cast("string").alias("text"))
    counts = chosen.mapInPandas(_count, "lang string, len int, key long, n long").groupBy("lang", "len", "key").agg(F.sum("n").alias("n"))
    if_seen = counts.withColumn("context", F.shiftright("key", 8))
    often = if_seen.where(F.col("len") == ORDER).groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= SEEN).select("context")
    kept = if_seen.where(F.col("len") < ORDER).unionByName(if_seen.where(F.col("len") == ORDER).join(often, "context").select(*if_seen.columns))
    table = kept.select("lang", "len", "key", "n").toPandas()
    langs = sorted(table["lang"].unique().tolist())
    table["lang"] = table["lang"].map({x: i for i, x in enumerate(langs)})
    return langs, {k: table.loc[table["len"] == k, ["key", "lang", "n"]].to_numpy(np.int64) for k in range(ORDER + 1)}


class Model:
    """Costs in bits of each byte under each language, by the longest known context."""

    def __init__(self, langs: list[str], grams: dict[int, np.ndarray]) -> None:
        n_langs = len(langs)
        contexts = [np.unique(grams[k][:, 0] >> 8) if k else np.zeros(1, np.int64) for k in range(ORDER + 1)]
        first = np.cumsum([0, *map(len, contexts)])
        chance = np.empty((first[-1], 256, n_langs), np.float32)
        self.by = [None] * (ORDER + 1)
        for k, own in enumerate(contexts):
            seen = np.zeros((len(own), 256, n_langs), np.float32)
            rows = grams[k]
            where = np.searchsorted(own, rows[:, 0] >> 8) if k else np.zeros(len(rows), np.int64)
            seen[where, rows[:, 0] & 255, rows[:, 1]] = rows[:, 2]
            if k:
                # the parent drops the oldest byte; every parent of a known context is known
                shorter = own & ((1 << 8 * (k - 1)) - 1)
                parent = chance[first[k - 1] + np.searchsorted(contexts[k - 1], shorter)] if k > 1 else np.repeat(chance[:1], len(own), 0)
            else:
                parent = np.full((1, 256, n_langs), 1 / 256, np.float32)
            total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            rest = np.where(seen > 0, 0, parent).sum(1, keepdims=True)
            escape = np.where(rest > 0, kinds / np.maximum(total + kinds, 1), 0)
            scale = np.where(rest > 0, total + kinds, np.maximum(total, 1))
            mixed = np.where(seen > 0, seen / np.maximum(scale, 1), escape * parent / np.maximum(rest, 1e-30))
            chance[first[k]:first[k + 1]] = np.where(total > 0, mixed, parent)
        self.cost = -np.log2(np.maximum(chance, 1e-30)).reshape(-1, n_langs)
        one = np.zeros(256, np.int32)
        one[contexts[1]] = first[1] + np.arange(len(contexts[1]))
        two = np.tile(one, 256)  # the newest byte is the low one
        two[contexts[2]] = first[2] + np.arange(len(contexts[2]))
        three = np.repeat(np.arange(first[3], dtype=np.int32), 256).reshape(-1, 256)
        oldest, newer = contexts[3] >> 16, contexts[3] & 0xFFFF
        three[two[newer], oldest] = first[3] + np.arange(len(contexts[3]))
        self.two, self.three = two, three.ravel()

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Cost of each byte behind the padding under each language."""
        a, b, c, s = data[:-3].astype(np.int32), data[1:-2].astype(np.int32), data[2:-1].astype(np.int32), data[3:]
        node = self.three[self.two[b * 256 + c] * 256 + a]
        return self.cost[node * 256 + s]

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.cost.shape[1]))
        group, size = [], 0

        def close() -> None:
            if group:
                # each text brings its own padding, whose costs are left out
                cost = self.lengths(np.concatenate([d for _, d in group] + [np.zeros(0, np.uint8)]))
                ends = np.cumsum([len(d) for _, d in group])
                for (i, d), end in zip(group, ends):
                    out[i] += cost[end - len(d):end - 3].sum(0, dtype=np.float64)
                group.clear()

        for i, text in enumerate(texts):
            data = _bytes(text)
            for at in range(0, max(1, len(data) - 3), _CHUNK):
                part = data[at:at + _CHUNK + 3]
                group.append((i, part))
                size += len(part)
                if size > _CHUNK:
                    close()
                    size = 0
        close()
        return out


_loaded: dict[str, Model] = {}


def predict(docs: DataFrame, langs: list[str], grams: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if not langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared, name = docs.sparkSession.sparkContext.broadcast((langs, grams)), uuid.uuid4().hex

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if model is None:
                if name not in _loaded:  # once for each Python worker
                    _loaded.clear()
                    _loaded[name] = Model(*shared.value)
                model = _loaded[name]
            real = pdf["text"].notna().to_numpy()
            pred, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            if real.any():
                bits = model.code_lengths(pdf["text"][real].tolist())
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                pred[real], score[real] = np.array(shared.value[0], object)[best], share
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": pred, "score": score})

    return rows.mapInPandas(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(docs))
