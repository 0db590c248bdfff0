"""Nearest neighbours by randomly rotated one-bit codes.

Equal vectors are one point, which keeps only the smallest ids that a list of neighbours can name. Points lie in lists, one
for each centroid of an index fitted on a bounded sample. A point's code holds the signs of its rotated residual (vector
less centroid), packed to bits, with two correction scalars: the residual's length and the code's inner product with the
residual's direction. A query meets the points of a list in cells of bounded size. There it looks up the inner products of
its own residual with the packed bytes in tables, divides by the correction, and has an estimate of each distance with an
error bound. The k points of smallest upper bound are measured exactly, in double precision on the original vectors; the
largest of these distances is the threshold, and all points whose lower bound is within it are measured too.

The fit is bounded by ``SAMPLE`` numbers (at most 32,768 vectors at 128 dimensions): vectors of least hash. It gives the
centroids, one per ``LIST`` points and at most one per ``FIT`` sampled vectors, and the share of lists that queries visit:
the share that holds ``RECALL`` of the true neighbours of 256 sampled vectors within the sample, where neighbours lie
further apart than in the whole table. Every row is indexed. With one list all points are met, and a point is missed only
where the error bound (``EPSILON`` deviations, which holds for 95 % of the pairs) fails by more than it lies within.

Hot vectors are one point; hot lists are cut into cells by hash, of some ``CELL`` points by some ``ASKED`` queries; queries
of one vector are asked once per ``ASKED`` of them. No pair leaves a cell but a query's k best there.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite number take no part, nor do rows without an
id, which no answer could name; vectors of different lengths are searched apart; rows that repeat an id and vector are
rows of their own (each asks, and each is a neighbour of the other); ties go to the smaller id; fewer candidates than k
give fewer neighbours; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hazlake.llm.common import stored

K, EVERY = 10, 100
LIST, FIT, SAMPLE, RECALL = 4096, 32, 4_194_304, 0.98
CELL, ASKED = 4096, 512
EPSILON = 1.9
SEED = 20240513
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Centroids, rotation and the number of lists a query visits, for vectors of one length."""

    def __init__(self, sample: np.ndarray, points: int, per_list: int = LIST, recall: float = RECALL):
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0].astype(np.float32)
        lists = max(1, min(points // per_list, len(sample) // FIT))
        self.centroids = sample[rng.permutation(len(sample))[:lists]].astype(np.float32)
        for _ in range(10 if lists > 1 else 1):
            near = self.lists_of(sample, 1)[:, 0]
            sums = np.zeros((lists, self.dim))
            np.add.at(sums, near, sample)
            n = np.bincount(near, minlength=lists)
            self.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centroids).astype(np.float32)
        self.probes = self._probes(sample, rng, recall) if lists > 1 else 1

    def _probes(self, sample: np.ndarray, rng: np.random.Generator, recall: float) -> int:
        asked = rng.permutation(len(sample))[:256]
        order = self.lists_of(sample[asked], len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        own, k = self.lists_of(sample, 1)[:, 0], min(K, len(sample) - 1)
        apart = _squares(sample[asked], sample)
        apart[np.arange(len(asked)), asked] = np.inf
        found = np.argpartition(apart, k - 1, axis=1)[:, :k]
        return int(np.quantile(np.take_along_axis(place, own[found], axis=1), recall, method="higher")) + 1

    def lists_of(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of each vector, nearest first."""
        out = []
        for at in range(0, len(vectors), 8192):
            d = _squares(vectors[at:at + 8192], self.centroids)
            best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1))
            out.append(np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable"), axis=1))
        return np.concatenate(out) if out else np.empty((0, n), np.int64)

    def rotated(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated directions of the residuals, and their lengths."""
        residual = vectors.astype(np.float32) - self.centroids[lists]
        length = np.sqrt((residual.astype(np.float64) ** 2).sum(1))
        return (residual / np.maximum(length, 1e-30)[:, None].astype(np.float32)) @ self.rotation.T, length

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, residual lengths, and inner products of codes and directions."""
        turned, length = self.rotated(vectors, lists)
        return np.packbits(turned >= 0, axis=1), length, np.abs(turned).sum(1) / math.sqrt(self.dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)


def estimated(index: Index, asked: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of queries and the points of one list, from the codes."""
    turned, own = index.rotated(asked, np.full(len(asked), lists))
    turned = np.pad(turned, ((0, 0), (0, -index.dim % 8)))
    said = np.zeros((len(asked), len(codes)), np.float32)
    for byte in range(codes.shape[1]):
        table = turned[:, 8 * byte:8 * byte + 8] @ _BITS.T
        said += np.take(table, codes[:, byte], axis=1)
    fit = np.maximum(fit, 1e-6)
    cosine = said / (math.sqrt(index.dim) * fit)
    wrong = EPSILON * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2) / math.sqrt(max(1, index.dim - 1)) + 1e-5
    base, scale = own[:, None] ** 2 + length[None, :] ** 2, 2 * own[:, None] * length[None, :]
    slack = 1e-5 * base  # of single precision
    return base - scale * np.minimum(cosine + wrong, 1) - slack, base - scale * np.maximum(cosine - wrong, -1) + slack


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 1))


def _cell(index: Index, k: int):
    def search(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "point", "score"]
        if not len(points) or not len(asked):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "point": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        vectors, wanted = _matrix(points["vector"]), _matrix(asked["vector"])
        codes = np.frombuffer(b"".join(points["code"]), np.uint8).reshape(len(points), -1)
        low, high = estimated(index, wanted, codes, points["length"].to_numpy(), points["fit"].to_numpy(), int(key[0]))
        limit = np.full(len(wanted), np.inf)
        if k < len(points):
            first = vectors[np.argpartition(high, k - 1, axis=1)[:, :k]].astype(np.float64)
            limit = ((first - wanted[:, None, :].astype(np.float64)) ** 2).sum(2).max(1) * (1 + 1e-12)
        ids, queries, out = points["point"].to_numpy(), asked["query"].to_numpy(), []
        for i in range(len(wanted)):
            near = np.flatnonzero(low[i] <= limit[i])
            differ = vectors[near].astype(np.float64) - wanted[i].astype(np.float64)
            score = np.sqrt((differ * differ).sum(1))
            if len(near) > k:
                # all that tie with the k-th stay: the smaller id decides later
                within = score <= np.partition(score, k - 1)[k - 1]
                near, score = near[within], score[within]
            out.append(pd.DataFrame({"query": queries[i], "point": ids[near], "score": score}))
        return pd.concat(out)[columns]

    return search


def _of_one_length(points: DataFrame, asked: DataFrame, dim: int, n: int, k: int, per_list: int, recall: float) -> DataFrame:
    """query, point, score: the nearest points of each query, at least those of rank k or better."""
    spark = points.sparkSession
    size = max(1, min(n, SAMPLE // dim))
    drawn = points.select("vector", F.xxhash64(F.lit(SEED), "vector").alias("h")).orderBy("h", "vector").limit(size).select("vector")
    index = spark.sparkContext.broadcast(Index(np.array([r[0] for r in drawn.collect()], dtype=np.float32), n, per_list, recall))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = _matrix(pdf["vector"])
            own = index.value.lists_of(vectors, 1)[:, 0]
            codes, length, fit = index.value.encode(vectors, own)
            yield pdf.assign(list=own, code=[c.tobytes() for c in codes], length=length, fit=fit)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(lists=list(index.value.lists_of(_matrix(pdf["vector"]), index.value.probes)))

    coded = points.select("point", "vector").mapInPandas(encode, "point long, vector array<float>, list int, code binary, length double, fit double")
    coded = stored(coded, "codes")
    sizes = coded.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    routed = asked.select("query", "vector").mapInPandas(route, "query long, vector array<float>, lists array<int>")
    visits = stored(routed.select("query", "vector", F.explode("lists").alias("list")), "visits")
    crowds = visits.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / ASKED).cast("int").alias("crowds"))
    # a row per list, and lists are bounded by the fit
    cut = F.broadcast(sizes.join(crowds, "list"))
    spot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = coded.join(cut, "list").withColumn("part", spot("point", "parts")).select("*", every("crowds").alias("crowd"))
    right = visits.join(cut, "list").withColumn("crowd", spot("query", "crowds")).select("*", every("parts").alias("part"))
    left = left.select("list", "part", "crowd", "point", "vector", "code", "length", "fit").groupBy("list", "part", "crowd")
    right = right.select("list", "part", "crowd", "query", "vector").groupBy("list", "part", "crowd")
    return left.cogroup(right).applyInPandas(_cell(index.value, k), "query long, point long, score double")


def neighbours(embeddings: DataFrame, is_query: Column, k: int = K, vector: str = "embedding", key: str = "vec_id",
               per_list: int = LIST, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query row, by Euclidean distance."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("vector"), is_query.alias("asks"))
    rows = stored(rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # a list can name at most k rows of a point, and the asking row itself; each task keeps no more before the shuffle
    order = Window.partitionBy("vector").orderBy("id", "row")
    named = rows.select("vector", "id", "row").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    points = named.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("rows"))
    points = stored(points.withColumn("point", F.monotonically_increasing_id()), "points")
    n_asked = rows.where("asks").count()
    salt = F.pmod(F.xxhash64("row"), F.lit(-(-n_asked // ASKED) or 1))
    asked = rows.where("asks").groupBy("vector", salt.alias("salt")).agg(F.collect_list(F.struct("id", "row")).alias("asking"))
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    found = []
    for dim, n in sorted(points.groupBy(F.size("vector")).count().collect()):
        own = F.size("vector") == dim
        found.append(_of_one_length(points.where(own), asked.where(own), dim, n, k + 1, per_list, recall))
    empty = spark.createDataFrame([], "query long, point long, score double")
    met = reduce(DataFrame.unionByName, found, empty)
    # by score alone, the k + 1 nearest points and all that tie with the last of them hold every row of the answer
    nearest = met.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy("score"))).where(F.col("place") <= k + 1)
    listed = nearest.join(points.select("point", "rows"), "point").select("query", "score", F.explode("rows").alias("to"))
    best = listed.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "to.id", "to.row"))).where(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "to", "score"))).alias("best"))
    each = best.join(asked.select("query", "asking"), "query").select(F.explode("asking").alias("own"), "best")
    others = F.slice(F.filter("best", lambda b: b["to"]["row"] != F.col("own.row")), 1, k)
    each = each.select(F.col("own.id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.to.id").alias("vec_id"), F.col("b.score").alias("score"))


def report(embeddings: DataFrame) -> DataFrame:
    return neighbours(embeddings, F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))
