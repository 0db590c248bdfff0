"""Near duplicates by circulant MinHash, banding and exact verification.

One permutation of the shingle hashes scatters them over the places of a circle, a second one gives each place its
rank; signature coordinate k is the smallest rank after the places are shifted by k. Bands of the signature propose
pairs, and every link is confirmed on the full shingle sets. With 3 rows in 30 bands a pair at the threshold of 0.75 is
missed with probability 7e-8.

Documents of one shingle set form a class, and only a class's smallest document goes on. A bucket never emits all its
pairs. First each member is compared with the bucket's smallest one. In a bucket whose other members then lie in several
components, those that cannot be linked with anything left go by an exact bound on the shingles they share with any other
open text. The rest meet in cells: the members outside the bucket's largest component with that component and with each
other, in blocks of bounded shingle counts, each text once a cell and only links coming out. So no link between
components is left out and no bucket is cut short.

Defined cases: texts without words have an empty set and are linked with nothing; a text of one to four words has one
shingle; rows without an id come behind all others (their component is null if none has an id); rows that repeat id and
text share their results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hazlake.llm.common import doc_id_of, stored, whole_row, with_key

SHINGLE, SIMILARITY = 5, 75
BANDS, ROWS = 30, 3
CIRCLE = 1 << 16
#: Shingles of a block; a cell holds two blocks, and its members are dealt by hash.
BLOCK = 500_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_AZ = bytes.maketrans(_UPPER, _LOWER)
_RANKS = np.random.default_rng(20240229).permutation(CIRCLE).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words as bytes, A-Z lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_AZ).split()
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = min(size, len(h))
    n = len(h) - size + 1
    acc = np.full(n, size, np.uint64)
    for i in range(size):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(acc)


def signature(hashes: np.ndarray, length: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: the smallest rank over the set for each shift of the circle.

    The first permutation is the bijection that gives a hash its place and its own low bits; a shift moves the place,
    whose rank comes from the second permutation, and the low bits settle hashes of one place.
    """
    p = _mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    place, rest = (p >> np.uint64(48)).astype(np.int64), p & np.uint64(0xFFFFFFFFFFFF)
    out = np.empty(length, np.uint64)
    step = max(1, 2_000_000 // max(1, len(p)))
    for k in range(0, length, step):
        shift = np.arange(k, min(length, k + step))[:, None]
        ranks = _RANKS[(place[None, :] + shift) & (CIRCLE - 1)].astype(np.uint64)
        out[k:k + step] = ((ranks << np.uint64(48)) | rest[None, :]).min(axis=1)
    return out


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for pdf in batches:
        rows = []
        for did, th, text in zip(pdf["did"], pdf["th"], pdf["text"]):
            s = shingle_set(text)
            if not len(s):
                rows.append((did, th, 0, 0, 0, None))
                continue
            band = signature(s).reshape(BANDS, ROWS)
            b = salt.copy()
            for r in range(ROWS):
                b = _mix(b * np.uint64(0x9E3779B97F4A7C15) + band[:, r])
            with np.errstate(over="ignore"):
                c1, c2 = s.sum(dtype=np.uint64), _mix(s).sum(dtype=np.uint64)
            rows.append((did, th, len(s), int(c1.astype(np.int64)), int(c2.astype(np.int64)), b.astype(np.int64)))
        yield pd.DataFrame(rows, columns=["did", "th", "n", "c1", "c2", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """did, th, n (set size), c1 and c2 (which name the set), bands."""
    return with_key(docs).mapInPandas(_signatures, "did long, th long, n long, c1 long, c2 long, bands array<long>")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    text, x = None, shingle_set(None)
    for pdf in batches:
        keep = []
        for at, bt in zip(pdf["at"], pdf["bt"]):
            if at != text:  # pairs come sorted by the centre
                text, x = at, shingle_set(at)
            y = shingle_set(bt)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        yield pdf.loc[keep, ["a_did", "a_th", "b_did", "b_th"]]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for the nodes of the edges (a, b). Alternating large and small stars."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(small.select("u", "m").union(small.select("v", "m")).where("u != m").distinct().toDF("u", "v"), "edges")
        now = state()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per (did, th): n, rep (did, th) of its class, comp (did, th): the smallest member of its component."""
    sig = stored(signatures(docs), "signatures")
    full = sig.where("n > 0")
    node = F.struct("did", "th").alias("node")
    classes = stored(full.groupBy("c1", "c2").agg(F.min(F.struct("did", "th")).alias("rep"), F.max("n").alias("n")), "classes")
    reps = classes.select(F.col("rep.did").alias("did"), F.col("rep.th").alias("th"))
    banded = full.select("did", "th", "n", "bands").join(reps, ["did", "th"]).dropDuplicates(["did", "th"])
    spots = banded.select("did", "th", "n", F.explode("bands").alias("bucket"))
    shared = spots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    spots = stored(spots.join(shared, "bucket").select("bucket", node, "n"), "buckets")
    low = spots.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("low"))
    spots = stored(spots.join(low, "bucket").where("node != low.node").select("bucket", "node", "n", "low"), "members")
    paired = spots.select(F.col("node").alias("b"), F.col("low.node").alias("a")).distinct()
    texts = with_key(docs).join(paired.select("b.*").union(paired.select("a.*")).distinct(), ["did", "th"], "left_semi")
    texts = stored(texts.dropDuplicates(["did", "th"]).select(node, "text"), "texts")
    links = stored(_linked(spots, texts), "links")
    comps = components(links)
    rest = spots.select("bucket", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = stored(_mixed(rest), "open")
    sets = texts.join(rest.select("node").distinct(), "node", "left_semi").select("node.did", "node.th", "text")
    sets = stored(sets.mapInPandas(_sets, "did long, th long, s array<long>").select(node, "s"), "sets")
    more = stored(_settle(stored(_possible(rest, sets), "possible"), sets), "links")
    label = classes.select("c1", "c2", "rep").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    per_class = label.select("c1", "c2", F.coalesce("comp", "rep").alias("comp"), "rep")
    if not more.isEmpty():  # these links join components, so each component is one node of them
        joined = components(_contracted(more, comps)).select(F.col("node").alias("comp"), F.col("comp").alias("low"))
        per_class = per_class.join(joined, "comp", "left").select("c1", "c2", F.coalesce("low", "comp").alias("comp"), "rep")
    named = sig.join(per_class, ["c1", "c2"], "left")
    return named.select("did", "th", "n", *[F.when(F.col("n") > 0, F.col(c)).otherwise(F.struct("did", "th")).alias(c) for c in ("rep", "comp")])


def _contracted(links: DataFrame, comps: DataFrame) -> DataFrame:
    """The links (a, b) with each end replaced by the smallest node of its component."""
    for end in ("a", "b"):
        named = comps.select(F.col("node").alias(end), "comp")
        links = links.join(named, end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    return links


def _pair(name: str) -> Column:
    return F.struct(F.col(f"{name}_did").alias("did"), F.col(f"{name}_th").alias("th")).alias(name)


def _linked(spots: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the members of buckets and their buckets' smallest ones."""
    pairs = spots.where(7 * F.least("n", "low.n") >= 3 * (F.col("n") + F.col("low.n")))
    pairs = pairs.select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()
    read = pairs.join(texts.toDF("b", "bt"), "b").join(texts.toDF("a", "at"), "a")
    flat = read.select(F.col("a.did").alias("a_did"), F.col("a.th").alias("a_th"), F.col("b.did").alias("b_did"), F.col("b.th").alias("b_th"), "at", "bt")
    found = flat.mapInPandas(_verify, "a_did long, a_th long, b_did long, b_th long")
    return found.select(_pair("a"), _pair("b"))


def _mixed(spots: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    several = spots.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
    return spots.join(several, "bucket", "left_semi")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"did": pdf["did"], "th": pdf["th"], "s": [shingle_set(x).astype(np.int64) for x in pdf["text"]]})


def _possible(spots: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds m, the shingles that a member shares with any other of these texts, and drops members that cannot be linked.

    The intersection with a partner is at most m, and the partner has at least the bucket's smallest set, so a member
    with 7 m < 3 (n + smallest) is below the similarity with all of them: 100 i >= 75 (n + k - i) means 7 i >= 3 (n + k).
    """
    alone = sets.select("node", F.explode("s").alias("s")).groupBy("s").agg(
        F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("u"))
    low = spots.groupBy("bucket").agg(F.min("n").alias("low"))
    known = spots.join(alone, "node", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    return known.join(low, "bucket").where(7 * F.col("m") >= 3 * (F.col("n") + F.col("low"))).drop("low")


def _settle(spots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join all components whose members in one bucket are linked.

    A bucket's largest component (main) needs no pairs of its own. Its blocks meet the blocks of all other members, and
    these meet each other; a cell is one such pair of blocks.
    """
    per = spots.groupBy("bucket", "comp").agg(F.sum("n").alias("size"))
    split = per.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("total"))
    blocks = split.where("total > main.size").select(
        "bucket", F.col("main.comp").alias("main"), F.ceil(F.col("main.size") / BLOCK).alias("mains"),
        F.ceil((F.col("total") - F.col("main.size")) / BLOCK).alias("others"))
    placed = spots.join(blocks, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    every = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    with_main = F.transform(every("mains"), lambda i: cell("main", i, F.col("block")))
    with_others = F.transform(every("others"), lambda j: cell("other", F.least("block", j), F.greatest("block", j)))
    cells = F.when(F.col("is_main"), F.transform(every("others"), lambda j: cell("main", F.col("block"), j)))
    cells = placed.withColumn("block", at).select(
        "node", "n", "m", "comp", "is_main", "bucket", F.explode(cells.otherwise(F.concat(with_main, with_others))).alias("cell"))
    read = cells.join(sets, "node").select(
        "bucket", "cell.*", "node.*", "n", "m", F.col("comp.did").alias("c_did"), F.col("comp.th").alias("c_th"), "is_main", "s")
    found = read.groupBy("bucket", "kind", "i", "j").applyInPandas(_cell_links, "a_did long, a_th long, b_did long, b_th long")
    return found.distinct().select(_pair("a"), _pair("b"))


def _cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of a cell, counted on full sets.

    A link within what earlier links of the cell have joined adds nothing, so there are fewer links than components.
    """
    found = []
    n, m, main = (cell[c].to_numpy() for c in ("n", "m", "is_main"))
    part = cell.groupby(["c_did", "c_th"]).ngroup().to_numpy().copy()
    ids = np.unique(np.concatenate(cell["s"].to_list()), return_inverse=True)[1]
    ends = np.cumsum(n)
    mark = np.zeros(int(ids.max()) + 1, bool)
    for y in np.flatnonzero(~main):
        apart = (part != part[y]) & (7 * np.minimum(m, m[y]) >= 3 * (n + n[y]))
        if cell["kind"].iat[0] == "main":
            apart &= main
        if not apart.any():
            continue
        own = ids[ends[y] - n[y]:ends[y]]
        mark[own] = True
        both = np.add.reduceat(mark[ids], ends - n)
        mark[own] = False
        near = np.flatnonzero(apart & (100 * both >= SIMILARITY * (n + n[y] - both)))
        if len(near):
            joined, first = np.unique(part[near], return_index=True)
            found += [(y, x) for x in near[first]]
            part[np.isin(part, joined)] = part[y]
    pair = np.array(found, dtype=np.int64).reshape(-1, 2)
    did, th = cell["did"].to_numpy(), cell["th"].to_numpy()
    return pd.DataFrame({"a_did": did[pair[:, 0]], "a_th": th[pair[:, 0]], "b_did": did[pair[:, 1]], "b_th": th[pair[:, 1]]})


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    component = doc_id_of(F.col("comp.did"))
    return found.select(doc_id_of(F.col("did")).alias("doc_id"), F.col("n").alias("n_shingles"),
                        component.alias("component_id"), (F.col("comp.did") == F.col("did")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of documents for each group of near duplicates, with all its columns.

    Rows without words stay; of rows that repeat id and text one stays.
    """
    keep = near_duplicates(docs).where(F.col("comp") == F.struct("did", "th")).select("did", "th").distinct()
    rows = with_key(docs, whole_row(docs)).drop("text")
    return rows.join(keep, ["did", "th"]).dropDuplicates(["did", "th"]).select("row.*")
