"""Approximate nearest neighbours: a forest of hash prefixes.

Each tree gives a vector a long hash string of sign bits: random projections of the vector, balanced at the medians of a
bounded sample. Sorted by its string, a tree is one sorted array; it is stored in blocks of equal leading bits. A query
descends each tree to its longest matching prefix, and all trees ascend together: the deepest level is sought at which the
prefixes shared with the query cover enough candidates over all trees; they are compared by exact cosine in double precision.
How many are enough is measured on the sample against brute force, so a forest that needs many candidates takes many.

Equal vectors are one entry that carries its few smallest ids, so copies never crowd a block. Blocks that hold more than
their share of entries are dealt out in parts. Levels above a block reach over several blocks: the query visits each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, need

TREES, BITS = 16, 48
#: Rows that medians and the number of candidates are fitted on, and the queries among them.
SAMPLE, PROBES = 4096, 256
#: Entries of a block, and what part of the neighbours the sample must find.
BLOCK, AIM = 4096, 0.95


class Forest:
    """Projections, medians, and how many candidates a query has to see, in shares of all entries, summed over the trees."""

    def __init__(self, sample: np.ndarray, near: int, seed: int = 5):
        dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(dim, TREES * BITS))
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.medians = np.median(unit @ self.axes, axis=0)
        self.share = self._calibrate(unit, near)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """Rows x trees: hash strings as numbers, the first bit highest."""
        bits = (unit @ self.axes > self.medians).reshape(len(unit), TREES, BITS)
        return bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def _calibrate(self, unit: np.ndarray, near: int) -> float:
        n = len(unit)
        if n <= near + 1:
            return float(TREES)
        probes = np.linspace(0, n - 1, min(PROBES, n)).astype(int)
        codes = self.strings(unit)
        cosine = unit[probes] @ unit.T
        cosine[np.arange(len(probes)), probes] = -2
        best = np.argsort(-cosine, axis=1)[:, :near]
        depth = np.zeros((len(probes), n), dtype=np.int8)
        for t in range(TREES):
            np.maximum(depth, _common(codes[probes, t][:, None], codes[None, :, t]), out=depth)
        for share in np.geomspace(0.02, TREES, 60):
            hit = 0
            for k in range(len(probes)):
                # deepest level whose prefixes cover the share, counted over all trees as a search counts them
                counts = _level_counts(codes[probes[k]], codes)
                level = int(np.flatnonzero(counts >= share * n - 1e-9)[-1])
                hit += (depth[k, best[k]] >= level).sum()
            if hit >= AIM * near * len(probes):
                return float(share)
        return float(TREES)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings of BITS bits."""
    x = (a ^ b).astype(np.uint64)
    return (BITS - np.where(x == 0, 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))) + 1)).astype(np.int8)


def _level_counts(query: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Over all trees: how many entries share at least the first k bits, for k = 0 to BITS."""
    length = _common(query[None, :], codes).ravel()
    return np.bincount(length, minlength=BITS + 1)[::-1].cumsum()[::-1]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])


def search(vectors: DataFrame, is_query, near: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``near`` nearest rows found for each row that ``is_query`` selects.

    Largest cosine first, ties to the smaller id, the query's own row left out; fewer rows if there are fewer. Vectors that
    are null, empty, zero, or have null or non-finite components take no part, nor do rows with a null id or a dimension
    other than the most frequent one. Rows that repeat an id count once. Empty tables: no rows.
    """
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    place = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= near + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # near + 1 ids each
    asking = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    entries = cut(least.join(asking, "v").select(F.xxhash64("v").alias("entry"), "v", "ids", "asks"))
    sizes = entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim, n = sizes["d"], sizes["n"]
    entries = entries.filter(F.size("v") == dim)
    sample = np.array([r.v for r in entries.orderBy("entry").limit(SAMPLE).select("v").collect()])
    forest = Forest(sample, near)
    shared = spark.sparkContext.broadcast(forest)
    enough = forest.share * n - 1e-6
    depth = int(max(0, min(20, np.floor(np.log2(max(1, n / block))))))  # leading bits of a block

    @F.pandas_udf("array<long>")
    def strings(vs: pd.Series) -> pd.Series:
        x = np.array(vs.tolist())
        return pd.Series(list(shared.value.strings(x / np.linalg.norm(x, axis=1, keepdims=True)))) if len(x) else pd.Series([], dtype=object)

    coded = cut(entries.withColumn("codes", strings("v")))
    indexed = coded.select("entry", "v", "ids", F.posexplode("codes").alias("tree", "code")).withColumn("prefix", F.shiftright("code", BITS - depth))
    blocks = indexed.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
    parts = cut(blocks)
    inside = indexed.join(parts, ["tree", "prefix"]).withColumn("part", F.expr("pmod(xxhash64(entry), parts)"))
    queries = coded.filter("asks").select(F.col("entry").alias("query"), F.col("v").alias("qv"), F.posexplode("codes").alias("tree", "code"))

    # Descent: how many entries share the first k bits, for each query, summed over the trees.
    own = queries.withColumn("prefix", F.shiftright("code", BITS - depth)).join(parts, ["tree", "prefix"]).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))

    def descend(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(held["code"].to_numpy())
        out = []
        for query, code in zip(asked["query"], asked["code"]):
            levels = np.arange(depth, BITS + 1)
            low = (code >> (BITS - levels)) << (BITS - levels)
            counts = np.searchsorted(codes, low + (1 << (BITS - levels)), side="left") - np.searchsorted(codes, low, side="left")
            out.append((query, counts.astype(np.int64)))
        return pd.DataFrame(out, columns=["query", "counts"])

    met = own.select("tree", "prefix", "part", "query", "code").groupBy("tree", "prefix", "part").cogroup(inside.select("tree", "prefix", "part", "code").groupBy("tree", "prefix", "part")).applyInPandas(descend, "query long, counts array<long>")
    deep = met.select("query", F.posexplode("counts").alias("k", "c")).select("query", (F.col("k") + depth).alias("level"), "c")
    sized = indexed.groupBy("tree", "prefix").agg(F.count("*").alias("c"))
    upper = sized.select("tree", "c", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "prefix").filter(F.col("level") < depth)
    upper = upper.groupBy("tree", "level", F.expr(f"shiftright(prefix, {depth} - level)").alias("p")).agg(F.sum("c").alias("c"))
    high = queries.select("query", "tree", "code", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).filter(F.col("level") < depth).withColumn("p", F.expr(f"shiftright(code, {BITS} - level)"))
    high = high.join(upper, ["tree", "level", "p"]).select("query", "level", "c")
    covered = deep.unionByName(high).groupBy("query", "level").agg(F.sum("c").alias("c"))
    level = cut(covered.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("c") >= enough, F.col("level"))), F.lit(0)).alias("level")))

    # Ascent: every tree offers what shares the first ``level`` bits; above the blocks that is several of them.
    wide = queries.join(level, "query")
    span = f"greatest(0, {depth} - level)"
    first = f"shiftleft(shiftright(code, {BITS} - least(level, {depth})), {span})"
    visits = wide.withColumn("prefix", F.explode(F.expr(f"sequence({first}, {first} + shiftleft(1L, {span}) - 1)"))).join(parts, ["tree", "prefix"]).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame([], columns=["query", "entry", "ids", "score"])
        vectors_, codes = np.array(held["v"].tolist()), held["code"].to_numpy()
        entries_, ids = held["entry"].to_numpy(), held["ids"].to_numpy()
        smallest = np.array([i[0] for i in ids])
        out = []
        for k in range(0, len(asked), 256):
            some = asked.iloc[k : k + 256]
            scores = _cosine(np.array(some["qv"].tolist()), vectors_)
            shift = BITS - some["level"].to_numpy()
            far = (some["code"].to_numpy() >> shift)[:, None] != (codes[None, :] >> shift[:, None])
            scores[far] = -3
            for q, row in zip(some["query"], scores):
                ok = np.flatnonzero(row > -3)
                if len(ok) > near + 1:
                    worst = np.partition(row[ok], len(ok) - near - 1)[len(ok) - near - 1]
                    ok = ok[row[ok] >= worst]
                ok = ok[np.lexsort((smallest[ok], -row[ok]))][: near + 1]
                out.extend((q, entries_[j], ids[j], float(row[j])) for j in ok)
        return pd.DataFrame(out, columns=["query", "entry", "ids", "score"])

    keys = ["tree", "prefix", "part"]
    offers = visits.select(*keys, "query", "qv", "code", "level").groupBy(*keys).cogroup(inside.select(*keys, "entry", "v", "ids", "code").groupBy(*keys)).applyInPandas(compare, "query long, entry long, ids array<long>, score double")
    offers = offers.groupBy("query", "entry").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    hits = offers.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= near + 1).select("query", "vec_id", "score")

    asked = rows.filter("asks").filter(F.size("v") == dim).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("query"))
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("found"))  # near + 1 each
    pairs = asked.join(lists, "query").select("query_id", F.posexplode(F.slice(F.expr("filter(found, f -> f.vec_id <> query_id)"), 1, near)).alias("k", "f"))
    return pairs.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
