"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document gets a rate: how many copies of it the mix holds on average. Among all rates that meet each source's token
target and stay below the cap, those of least relative entropy to "one copy each" are exp(lambda * size), cut at the cap;
lambda solves the convex dual of that problem. Its Newton steps are sums over all documents, grouped by source, kept inside
a bracket that always holds the root. Rates become whole copies by rounding running sums, so that what a source takes stays
within its largest document of its target; a few documents, one for each power of two of the size, then take up the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, need

#: Documents of one source and size are dealt out over so many buckets; each bucket ranks its own documents.
SALTS = 32


def word_count(text_col: str):
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """``_source, source_rank, source_size, target`` from rows of (_source, _size, n): one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. They get ``share`` of all sizes by weight; what exceeds
    ``cap`` times a source's size goes to the others by weight. That is min(cap * size, level * weight) at the one level
    that spends everything; it follows from running sums over the sources in the order in which they reach their caps.
    """
    per = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("source_rank", rank)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_rank", F.lit(len(weights))) + 1).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", "source_rank")
    every = Window.partitionBy()
    per = per.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    return per.select("_source", "source_rank", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _balance(cells: DataFrame, plan: DataFrame, cap: float, tolerance: float, rounds: int) -> DataFrame:
    """``source_rank, scale, lam``: Newton on the dual for all sources at once; cells are (source_rank, _size, n)."""
    shape = cells.filter("_size > 0").groupBy("source_rank").agg(F.sum("n").alias("docs"), F.min("_size").alias("least"))
    state = plan.join(shape, "source_rank").filter("target > 0")
    state = state.withColumn("scale", F.col("source_size") / F.col("docs")).withColumn("x0", F.col("least") / F.col("scale"))
    grow = F.log(F.col("target") / F.col("source_size"))
    state = state.withColumn("lo", F.least(F.lit(0.0), grow / F.col("x0"))).withColumn("hi", F.when(grow <= 0, 0.0).otherwise(F.lit(math.log(cap)) / F.col("x0")))
    state = cut(state.select("source_rank", "target", "scale", "lo", "hi", F.greatest("lo", F.least("hi", grow)).alias("lam")))
    for _ in range(rounds):
        x = F.col("_size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap))))
        sums = cells.join(state, "source_rank").groupBy("source_rank").agg(
            F.sum(F.col("n") * F.col("_size") * rate).alias("got"),
            F.sum(F.when(F.col("lam") * x < math.log(cap), F.col("n") * F.col("_size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        new = state.join(sums, "source_rank").withColumn("off", F.abs(gap) / F.col("target"))
        new = new.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - F.try_divide(gap, F.col("slope"))
        step = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = cut(new.select("source_rank", "target", "scale", "lo", "hi", F.when(F.col("off") <= tolerance, F.col("lam")).otherwise(step).alias("lam"), "off"))
        state = new.drop("off")
        if (new.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("source_rank", "scale", "lam")


def _correct(cells: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """``source_rank, _size, change``: copies to add to or take from one cell for each power of two of the size."""
    got = cells.groupBy("source_rank").agg(F.sum(F.col("k") * F.col("_size")).alias("got"))
    picked = cells.filter("_size > 0").groupBy("source_rank", F.floor(F.log2("_size")).alias("power")).agg(F.max(F.struct("n", "_size", "k")).alias("s"))
    lists = picked.groupBy("source_rank").agg(F.sort_array(F.collect_list(F.struct("s._size", "s.n", "s.k")), asc=False).alias("cells"))  # at most 63 for each source
    step = (
        "aggregate(cells, named_struct('rest', rest, 'out', cast(array() as array<struct<_size: bigint, change: bigint>>)), (a, c) -> "
        f"named_struct('rest', a.rest - c._size * greatest(-c.k, least({cap} * c.n - c.k, cast(round(a.rest / c._size) as bigint))), "
        f"'out', array_append(a.out, named_struct('_size', c._size, 'change', greatest(-c.k, least({cap} * c.n - c.k, cast(round(a.rest / c._size) as bigint)))))))"
    )
    rest = lists.join(plan, "source_rank").join(got, "source_rank").withColumn("rest", F.col("target") - F.col("got"))
    return rest.select("source_rank", F.explode(F.expr(step)["out"]).alias("c")).select("source_rank", "c.*")


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, size_col: str | None, share: float, weights: tuple[int, ...], cap: int, tolerance: float, rounds: int) -> DataFrame:
    """``docs`` with its columns named c0, c1 and so on, so that no name of theirs is in the way, and the four new columns."""
    need(docs, id_col, source_col)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*at.values())
    sized = docs.withColumn("mix_size", F.col(at[size_col]).cast("long") if size_col else word_count(at[text_col]))
    rows = sized.withColumn("_source", F.col(at[source_col])).withColumn("_order", F.xxhash64(F.col(at[id_col]))).withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(SALTS)))
    buckets = cut(rows.groupBy("_source", F.col("mix_size").alias("_size"), "_salt").agg(F.count("*").alias("n")))
    plan = cut(targets(buckets, share, weights, float(cap)))
    source = plan.select(F.col("_source").alias("_named"), "source_rank")
    buckets = cut(buckets.join(source, F.col("_source").eqNullSafe(F.col("_named"))).select("source_rank", "_size", "_salt", "n"))
    cells = cut(buckets.groupBy("source_rank", "_size").agg(F.sum("n").alias("n")))
    dual = _balance(cells, plan, float(cap), tolerance, rounds)

    rate = F.when(F.col("lam").isNull() | (F.col("_size") == 0), 0.0).otherwise(F.exp(F.least(F.col("lam") * F.col("_size") / F.col("scale"), F.lit(math.log(cap)))))
    rated = cells.join(dual, "source_rank", "left").withColumn("ideal", F.col("n") * rate)
    down = Window.partitionBy("source_rank").orderBy(F.desc("_size"))
    run = F.sum("ideal").over(down)
    rated = rated.withColumn("run", run).withColumn("k", F.least(F.col("n") * cap, (F.round("run") - F.round(F.col("run") - F.col("ideal"))).cast("long")))
    rated = cut(rated.select("source_rank", "_size", "n", "k"))
    copies = rated.join(_correct(rated, plan, cap), ["source_rank", "_size"], "left").withColumn("k", F.col("k") + F.coalesce("change", F.lit(0)))
    copies = copies.select("source_rank", "_size", F.floor(F.col("k") / F.col("n")).alias("base"), F.expr("k - floor(k / n) * n").alias("extra"), F.col("n").alias("docs"))

    share_of = buckets.join(copies, ["source_rank", "_size"]).withColumn("upto", F.expr("sum(n) over (partition by source_rank, _size order by _salt)"))
    part = F.expr("floor(upto * extra / docs) - floor((upto - n) * extra / docs)")
    chosen = share_of.select("source_rank", "_size", "_salt", "base", part.alias("more")).join(plan, "source_rank")
    chosen = chosen.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_salt").alias("_b"), "base", "more", "source_size", "target")
    on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("mix_size") == F.col("_z")) & (F.col("_salt") == F.col("_b"))
    place = F.row_number().over(Window.partitionBy("_source", "mix_size", "_salt").orderBy("_order"))
    out = rows.join(chosen, on).withColumn("_place", place)
    return out.select(*docs.columns, "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("base") + F.when(F.col("_place") <= F.col("more"), 1).otherwise(0)).cast("long").alias("mix_copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: int = 2, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies`` (0 to ``cap`` copies of each row).

    ``size_col`` may name a column of sizes; else words of ``text_col`` are counted. A source may be null (it is one
    source, last in order). Documents of size 0 get no copy: they add nothing to any target. Repeated rows count each.
    Among documents of one source and size the hash of the id decides, so reruns agree. Other columns may have any names; those
    of the four new names are replaced. Null and empty texts have size 0. Empty tables: no rows.
    """
    mixed = _mixed(docs, id_col, source_col, text_col, size_col, share, weights, cap, tolerance, rounds)
    new = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    return mixed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new), *new)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: int = 2, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies (0 to ``cap``), with the columns of ``docs``.

    Cases as in :func:`mix_sources`: rows of null or empty texts have no copies, a null source is a source, repeated rows count each.
    """
    mixed = _mixed(docs, id_col, source_col, text_col, size_col, share, weights, cap, tolerance, rounds)
    copies = mixed.withColumn("_copy", F.explode(F.expr("if(mix_copies > 0, sequence(1L, mix_copies), cast(array() as array<bigint>))")))
    return copies.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
