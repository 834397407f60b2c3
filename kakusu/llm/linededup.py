"""Line dedup as an exact set-similarity join, with DataFrame functions only.

A line is the set of its words, lower-cased. Sets are put in a global order, rare words first (corpus counts in a fixed
number of buckets, then the word's hash), so that two sets of Jaccard >= 0.8 must share a word within their first
n - ceil(0.8 n) + 1 ones. Only these prefix words are dealt out. In the join, pairs are tested by length, by position (what
can still overlap behind the shared word) and by maps of 128 bits of each set: a bit that one map has alone is a word that
the other set lacks. What remains is verified on the whole sets: the earliest partner of each line, and all others where
that one fails. A line goes if any earlier line matches it.

Equal sets are one class from the start, so copies never pair. Ahead of the join each class is compared with the earliest
classes that have the same least and greatest word hash, for two orders of the hashes; only classes without such a likely match, or whose likely match fails
the verification, look for partners in the join. That keeps large groups of near-copies linear and the result exact.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, keep, need

#: Buckets of the word counts that order words by rarity: a fixed size, whatever the corpus. Words that share a bucket rank
#: by their sum, so a vocabulary far larger than this blurs the order: more pairs are tested, the result is the same.
BUCKETS = 1 << 18
#: Up to so many rows a side of a join is broadcast; beyond, both sides are shuffled.
SMALL = 200_000
_BLANKS = "\\t\\r\\u000B\\u000C"


def _split(line: str) -> str:
    """The words of a line, lower-cased, with empty ones between blanks in a row."""
    odd = " or ".join(f"contains({line}, '{c}')" for c in ("\\t", "\\r", "\\u000B", "\\u000C"))
    return f"split(if({odd}, translate(lower({line}), '{_BLANKS}', '    '), lower({line})), ' ')"


def _hashes(line: str) -> str:
    """Hashes of the distinct words of a line."""
    return f"array_remove(array_distinct(transform({_split(line)}, w -> xxhash64(w))), xxhash64(''))"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("_id", "_copy", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))


def _rarity(hashed: DataFrame) -> Column:
    """Class of each bucket of word hashes, 0 to 127 by the logarithm of its count over all lines: an array that folds to a literal."""
    buckets = hashed.select(F.explode("hs").alias("h")).select(F.expr(f"h & {BUCKETS - 1}L").alias("b"))
    counts = buckets.groupBy("b").agg(F.count("*").alias("n"))
    rank = F.least(F.lit(127), (F.log2("n") * 4).cast("int") + 1)
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("b", rank.alias("r")))).alias("ranks")).first()["ranks"] or {}  # at most BUCKETS entries
    return F.split(F.lit(",".join(str(found.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<bigint>")


def _enough(nx: str, ny: str, both: str) -> str:
    """Jaccard >= 0.8, for an overlap ``both`` of sets of these sizes."""
    return f"9 * ({both}) >= 4 * ({nx} + {ny})"


#: Bits of the words whose hash has this bit clear (~) or set, without a branch.
_MAP = "aggregate(hs, 0L, (m, h) -> m | shiftleft({side}shiftright(h, 12) & 1L, cast(h & 63L as int)))"
_ALONE = lambda x, y: f"(bit_count({x}.m0 & ~{y}.m0) + bit_count({x}.m1 & ~{y}.m1))"
_NEAR = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)"
_FITS = _enough("x.n", "y.n", f"least(x.n - {_ALONE('x', 'y')}, y.n - {_ALONE('y', 'x')})")
_EARLIER = "(x.id < y.id or (x.id = y.id and (x.pos < y.pos or (x.pos = y.pos and x.cls < y.cls))))"
_PLACE = ["_id", "_copy", "pos"]


def _tokens(ranks: Column) -> Column:
    """The hashes ``hs`` behind their ranks, ascending. They are never null: then plain numbers are sorted, not objects."""
    code = lambda h: F.shiftleft(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1))), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform("hs", lambda h: F.coalesce(code(h), F.lit(0).cast("long"))))


def _encoded(base: DataFrame) -> DataFrame:
    """Each line with words: its place, class (two hashes of its set), size, maps, two kins and prefix."""
    hashed = _lines(base).select(*_PLACE, F.expr(_hashes("line")).alias("hs")).filter("size(hs) > 0").persist(StorageLevel.DISK_ONLY)  # a lost part is made anew
    ranks = _rarity(hashed)
    maps = (F.expr(_MAP.format(side=side)).alias(m) for side, m in (("~", "m0"), ("", "m1")))
    kins = F.array(F.xxhash64(F.array_min("hs"), F.array_max("hs")), F.xxhash64(F.array_min("turned"), F.array_max("turned"), F.lit(1)))
    turned = hashed.withColumn("turned", F.transform("hs", lambda h: F.shiftleft(h, 21)))
    shown = turned.select(*_PLACE, F.size("hs").alias("n"), _tokens(ranks).alias("toks"), *maps, kins.alias("kins"))
    prefix = F.expr("transform(slice(toks, 1, n - cast(ceil(n * 0.8D) as int) + 1), t -> hash(t))")
    lines = keep(shown.select(*_PLACE, "n", F.xxhash64("toks").alias("cls"), F.xxhash64(F.lit(1), "toks").alias("low"), "m0", "m1", "kins", prefix.alias("prefix")))
    hashed.unpersist()
    return lines


def _classes(lines: DataFrame, order: Column) -> DataFrame:
    """One row for each set of words: its first line and how many lines it has."""
    first = F.min(F.struct("_id", "pos", "_copy", "n", "m0", "m1", "kins", "prefix"))
    return lines.groupBy("cls", "low").agg(first.alias("s"), F.count("*").alias("copies")).select("cls", "low", "copies", "s.*").withColumn("id", order)


def _guesses(classes: DataFrame) -> DataFrame:
    """``cls, low, y, x``: for classes of which a kin's earliest class is a likely match, the places of both."""
    rows = classes.select("cls", "low", *_PLACE, "id", "n", "m0", "m1", F.explode("kins").alias("kin"))
    heads = rows.groupBy("kin").agg(F.min(F.struct("id", "pos", "cls", "n", "m0", "m1", "_id", "_copy")).alias("s"), F.count("*").alias("c")).filter("c > 1").select("kin", "s.*")
    fits = F.expr(f"x.kin = y.kin and {_NEAR} and {_EARLIER} and {_FITS}")
    met = rows.alias("y").join(heads.alias("x"), fits)
    place = lambda k: F.struct(*(F.col(f"{k}.{c}").alias(c) for c in _PLACE)).alias(k)
    first = F.min(F.struct("x.id", "x.pos", place("x")))["x"]
    return met.groupBy("y.cls", "y.low", place("y")).agg(first.alias("x"))


def _few(df: DataFrame) -> DataFrame:
    """``df``, a kept table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _partners(asking: DataFrame, among: DataFrame, few: bool) -> DataFrame:
    """``later, earlier, id, pos``: pairs of classes that may match, of which the later one is ``asking`` (column ask).

    The test of ``ask`` names both sides so that it stays in the join, and equal sides are one exchange.
    """
    dealt = lambda df: df.select("cls", "id", "pos", "n", "m0", "m1", "ask", F.posexplode("prefix").alias("i", "tok"))
    y, x = dealt(asking), dealt(among)
    near = f"x.tok = y.tok and {_NEAR} and " + _enough("x.n", "y.n", "least(x.n - x.i, y.n - y.i)") + f" and (y.ask or (x.ask and x.n < 0)) and {_EARLIER} and {_FITS}"
    y = F.broadcast(y.filter("ask").alias("y")) if few else y.alias("y")
    return x.alias("x").join(y, F.expr(near)).select(F.col("y.cls").alias("later"), F.col("x.cls").alias("earlier"), "x.id", "x.pos").distinct()


def _placed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of places: ``cls, low, y, x``."""
    place = F.struct(*_PLACE)
    y = classes.select(F.col("cls").alias("later"), "cls", "low", place.alias("y"))
    x = classes.select(F.col("cls").alias("earlier"), place.alias("x"))
    return pairs.select("later", "earlier").join(y, "later").join(x, "earlier").select("cls", "low", "y", "x")


def _verified(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cls, low`` of the pairs (cls, low, y, x: places) whose whole lines have Jaccard >= 0.8."""
    wanted = pairs.select("y.*").unionByName(pairs.select("x.*")).distinct().groupBy(F.col("_id").alias("i"), F.col("_copy").alias("c")).agg(F.collect_set("pos").alias("wanted"))
    wanted = _few(keep(wanted))
    docs = base.join(wanted, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_copy") == F.col("c")))
    picked = "inline(transform(array(split(_text, '\\n', -1)), a -> transform(wanted, p -> named_struct('pos', p, 'line', a[p])))[0])"
    lines = docs.select("_id", "_copy", F.expr(picked)).dropDuplicates(_PLACE)
    sets = keep(lines.select(F.xxhash64("_id", "_copy", "pos").alias("at"), F.struct(*_PLACE).alias("place"), F.expr(_hashes("line")).alias("hs")))
    end = lambda k: sets.select(F.col("at").alias(f"at_{k}"), F.col("place").alias(f"place_{k}"), F.col("hs").alias(f"hs_{k}"))
    at = lambda k: F.xxhash64(f"{k}._id", f"{k}._copy", f"{k}.pos").alias(f"at_{k}")
    both = pairs.select("cls", "low", "y", "x", at("y"), at("x"))
    for k in ("y", "x"):
        both = both.join(end(k), f"at_{k}").filter(F.col(k).eqNullSafe(F.col(f"place_{k}")))
    return both.filter(_enough("size(hs_x)", "size(hs_y)", "size(array_intersect(hs_x, hs_y))")).select("cls", "low").distinct()


def matched_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _copy, pos``: the lines of ``docs`` that an earlier line matches with Jaccard >= 0.8.

    Lines are ordered by id (null first), position, and hash. Rows that repeat id and text are the same place: a line
    never matches itself. Lines without words match nothing. Null texts have no lines.
    """
    need(docs, id_col, text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_copy"))
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    order = F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.col("_id").cast("string"), F.lit(""))
    lines = _encoded(base)
    classes = keep(_classes(lines, order))

    likely = keep(_guesses(classes))
    guessed = _few(likely.select("cls", "low", F.lit(False).alias("asks")))
    asked = classes.join(guessed, ["cls", "low"], "left").select("cls", "id", "pos", "n", "m0", "m1", "prefix", F.coalesce("asks", F.lit(True)).alias("ask"))
    near = keep(_partners(asked, asked, few=False))
    best = near.groupBy("later").agg(F.min(F.struct("id", "pos", "earlier"))["earlier"].alias("earlier"))
    tried = keep(likely.unionByName(_placed(best, classes)))
    found = keep(_verified(base, tried))
    failed = keep(tried.select("cls", "low").join(found, ["cls", "low"], "left_anti").distinct())
    if failed.limit(1).count():
        rest = _placed(near.join(failed.select(F.col("cls").alias("later")).distinct(), "later", "left_semi"), classes)
        again = classes.join(_few(keep(likely.join(failed, ["cls", "low"], "left_semi").select("cls", "low"))), ["cls", "low"], "left_semi").withColumn("ask", F.lit(True))
        few = again.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
        if few:
            rest = rest.unionByName(_placed(_partners(again, classes.withColumn("ask", F.lit(False)), few=few <= SMALL), classes))
        more = keep(rest)
        found = found.unionByName(keep(_verified(base, more))).distinct()
        drop(more)

    reps = classes.join(found.withColumn("matched", F.lit(True)), ["cls", "low"], "left").filter("matched or copies > 1").select("cls", "low", *(F.col(c).alias(f"first{c}") for c in _PLACE), "matched")
    own = F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_copy") == F.col("first_copy")) & (F.col("pos") == F.col("firstpos"))
    out = keep(lines.select(*_PLACE, "cls", "low").join(reps, ["cls", "low"]).filter(F.coalesce("matched", F.lit(False)) | ~own).select(*_PLACE))
    for table in (lines, classes, likely, near, tried):
        drop(table)
    return out


def _removed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _copy, removed``: ascending positions of the lines to remove, for documents that have any."""
    return matched_lines(docs, id_col, text_col).groupBy("_id", "_copy").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, ``n_lines``, ``n_removed`` and ``removed`` (positions from 0).

    Null texts have no lines; an empty text has one, which matches nothing. Repeated rows report alike. Empty tables: no rows.
    """
    removed = _removed(docs, id_col, text_col)
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_copy"), F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    joined = rows.join(removed, rows[id_col].eqNullSafe(removed["_id"]) & (rows["_copy"] == removed["_copy"]), "left")
    return joined.select(F.col(id_col), F.col("n_lines").cast("long"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later matches removed from ``text_col``; every row stays (with an empty text if no line is left).

    All columns are kept, whatever their names; ``n_chars``, if there is one, is the new text's where lines went. Rows without
    a removed line are unchanged, also those of null or empty texts. Repeated rows lose the same lines. Empty tables: no rows.
    """
    an_id, copy, gone = fresh(docs, "_removed_id", "_removed_copy", "_removed_lines")
    removed = _removed(docs, id_col, text_col).toDF(an_id, copy, gone)
    joined = docs.join(removed, docs[id_col].eqNullSafe(removed[an_id]) & (F.xxhash64(docs[text_col]) == removed[copy]), "left")
    left = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    new = F.when(F.col(gone).isNull(), docs[text_col]).otherwise(left)
    size = lambda c: F.when(F.col(gone).isNull(), docs[c]).otherwise(F.char_length(left)).cast(docs.schema[c].dataType).alias(c)
    return joined.select(*(new.alias(c) if c == text_col else size(c) if c == "n_chars" else docs[c] for c in docs.columns))
