"""Annotated corpora: inline tags, validation, alignment to tokens, splits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import NER_LABELS, Pattern
from ..functions.spans import bind, find, first_wins, running

ENTITY = "struct<start:int,end:int,label:string,text:string>"
ENTITIES = f"array<{ENTITY}>"
#: White space in ASCII, and runs of anything else.
BLANKS = " \t\n\x0b\f\r"
_RUN = r"[^\x20\x09-\x0D]+"
#: So many characters are walked through for the entities of a text at most.
WALK = 1 << 24
_TAG = "(?s)<(" + "|".join(NER_LABELS) + r")>(.*?)</\1>"


def parse_tags(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``text`` without tags and ``entities`` at its code points. Unknown and unclosed tags are ordinary text."""
    own = F.col(raw_col)
    raw = F.when(own.contains("\x01") | own.contains("\x02"), F.translate(own, "\x01\x02", "  ")).otherwise(own)
    cut = F.split(F.regexp_replace("_raw", F.lit(_TAG), F.lit("\x01$1\x02$2\x01")), "\x01", -1)
    pieces = F.when(F.col("_raw").contains("</"), cut).otherwise(F.array("_raw"))  # without an end of a tag there is none
    body = lambda piece: F.substring_index(piece, "\x02", -1)
    starts = lambda p: running(F.transform(p, lambda x: F.char_length(body(x))), _added, lambda x, y: x + y)

    def entity(piece: Column, at: Column) -> Column:
        return F.struct(at.alias("start"), (at + F.char_length(body(piece))).alias("end"), F.substring_index(piece, "\x02", 1).alias("label"), body(piece).alias("text"))

    inside = lambda p: F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
    found = bind(starts(F.col("_pieces")), lambda at: F.transform(inside("_pieces"), lambda i: entity(F.get("_pieces", i), F.get(at, i)))).cast(ENTITIES)
    some = F.size("_pieces") > 2
    out = df.withColumn("_raw", raw).withColumn("_pieces", F.when(F.col("_raw").isNotNull(), pieces))
    text = F.when(some, F.array_join(F.transform("_pieces", body), "")).otherwise(F.col("_raw"))
    return out.withColumn("text", text).withColumn("entities", F.when(some, found).when(F.col("_raw").isNotNull(), F.array().cast(ENTITIES))).drop("_raw", "_pieces")


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda x, y: x + y)


def valid_annotations(text: Column, entities: Column, labels: tuple[str, ...] = NER_LABELS) -> Column:
    """Every entity is the text at its place and has a known label, and no two overlap: none begins before the one ahead of it ends."""
    right = F.forall(entities, lambda e: (F.substring(text, e["start"] + 1, e["end"] - e["start"]) == e["text"]) & e["label"].isin(*labels))
    places = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    clash = bind(places, lambda v: F.exists(F.transform(v, lambda e, i: (i > 0) & (e["start"] < F.get(v, i - 1)["end"])), lambda x: x))
    return right & ~clash


def usable(df: DataFrame) -> DataFrame:
    """Documents with a text, at least one entity, and valid annotations."""
    return df.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.size("entities") > 0) & valid_annotations(F.col("text"), F.col("entities")))


def tokens(text: Column, regex: str = r"\S+") -> Column:
    """Runs of non-blank characters (or what ``regex`` matches) with their places: a stand-in for a tokenizer."""
    return F.transform(find(text, Pattern("token", regex, 1.0, (), False), "TOKEN"), lambda s: F.struct(s["text"].alias("tok"), s["start"].alias("start"), s["end"].alias("end")))


def _ahead(these: Column, those: Column, edge: str, ties: bool) -> Column:
    """For each of ``those`` how many of ``these`` have a lower (with ``ties``: or equal) edge: one merge of both, in order."""
    mark = lambda items, kind: F.transform(items, lambda x, i: F.struct(x[edge].alias("at"), F.lit(kind).alias("kind"), i.alias("no")))
    merged = F.array_sort(F.concat(mark(these, 0 if ties else 2), mark(those, 1)))
    ahead = lambda m: running(F.transform(m, lambda x: F.when(x["kind"] == 1, 0).otherwise(1)), _added, lambda x, y: x + y)
    own = lambda m, a: F.filter(F.transform(m, lambda x, i: F.struct(x["no"].alias("no"), F.get(a, i).alias("n"), x["kind"].alias("kind"))), lambda x: x["kind"] == 1)
    return bind(merged, lambda m: bind(ahead(m), lambda a: F.transform(F.array_sort(own(m, a)), lambda x: x["n"])))


def token_ranges(entities: Column, tokens: Column) -> Column:
    """For each entity ``first`` and ``last``, the tokens it is widened to (from 0): the last that begins at or before its start, the
    first that ends at or after its end; null where there is none. Tokens are disjoint and in order. Both arrays are merged, so
    the work is that of sorting them, whatever their lengths.
    """
    last = lambda n, size: F.when(n < size, n)
    return bind(tokens, lambda t: F.transform(F.arrays_zip(_ahead(t, entities, "start", True).alias("a"), _ahead(t, entities, "end", False).alias("b")), lambda x: F.struct(F.when(x["a"] > 0, x["a"] - 1).alias("first"), last(x["b"], F.size(t)).alias("last"))))


def _plain(text: Column) -> Column:
    return F.translate(text, BLANKS, " " * len(BLANKS))


def run_ranges(text: Column, entities: Column) -> Column:
    """:func:`token_ranges` where tokens are runs of other characters than BLANKS, with ``start`` of the first and ``end`` of the last.

    Taken from what stands before and behind each entity, without the tokens of the text; texts with so many entities that this would be
    more work than their tokens are (WALK characters in all) are merged with them.
    """

    def near(t: Column, e: Column) -> Column:
        till, to = F.rtrim(F.substring(t, F.lit(1), e["start"] + 1)), F.greatest(e["end"], F.lit(1))
        head = bind(till, lambda u: F.when(u != "", F.struct((F.regexp_count(u, F.lit("[^ ]+")) - 1).alias("no"), (F.char_length(u) - F.char_length(F.substring_index(u, " ", -1))).alias("at"))))
        inside = (e["end"] > 0) & (F.substring(t, to, F.lit(1)) != " ")
        before = F.regexp_count(F.substring(t, F.lit(1), e["end"]), F.lit("[^ ]+")) - F.when(inside, 1).otherwise(0)
        ahead = lambda rest, r: F.when(r != "", F.struct(before.alias("no"), (to - 1 + F.char_length(rest) - F.char_length(r) + F.char_length(F.substring_index(r, " ", 1))).alias("at")))
        tail = bind(F.substring(t, to, F.char_length(t)), lambda rest: bind(F.ltrim(rest), lambda r: ahead(rest, r)))
        return bind(head, lambda h: bind(tail, lambda z: F.struct(h["no"].alias("first"), z["no"].alias("last"), h["at"].alias("start"), z["at"].alias("end"))))

    edges = lambda t, r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.get(t, r["first"])["start"].alias("start"), F.get(t, r["last"])["end"].alias("end"))
    merged = bind(tokens(text, _RUN), lambda t: F.transform(token_ranges(entities, t), lambda r: edges(t, r)))
    few = F.size(entities).cast("long") * F.char_length(text) <= WALK
    kind = "array<struct<first:int,last:int,start:int,end:int>>"
    return F.when(F.size(entities) == 0, F.array().cast(kind)).when(few, bind(_plain(text), lambda t: F.transform(entities, lambda e: near(t, e))).cast(kind)).otherwise(merged.cast(kind))


def _aligned(df: DataFrame, entities_col: str) -> DataFrame:
    """Entities by ``_ranges``: widened, and of those with a token in common the first."""
    widen = lambda e, i: F.struct(F.get("_ranges", i).alias("r"), e["label"].alias("label"), e["text"].alias("text"))
    fine = F.filter(F.transform(F.col(entities_col), widen), lambda e: e["r"]["start"].isNotNull() & e["r"]["end"].isNotNull() & (e["r"]["start"] < e["r"]["end"]))
    spans = F.transform("_fine", lambda e, i: F.struct(i.cast("string").alias("entity_type"), e["r"]["first"].alias("start"), (e["r"]["last"] + 1).alias("end"), F.lit(0.0).alias("score"), F.lit("").alias("text")))
    kept = F.transform(first_wins(spans), lambda s: F.get(F.col("_fine"), s["entity_type"].cast("int")))
    aligned = F.transform(kept, lambda e: F.struct(e["r"]["start"].alias("start"), e["r"]["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text"))).cast(ENTITIES)
    out = df.withColumn("_fine", fine).withColumn("aligned", aligned).withColumn("total", F.size(entities_col).cast("long"))
    return out.withColumn("failed", (F.size(entities_col) - F.size("_fine")).cast("long")).drop("_fine", "_ranges")


def align(df: DataFrame, entities_col: str = "entities", tokens_col: str = "tokens") -> DataFrame:
    """Adds ``aligned`` (entities widened to token edges; of those with a token in common the first stays), ``failed`` and ``total``.

    An entity that no tokens reach fails. Null entities or tokens: null.
    """
    t = F.col(tokens_col)
    edges = lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.get(t, r["first"])["start"].alias("start"), F.get(t, r["last"])["end"].alias("end"))
    return _aligned(df.withColumn("_ranges", F.transform(token_ranges(F.col(entities_col), t), edges)), entities_col)


def align_runs(df: DataFrame, entities_col: str = "entities", text_col: str = "text") -> DataFrame:
    """:func:`align` to runs of other characters than BLANKS, see :func:`run_ranges`."""
    return _aligned(df.withColumn("_ranges", run_ranges(F.col(text_col), F.col(entities_col))), entities_col)


def aligned_documents(df: DataFrame) -> DataFrame:
    """Without documents whose alignment failed and that kept nothing."""
    return df.filter("not (failed > 0 and size(aligned) = 0)")


def alignment_report(df: DataFrame) -> DataFrame:
    sums = df.agg(F.count("*").alias("documents"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    rate = F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("total")), F.lit(0.0))
    return sums.withColumn("failure_rate", rate).withColumn("warn", rate > 5)


def split(df: DataFrame, id_col: str = "doc_id", train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: train, dev, test by exact counts, in the order of md5("seed:id") (ties: the id).

    Ranks come from counts of 4096 ranges of the digest and from ranks within each, so no task sorts everything.
    """
    keyed = df.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))  # 4096 rows at most
    order = Window.orderBy("_range")
    ends = counts.select(F.col("_range").alias("_r"), (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_key", id_col))
    out = keyed.join(F.broadcast(ends), F.col("_range") == F.col("_r")).withColumn("_rank", rank)
    first, second = F.floor(F.col("_all") * F.lit(train)), F.floor(F.col("_all") * F.lit(train + dev))
    return out.withColumn("split", F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= second, "dev").otherwise("test")).select(*df.columns, "split")


def label_counts(df: DataFrame, entities_col: str = "entities") -> DataFrame:
    """Entities for each label over the corpus, by label."""
    return df.select(F.explode(entities_col).alias("e")).groupBy(F.col("e.label").alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def corpus_counts(df: DataFrame, entities_col: str = "entities") -> DataFrame:
    return df.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(entities_col)), F.lit(0)).alias("entities"))


def generate(templates: DataFrame, batches: int, make, schema: str = "domain string, batch long, raw string") -> DataFrame:
    """Raw texts of ``templates`` (domain, prompt) x ``batches``: ``make(domain, prompt, batch)`` runs in Arrow batches."""
    todo = templates.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(max(0, batches - 1))))) if batches > 0 else templates.withColumn("batch", F.lit(0)).limit(0)

    def run(frames):
        for f in frames:
            yield f.assign(raw=[make(d, p, int(b)) for d, p, b in zip(f["domain"], f["prompt"], f["batch"])])[["domain", "batch", "raw"]]

    return todo.withColumn("batch", F.col("batch").cast("long")).mapInPandas(run, schema)
