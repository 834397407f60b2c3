"""MinHash near-duplicates by tensored banding.

Two small collections of m bands, each band a run of r minhashes, stand for m * m hash tables: table (i, j) is keyed by
band i of the first and band j of the second collection, so its keys hold 2 r minhashes while only 2 m r are computed
(m * m * 2 r for separate tables). The tables stay factored: a row is dealt by band i, and the join compares the second
half of the keys (i, 1..m) at once; a document is shuffled m times instead of m * m times. A pair is emitted once, at
its first common band. Two sets of similarity s meet with probability (1 - (1 - s^r)^m)^2: 0.9998 at 0.85 with m = 10,
r = 3; and more above.

Candidates also pass a bitmap test that loses no link: each set carries a bitmap of several bits a member, and a bit that one
map has alone is a member that the other set lacks. So most pairs below the threshold never leave the join, also in large
groups of near-copies.

Documents of equal sets count as one from the start, so copies never form pairs. First each node is compared
with few members of its buckets, which joins most copies of an original; then all remaining pairs of different components
are. Candidate pairs are verified on full sets in blocks: nodes of one neighbourhood are cut into chunks of bounded size and each pair of chunks is one task, so a
set is sent once for each chunk that it meets instead of once for each pair. Verified links are contracted in the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, fresh, keep, mix, need, shingle_hashes, words_of
from .graph import components

BANDS, ROWS = 10, 3
CHUNK = 256
MAP_LONGS = 64
#: Bits of the filter of ids: most of them, and of a segment that a task makes.
LARGEST, SEGMENT = 1 << 28, 1 << 20


def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:n] | np.uint64(1))[:, None], seed[n:, None]


def signature(shingles: np.ndarray, hashers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over the set."""
    times, plus = hashers
    out = np.full(len(times), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[None, k : k + 2048] * times + plus).min(axis=1), out=out)
    return out


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """One 32-bit key for each run of ``rows`` minhashes."""
    out = np.zeros(len(values) // rows, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[k::rows])
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """At least eight bits for each member as longs, 64 longs at most; sets of one length class can be compared."""
    bits = min(64 * MAP_LONGS, max(64, 1 << (8 * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, dtype=bool)
    out[shingles & np.uint64(bits - 1)] = True
    return np.packbits(out).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a set: what names a node of the graph."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signatures(k: int, m: int, r: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashers = _hashers(2 * m * r)
        for batch in batches:
            rows = []
            for doc_id, copy, text in zip(batch["doc_id"], batch["copy"], batch["text"]):
                s = shingle_hashes(words_of(text), k)
                if len(s):
                    sig = bands(signature(s, hashers), r)
                    rows.append((doc_id, copy, len(s), digest(s), sig[:m], sig[m:], bitmap(s)))
                else:
                    rows.append((doc_id, copy, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "n_shingles", "node", "a", "b", "bits"])

    return run


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(SEGMENT, dtype=bool)
    out[pdf["bit"]] = True
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [zlib.compress(np.packbits(out, bitorder="little").tobytes(), 1)]})


def hash_filter(hashes: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """Bits of the hashes (column h, long) and how many there may be: 32 to 64 for each hash, LARGEST at most (32 MB), in segments.

    A hash that is not there has its bit set in at most 3 of 100 cases, in more where there are more than LARGEST / 32 hashes.
    """
    bits = min(LARGEST, max(SEGMENT, 1 << (32 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.floor(at / SEGMENT).alias("segment"), (at % SEGMENT).alias("bit")).groupBy("segment").applyInPandas(_segment, "segment long, bits binary")
    return bits, {r["segment"]: np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8) for r in rows.toLocalIterator()}


def may_have(found: tuple[int, dict[int, np.ndarray]], hashes: np.ndarray) -> np.ndarray:
    bits, segments = found
    at = hashes & (bits - 1)
    out = np.zeros(len(at), dtype=bool)
    for segment, held in segments.items():
        here = np.flatnonzero(at // SEGMENT == segment) if bits > SEGMENT else np.arange(len(at))
        bit = at[here] % SEGMENT
        out[here] = (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
    return out


def _sets(k: int, wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets of the texts that may be wanted; others stay where they are."""
        for batch in batches:
            texts = batch["text"][may_have(wanted.value, batch["h"].to_numpy())]
            rows = [(digest(s), s.view(np.int64)) for s in (shingle_hashes(words_of(t), k) for t in texts) if len(s)]
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    return run


def _verify(percent: int):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        """Links of one task, contracted: each node of a local component with its least node."""
        held = dict(zip(sets["node"], sets["shingles"]))
        made: dict[bytes, set] = {}
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def get(x: bytes) -> set:
            if x not in made:
                made[x] = set(held[x].tolist())
            return made[x]

        for a, b in zip(pairs["l"], pairs["r"]):
            x, y = top(a), top(b)
            if x == y:
                continue
            both = len(get(a) & get(b))
            if 100 * both >= percent * (len(get(a)) + len(get(b)) - both):
                up[max(x, y)] = min(x, y)
        out = [(x, top(x)) for x in up if top(x) != x]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _meet(percent: int) -> str:
    """Whether rows x and y (node, n, a, b, bits) share a key in one of the tables and may have a link."""
    alone = lambda p, q: f"aggregate(zip_with({p}.bits, {q}.bits, (u, v) -> bit_count(u & ~v)), 0, (t, k) -> t + k)"
    both = f"least(x.n - {alone('x', 'y')}, y.n - {alone('y', 'x')})"
    return (
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and exists(zip_with(x.a, y.a, (p, q) -> p = q), t -> t) and exists(zip_with(x.b, y.b, (p, q) -> p = q), t -> t)"
        f" and (size(x.bits) <> size(y.bits) or {100 + percent} * {both} >= {percent} * (x.n + y.n))"
    )


def star_pairs(some: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """``l, r``: each node with two members of each of its buckets: the one with most company, and one by hash.

    At most twice the number of buckets for each node. An original and its many copies become one component by these.
    """
    sized = keys.join(keys.groupBy("i", "key").agg(F.count("*").alias("c")), ["i", "key"])
    company = sized.groupBy(F.col("node").alias("at")).agg(F.sum("c").alias("company"))
    ranked = sized.join(company, F.col("node") == F.col("at"))
    hubs = ranked.groupBy("i", "key").agg(F.max(F.struct("company", "node"))["node"].alias("hub"), F.min(F.struct(F.xxhash64("node", "key"), "node"))["node"].alias("other"))
    ends = keys.join(hubs, ["i", "key"]).select("node", F.explode(F.array("hub", "other")).alias("hub")).filter("node <> hub").distinct()
    held = ends.join(some, "node").select("hub", F.struct("node", "n", "a", "b", "bits").alias("x"))
    both = held.join(some.select(F.col("node").alias("hub"), F.struct("node", "n", "a", "b", "bits").alias("y")), "hub")
    return both.filter(F.expr(_meet(percent))).select(F.expr("least(x.node, y.node)").alias("l"), F.expr("greatest(x.node, y.node)").alias("r")).distinct()


def candidate_pairs(some: DataFrame, percent: int) -> DataFrame:
    """``l, r``: all pairs of nodes of different components (column comp) that meet in a table and may have a link."""
    rows = some.select("node", "n", "a", "b", "bits", "comp", F.posexplode("a").alias("i", "key"))
    x, y = rows.alias("x"), rows.alias("y")
    first = "x.i = y.i and x.key = y.key and x.node < y.node and x.comp <> y.comp and array_position(zip_with(x.a, y.a, (p, q) -> p = q), true) = x.i + 1"
    return x.join(y, F.expr(f"{first} and {_meet(percent)}")).select(F.col("x.node").alias("l"), F.col("y.node").alias("r"))


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """``a, b``: links among ``pairs`` (l, r) by whole sets (node, shingles), contracted within each task.

    Nodes are dealt into blocks by their least partner, in chunks of about ``chunk``; a task has two blocks at most.
    """
    ends = pairs.select(F.col("r").alias("node"), F.col("l").alias("near")).unionByName(pairs.select(F.col("l").alias("node"), F.col("l").alias("near")))
    near = ends.groupBy("node").agg(F.min("near").alias("label"))
    sizes = near.groupBy("label").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    block = cut(near.join(sizes, "label").select("node", F.xxhash64("label", F.expr("pmod(xxhash64(node), chunks)")).alias("block")))
    tasks = pairs.join(block.select(F.col("node").alias("l"), F.col("block").alias("bl")), "l").join(block.select(F.col("node").alias("r"), F.col("block").alias("br")), "r")
    tasks = cut(tasks.select("l", "r", F.xxhash64(F.least("bl", "br"), F.greatest("bl", "br")).alias("task")))
    members = tasks.select(F.col("task").alias("at"), F.col("l").alias("node")).unionByName(tasks.select(F.col("task").alias("at"), F.col("r").alias("node"))).distinct()
    held = members.join(sets, "node")
    return cut(tasks.groupBy("task").cogroup(held.groupBy("at")).applyInPandas(_verify(percent), "a binary, b binary"))


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, m: int, r: int, chunk: int) -> DataFrame:
    """``doc_id, copy, n_shingles, node, component, component_id`` for every row; copy: two hashes of the text."""
    need(docs, id_col, text_col)
    copy = F.concat_ws("-", F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col))
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), copy.alias("copy"), F.col(text_col).alias("text"))
    sigs = base.mapInPandas(_signatures(shingle, m, r), "doc_id string, copy string, n_shingles long, node binary, a array<int>, b array<int>, bits array<long>")
    sigs = keep(sigs.withColumn("doc_id", F.col("doc_id").cast("long")))
    full = sigs.filter("n_shingles > 0")
    nodes = keep(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("n_shingles", "a", "b", "bits")).alias("s")).select("node", "rep", F.col("s.n_shingles").alias("n"), "s.a", "s.b", "s.bits"))
    keys = nodes.select("node", F.posexplode("a").alias("i", "key"))
    shared = keys.groupBy("i", "key").agg(F.count("*").alias("c")).filter("c > 1").select("i", "key")
    keys = keep(keys.join(shared, ["i", "key"]))
    some = keep(nodes.join(keys.select("node").distinct(), "node").select("node", "rep", "n", "a", "b", "bits"))
    of_id = lambda c: F.xxhash64(F.col(c).cast("long")).alias("h")
    wanted = docs.sparkSession.sparkContext.broadcast(hash_filter(some.select(of_id("rep"))))  # so that texts are not dealt to be met with ids
    sets = keep(base.select(of_id("doc_id"), "text").mapInPandas(_sets(shingle, wanted), "node binary, shingles array<long>").join(some.select(F.col("node").alias("wanted")), F.col("node") == F.col("wanted"), "left_semi").dropDuplicates(["node"]))

    links = verified_links(keep(star_pairs(some, keys, percent)), sets, percent, chunk)
    joined = components(links)
    rest = some.join(joined, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    more = verified_links(keep(candidate_pairs(rest, percent)), sets, percent, chunk)
    comps = components(links.unionByName(more))

    owner = nodes.join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = owner.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = keep(owner.join(least, "component").select("node", "component", "component_id"))
    out = keep(sigs.select("doc_id", "copy", "n_shingles", "node").join(named, "node", "left"))
    for table in (sigs, nodes, keys, some, sets, named):
        drop(table)
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, m: int = BANDS, r: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Links: 100 * intersection >= ``percent`` * union of the sets of distinct ``shingle``-word runs, verified on full
    sets. ``component_id`` is the least id reachable over links, ``kept`` marks that row. Rows without words have an
    empty set and stay alone. Repeated rows share a component (and are all kept if their id is its least). Ids may be
    null: such rows count as members but never name a component unless all its ids are null. Empty tables: no rows.
    """
    linked = _linked(docs, id_col, text_col, shingle, percent, m, r, chunk)
    return linked.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one of least id (null last) and, of equal ids, of least hash of the text.

    Of several rows of that id and text one stays. Rows without words (null, empty or blank texts) are no copies of anything
    but of rows of the same id and text. Texts of any length count as a whole; columns may have any names. Empty tables: no rows.
    """
    linked = _linked(docs, id_col, text_col, shingle, percent, BANDS, ROWS, CHUNK)
    group = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.concat_ws(" ", "doc_id", "copy").cast("binary"))
    an_id, copy, own = fresh(docs, "_kept_id", "_kept_copy", "_own_copy")
    first = linked.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy")).alias("s"))
    first = keep(first.select(F.col("s.doc_id").alias(an_id), F.col("s.copy").alias(copy)).distinct())
    same = F.concat_ws("-", F.xxhash64(docs[text_col]), F.xxhash64(F.lit(1), docs[text_col]))
    kept = docs.withColumn(own, same).join(first, docs[id_col].cast("long").eqNullSafe(F.col(an_id)) & (F.col(own) == F.col(copy)))
    return kept.dropDuplicates([an_id, copy]).select(*docs.columns)
