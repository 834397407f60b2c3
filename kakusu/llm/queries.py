"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of
    from .langid import identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of
    from .quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    mixed = mix_sources(docs, size_col="size")
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"), F.col("mix_copies").alias("copies"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import link_components

    return link_components(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixtree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcodes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gracededup import classes

    return classes(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenalign import align_documents

    return align_documents(table(spark, sf_dir, "documents"), vocabulary_path(), pieces_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_language_id": op2_language_id,
    "op3_quality_pu": op3_quality_pu,
    "op4_license_scan": op4_license_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_line_dedup": op6_line_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_tree_scores": op9_suffix_tree_scores,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_delta_lloyd_codes": op11_delta_lloyd_codes,
    "op12_grace_dedup": op12_grace_dedup,
    "op13_token_alignment": op13_token_alignment,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Rounds of assignment and means, spelled out one after the other."""
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS q FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS c FROM v, range({parts}) AS r(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, c FROM (SELECT part, c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries})",
    ]
    for k in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, p.c, min(CAST({away} AS BIGINT) * {entries} + b.entry) AS m FROM p JOIN b{k} AS b ON b.part = p.part GROUP BY ALL)")
        if k < rounds:
            mean = f"""SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT part, entry, i, CAST(sum(x) AS DOUBLE) AS s, count(*) AS n
              FROM (SELECT part, m % {entries} AS entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL"""
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} AS b LEFT JOIN ({mean}) AS n ON n.part = b.part AND n.entry = b.entry)")
    steps.append(f"e AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    books = f"(SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, CAST(unnest(c) AS VARCHAR) AS x, unnest(range(len(c))) AS i FROM b{rounds}))"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM e"


ORACLES: dict[str, str] = {
    "op11_delta_lloyd_codes": _codes_sql(),
    "op12_grace_dedup": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
      FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
}
