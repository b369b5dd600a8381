"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textstrata.llm import chat, importance, licenses, maxent, mixing, packing, quality, repair, rules, secrets, simhash, topk, toxicity
from textstrata.llm.shared import crc_bucket, materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth vector's 20 best others by integer inner product."""
    vectors = topk.clean_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    # beyond 2**53 a double is a whole number, and floor() to a long would saturate
    whole = vectors.select("id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0 ** 47, F.floor(x * 64).cast("double")).otherwise(x * 64)).alias("v"))
    best = topk.top_k(whole, F.col("id") % 20 == 0, k=20)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels with crc32 mod 4 = 2 are held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, toxicity.training_labels(_table(spark, sf_dir, "labels"))))
    return scored.select(F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and guess-cost spans of every document."""
    return secrets.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, at most 2 differing bits."""
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all documents."""
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels with crc32 mod 3 = 1 are held out."""
    labels = _table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    scored = quality.score(_table(spark, sf_dir, "documents"), labels)
    return scored.select(F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    rows = materialise(mixing.sized(_table(spark, sf_dir, "documents")), "sizes")
    units, sources = mixing.mix_sized(rows)
    sources = sources.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target")
    same = rows["id"].eqNullSafe(units["id"]) & (rows["size"] == units["size"]) & (rows["pattern"] == units["pattern"])
    taken = rows.join(units, same).select(rows["id"], rows["size"], rows["pattern"], (units["copies"] * rows["size"]).alias("taken"))
    return taken.join(sources, "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents with adaptive fences."""
    judged = rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after seeded damage."""
    turns = _table(spark, sf_dir, "conversations")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    fixed = repair.repair(repair.damage(turns))
    facts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *repair.FIELDS)]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(fixed, every["conv_id"].eqNullSafe(fixed["conv"]), "left").select(
        "conv_id", *facts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; those with crc32 mod 5 = 1 are held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = maxent.fit_and_score(docs, docs.where(crc_bucket(F.col("doc_id"), 5) != 1))
    return scored.select(F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five per cent of the longer documents, drawn by likeness to the benchmark texts."""
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), per_cent=5, least_words=20, seed=42)
    return drawn.withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_toxicity, op3_secrets, op4_simhash, op5_packing, op6_chat, op7_licenses, op8_quality, op9_mixing, op10_rules, op11_repair, op12_lm, op13_importance, pipeline)}
