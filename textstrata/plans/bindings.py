"""Bindings of the operators to the driver's test tables.

Each query reads whole tables from ``sf_dir`` and runs one operator (or a
short chain) on them; ``ORACLE_SQL`` holds, for the same name, a DuckDB query
written in a different form (plain ``row_number`` instead of buckets, dense
instead of sparse sums, anti-joins instead of the fold) that must give the
same rows.  Column names are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textstrata.functions.arrays import argmax, softmax
from textstrata.functions.text import normalise
from textstrata.functions.hashing import hash_bucket, hash_order
from textstrata.operators import bayes, clean, encode, epochs, language, pick, sample, stats
from textstrata.operators import train as train_ops
from textstrata.operators.clean import prepare
from textstrata.operators.labels import (LITHOLOGY_LABELS, id_to_label, label2id,
                                         labels_by_first_seen, map_labels)
from textstrata.operators.order import expand_idem
from textstrata.operators.sample import stratified_split
from textstrata.operators.stats import balanced_class_weights
from textstrata.plans import jobs
from textstrata.plans.oracle import TURNS, oracle_sql
from textstrata.session import shared_path, written
from textstrata.sources import io
from textstrata.streaming.predict import start_stream, start_stream_predict

SEED = 2023
TEST_SIZE = 0.15
# The test tables' label tables: the quality/toxic flags named by their digits;
# the embeddings' labels 0-9 use the ten-class table (nine classes + none).
QUALITY = label2id(["0", "1"])
TOXIC = label2id(["0", "1"], with_none=True)
TEN_CLASSES = label2id(LITHOLOGY_LABELS, with_none=True)
TARGETS = ("HL", "NL1", "NL2")
CUTOFF = 0.1
SCALE = 20.0
CUTOFFS = pick.numpy_cutoffs()
FINE_CUTOFFS = [i / 200 for i in range(200)]
LANGUAGES = {"de": 0, "en": 1, "es": 2, "fr": 3}
EPOCH_RATE = 4.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` joined with their labels (only labelled documents)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, filled (P1), mapped (P7) and split (S2) on ``quality``."""
    rows = prepare(labelled_documents(spark, sf_dir), ["doc_id", "text"], ["quality"])
    rows = map_labels(rows, "quality", QUALITY, "label_id")
    return stratified_split(rows, "doc_id", "quality", test_size=TEST_SIZE, seed=SEED)


def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: balanced class weights of the train split."""
    return balanced_class_weights(split_rows(spark, sf_dir), "label_id", QUALITY)



def q_fill_and_map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join fills missing targets with ``none``; ``quality``
    uses the plain table (``none`` unmapped -> null), ``toxic`` the one with ``none``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    rows = prepare(rows, ["doc_id", "text"], ["quality", "toxic"])
    return map_labels(map_labels(rows, "quality", QUALITY, "quality_id"), "toxic", TOXIC, "toxic_id")


def q_labels_by_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on ``documents.lang`` in ``doc_id`` order."""
    return labels_by_first_seen(read(spark, sf_dir, "documents"), "lang", "doc_id")


def q_export_label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ids of ``embeddings`` back to names (ten-class table)."""
    emb = read(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", id_to_label("label", TEN_CLASSES).alias("label_name"))


def q_normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 on every document; the md5 of the normalised text stands for it."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(normalise("text")).alias("text_md5"),
                       F.length(normalise("text")).cast("long").alias("n_chars_norm"))


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` names made into descriptions; some sizes give interval forms."""
    p = read(spark, sf_dir, "part")
    s = F.col("p_size").cast("string")
    s1 = (F.col("p_size") + 1).cast("string")
    s10 = (F.col("p_size") + 10).cast("string")
    s20 = (F.col("p_size") + 20).cast("string")
    n = F.col("p_name")
    text = (F.when(F.col("p_size") <= 8, F.concat(F.lit("van "), s, F.lit(" tot "), s10, F.lit(" m "), n,
                                                   F.lit(" van "), s10, F.lit(" tot "), s20, F.lit(" m klei")))
            .when(F.col("p_size") <= 16, F.concat(F.lit("0,"), s, F.lit(" - 1,"), s, F.lit(" m "), n))
            .when(F.col("p_size") <= 24, F.concat(F.lit("Kern "), s, F.lit(".0-"), s1, F.lit(".0 m "), n))
            .when(F.col("p_size") <= 32, F.concat(n, F.lit(" 0,"), s, F.lit(" - 1,"), s, F.lit(" m")))
            .when(F.col("p_size") <= 40, F.concat(F.lit("KERNSTROOK "), s, F.lit(" 3.0 m - 4,5m "), n))
            .when(F.col("p_size") <= 44, F.concat(F.lit("VAN "), s, F.lit(" TOT "), s10, F.lit(" a van b tot c")))
            .otherwise(n))
    return p.select("p_partkey", text.alias("text"))


def q_drop_multi_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 on the interval texts made from ``part``."""
    return clean.drop_multi_interval(interval_texts(spark, sf_dir), "text")


def q_drop_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5(a): drop French documents by the language column."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return clean.drop_language(docs, "fr", lang_col="lang")


def q_drop_language_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5(b): drop documents whose words score French, on the whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kept = clean.drop_language(docs, "fr", text_col="text", detected_col="detected")
    return kept.select("doc_id", "lang", "detected")


def idem_rows(spark: SparkSession, sf_dir: str, with_intervals: bool = False) -> DataFrame:
    """``conversations`` with idem markers (and interval texts) made by projection:
    assistant turns say ``idem``, later user turns ``Idem,``, texts starting
    with L ``IDEM met idem`` (a first turn then has no base)."""
    c = read(spark, sf_dir, "conversations")
    t, turn = F.col("text"), F.col("turn")
    text = (F.when(F.col("role") == "assistant", F.concat(F.lit("idem "), t))
            .when(turn >= 5, F.concat(F.lit("Idem, "), t))
            .when(F.startswith(t, F.lit("L")), F.concat(F.lit("IDEM met idem "), t)))
    if with_intervals:
        text = F.when(turn == 2, F.concat(F.lit("van "), turn.cast("string"), F.lit(" tot "),
                                          (turn + 1).cast("string"), F.lit(" m zand van 3 tot 4 m "), t)) \
            .otherwise(text)
    return c.select("conv_id", "turn", F.coalesce(text, t).alias("text"))


def q_idem_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2 on conversations: site ``conv_id``, order ``turn``."""
    return expand_idem(idem_rows(spark, sf_dir), ["conv_id"], "turn", "text")


def q_idem_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2 with three long sites of many chunks and blocks: all conversations, one after another."""
    rows = idem_rows(spark, sf_dir).select(
        (F.col("conv_id") % 3).alias("site"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "text")
    return expand_idem(rows, ["site"], "place", "text", chunk_width=32)


def q_text_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function on the text column of every document; digits become #."""
    rows = prepare(read(spark, sf_dir, "documents"), ["doc_id", "text"], ["lang"], "text",
                   process_text=lambda c: F.regexp_replace(c, "[0-9]", "#"), process_on_column=True)
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def q_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without text and length."""
    return clean.drop_columns(read(spark, sf_dir, "documents"), "text", "n_chars")


def q_clean_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idem, then French by word scores, then multi-interval rows dropped."""
    return clean.clean_chain(idem_rows(spark, sf_dir, with_intervals=True), ["conv_id"], "turn", "text")


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by ``o_orderpriority``, key ``o_orderkey``."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return stratified_split(o, "o_orderkey", "o_orderpriority", TEST_SIZE, SEED)


def q_unstratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: ``documents`` with one stratum."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    return sample.unstratified_split(d, "doc_id", TEST_SIZE, SEED)


def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split of the ``orders`` split."""
    return stats.split_counts(q_stratified_split(spark, sf_dir))


def q_exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact sample of 500 orders."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return sample.exact_sample(o, 500, "o_orderkey", SEED)


def q_exact_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact sample of 12,000 orders (most of the table at sf0.01)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sample.exact_sample(o, 12_000, "o_orderkey", SEED)


def q_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every order in the seeded permutation."""
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    return sample.seeded_shuffle(o, "o_orderkey", SEED)


def q_minority_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 (+A2-A4, S5-S7): ``part``, targets brand and type, text name, N=300, ratio 0.3."""
    p = read(spark, sf_dir, "part")
    return sample.minority_select(p, ["p_brand", "p_type"], "p_name", "p_partkey",
                                  num_samples=300, minor_ratio=0.3, seed=SEED)


def q_minority_select_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 with more minority than random rows, so that the random pool leaves small groups out."""
    p = read(spark, sf_dir, "part")
    return sample.minority_select(p, ["p_brand", "p_type"], "p_name", "p_partkey",
                                  num_samples=300, minor_ratio=0.75, seed=SEED)


def q_replicate_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (brand, type) group of ``part`` as many times as its size."""
    groups = sample.group_sizes(read(spark, sf_dir, "part"), ["p_brand", "p_type"], "n")
    return sample.replicate_by_count(groups, "n", "copy")


def q_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: ``part`` type x brand."""
    return stats.crosstab(read(spark, sf_dir, "part"), "p_type", "p_brand")


def _round_assoc(df: DataFrame) -> DataFrame:
    return (df.withColumn("chi2", F.round("chi2", 6))
            .withColumn("cramers_v", F.round("cramers_v", 9)))


def q_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cramér's V of ``part`` type and brand."""
    return _round_assoc(stats.association(read(spark, sf_dir, "part"), "p_type", "p_brand"))


def q_association_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on ``orders``: order status against order priority."""
    return _round_assoc(stats.association(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


ASSOCIATION_PAIRS = (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"),
                     ("l_linestatus", "l_linenumber"))


def q_association_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three column pairs of ``lineitem`` in one aggregation."""
    return _round_assoc(stats.association_pairs(read(spark, sf_dir, "lineitem"), ASSOCIATION_PAIRS))


def folded_logits(emb: DataFrame) -> DataFrame:
    """Vectors with ten logits per target in ``l_0``, ``l_1``, ``l_2``: all 64
    elements, summed by ``(position + turn) % 10`` with another turn per target."""
    def folded(turn: int) -> Column:
        sums = [" + ".join(f"double(embedding[{j}])" for j in range(64) if (j + turn) % 10 == c) for c in range(10)]
        return F.expr(f"array({', '.join(sums)})")
    return emb.select("vec_id", "label", *[folded(turn).alias(f"l_{t}") for t, turn in enumerate(TURNS)])


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``folded_logits`` of ``embeddings``."""
    return folded_logits(read(spark, sf_dir, "embeddings"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the argmax of the first target's logits as a prediction."""
    return logits(spark, sf_dir).select("vec_id", "label", argmax("l_0").alias("pred"))


def q_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 counts: truth ``label`` against the argmax."""
    return stats.confusion_counts(predictions(spark, sf_dir), "label", "pred")


def q_confusion_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 normalised by the true-label total."""
    m = stats.confusion_counts(predictions(spark, sf_dir), "label", "pred", normalize="true")
    return m.withColumn("value", F.round("value", 12))


def q_argmax_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 on the first target's logits."""
    return stats.argmax_accuracy(logits(spark, sf_dir), "l_0", "label")


def q_weighted_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 with balanced weights of the labels (A1 over all rows)."""
    emb = read(spark, sf_dir, "embeddings")
    weights = balanced_class_weights(emb, "label", TEN_CLASSES, split_col=None)
    loss = stats.weighted_cross_entropy(logits(spark, sf_dir), "l_0", "label", weights)
    return loss.withColumn("loss", F.round("loss", 9))


def q_metric_trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, balanced accuracy and MCC of the argmax."""
    m = stats.classification_metrics(predictions(spark, sf_dir), "label", "pred")
    return m.select(*[F.round(c, 12).alias(c) for c in m.columns])


def scored(rows: DataFrame) -> DataFrame:
    """Three targets' scores: softmax of 20x their logits."""
    return rows.select("vec_id", "label", *[
        softmax(f"l_{i}", SCALE).alias(f"s_{t}") for i, t in enumerate(TARGETS)])


def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` logits of ``embeddings``."""
    return scored(logits(spark, sf_dir))


def _picked(sc: DataFrame) -> DataFrame:
    out = pick.pick_labels(sc, {t: f"s_{t}" for t in TARGETS}, TEN_CLASSES, CUTOFF, score_digits=9)
    return out.select("vec_id", *[c for t in TARGETS for c in (f"{t}_label", f"{t}_score")])


def q_pick_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels over HL, NL1, NL2 at cut-off 0.1."""
    return _picked(target_scores(spark, sf_dir))


def q_stream_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 without a trained model: ``embeddings`` as a file stream, scored, picked, appended to Parquet."""
    out, ckpt = shared_path(spark, "stream_pick_out"), shared_path(spark, "stream_pick_ckpt")
    q = start_stream(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet", read(spark, sf_dir, "embeddings").schema,
                     lambda emb: _picked(scored(folded_logits(emb))), out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out)


def q_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 stopped and started again: half of ``embeddings``, then the rest with the first half sent again; each row once."""
    src, out, ckpt = (shared_path(spark, f"stream_once_{x}") for x in ("in", "out", "ckpt"))
    rows = read(spark, sf_dir, "embeddings").withColumn("sent", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id")))

    def run() -> None:
        start_stream(spark, src, rows.schema, lambda emb: _picked(scored(folded_logits(emb))), out, ckpt, files_per_trigger=2,
                     once_by=["vec_id"], event_time="sent", delay="365 days").awaitTermination()

    first = rows.where(F.col("vec_id") % 2 == 0).repartition(3)
    first.write.mode("append").parquet(src)
    run()
    rows.where(F.col("vec_id") % 2 == 1).unionByName(first).repartition(3).write.mode("append").parquet(src)
    run()
    return spark.read.parquet(out)


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = target_scores(spark, sf_dir)
    return pick.cutoff_sweep(sc, {t: f"s_{t}" for t in TARGETS}, {t: "label" for t in TARGETS},
                             TEN_CLASSES, CUTOFFS)


def q_cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per cut-off and target (12 numpy cut-offs)."""
    return _sweep(spark, sf_dir).withColumn("accuracy", F.round("accuracy", 12))


def q_cutoff_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep with one column per target."""
    wide = pick.cutoff_wide(_sweep(spark, sf_dir), TARGETS)
    return wide.select("cutoff", *[F.round(t, 12).alias(t) for t in TARGETS])


def q_best_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cut-off by mean accuracy over targets."""
    return pick.best_cutoff(_sweep(spark, sf_dir))




def q_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A3: (brand, type) group sizes of ``part`` and their running total."""
    groups = sample.group_sizes(read(spark, sf_dir, "part"), ["p_brand", "p_type"])
    return sample.running_total(groups, ["p_brand", "p_type"])


def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: first ``part`` row (by key) of each (brand, type, name) duplicate group."""
    return sample.drop_duplicates_first(read(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"],
                                        "p_partkey")


def q_semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows whose part is in the key set of the SMALL parts."""
    keys = read(spark, sf_dir, "part").where(F.col("p_type") == "SMALL") \
        .select(F.col("p_partkey").alias("l_partkey"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return sample.semi_join(li, keys, ["l_partkey"])


def q_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the best and second label, and how many labels
    reach the cut-off."""
    sc = target_scores(spark, sf_dir)
    names = {v: k for k, v in TEN_CLASSES.items()}
    cols = []
    for t in TARGETS:
        ranked = pick.rank_scores(f"s_{t}", names)
        top = pick.top1(ranked)
        cols += [top["label"].alias(f"{t}_top"), F.round(top["score"], 9).alias(f"{t}_top_score"),
                 F.element_at(ranked, 2)["label"].alias(f"{t}_second"),
                 F.size(pick.filter_scores(ranked, CUTOFF)).alias(f"{t}_n_above")]
    return sc.select("vec_id", *cols)

# ------------------------------------------------ sources and sinks (IO1-IO7)

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO2 then IO1: documents written as ``;``-delimited part files (quoted line
    breaks included) and read back with a schema; rows equal the source."""
    path = shared_path(spark, "csv_round_trip")
    io.write_delimited(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"),
                       path)
    return io.read_delimited(spark, path, DOC_SCHEMA)


def q_split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO4 then IO5: split sets written partitioned by split; the test split read back."""
    path = shared_path(spark, "split_sets")
    io.write_split_sets(split_rows(spark, sf_dir), path, "text", "label_id")
    return io.load_split_sets(spark, path, "test").select("text", "label")


def q_weights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO3: the class weights' one-line ``%10.5f`` text form, written and read back."""
    path = shared_path(spark, "weights")
    io.write_class_weights(q_class_weights(spark, sf_dir), path)
    return spark.read.text(f"{path}/text")


def q_export_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO6: splits exported with label names, one delimited directory per split."""
    path = shared_path(spark, "export")
    rows = split_rows(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    io.export_split_names(rows, path, QUALITY, label_col="label_id")
    return spark.read.options(header="true", quote='"', escape='"', multiLine="true") \
        .schema("row_id long, text string, label string, split string").csv(path)


def q_read_delimited_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO1 without a schema: orders in several files, missing prices spelled NA, codes
    that look like suffixed numbers; row ids in the order of the files."""
    path, out = shared_path(spark, "inferred"), shared_path(spark, "inferred_rows")
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), F.concat((key % 100).cast("string"), F.lit("D")).alias("code"))
    io.write_delimited(rows.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return io.ingest_delimited(spark, path, out)


def q_dataset_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled-set job (P1, P7, S2, A1, IO3-IO5, E1): its written sets with the written weight of each row's label and the digest of its encoding."""
    paths = jobs.dataset_job(labelled_documents(spark, sf_dir), "text", "quality", QUALITY, shared_path(spark, "labelled_set"),
                             row_col="doc_id", test_size=TEST_SIZE, seed=SEED)
    weights = spark.read.parquet(f"{paths['weights']}/table").select("label_id", F.round("weight", 9).alias("weight"))
    rows = io.load_split_sets(spark, paths["dataset"])
    encoded = spark.read.parquet(paths["tokenized"]).select("doc_id", _id_digest("input_ids").alias("ids_md5"))
    return rows.join(weights, rows["label"] == weights["label_id"], "left").join(encoded, "doc_id").select(
        "doc_id", F.md5("text").alias("text_md5"), F.col("label").cast("int").alias("label"), "split", "weight", "ids_md5")


# ------------------------------------------------ encoding

WORD_VOCABULARY = encode.WORD_IDS


def _id_digest(c: str) -> Column:
    return F.md5(F.array_join(c, ","))


def q_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on hashed word ids: every document framed and padded to 512; digests of ids and mask."""
    ids = encode.word_ids(read(spark, sf_dir, "documents"), "text", ["doc_id"], WORD_VOCABULARY, max_words=encode.MAX_LENGTH - 2)
    rows = encode.pad_ids(ids, ["doc_id"])
    return rows.select("doc_id", _id_digest("input_ids").alias("ids_md5"), _id_digest("attention_mask").alias("mask_md5"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in vocabulary ``(piece, id)``: beginnings of up to four characters of the benchmark
    words and the words themselves, each also as an inner piece; ids are the first 28 bits of the piece's md5."""
    word = F.explode(F.split(F.col("text"), r"[\x20\x09-\x0D]+"))
    words = read(spark, sf_dir, "benchmark").select(word.alias("w")).where("w <> ''").distinct()
    some = words.select(F.explode(F.concat(F.array("w"), *[F.array(F.substring("w", 1, n)) for n in range(1, 5)])).alias("w"))
    both = some.select(F.explode(F.array(F.col("w"), F.concat(F.lit("##"), "w"))).alias("piece")).distinct()
    return both.withColumn("id", F.conv(F.substring(F.md5("piece"), 1, 7), 16, 10).cast("int"))


def q_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 by a table of word pieces: every document framed and padded to 512; known ids and digests of ids and mask."""
    ids = encode.piece_ids(read(spark, sf_dir, "documents"), "text", ["doc_id"], _pieces(spark, sf_dir), unknown_id=-1,
                           max_words=encode.MAX_LENGTH - 2)
    rows = encode.pad_ids(ids, ["doc_id"])
    return rows.select("doc_id", F.size(F.filter("input_ids", lambda x: x == -1)).cast("long").alias("n_unknown"),
                       _id_digest("input_ids").alias("ids_md5"), _id_digest("attention_mask").alias("mask_md5"))


def q_mask_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, E3 on hashed word ids with portable draws; digests of masked ids and targets."""
    ids = encode.word_ids(read(spark, sf_dir, "documents"), "text", ["doc_id"], WORD_VOCABULARY, max_words=encode.MAX_LENGTH - 2)
    rows = encode.mask_tokens(encode.frame_ids(ids, ["doc_id"]), "doc_id", mask_id=49408, vocab_size=49408,
                              seed=SEED, portable=True)
    return rows.select("doc_id", F.size("input_ids").cast("long").alias("n_ids"),
                       F.size(F.filter("labels", lambda x: x != encode.IGNORE_INDEX)).cast("long").alias("n_targets"),
                       _id_digest("input_ids").alias("ids_md5"), _id_digest("labels").alias("labels_md5"))


def q_pretrain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, P11, E3 as one job: documents split (S3), encoded, masked for two epochs; digests of the second epoch's sets."""
    rows = sample.unstratified_split(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", TEST_SIZE, SEED)
    paths = jobs.pretrain_dataset_job(rows, shared_path(spark, "pretrain"), key_col="doc_id", epochs=2, seed=SEED, portable=True)
    second = spark.read.parquet(paths["epoch1"])
    return second.select("doc_id", "split", _id_digest("input_ids").alias("ids_md5"), _id_digest("labels").alias("labels_md5"))


def q_encode_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, truncated and padded to 512."""
    return encode.encode_padded(read(spark, sf_dir, "documents"), "text", ["doc_id"])


def q_encode_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded to at most 512 ids with the special-token mask."""
    return encode.encode_variable(read(spark, sf_dir, "documents"), "text", ["doc_id"])


def q_mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 % masking of E2's ids (mask id 49408 = first free id)."""
    enc = encode.encode_variable(read(spark, sf_dir, "documents"), "text", ["doc_id"])
    return encode.mask_tokens(enc, "doc_id", mask_id=49408, vocab_size=49408, seed=SEED)


# ------------------------------------------------ train, score, predict

MODEL_TARGETS = ("quality", "toxic")


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(labelled_documents(spark, sf_dir), ["doc_id", "text"], list(MODEL_TARGETS))
    for t in MODEL_TARGETS:
        rows = map_labels(rows, t, QUALITY, f"{t}_id")
    return stratified_split(rows, "doc_id", "quality", test_size=TEST_SIZE, seed=SEED)


def _bundle(spark: SparkSession, sf_dir: str, save: bool = True) -> tuple[str | None, dict]:
    """T1 on the train split with balanced weights; saved as a bundle (IO7) when asked."""
    labels = {t: f"{t}_id" for t in MODEL_TARGETS}
    if not save:
        train_rows = _model_rows(spark, sf_dir).where("split = 'train'")
        return None, train_ops.train_models(train_rows, "text", labels, weight_mapping=QUALITY)
    path = shared_path(spark, "bundle")
    return path, jobs.train_job(_model_rows(spark, sf_dir), "text", labels, QUALITY, path)


def q_train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + C1: weighted classifiers per target, every document scored (ranked lists)."""
    _, models = _bundle(spark, sf_dir, save=False)
    scored = train_ops.score(read(spark, sf_dir, "documents").select("doc_id", "text"), models,
                             MODEL_TARGETS, len(TOXIC))
    id2name = {v: k for k, v in TOXIC.items()}
    return train_ops.ranked_scores(scored, MODEL_TARGETS, id2name).select(
        "doc_id", *[f"{t}_ranked" for t in MODEL_TARGETS])


def q_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regularisation settings per target, best by test accuracy."""
    rows = _model_rows(spark, sf_dir)
    table, _ = train_ops.best_run(rows.where("split = 'train'"), rows.where("split = 'test'"), "text",
                                  {t: f"{t}_id" for t in MODEL_TARGETS},
                                  [{"reg_param": 0.0}, {"reg_param": 0.1}])
    return table


def q_batch_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 (+IO7): bundle saved and loaded, every document labelled at cut-off 0.1."""
    path, _ = _bundle(spark, sf_dir)
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = jobs.batch_predict_job(spark, texts, path, MODEL_TARGETS, TOXIC, shared_path(spark, "predictions"))
    return out.drop("text")


def q_stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table read as a file stream, labelled, appended to Parquet."""
    _, models = _bundle(spark, sf_dir, save=False)
    out, ckpt = shared_path(spark, "stream_out"), shared_path(spark, "stream_ckpt")
    q = start_stream_predict(spark, f"{sf_dir.rstrip('/')}/documents.parquet", read(spark, sf_dir, "documents").schema,
                             models, MODEL_TARGETS, TOXIC, out, ckpt, cutoff=0.1, keep=["doc_id", "text"])
    q.awaitTermination()
    return spark.read.parquet(out).drop("text")

# ------------------------------------------------ models as tables (T1, T2, C1, C6, IO7), learned languages (P5b), tuning

def _label_columns() -> dict[str, str]:
    return {t: f"{t}_id" for t in MODEL_TARGETS}


def q_train_and_score_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + C1 as tables: class-weighted naive Bayes per target on the train split, every document scored."""
    train_rows = _model_rows(spark, sf_dir).where("split = 'train'")
    model = bayes.train(train_rows, "text", _label_columns(), len(QUALITY))
    out = bayes.score(read(spark, sf_dir, "documents"), ["doc_id"], "text", model, MODEL_TARGETS, len(QUALITY))
    return out.select("doc_id", *[F.round(F.col(f"s_{t}")[i], 9).alias(f"{t}_{i}") for t in MODEL_TARGETS for i in range(len(QUALITY))])


def q_batch_predict_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO7 + C6 as tables: models saved with a manifest, loaded, checked, every document labelled and written."""
    path = shared_path(spark, "table_bundle")
    jobs.train_tables_job(_model_rows(spark, sf_dir), "text", _label_columns(), QUALITY, path)
    out = jobs.batch_predict_tables_job(spark, read(spark, sf_dir, "documents"), ["doc_id"], "text", path, MODEL_TARGETS, QUALITY,
                                        shared_path(spark, "table_predictions"), cutoff=CUTOFF)
    return out.select("doc_id", *[c for t in MODEL_TARGETS for c in (f"{t}_label", F.round(f"{t}_score", 9).alias(f"{t}_score"))])


def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten epochs of a class-weighted softmax regression on ``embeddings``; loss, test accuracy and the best."""
    test = hash_bucket(hash_order(SEED, "vec_id"), 1) < "4"
    rows = read(spark, sf_dir, "embeddings").withColumn("split", F.when(test, "test").otherwise("train"))
    table, _ = epochs.train_epochs(rows, "embedding", "label", TEN_CLASSES, dimensions=64, epochs=10, rate=EPOCH_RATE)
    return table.select("epoch", F.round("loss", 9).alias("loss"), F.round("accuracy", 12).alias("accuracy"), "n_test", "best")


def q_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5(b) with learned profiles: half of the documents teach, all are detected, French ones go."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    teachers = docs.where(hash_bucket(hash_order(SEED, "doc_id"), 1) < "8")
    detected = language.detect(docs, ["doc_id"], "text", language.learn_profiles(teachers, "text", "lang", LANGUAGES), LANGUAGES)
    detected = written(detected, "detected")
    kept = language.drop_detected(docs.select("doc_id", "lang"), ["doc_id"], detected, "fr")
    return kept.join(detected, "doc_id")


def _sweep_counts(spark: SparkSession, sf_dir: str, cutoffs) -> DataFrame:
    sc = target_scores(spark, sf_dir)
    return pick.sweep_counts(sc, {t: f"s_{t}" for t in TARGETS}, {t: "label" for t in TARGETS}, TEN_CLASSES, cutoffs)


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("cutoff", "target", *[F.round(m, 9).alias(m) for m in ("accuracy", "balanced_accuracy", "mcc")])


def q_cutoff_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 per cut-off and target on the final picks."""
    return _rounded(pick.cutoff_metrics(_sweep_counts(spark, sf_dir, CUTOFFS)))


def q_best_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 by each of the three metrics."""
    best = pick.best_cutoffs(pick.cutoff_metrics(_sweep_counts(spark, sf_dir, CUTOFFS)), digits=9)
    return best


def q_sweep_counts_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 at 200 cut-offs: rows per cut-off, target, truth and pick."""
    return _sweep_counts(spark, sf_dir, FINE_CUTOFFS)


def q_tune_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8-C10 as a job, each target measured on its own test split (``vec_id`` modulo 3 names the target)."""
    own = F.element_at(F.array(*[F.lit(t) for t in TARGETS]), (F.col("vec_id") % 3 + 1).cast("int"))
    sc = target_scores(spark, sf_dir).withColumn("_target", own)
    res = jobs.sweep_job(sc, {t: f"s_{t}" for t in TARGETS}, {t: "label" for t in TARGETS}, TEN_CLASSES, shared_path(spark, "tuning"), CUTOFFS,
                         row_target_col="_target")
    return _rounded(res["metrics"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "class_weights": q_class_weights,
    "fill_and_map_labels": q_fill_and_map_labels,
    "labels_by_first_seen": q_labels_by_first_seen,
    "export_label_names": q_export_label_names,
    "normalise_text": q_normalise_text,
    "drop_multi_interval": q_drop_multi_interval,
    "drop_language": q_drop_language,
    "drop_language_words": q_drop_language_words,
    "idem_expand": q_idem_expand,
    "clean_chain": q_clean_chain,
    "stratified_split": q_stratified_split,
    "unstratified_split": q_unstratified_split,
    "split_counts": q_split_counts,
    "exact_sample": q_exact_sample,
    "exact_sample_large": q_exact_sample_large,
    "seeded_shuffle": q_seeded_shuffle,
    "minority_select": q_minority_select,
    "replicate_by_count": q_replicate_by_count,
    "crosstab": q_crosstab,
    "association": q_association,
    "association_pairs": q_association_pairs,
    "association_orders": q_association_orders,
    "confusion_counts": q_confusion_counts,
    "confusion_normalised": q_confusion_normalised,
    "argmax_accuracy": q_argmax_accuracy,
    "weighted_ce": q_weighted_ce,
    "metric_trio": q_metric_trio,
    "pick_labels": q_pick_labels,
    "cutoff_sweep": q_cutoff_sweep,
    "cutoff_wide": q_cutoff_wide,
    "best_cutoff": q_best_cutoff,
    "group_sizes": q_group_sizes,
    "dedup_first": q_dedup_first,
    "semi_join_keys": q_semi_join_keys,
    "top_labels": q_top_labels,
    "csv_round_trip": q_csv_round_trip,
    "split_sets": q_split_sets,
    "weights_text": q_weights_text,
    "export_splits": q_export_splits,
    "read_delimited_inferred": q_read_delimited_inferred,
    "dataset_job": q_dataset_job,
    "text_hook": q_text_hook,
    "drop_columns": q_drop_columns,
    "idem_chunks": q_idem_chunks,
    "minority_select_wide": q_minority_select_wide,
    "stream_pick": q_stream_pick,
    "encode_words": q_encode_words,
    "encode_pieces": q_encode_pieces,
    "mask_words": q_mask_words,
    "encode_padded": q_encode_padded,
    "encode_variable": q_encode_variable,
    "mask_tokens": q_mask_tokens,
    "train_and_score": q_train_and_score,
    "best_run": q_best_run,
    "batch_predict": q_batch_predict,
    "stream_predict": q_stream_predict,
    "train_and_score_nb": q_train_and_score_nb,
    "batch_predict_nb": q_batch_predict_nb,
    "best_epoch": q_best_epoch,
    "language_profiles": q_language_profiles,
    "cutoff_metrics": q_cutoff_metrics,
    "best_cutoffs": q_best_cutoffs,
    "sweep_counts_fine": q_sweep_counts_fine,
    "tune_cutoffs": q_tune_cutoffs,
    "pretrain_words": q_pretrain_words,
    "stream_once": q_stream_once,
}

ORACLE_SQL: dict[str, str] = oracle_sql(CUTOFFS, FINE_CUTOFFS, LANGUAGES, EPOCH_RATE)
