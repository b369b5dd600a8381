"""End-to-end jobs composed from the operators.

* ``dataset_job``       delimited table -> labelled split sets, class weights, encodings
* ``pretrain_dataset_job`` split sets -> encoded ids -> masked inputs and targets per epoch
* ``clean_job``         idem -> language -> intervals, written as a cleaned table
* ``train_job``         per-target classifiers on the train split, saved as a bundle
* ``predict_table``     C1 -> C3 on any table of texts (C6's core)
* ``batch_predict_job`` C6: texts in, picks out, written to Parquet
* ``train_tables_job``, ``batch_predict_tables_job``  the same with naive Bayes tables instead of fitted models
* ``sweep_job``         A12, C8-C10: score once, write, sweep cut-offs, three metrics, the best of each
* ``tune_cutoffs_job``  C8-C10 from a bundle and each target's own test split

Each job writes its results; later steps read the written tables, so lineage
stays short and a lost executor costs at most the current stage.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textstrata.operators import bayes, clean, encode, pick, sample, stats, train
from textstrata.operators.labels import map_labels
from textstrata.sources import io


def dataset_job(df: DataFrame, text_col: str, target_col: str, mapping: Mapping[str, int],
                out_dir: str, input_cols: Sequence[str] | None = None,
                output_cols: Sequence[str] | None = None, row_col: str = "row_id",
                test_size: float = 0.15, seed: int = 2023, sample_n: int = -1,
                save_preprocessed: bool = False, vocabulary: str | None = None,
                tokenize: bool = True, max_length: int = encode.MAX_LENGTH,
                pieces: DataFrame | None = None, unknown_id: int = 0) -> dict[str, str]:
    """The labelled-set job: sample, select and fill, map labels, split,
    class weights, split sets and their encodings.  Returns the written paths.

    Encodings are hashed word ids; with ``pieces``, a table ``(piece, id)``, they are
    that vocabulary's; with ``vocabulary`` they are that tokenizer file's."""
    spark = df.sparkSession
    paths = {k: os.path.join(out_dir, k) for k in ("preprocessed", "weights", "dataset", "tokenized")}
    rows = sample.exact_sample(df, sample_n, row_col, seed) if sample_n > 0 else df
    ins = list(input_cols or [text_col])
    outs = list(output_cols or [target_col])
    rows = clean.prepare(rows, [row_col, *[c for c in ins if c != row_col]], outs, text_col)
    rows = map_labels(rows, target_col, mapping, "label_id")
    rows = sample.stratified_split(rows, row_col, target_col, test_size, seed)
    if save_preprocessed:
        io.write_delimited(rows, paths["preprocessed"])
    rows.select(row_col, text_col, "label_id", "split").write.mode("overwrite") \
        .partitionBy("split").parquet(paths["dataset"] + "_rows")
    split_rows = spark.read.parquet(paths["dataset"] + "_rows")
    io.write_class_weights(stats.balanced_class_weights(split_rows, "label_id", mapping), paths["weights"],
                           target=target_col)
    io.write_split_sets(split_rows, paths["dataset"], text_col, "label_id", key_col=row_col)
    if tokenize:
        keys = [row_col, "label_id", "split"]
        enc = encode.pad_ids(_content_ids(split_rows, text_col, keys, vocabulary, pieces, unknown_id, max_length), keys, max_length)
        enc.write.mode("overwrite").partitionBy("split").parquet(paths["tokenized"])
    return paths


def _content_ids(rows: DataFrame, text_col: str, keys: Sequence[str], vocabulary: str | None,
                 pieces: DataFrame | None, unknown_id: int, max_length: int) -> DataFrame:
    """Content ids from a tokenizer file, a table of pieces, or word hashes; no more than truncation keeps."""
    if vocabulary is not None:
        return encode.token_ids(rows, text_col, keys, vocabulary, max_ids=max_length - 2)
    if pieces is not None:
        return encode.piece_ids(rows, text_col, keys, pieces, unknown_id, max_words=max_length - 2)
    return encode.word_ids(rows, text_col, keys, encode.WORD_IDS, max_words=max_length - 2)


def pretrain_dataset_job(split_sets: DataFrame, out_dir: str, key_col: str = "row_id",
                         vocabulary: str | None = None, mask_id: int = 49408, vocab_size: int = 49408,
                         epochs: int = 1, seed: int = 2023,
                         max_length: int = encode.MAX_LENGTH, portable: bool = False,
                         pieces: DataFrame | None = None, unknown_id: int = 0) -> dict[str, str]:
    """Masked-word training data: E2 (ids to ``max_length``, special-token
    mask), P11 (text and label dropped), E3 once per epoch with that epoch's
    draws; one Parquet set per epoch, partitioned by split.  Ids as in ``dataset_job``."""
    keys = [key_col, "split"]
    enc = encode.frame_ids(_content_ids(split_sets, "text", keys, vocabulary, pieces, unknown_id, max_length), keys, max_length)
    enc = clean.drop_columns(enc, "text", "label")
    enc.write.mode("overwrite").partitionBy("split").parquet(os.path.join(out_dir, "encoded"))
    stored = split_sets.sparkSession.read.parquet(os.path.join(out_dir, "encoded"))
    paths = {}
    for epoch in range(epochs):
        path = os.path.join(out_dir, f"masked_epoch{epoch}")
        encode.mask_tokens(stored, key_col, mask_id, vocab_size, seed=seed, epoch=epoch, portable=portable) \
            .write.mode("overwrite").partitionBy("split").parquet(path)
        paths[f"epoch{epoch}"] = path
    return paths


def clean_job(df: DataFrame, site_cols: Sequence[str], order_col: str, text_col: str, out_path: str,
              lang: str = "fr", lang_col: str | None = None) -> DataFrame:
    """P6 as a job: the cleaned table is written and read back."""
    clean.clean_chain(df, site_cols, order_col, text_col, lang, lang_col).write.mode("overwrite").parquet(out_path)
    return df.sparkSession.read.parquet(out_path)


def train_job(split_rows: DataFrame, text_col: str, label_cols: Mapping[str, str],
              weight_mapping: Mapping[str, int] | None, bundle_path: str, split_col: str = "split",
              max_iter: int = train.EPOCHS) -> dict:
    """T1 on the train split with A1's weights per target; the bundle is saved (IO7)."""
    tr = split_rows.where(F.col(split_col) == "train")
    models = train.train_models(tr, text_col, label_cols, max_iter=max_iter, weight_mapping=weight_mapping)
    io.save_bundle(models, bundle_path)
    return models


def predict_table(df: DataFrame, models: Mapping, targets: Sequence[str], label_ids: Mapping[str, int],
                  cutoff: float = 0.1, score_digits: int | None = None) -> DataFrame:
    """C1 -> C3: score every target, then pick distinct labels with the cut-off."""
    scored = train.score(df, models, targets, max(label_ids.values()) + 1)
    picked = pick.pick_labels(scored, {t: f"s_{t}" for t in targets}, label_ids, cutoff, score_digits)
    return picked.drop(*[f"s_{t}" for t in targets])


def batch_predict_job(spark: SparkSession, texts: DataFrame, bundle_path: str, targets: Sequence[str],
                      label_ids: Mapping[str, int], out_path: str, cutoff: float = 0.1) -> DataFrame:
    """Load the bundle (fails early on a missing target), predict, write."""
    models = io.load_bundle(bundle_path, ["features", *targets])
    predict_table(texts, models, targets, label_ids, cutoff).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def train_tables_job(split_rows: DataFrame, text_col: str, label_cols: Mapping[str, str], label_ids: Mapping[str, int], bundle_path: str,
                     split_col: str = "split", tokens: str = "words") -> None:
    """T1 as tables: naive Bayes with A1's class weights on the train split, saved as a bundle (IO7)."""
    model = bayes.train(split_rows.where(F.col(split_col) == "train"), text_col, label_cols, max(label_ids.values()) + 1, tokens)
    io.save_table_bundle(model, bundle_path, list(label_cols), label_ids, tokens)


def predict_with_tables(spark: SparkSession, texts: DataFrame, key_cols: Sequence[str], text_col: str, bundle_path: str, targets: Sequence[str],
                        label_ids: Mapping[str, int], cutoff: float = 0.1, tokens: str = "words", score_digits: int | None = None) -> DataFrame:
    """C1 -> C3 with a table bundle: the key columns and each target's label and score.

    The bundle is checked against targets, labels and token rule before any text
    is read; no part of the model is held by the driver.
    """
    model = io.load_table_bundle(spark, bundle_path, targets, label_ids, tokens)
    scored = bayes.score(texts, key_cols, text_col, model, targets, max(label_ids.values()) + 1, tokens)
    picked = pick.pick_labels(scored, {t: f"s_{t}" for t in targets}, label_ids, cutoff, score_digits)
    return picked.drop(*[f"s_{t}" for t in targets])


def batch_predict_tables_job(spark: SparkSession, texts: DataFrame, key_cols: Sequence[str], text_col: str, bundle_path: str, targets: Sequence[str],
                             label_ids: Mapping[str, int], out_path: str, cutoff: float = 0.1, tokens: str = "words") -> DataFrame:
    """C6 with a table bundle: predict, write, read back."""
    predict_with_tables(spark, texts, key_cols, text_col, bundle_path, targets, label_ids, cutoff, tokens).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def sweep_job(scores: DataFrame, score_cols: Mapping[str, str], truth_cols: Mapping[str, str],
              label_ids: Mapping[str, int], out_dir: str,
              cutoffs: Sequence[float] | None = None,
              row_target_col: str | None = None) -> dict[str, DataFrame]:
    """The scores are written once and swept over all cut-offs; accuracy,
    the three metrics and the best cut-off of each come from one table of counts."""
    spark = scores.sparkSession
    cols = sorted({*score_cols.values(), *truth_cols.values(), *([row_target_col] if row_target_col else [])})
    scores.select(*cols).write.mode("overwrite").parquet(os.path.join(out_dir, "scores"))
    stored = spark.read.parquet(os.path.join(out_dir, "scores"))
    counts = pick.sweep_counts(stored, score_cols, truth_cols, label_ids, cutoffs or pick.numpy_cutoffs(), row_target_col)
    counts.write.mode("overwrite").parquet(os.path.join(out_dir, "sweep_counts"))
    metrics = pick.cutoff_metrics(spark.read.parquet(os.path.join(out_dir, "sweep_counts")))
    metrics.write.mode("overwrite").parquet(os.path.join(out_dir, "sweep"))
    metrics = spark.read.parquet(os.path.join(out_dir, "sweep"))
    sweep = metrics.select("cutoff", "target", "accuracy")
    return {"sweep": sweep, "wide": pick.cutoff_wide(sweep, list(score_cols)), "best": pick.best_cutoff(sweep),
            "metrics": metrics, "best_by_metric": pick.best_cutoffs(metrics)}


def tune_cutoffs_job(spark: SparkSession, bundle_path: str, test_sets: Mapping[str, DataFrame],
                     label_ids: Mapping[str, int], out_dir: str,
                     cutoffs: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """The reference's cut-off tuning: for each target, its own test split
    (``text``, ``label`` ids) is labelled with the whole bundle (picks run over
    all targets) and only that target's pick is scored.  All test splits are
    scored in one pass (their union, tagged with the target), then swept."""
    targets = list(test_sets)
    models = io.load_bundle(bundle_path, ["features", *targets])
    tagged = None
    for t, rows in test_sets.items():
        part = rows.select("text", F.col("label").cast("int").alias("label"), F.lit(t).alias("_target"))
        tagged = part if tagged is None else tagged.unionByName(part)
    scored = train.score(tagged, models, targets, max(label_ids.values()) + 1)
    return sweep_job(scored, {t: f"s_{t}" for t in targets}, {t: "label" for t in targets}, label_ids,
                     out_dir, cutoffs, row_target_col="_target")
