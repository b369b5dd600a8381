"""Readers and writers (IO1-IO7).

Delimited files are read and written in parallel as directories of part files
(never ``coalesce(1)``).  They are ingested once into Parquet with a ``row_id``
in the order of the files, and all later work reads the Parquet copy.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from textstrata.operators.labels import id_to_label
from textstrata.session import written

# The strings that pandas' delimited reader treats as missing by
# default (public pandas behaviour, which the reference's reader relies on).
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def normalise_missing(df: DataFrame, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Every string column: a value that is one of ``tokens`` becomes null."""
    toks = list(tokens)
    return df.select(*[
        F.when(F.col(f.name).isin(toks), F.lit(None).cast("string")).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields])


#: What counts as a number; the engine's own cast also takes suffixes such as ``10D``.
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def infer_numeric(df: DataFrame) -> DataFrame:
    """String columns whose every non-null value is an integer become ``long``,
    else whose every non-null value is a number become ``double``.

    Runs after missing-value normalisation, so ``NA`` in a number column
    gives a null number (as pandas' reader does).  One aggregation pass of
    partial counts decides all columns.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not cols:
        return df
    counts = df.agg(*[e for c in cols for e in (
        F.count(F.col(c)).alias(f"{c}__n"),
        F.count(F.when(F.col(c).rlike(_INTEGER), F.col(c).try_cast("bigint"))).alias(f"{c}__l"),
        F.count(F.when(F.col(c).rlike(_NUMBER), F.col(c).try_cast("double"))).alias(f"{c}__d"))]).first()
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in cols and counts[f"{c}__n"] > 0 and counts[f"{c}__l"] == counts[f"{c}__n"]:
            out.append(F.col(c).cast("bigint").alias(c))
        elif c in cols and counts[f"{c}__n"] > 0 and counts[f"{c}__d"] == counts[f"{c}__n"]:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _delimited_text(spark: SparkSession, path: str, schema: StructType | str | None, sep: str,
                    multiline: bool) -> DataFrame:
    reader = spark.read.options(**_CSV_OPTIONS).option("sep", sep) \
        .option("multiLine", str(multiline).lower()).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   sep: str = ";", multiline: bool = True,
                   na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """IO1: delimited text with a header; missing-value spellings become null.

    With a schema nothing is inferred.  Without one, every column is read as
    text, missing spellings become null, and then number columns are
    recognised (``infer_numeric``).  ``multiline`` allows quoted line breaks,
    and each file is then read by one task.
    """
    rows = normalise_missing(_delimited_text(spark, path, schema, sep, multiline), na_tokens)
    return rows if schema is not None else infer_numeric(rows)


def ingest_delimited(spark: SparkSession, path: str, out_path: str,
                     schema: StructType | str | None = None, sep: str = ";",
                     row_col: str = "row_id", multiline: bool = False) -> DataFrame:
    """IO1 + ingest: read once, number the rows, write Parquet, read that back.

    Files are split among tasks; a quoted line break then fails the job, and
    ``multiline=True`` reads each file whole.
    ``row_id`` counts from 0 in the order of file path and position in the file,
    however the files are packed into tasks.  A task reads each piece of a file
    as one run of rows, so a row's place is its distance from the first row of
    its piece, plus the rows of all earlier pieces (a table of one short row
    per piece).  It is assigned once here and stored, never recomputed.
    """
    text = _delimited_text(spark, path, schema, sep, multiline)
    staged = written(text.select(
        "*", F.col("_metadata.file_path").alias("_ts_file"), F.col("_metadata.file_block_start").alias("_ts_at"),
        F.monotonically_increasing_id().alias("_ts_id")), "delimited")
    pieces = staged.groupBy("_ts_file", "_ts_at").agg(F.min("_ts_id").alias("_ts_first"), F.count(F.lit(1)).alias("_ts_n"))
    earlier = Window.orderBy("_ts_file", "_ts_at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_ts_before", F.coalesce(F.sum("_ts_n").over(earlier), F.lit(0))).drop("_ts_n")
    numbered = (staged.join(pieces, ["_ts_file", "_ts_at"])
                .withColumn(row_col, F.col("_ts_before") + F.col("_ts_id") - F.col("_ts_first")))
    out = normalise_missing(numbered.select(*text.columns, row_col))
    if schema is None:
        out = infer_numeric(out)
    out.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite",
                    partition_by: Sequence[str] = ()) -> None:
    """IO2 (and IO6): a directory of delimited part files with a header."""
    w = df.write.mode(mode).options(**_CSV_OPTIONS).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def weights_text(weights: DataFrame, fmt: str = "%10.5f") -> DataFrame:
    """IO3 text form: one line, the weights in class order, each as ``fmt``
    and separated by a space.  Built from the per-class table (one row per class)."""
    return weights.agg(F.concat_ws(" ", F.transform(
        F.array_sort(F.collect_list(F.struct("label_id", "weight"))),
        lambda s: F.format_string(fmt, s["weight"]))).alias("value"))


def write_class_weights(weights: DataFrame, path: str, target: str | None = None) -> None:
    """IO3: the ``([target,] label_id, label, n, weight)`` table at full
    precision, and its one-line text form next to it."""
    table = weights.select(F.lit(target).alias("target"), "*") if target else weights
    table.write.mode("overwrite").parquet(os.path.join(path, "table"))
    weights_text(weights).write.mode("overwrite").text(os.path.join(path, "text"))


def write_split_sets(df: DataFrame, path: str, text_col: str, label_col: str,
                     split_col: str = "split", splits: Sequence[str] = ("train", "test"),
                     key_col: str | None = None) -> None:
    """IO4: ``{text, label}`` per split (plus the row key when given, which
    seeds later per-row draws), Parquet partitioned by split; rows of other
    splits (``NOT_SET``) are left out."""
    keep = [F.col(key_col)] if key_col else []
    (df.where(F.col(split_col).isin(list(splits)))
     .select(*keep, F.col(text_col).alias("text"), F.col(label_col).alias("label"),
             F.col(split_col).alias("split"))
     .write.mode("overwrite").partitionBy("split").parquet(path))


def load_split_sets(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """IO5: all splits, or one (partition pruning skips the other directories)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split is not None else df


def export_split_names(df: DataFrame, path: str, mapping: Mapping[str, int], row_col: str = "row_id",
                       text_col: str = "text", label_col: str = "label", split_col: str = "split") -> None:
    """IO6: label ids back to names (unknown id fails), delimited, one directory per split."""
    out = df.select(row_col, F.col(text_col).alias("text"),
                    id_to_label(label_col, mapping).alias("label"), F.col(split_col).alias("split"))
    write_delimited(out, path, sep=",", partition_by=("split",))


def save_bundle(models: Mapping[str, object], path: str) -> None:
    """IO7: one saved Spark ML model per target under ``<path>/<target>``."""
    for target, model in models.items():
        model.write().overwrite().save(os.path.join(path, target))


def load_bundle(path: str, targets: Sequence[str]):
    """IO7: load every target's model; a missing directory fails before any job."""
    from pyspark.ml import PipelineModel

    spark = SparkSession.getActiveSession()
    for folder in (path, *(os.path.join(path, t) for t in targets)):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"no model folder at {folder}")
    return {t: PipelineModel.load(os.path.join(path, t)) for t in targets}



#: Layout version of a table bundle.
BUNDLE_VERSION = 1


def _exists(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_table_bundle(model: DataFrame, path: str, targets: Sequence[str], label_ids: Mapping[str, int], tokens: str) -> None:
    """IO7 as tables: ``<path>/weights`` (one folder per target) and a manifest of
    layout version, token rule, targets and label ids, written last."""
    model.write.mode("overwrite").partitionBy("target").parquet(os.path.join(path, "weights"))
    rows = [(BUNDLE_VERSION, tokens, t, int(i), name) for t in targets for name, i in label_ids.items()]
    spark = model.sparkSession
    spark.createDataFrame(rows, "version int, tokens string, target string, label_id int, label string") \
        .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "manifest"))


def load_table_bundle(spark: SparkSession, path: str, targets: Sequence[str], label_ids: Mapping[str, int], tokens: str) -> DataFrame:
    """IO7 as tables: the model of ``targets``, checked before any text is read.

    A missing folder or target fails without a job; another layout version, token
    rule or label table fails after reading the manifest (a row per label).
    """
    for folder in ("manifest", "weights", *(f"weights/target={t}" for t in targets)):
        if not _exists(spark, os.path.join(path, folder)):
            raise FileNotFoundError(f"no model folder at {os.path.join(path, folder)}")
    rows = spark.read.parquet(os.path.join(path, "manifest")).collect()
    for t in targets:
        own = {r["label"]: r["label_id"] for r in rows if r["target"] == t}
        if own != dict(label_ids):
            raise ValueError(f"the bundle's labels of {t} are {own}, not {dict(label_ids)}")
    if {(r["version"], r["tokens"]) for r in rows} != {(BUNDLE_VERSION, tokens)}:
        raise ValueError(f"the bundle isn't of layout {BUNDLE_VERSION} with the token rule {tokens}")
    schema = "token string, weights array<bigint>, target string"
    return spark.read.schema(schema).parquet(os.path.join(path, "weights")).where(F.col("target").isin(list(targets)))
