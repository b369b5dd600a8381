"""Helpers shared by the operators: written tables in the shared folder and
UTF-8 word access on Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textstrata.session import checkpoint_dir

#: Words are maximal runs outside space, tab, line feed, VT, FF and CR.  As
#: ``bytes.split()`` cuts exactly there, Python and JVM code agree on them.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir``, in folders of the columns ``by``, and read it back.

    Later steps then start from files every executor can read, so a lost
    executor costs its own tasks and not the work before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, without copies: what Python makes of
    a slice is freed before the next one, so long texts take no more memory than a slice of them."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text modulo ``buckets``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets, F.lit(-1))
