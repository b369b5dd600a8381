"""Label tables and label <-> id mapping.

A label table is small and fixed by the caller, so it is applied as a literal
map inside the projection: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The default label table of the reference (name -> id is the
# position in this tuple), its extra class for the secondary targets, the
# target names and the value that stands for a missing entry.
LITHOLOGY_LABELS = (
    "fijn_zand", "grind", "zand_onb", "grof_zand", "klei",
    "veen", "middel_zand", "leem", "silt",
)
NONE_LABEL = "none"
MAIN_TARGET = "HL_cor"
SECONDARY_TARGETS = ("NL1_cor", "NL2_cor")
DEFAULT_TARGETS = (MAIN_TARGET, *SECONDARY_TARGETS)
TEXT_COLUMN = "beschrijving"


def label2id(labels: Sequence[str] | Mapping[str, int], with_none: bool = False) -> dict[str, int]:
    """Name -> id; a sequence is numbered by position, ``with_none`` appends ``none``."""
    table = dict(labels) if isinstance(labels, Mapping) else {n: i for i, n in enumerate(labels)}
    if with_none and NONE_LABEL not in table:
        table[NONE_LABEL] = max(table.values(), default=-1) + 1
    return table


def target_label2id(target: str, labels: Sequence[str] = LITHOLOGY_LABELS,
                    main_target: str = MAIN_TARGET,
                    secondary_targets: Sequence[str] = SECONDARY_TARGETS) -> dict[str, int]:
    """The main target has the plain table, secondary targets add ``none``."""
    if target == main_target:
        return label2id(labels)
    if target in secondary_targets:
        return label2id(labels, with_none=True)
    raise ValueError(f"no label table for {target!r}")


def label_table(spark: SparkSession, mapping: Mapping[str, int]) -> DataFrame:
    """The label table as a (label, label_id) DataFrame."""
    return spark.createDataFrame(sorted(mapping.items(), key=lambda kv: kv[1]),
                                 "label string, label_id int")


def target_label_table(spark: SparkSession, targets: Sequence[str] = DEFAULT_TARGETS,
                       labels: Sequence[str] = LITHOLOGY_LABELS) -> DataFrame:
    """P9 as one table: ``(target, label, label_id)`` for every target."""
    rows = [(t, name, i) for t in targets for name, i in target_label2id(t, labels).items()]
    return spark.createDataFrame(rows, "target string, label string, label_id int")


def _literal_map(mapping: Mapping, key_type: str, value_type: str) -> Column:
    if not mapping:
        return F.create_map().cast(f"map<{key_type},{value_type}>")
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k).cast(key_type), F.lit(v).cast(value_type)]
    return F.create_map(*pairs)


def label_to_id(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Name -> id; a name not in the table gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(_literal_map(mapping, "string", "int"), c.cast("string"))


def map_labels(df: DataFrame, col: str, mapping: Mapping[str, int],
               out_col: str = "label_id") -> DataFrame:
    """P7 as a table operator."""
    return df.withColumn(out_col, label_to_id(col, mapping))


def id_to_label(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Id -> name; an unknown id fails the job, as a dictionary lookup does."""
    c = F.col(c) if isinstance(c, str) else c
    inverse = {v: k for k, v in mapping.items()}
    name = F.try_element_at(_literal_map(inverse, "int", "string"), c.cast("int"))
    return F.when(name.isNull(),
                  F.raise_error(F.concat(F.lit("unknown label id: "), c.cast("string")))
                  ).otherwise(name)


def labels_by_first_seen(df: DataFrame, label_col: str, order_col: str) -> DataFrame:
    """P10: ids numbered by the first row (by ``order_col``) where a label occurs.

    The aggregation runs distributed; the numbering window runs on the
    distinct-label table only.  A missing value counts as a label.
    """
    first = df.groupBy(label_col).agg(F.min(order_col).alias("first_seen"))
    w = Window.orderBy("first_seen", label_col)
    return first.select(
        F.col(label_col).alias("label"),
        (F.row_number().over(w) - 1).cast("int").alias("label_id"),
    )
