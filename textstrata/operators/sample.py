"""Sampling, splitting and selection (S1-S8, with A2-A4 used by S4).

All random choices are "the first k rows of a stratum in seeded hash order"
(``functions.hashing``).  The exact form of that at scale is bucketed:

1. count rows per (stratum, hash bucket)      - one scan, map-side combined
2. per stratum, find the bucket in which the k-th row falls; only that
   bucket's rows are ranked, which gives the k-th order key of the stratum
3. flag every row by comparing its order key with that threshold

Steps 1 and 2 write tables with at most one row per (stratum, bucket) and one
per stratum (quotas and boundary buckets in the same plan) to the shared folder; joins against them are planned by their size
in bytes.  A stratum holding a third of all rows costs no more than others: its
work is spread over all scan tasks and only a ``1/16**digits`` slice of it is
ever ranked in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from textstrata.functions.hashing import hash_bucket, hash_order
from textstrata.operators.prefix import running_sum
from textstrata.session import written

DEFAULT_SEED = 2023
BUCKET_DIGITS = 4

_H, _B, _K, _CNT = "_ts_h", "_ts_b", "_ts_k", "_ts_cnt"


def _as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def _null_safe_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` compared null-safely (a missing stratum is a stratum of
    its own); the key columns of ``big`` are kept."""
    renamed = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    cond = None
    for k in keys:
        c = big[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return big.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def mark_first_k(df: DataFrame, strata: Sequence[str], key_cols: Sequence[str],
                 quotas: Callable[[DataFrame], DataFrame], out_col: str,
                 seed: int = DEFAULT_SEED, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Flag the first ``quota`` rows of each stratum in seeded hash order.

    ``quotas`` receives the per-stratum counts ``(*strata, n_c)`` and returns
    them with a ``quota`` column.  ``key_cols`` must identify a row (as the
    row position does in the reference); ties in the hash are broken by the
    key, and a key repeated at a threshold fails the job, because no exact
    number of rows could be taken there.
    """
    strata, key_cols = list(strata), list(key_cols)
    single = not strata
    if single:  # one stratum: a constant key for the small tables, literals at the end
        df = df.withColumn("_ts_all", F.lit(0))
        strata = ["_ts_all"]
    h = hash_order(seed, *key_cols)
    keyed = df.select(*strata, h.alias(_H), hash_bucket(F.col(_H), digits).alias(_B),
                      F.struct(*key_cols).alias(_K))

    # Counts per (stratum, bucket) -> quotas -> the bucket in which each
    # stratum's quota-th row falls.
    bucket_counts = written(keyed.groupBy(*strata, _B).agg(F.count(F.lit(1)).alias(_CNT)), "bucket-counts")
    class_counts = bucket_counts.groupBy(*strata).agg(F.sum(_CNT).alias("n_c"))
    quota_table = quotas(class_counts).select(*strata, "n_c", F.col("quota").cast("long"))
    w = Window.partitionBy(*strata).orderBy(_B)
    boundary = (
        _null_safe_join(bucket_counts, quota_table, strata, "inner")
        .withColumn("_before", F.coalesce(F.sum(_CNT).over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where((F.col("quota") > F.col("_before"))
               & (F.col("quota") <= F.col("_before") + F.col(_CNT))
               & (F.col("quota") < F.col("n_c")))
        .select(*strata, _B, (F.col("quota") - F.col("_before")).alias("_need")))

    # Only the boundary buckets' rows are ranked; the need-th is the threshold.
    wr = Window.partitionBy(*strata).orderBy(_H, _K)
    next_key = F.lead(F.struct(_H, _K)).over(wr)
    repeated = F.raise_error(F.lit("row keys repeat: an exact number of rows can't be taken"))
    ranked = (_null_safe_join(keyed, boundary, [*strata, _B], "inner")
              .withColumn("_rn", F.row_number().over(wr)).withColumn("_next", next_key)
              .where(F.col("_rn") == F.col("_need"))
              .withColumn("_th", F.when(F.col("_next").eqNullSafe(F.struct(_H, _K)), repeated).otherwise(F.col(_H))))
    threshold = ranked.select(*strata, "_th", F.col(_K).alias("_tk"))
    decide = written(_null_safe_join(quota_table, threshold, strata, "left"), "thresholds")

    rows = df.withColumn(_H, h).withColumn(_K, F.struct(*key_cols))
    if single:
        return _flag_with_literals(rows, decide, out_col).drop("_ts_all")
    flagged = _null_safe_join(rows, decide, strata, "left")
    take = (F.col("quota") >= F.col("n_c")) | (
        (F.col("quota") > 0) & (F.struct(F.col(_H), F.col(_K)) <= F.struct(F.col("_th"), F.col("_tk"))))
    return (flagged.withColumn(out_col, F.coalesce(take, F.lit(False)))
            .drop(_H, _K, "n_c", "quota", "_th", "_tk"))


def _flag_with_literals(rows: DataFrame, decide: DataFrame, out_col: str) -> DataFrame:
    """One stratum: its decision (one row, or none for an empty table) becomes literals, no join."""
    d = decide.first()
    if d is None or d["quota"] <= 0:
        take = F.lit(False)
    elif d["quota"] >= d["n_c"]:
        take = F.lit(True)
    else:
        ktype = rows.schema[_K].dataType
        tk = F.struct(*[F.lit(d["_tk"][f.name]).cast(f.dataType).alias(f.name) for f in ktype.fields])
        take = F.struct(F.col(_H), F.col(_K)) <= F.struct(F.lit(d["_th"]), tk)
    return rows.withColumn(out_col, take).drop(_H, _K)


def split_quotas(test_size: float, strict: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Train quota per stratum, as a stratified shuffle split sizes it.

    ``n_test = ceil(test_size * n)`` (double arithmetic), ``n_train = n - n_test``;
    each stratum gets ``floor(n_c * n_train / n)`` plus one for the strata with
    the largest remainders (ties: smaller stratum first) until ``n_train`` is
    reached.  Products are exact in decimal(38,0).  ``strict`` fails the job
    where a stratified split cannot be made (a stratum with one row, or a side
    with fewer rows than strata).
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie strictly between 0 and 1")

    def quotas(counts: DataFrame) -> DataFrame:
        strata = [c for c in counts.columns if c != "n_c"]
        dec = "decimal(38,0)"
        whole = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"), F.min("n_c").alias("least")).first()
        n = whole["n"] or 0
        n_test = math.ceil(float(test_size) * n)
        n_train = n - n_test
        impossible = strict and n > 0 and (whole["least"] < 2 or n_train < whole["k"] or n_test < whole["k"])
        prod = F.col("n_c").cast(dec) * F.lit(n_train).cast(dec)
        q = (counts.withColumn("_prod", prod)
             .withColumn("_base", F.expr(f"cast(_prod div cast({max(n, 1)} as {dec}) as long)"))
             .withColumn("_rem", F.col("_prod") % F.lit(max(n, 1)).cast(dec)))
        short = n_train - (q.agg(F.sum("_base")).first()[0] or 0)
        order = [F.desc("_rem"), *[F.asc_nulls_first(s) for s in strata]]
        q = running_sum(q, order, F.lit(1), "_rank")
        if impossible:
            q = q.withColumn("_base", F.raise_error(F.lit(
                "stratified split impossible: a stratum has fewer than 2 rows "
                "or a side has fewer rows than strata")).cast("long"))
        return q.select(*strata, "n_c", (F.col("_base") + (F.col("_rank") <= short).cast("long")).alias("quota"))

    return quotas


def stratified_split(df: DataFrame, key_cols: str | Sequence[str], strata: str | Sequence[str] | None,
                     test_size: float = 0.15, seed: int = DEFAULT_SEED,
                     split_col: str = "split", strict: bool = False,
                     digits: int = BUCKET_DIGITS) -> DataFrame:
    """S2 (and S3 with ``strata=None``): exact-size train/test split.

    Adds ``split`` = ``train``/``test``.  Sizes equal a stratified shuffle
    split's; membership is the seeded hash order within each stratum.
    """
    out = mark_first_k(df, _as_list(strata), _as_list(key_cols), split_quotas(test_size, strict),
                       "_ts_train", seed=seed, digits=digits)
    return out.withColumn(split_col, F.when(F.col("_ts_train"), "train").otherwise("test")).drop("_ts_train")


def unstratified_split(df: DataFrame, key_cols: str | Sequence[str], test_size: float = 0.15,
                       seed: int = DEFAULT_SEED, split_col: str = "split") -> DataFrame:
    """S3: the same split with one stratum (an unlabelled corpus)."""
    return stratified_split(df, key_cols, None, test_size, seed, split_col)


def exact_sample(df: DataFrame, n: int, key_cols: str | Sequence[str], seed: int = DEFAULT_SEED,
                 strict: bool = False) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the first ``n`` in seeded hash order.

    ``n <= 0`` returns every row (sampling off).  The sample is taken with the
    bucketed threshold, so no task holds more than one bucket of one stratum.
    ``strict`` fails when ``n`` exceeds the rows.
    """
    keys = _as_list(key_cols)
    if n <= 0:
        return df
    if strict:
        total = df.count()
        if n > total:
            raise ValueError(f"cannot take a sample of {n} from {total} rows")

    def quotas(counts: DataFrame) -> DataFrame:
        return counts.withColumn("quota", F.least(F.col("n_c"), F.lit(int(n))))

    marked = mark_first_k(df, [], keys, quotas, "_ts_take", seed=seed)
    return marked.where("_ts_take").drop("_ts_take")


def seeded_shuffle(df: DataFrame, key_cols: str | Sequence[str], seed: int = DEFAULT_SEED,
                   position_col: str = "position", digits: int = BUCKET_DIGITS) -> DataFrame:
    """A seeded permutation; adds each row's 0-based position in it.

    Positions are bucket offsets (from at most ``16**digits`` bucket counts,
    broadcast) plus the rank inside the bucket.  Buckets are hash ranges of
    the row key (which identifies a row), so they are equally full whatever
    the data; the one shuffle is by bucket.
    """
    keys = _as_list(key_cols)
    h = hash_order(seed, *keys)
    keyed = df.withColumn(_H, h).withColumn(_B, hash_bucket(F.col(_H), digits))
    counts = keyed.groupBy(_B).agg(F.count(F.lit(1)).alias(_CNT))
    offsets = counts.select(_B, (F.coalesce(F.sum(_CNT).over(
        Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_off"))
    offsets = written(offsets, "offsets")  # at most 16**digits rows of two numbers
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(_B).orderBy(_H, *keys)))
    return (ranked.join(F.broadcast(offsets), _B, "left")
            .withColumn(position_col, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop(_H, _B, "_off", "_rn"))


def replicate_by_count(df: DataFrame, count_col: str, copy_col: str = "copy",
                       chunk: int = 1 << 16) -> DataFrame:
    """Each row ``count`` times, numbered ``0 .. count-1`` in ``copy_col``.

    A large count is first cut into chunks of at most ``chunk`` copies and the
    chunks are spread over tasks, so a group holding a third of all rows is not
    expanded inside one task.
    """
    n = F.col(count_col).cast("long")
    n_chunks = F.ceil(n / F.lit(chunk)).cast("long")
    chunk_ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n_chunks - 1))
    chunks = df.withColumn("_ts_c", F.explode(chunk_ids))
    # An explicit partition count: adaptive coalescing would otherwise put the
    # (tiny, not yet expanded) chunk rows back into one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(parts, F.col("_ts_c"), *[F.col(c) for c in df.columns])
    lo = F.col("_ts_c") * F.lit(chunk)
    hi = F.least(lo + F.lit(chunk), n) - 1
    return (spread.withColumn(copy_col, F.explode(F.sequence(lo, hi)))
            .drop("_ts_c"))


def semi_join(df: DataFrame, keys_df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys_df``; the join strategy follows the sizes."""
    return df.join(keys_df.select(*on), list(on), "left_semi")


def concat_rows(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def _group_key(df: DataFrame, name: str) -> Column:
    """The column itself, or the SHA-256 of a text or binary column (null stays null)."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return F.unhex(F.sha2(F.encode(F.col(name), "UTF-8"), 256))
    return F.unhex(F.sha2(F.col(name), 256)) if isinstance(kind, BinaryType) else F.col(name)


def first_of_duplicates(df: DataFrame, subset: Sequence[str], order_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, order_col)`` of the first row of each duplicate group, without its texts.

    ``keep`` names columns of ``subset`` that aren't digested away.  Texts are
    compared by their SHA-256, so long ones are neither shuffled nor sorted and
    the aggregation is a hash aggregation, combined map-side.
    """
    digests = [_group_key(df, c).alias(f"_ts_d{i}") for i, c in enumerate(subset) if c not in keep]
    slim = df.select(*keep, order_col, *digests) if order_col not in keep else df.select(*keep, *digests)
    names = [c for c in slim.columns if c.startswith("_ts_d")]
    return slim.groupBy(*keep, *names).agg(F.min(order_col).alias(order_col)).drop(*names)


def drop_duplicates_first(df: DataFrame, subset: Sequence[str], order_col: str) -> DataFrame:
    """A4: keep the first row (smallest ``order_col``) of each duplicate group.

    ``order_col`` identifies a row, as the row position does.  The first row of
    a group is found on digests (``first_of_duplicates``); the kept rows are
    then fetched by it, by a join planned by its bytes.  Null keys are equal to
    each other; an empty table stays empty.
    """
    kept = first_of_duplicates(df, subset, order_col).withColumnRenamed(order_col, "_ts_first")
    return df.join(kept, F.col(order_col) == F.col("_ts_first"), "left_semi")


def group_sizes(df: DataFrame, cols: Sequence[str], count_col: str = "count") -> DataFrame:
    """A2: rows per group (null keys dropped); ``group_sizes_ordered`` sorts them."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    src = df.where(cond) if cond is not None else df
    return src.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_col))


def group_sizes_ordered(df: DataFrame, cols: Sequence[str], count_col: str = "count") -> DataFrame:
    """A2: ``group_sizes`` ascending by size, then by the group columns."""
    return group_sizes(df, cols, count_col).orderBy(count_col, *cols)


def running_total(groups: DataFrame, cols: Sequence[str], count_col: str = "count",
                  out_col: str = "cum") -> DataFrame:
    """A3: running total of group sizes in ascending size order, summed per
    range of the order, so the groups never meet in one task."""
    return running_sum(groups, [F.col(count_col), *[F.col(c) for c in cols]], F.col(count_col), out_col)


def minority_select(df: DataFrame, targets: Sequence[str], text_col: str, row_col: str,
                    num_samples: int, minor_ratio: float, seed: int = DEFAULT_SEED,
                    disjoint: bool = False, pool_col: str = "pool") -> DataFrame:
    """Minority-first selection of rows to label.

    ``M = int(minor_ratio*N)``, ``R = int((1-minor_ratio)*N)``.  On the rows
    deduplicated on targets + text (first row kept): every row of the groups
    whose running size total (ascending) is ``<= M``, plus exactly ``R`` rows
    in seeded hash order from the groups with running total ``> M - R``
    (``> M`` when ``disjoint``).  The two parts are concatenated, so a row can
    occur twice unless ``disjoint``.
    """
    if not 0.0 < minor_ratio < 1.0:
        raise ValueError(f"minor_ratio is {minor_ratio}; a share strictly between 0 and 1 is needed")
    targets = list(targets)
    n_minor = int(minor_ratio * num_samples)
    n_random = int((1 - minor_ratio) * num_samples)
    # Decided on targets and row key alone; the kept rows are fetched by key.
    kept = written(first_of_duplicates(df, [*targets, text_col], row_col, keep=targets), "kept-rows")
    groups = written(running_total(group_sizes(kept, targets), targets), "groups")
    bound = n_minor if disjoint else n_minor - n_random
    minor = semi_join(kept, groups.where(F.col("cum") <= n_minor), targets).select(row_col)
    pool = semi_join(kept, groups.where(F.col("cum") > bound), targets).select(row_col)
    rand = exact_sample(pool, n_random, [row_col], seed=seed) if n_random > 0 else pool.limit(0)
    picked = written(concat_rows(minor.withColumn(pool_col, F.lit("minor")),
                                 rand.withColumn(pool_col, F.lit("random"))), "picked")
    return df.join(picked, row_col).select(*df.columns, pool_col)
