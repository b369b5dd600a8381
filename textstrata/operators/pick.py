"""Scores, ranking and distinct-label picking (C2-C5), the cut-off sweep.

Scores of a row are one ``array<double>`` per target, indexed by label id;
all targets share one label table (ids and names), because the picking rule
compares label *names* across targets.

Picking runs targets in their declared order and takes, per target, the best
label with ``score >= cutoff`` that no earlier target has taken; otherwise the
fallback ``("none", -1)``.  A picked label - a predicted ``none`` included - is
taken; a fallback is not.  NaN is no score.  Picking is row-local - no join, no shuffle: one projection
per target, whatever the size of the label table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.functions.arrays import let
from textstrata.operators.labels import NONE_LABEL, id_to_label
from textstrata.operators.stats import metrics_from_counts

FALLBACK_SCORE = -1.0


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scored(scores: Column) -> Column:
    """``array<double>`` -> ``array<struct<score, nid>>`` with ``nid = -label_id``,
    so that the struct maximum breaks score ties towards the smaller id."""
    return F.transform(scores, lambda x, i: F.struct(x.cast("double").alias("score"), (-i).alias("nid")))


def rank_scores(scores: str | Column, id2name: Mapping[int, str]) -> Column:
    """The full distribution as ``array<struct<label_id, label, score>>``,
    by score descending (ties: smaller id first).  Ids may have gaps; a position
    that no label has gets a null name."""
    names = F.create_map(*[F.lit(x) for i in sorted(id2name) for x in (int(i), id2name[i])])
    ordered = F.array_sort(F.transform(_c(scores), lambda x, i: F.struct(
        (-x.cast("double")).alias("neg"), i.alias("label_id"))))
    return F.transform(ordered, lambda s: F.struct(
        s["label_id"].alias("label_id"), F.try_element_at(names, s["label_id"]).alias("label"),
        (-s["neg"]).alias("score")))


def filter_scores(ranked: str | Column, cutoff: float | Column, exclude: Column | None = None) -> Column:
    """C4: keep entries with ``score >= cutoff`` whose label id is not excluded."""
    c = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    if exclude is None:
        return F.filter(_c(ranked), lambda x: x["score"] >= c)
    return F.filter(_c(ranked), lambda x: (x["score"] >= c) & ~F.array_contains(exclude, x["label_id"]))


def top1(ranked: str | Column) -> Column:
    """First entry of a ranked list (null when empty)."""
    return F.try_element_at(_c(ranked), F.lit(1))


def pick_fold(score_cols: Sequence[str | Column], cutoff: float | Column) -> Column:
    """``array<struct<score, nid>>`` of picks, one per target; null = fallback."""
    c = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    per_target = F.array(*[_scored(_c(s)) for s in score_cols])
    start = F.struct(F.array().cast("array<int>").alias("used"),
                     F.array().cast("array<struct<score:double,nid:int>>").alias("picks"))

    def step(acc: Column, t: Column) -> Column:
        best = F.array_max(F.filter(t, lambda x: (x["score"] >= c) & ~F.isnan(x["score"])
                                    & ~F.array_contains(acc["used"], -x["nid"])))
        return let(best, lambda b: F.struct(
            F.when(b.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(-b["nid"]))).alias("used"),
            F.concat(acc["picks"], F.array(b)).alias("picks")))

    return F.aggregate(per_target, start, step)["picks"]


def _open_entry(cutoff: Column, earlier: Sequence[str]):
    """Whether a scored entry reaches the cut-off and no pick in ``earlier`` took it."""
    def test(x: Column) -> Column:
        ok = (x["score"] >= cutoff) & ~F.isnan(x["score"])
        for prev in earlier:
            ok = ok & (F.col(prev).isNull() | (F.col(prev)["nid"] != x["nid"]))
        return ok
    return test


def with_picks(df: DataFrame, score_cols: Sequence[str | Column], cutoff: float | Column,
               num_labels: int, prefix: str = "_ts_pk") -> tuple[DataFrame, list[str]]:
    """C3 with the label count known: one column per target holding the pick
    (``struct<score, nid>``, null = fallback), the same rule as ``pick_fold``.

    One projection per target: the greatest scored entry that reaches the
    cut-off and that no earlier pick took.  The expression does not grow with
    the label table, so label tables of any size run the same plan.  A score
    array longer than the label table fails the job (as an unknown id does).
    """
    cols = [_c(x) for x in score_cols]
    names = [f"{prefix}{i}" for i in range(len(cols))]
    c = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    out = df
    for t, col in enumerate(cols):
        best = F.array_max(F.filter(_scored(col), _open_entry(c, names[:t])))
        too_long = F.raise_error(F.lit(f"more scores than the {num_labels} labels of the table"))
        out = out.withColumn(names[t], F.when(F.size(col) > num_labels, too_long).otherwise(best))
    return out, names


def pick_labels(df: DataFrame, score_cols: Mapping[str, str | Column], label_ids: Mapping[str, int],
                cutoff: float | Column = 0.0, score_digits: int | None = None) -> DataFrame:
    """C3 as a table operator: adds ``<target>_label`` and ``<target>_score``.

    ``score_cols`` maps target -> scores column, in the targets' order.  The
    fallback is ``("none", -1.0)``.  ``score_digits`` rounds reported scores.
    """
    targets = list(score_cols)
    out, picks = with_picks(df, [score_cols[t] for t in targets], cutoff, _num_labels(label_ids))
    for t, p in zip(targets, picks):
        pc = F.col(p)
        score = pc["score"] if score_digits is None else F.round(pc["score"], score_digits)
        out = (out.withColumn(f"{t}_label", F.when(pc.isNull(), F.lit(NONE_LABEL))
                              .otherwise(id_to_label(-pc["nid"], label_ids)))
               .withColumn(f"{t}_score", F.coalesce(score, F.lit(FALLBACK_SCORE))))
    return out.drop(*picks)


def _num_labels(label_ids: Mapping[str, int]) -> int:
    """Score arrays are indexed by label id: their length is the highest id + 1."""
    return max(label_ids.values()) + 1 if label_ids else 0


def numpy_cutoffs(start: float = 0.1, stop: float = 0.7, step: float = 0.05) -> list[float]:
    """The sweep's cut-offs exactly as ``numpy.arange`` produces them."""
    return [float(x) for x in np.arange(start, stop, step)]


def _count_up_to(cutoffs: Sequence[float], x: str) -> str:
    """SQL of how many of the sorted cut-offs are ``<= x``, by binary search."""
    every = ", ".join(f"{c!r}D" for c in cutoffs)
    steps = ", ".join(str(1 << k) for k in reversed(range(max(1, len(cutoffs)).bit_length())))
    return (f"aggregate(array({steps}), 0, (at, s) -> if(at + s <= {len(cutoffs)} "
            f"and coalesce(try_element_at(array({every}), at + s) <= {x}, false), at + s, at))")


def with_pick_intervals(df: DataFrame, score_cols: Sequence[str], num_labels: int, prefix: str = "_ts_iv") -> tuple[DataFrame, list[str]]:
    """C3 at every cut-off at once: per target an array of ``(lo, hi, used, pick)``.

    For a cut-off in ``(lo, hi]`` the target's pick is ``pick`` (null: fallback)
    and ``used`` are the ids that the targets up to it have taken.  A row's picks
    change only at scores of its own, so a target cuts each interval once at
    most, where the best label not yet taken falls below the cut-off.
    """
    out, names = df, [f"{prefix}{i}" for i in range(len(score_cols))]
    before = "array(named_struct('lo', double('-Infinity'), 'hi', double('Infinity'), 'used', cast(array() as array<int>), 'pick', cast(null as int)))"

    def piece(lo: str, hi: str, taken: bool) -> str:
        used, pick = ("concat(v.used, array(-b.nid))", "-b.nid") if taken else ("v.used", "cast(null as int)")
        return f"named_struct('lo', {lo}, 'hi', {hi}, 'used', {used}, 'pick', {pick})"

    for name, col in zip(names, score_cols):
        best = (f"array_max(filter(transform(`{col}`, (x, i) -> named_struct('score', double(x), 'nid', -i)), "
                "x -> x.score is not null and not isnan(x.score) and not array_contains(v.used, -x.nid)))")
        cut = (f"case when b is null or b.score <= v.lo then array({piece('v.lo', 'v.hi', False)}) "
               f"when b.score >= v.hi then array({piece('v.lo', 'v.hi', True)}) "
               f"else array({piece('v.lo', 'b.score', True)}, {piece('b.score', 'v.hi', False)}) end")
        too_long = f"raise_error('more scores than the {num_labels} labels of the table')"
        out = out.withColumn(name, F.expr(f"case when size(`{col}`) > {num_labels} then {too_long} "
                                          f"else flatten(transform({before}, v -> transform(array({best}), b -> {cut})[0])) end"))
        before = f"`{name}`"
    return out, names


def sweep_counts(df: DataFrame, score_cols: Mapping[str, str | Column], truth_cols: Mapping[str, str], label_ids: Mapping[str, int],
                 cutoffs: Sequence[float], row_target_col: str | None = None) -> DataFrame:
    """Rows per ``(cutoff, target, truth, pick)`` (label ids; the fallback is the ``none`` id, or -1 without one).

    Each row gives the stretches of cut-offs over which its picks stay, as a +1
    where a stretch begins and a -1 behind its end; the sums of those are added
    up along the cut-offs.  The work per row doesn't grow with their number, and
    what is shuffled is bounded by labels and cut-offs.  A row without a truth
    fails the job.  With ``row_target_col`` a row counts only for the target named
    there (each target's own test split), while its picks run over all targets.
    """
    targets, cuts = list(score_cols), sorted({float(c) for c in cutoffs})
    none_id = label_ids.get(NONE_LABEL, -1)
    extra = [F.col(row_target_col).alias("_row_target")] if row_target_col else []
    rows = df.select(*[_c(score_cols[t]).alias(f"_s{i}") for i, t in enumerate(targets)],
                     *[F.col(truth_cols[t]).cast("int").alias(f"_y{i}") for i, t in enumerate(targets)], *extra)
    cut, names = with_pick_intervals(rows, [f"_s{i}" for i in range(len(targets))], _num_labels(label_ids))

    def marks_of(i: int, name: str) -> str:
        """SQL of the marks of one target: where each stretch begins, and behind its end."""
        mark = "named_struct('_t', {i}, 'truth', coalesce(`_y{i}`, int(raise_error({no_truth}))), 'pick', s.pick, 'at', s.{at}, 'd', {d})"
        no_truth = "'" + f"row without a truth for {targets[i]}".replace("'", "") + "'"
        begin, end = (mark.format(i=i, no_truth=no_truth, at=at, d=d) for at, d in (("a", 1), ("b", -1)))
        within = f"transform(`{name}`, v -> named_struct('pick', coalesce(v.pick, {none_id}), 'a', {_count_up_to(cuts, 'v.lo')} + 1, 'b', {_count_up_to(cuts, 'v.hi')} + 1))"
        return f"flatten(transform(filter({within}, s -> s.a < s.b), s -> array({begin}, {end})))"

    nothing = F.array().cast("array<struct<_t:int,truth:int,pick:int,at:int,d:int>>")
    found = [F.when(F.col("_row_target") == targets[i], F.expr(marks_of(i, n))).otherwise(nothing) if extra else F.expr(marks_of(i, n)) for i, n in enumerate(names)]
    marks = cut.select(F.explode(F.flatten(F.array(*[F.coalesce(f, nothing) for f in found]))).alias("_m")).select("_m.*")
    sums = marks.where(F.col("at") <= len(cuts)).groupBy("_t", "truth", "pick", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("_t", "truth", "pick").orderBy("at")
    running = sums.select("_t", "truth", "pick", "at", F.sum("d").over(w).alias("n"), F.lead("at", 1, len(cuts) + 1).over(w).alias("_next")).where("n > 0")
    every, names_ = F.expr(f"array({', '.join(f'{c!r}D' for c in cuts)})"), F.array(*[F.lit(t) for t in targets])
    spread = running.withColumn("_at", F.explode(F.sequence("at", F.col("_next") - 1)))
    return spread.select(F.element_at(every, F.col("_at")).alias("cutoff"), F.element_at(names_, F.col("_t") + 1).alias("target"), "truth", "pick", "n")


def cutoff_sweep(df: DataFrame, score_cols: Mapping[str, str | Column], truth_cols: Mapping[str, str],
                 label_ids: Mapping[str, int], cutoffs: Sequence[float],
                 row_target_col: str | None = None) -> DataFrame:
    """Accuracy per (cutoff, target) of the picks against the truth ids, from ``sweep_counts``."""
    counts = sweep_counts(df, score_cols, truth_cols, label_ids, cutoffs, row_target_col)
    hits = F.sum(F.when(F.col("pick") == F.col("truth"), F.col("n")).otherwise(0))
    return counts.groupBy("cutoff", "target").agg((hits / F.sum("n")).alias("accuracy"))


def cutoff_metrics(counts: DataFrame) -> DataFrame:
    """A12 of the final picks: accuracy, balanced accuracy and Matthews correlation
    per (cutoff, target), from the rows of ``sweep_counts``."""
    return metrics_from_counts(counts, ["cutoff", "target"], "truth", "pick", "n")


def best_cutoffs(metrics: DataFrame, digits: int = 12) -> DataFrame:
    """C10 for each metric: the cut-off with the highest mean over targets (ties: the smaller cut-off)."""
    names = ["accuracy", "balanced_accuracy", "mcc"]
    means = metrics.groupBy("cutoff").agg(*[F.round(F.avg(m), digits).alias(m) for m in names])
    best = means.agg(*[F.max_by(F.struct(F.col("cutoff"), F.col(m).alias("value")), F.struct(m, -F.col("cutoff"))).alias(m) for m in names])
    long = best.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.cutoff").alias("cutoff"), F.col(f"{m}.value").alias("value")) for m in names])).alias("_b"))
    return long.select("_b.*").where("cutoff is not null")


def cutoff_wide(sweep: DataFrame, targets: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One column per target (pivot with explicit values)."""
    wide = sweep.groupBy("cutoff").pivot("target", list(targets)).agg(F.first("accuracy"))
    if names:
        for t, n in zip(targets, names):
            wide = wide.withColumnRenamed(t, n)
    return wide


def best_cutoff(sweep: DataFrame, digits: int = 12) -> DataFrame:
    """The cut-off with the highest mean accuracy over targets (first on ties)."""
    means = sweep.groupBy("cutoff").agg(F.round(F.avg("accuracy"), digits).alias("mean_accuracy"))
    return means.orderBy(F.desc("mean_accuracy"), F.asc("cutoff")).limit(1)
