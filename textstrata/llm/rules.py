"""Quality rules with thresholds that adapt to each language and source.

Three fixed cut-offs of classic rule sets (symbols per word, repeated lines,
repeated windows) and the mean word length are replaced by fences taken from
mergeable quantile sketches.  A sketch is a histogram of bins of equal width,
``BINS`` for a share and ``BINS`` to 20 characters for the mean word length, which
has no upper end: adding two sketches is adding counts, only bins that occur take
room, and a quantile read from it is off by one bin at most.
Everything is DataFrame expressions; a text never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.functions.arrays import let
from textstrata.llm.shared import GAP, materialise

BINS = 1000
#: statistic -> smallest half width, in bins, that a fence is built from
METRICS = {"symbol_rate": 4, "dup_line_rate": 15, "repeat_rate": 15, "word_length": 6}
#: A fence is the median plus and minus so many half widths.
FENCE = 8
#: Every sketch of a language and source also holds so many points of its language's sketch,
#: and that one of all rows' sketch, each counted ``POINT_ROWS`` times: 100 rows in all.
POINTS = 20
POINT_ROWS = 5


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; overlaps count once."""
    def covered(pos: Column) -> Column:
        step = F.transform(pos, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def from_windows(win: Column) -> Column:
        def twice(ordered: Column) -> Column:
            hit = F.filter(ordered, lambda x, i: (F.get(ordered, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])))
            return let(F.sort_array(F.transform(hit, lambda x: x["p"])), covered)
        keyed = F.transform(win, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("p"), i))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(F.sort_array(keyed), twice))

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashed, lambda h: let(
            F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), from_windows))
    return let(words, windows)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words`` (long).

    A null text counts as empty.  Windows are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (docs.select(*[F.col(c) for c in keep],
                        F.size(words).cast("long").alias("n_words"),
                        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
                        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))).alias("_lines"),
                        F.coalesce(_repeat_words(words), F.lit(0)).cast("long").alias("n_repeat_words"))
            .select(*keep, "n_words", "word_chars", "n_symbols", "_lines.n_dup_lines", "_lines.n_lines", "n_repeat_words"))


def _bin(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(F.lit(BINS) * part / whole).cast("long"))


def with_bins(stats: DataFrame) -> DataFrame:
    """Adds the bin of each statistic; null where a row has no words."""
    return (stats.withColumn("symbol_rate", _bin(F.col("n_symbols"), F.col("word_chars")))
            .withColumn("dup_line_rate", _bin(F.col("n_dup_lines"), F.col("n_lines")))
            .withColumn("repeat_rate", _bin(F.col("n_repeat_words"), F.col("n_words")))
            .withColumn("word_length", _bin(F.col("word_chars"), F.col("n_words") * 20)))


def sketches(binned: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, metric, bin, n)``: the sketches, combined map-side; a row per group, metric and bin that occurs."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in METRICS]))
    return binned.where("n_words > 0").select(*by, cells.alias("c")).groupBy(*by, "c.metric", "c.bin").agg(F.count("*").alias("n"))


def _cumulated(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The cells of a sketch with ``upto``, the rows up to their bin, and ``total``."""
    cell = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*by, "metric")
    return cell.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("total", F.sum("n").over(part))


def prior_points(sketch: DataFrame, by: list[str]) -> DataFrame:
    """A sketch of ``POINTS`` evenly spaced quantiles, ``POINT_ROWS`` rows each, per group of ``by`` and metric.

    Point i is the bin that reaches (2 i + 1) / (2 ``POINTS``) of the rows; whole numbers throughout.
    """
    reached = lambda rows: F.expr(f"({2 * POINTS} * ({rows}) + total) div (2 * total)")
    points = _cumulated(sketch, by).withColumn("n", (reached("upto") - reached("upto - n")) * POINT_ROWS)
    return points.where("n > 0").select(*by, "metric", "bin", "n")


def blended(own: DataFrame) -> DataFrame:
    """The sketches of ``own`` by language and source, each with the points of its language's
    sketch added, which in turn has those of all rows added.  A small group is judged mostly
    by its language, a large one by itself, without a step in between."""
    cells = ["metric", "bin", "n"]
    whole = materialise(prior_points(own, []), "rule-prior")
    of_lang = own.select("lang", *cells).unionByName(own.select("lang", "metric").distinct().join(whole, "metric"))
    lang = materialise(prior_points(of_lang, ["lang"]).withColumnRenamed("lang", "_lang").withColumnRenamed("metric", "_metric"), "rule-language-prior")
    groups = own.select("lang", "source", "metric").distinct()
    added = groups.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric"))).select("lang", "source", *cells)
    return own.select("lang", "source", *cells).unionByName(added)


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, <metric>_low, <metric>_high)`` from the quartiles of merged sketches.

    The half width is the smaller distance of the median from a quartile: bad
    rows of less than half a group, on either side, leave the median among the
    good rows and can widen only the distance on their own side.
    """
    run = _cumulated(sketch, by)
    quart = run.groupBy(*by, "metric").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bin"))).alias("q2"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"))
    out = []
    for m, least in METRICS.items():
        width = F.greatest(F.least(F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")), F.lit(least)) * FENCE
        out += [F.max(F.when(F.col("metric") == m, F.col("q2") + width)).alias(f"{m}_high"), F.max(F.when(F.col("metric") == m, F.col("q2") - width)).alias(f"{m}_low")]
    return quart.groupBy(*by).agg(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: ``id``, the statistics, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them inside
    repeated 3-word windows.  Else a row is kept if each statistic lies inside
    the fences of its language and source, read from the ``blended`` sketches.  A null
    language or source is a value of its own.  Repeated rows each get a row and
    count as often; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    rows = materialise(with_bins(statistics(src, "text", ("id", "lang", "source"))), "rule-statistics")
    own = materialise(sketches(rows, ["lang", "source"]), "rule-sketches")
    table = fences(blended(own), ["lang", "source"]).withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    joined = rows.join(table, rows["lang"].eqNullSafe(table["g_lang"]) & rows["source"].eqNullSafe(table["g_source"]), "left")
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return joined.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"))
