"""A classifier that is a table (T1, C1): class-weighted multinomial naive Bayes.

Training is one aggregation of token counts per class; the model is a table
``(target, token, weights)`` with one log probability per label id, and scoring
is a join on the token followed by a sum.  Nothing of the model reaches the
driver but one row per class.

Log probabilities are whole numbers of millionths, so sums over a text are exact
and a score is the same whatever the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textstrata.functions.arrays import softmax
from textstrata.session import written

#: Units of a log probability in the model's tables.
SCALE = 1_000_000
#: At most so many tokens of a model, those with the largest weights, are looked up where the texts are.
HEAD_TOKENS = 20_000
#: The token of the row that holds the classes' own log probabilities; no token is empty.
PRIOR = ""


def word_tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def edge_grams(text: str | Column, n: int = 3) -> Column:
    """The first and the last ``n`` characters of every run of letters, marked ``^`` and ``$``."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.array_remove(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}]+"), "")
    first = F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))
    last = F.transform(words, lambda w: F.concat(F.when(F.length(w) > n, F.substring(w, -n, n)).otherwise(w), F.lit("$")))
    return F.concat(first, last)


#: Token rules by the name that a saved model keeps.
TOKENS: dict[str, Callable[[str | Column], Column]] = {"words": word_tokens, "edges": edge_grams}


def train(df: DataFrame, text_col: str, label_cols: Mapping[str, str], num_labels: int,
          tokens: str = "words", alpha: float = 1.0, balanced: bool = True) -> DataFrame:
    """The model table ``(target, token, weights)`` of every target in ``label_cols`` (target -> label id column).

    Rows of class ``c`` weigh ``n / (K n_c)`` (A1; 1 unless ``balanced``).  A
    token's weight for ``c`` is ``ln((w_c n_ct + alpha) / (w_c n_c. + alpha V))``,
    ``V`` the tokens that the target's rows have; the row of the empty token holds
    the classes' shares.  A class without rows has null weights.  A row without a
    label doesn't count for that target; an id outside the table fails the job.

    Texts are read once: one count per (labels, token) is combined map-side and
    written, the targets are cut out of those counts.
    """
    names, cols = list(label_cols), list(label_cols.values())
    ids = [F.col(c).cast("int").alias(f"_y{i}") for i, c in enumerate(cols)]
    ys = [f"_y{i}" for i in range(len(cols))]
    # a row's own marker token counts the rows of its classes in the same aggregation
    seen = F.explode(F.concat(TOKENS[tokens](text_col), F.array(F.lit(PRIOR)))).alias("token")
    counts = df.select(*ids, seen).groupBy(*ys, "token").agg(F.count(F.lit(1)).alias("n"))
    per_target = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(y).alias("label_id")) for t, y in zip(names, ys)])).alias("_t")
    counts = (counts.select(per_target, "token", "n").select("_t.*", "token", "n").where("label_id is not null")
              .groupBy("target", "token", "label_id").agg(F.sum("n").alias("n")))
    counts = written(counts, "token-counts")

    is_prior = F.col("token") == PRIOR
    totals = counts.groupBy("target", "label_id").agg(F.sum(F.when(is_prior, F.col("n"))).alias("rows"),
                                                      F.coalesce(F.sum(F.when(~is_prior, F.col("n"))), F.lit(0)).alias("tokens")).collect()  # a row per class
    kinds = {r["target"]: r["v"] for r in counts.where(~is_prior).groupBy("target").agg(F.count_distinct("token").alias("v")).collect()}
    outside = [r for r in totals if not 0 <= r["label_id"] < num_labels]
    if outside:
        raise ValueError(f"label id {outside[0]['label_id']} of target {outside[0]['target']} is outside the table of {num_labels} labels")

    weights = None
    for t in names:
        own = {r["label_id"]: r for r in totals if r["target"] == t}
        every = sum(r["rows"] for r in own.values())
        by_class, priors = [], []
        for i in range(num_labels):
            if i not in own:
                by_class.append(F.lit(None).cast("double"))
                priors.append(F.lit(None).cast("double"))
                continue
            w = every / (len(own) * own[i]["rows"]) if balanced else 1.0
            n = F.coalesce(F.sum(F.when(F.col("label_id") == i, F.col("n"))), F.lit(0)).cast("double")
            below = w * own[i]["tokens"] + alpha * kinds.get(t, 0)
            by_class.append(F.log((F.lit(w) * n + F.lit(alpha)) / F.lit(below)))
            priors.append(F.log(F.lit(1.0 / len(own) if balanced else own[i]["rows"] / every)))
        rows = counts.where((F.col("target") == t) & ~is_prior).groupBy("target", "token").agg(F.array(*by_class).alias("w"))
        prior = counts.where((F.col("target") == t) & is_prior).groupBy("target", "token").agg(F.array(*priors).alias("w"))
        part = rows.unionByName(prior)
        weights = part if weights is None else weights.unionByName(part)
    return weights.select("target", "token", F.transform("w", lambda x: F.round(x * SCALE).cast("long")).alias("weights"))


def score(df: DataFrame, key_cols: Sequence[str], text_col: str, model: DataFrame, targets: Sequence[str], num_labels: int,
          tokens: str = "words", prefix: str = "s_") -> DataFrame:
    """The key columns and, per target, ``<prefix><target>: array<double>`` over all label ids.

    ``key_cols`` identify a row.  Tokens the model doesn't know are left out; a
    text without known tokens gets the classes' own shares; a class without
    training rows scores 0.  The ``HEAD_TOKENS`` tokens with the largest weights,
    which are the most frequent ones in training, are broadcast and summed in the
    texts' own tasks; only words beyond them meet the rest of the model, in a join
    that is planned by the bytes of the two sides.  So no task sorts all places
    of a frequent word, and the words that are shuffled are the rare ones.
    """
    keys, wanted = list(key_cols), list(targets)
    wide = written(model.where(F.col("target").isin(wanted)).groupBy("token").agg(
        *[F.first(F.when(F.col("target") == t, F.col("weights")), ignorenulls=True).alias(f"_w{i}") for i, t in enumerate(wanted)]), "model-by-token")
    words = df.select(*keys, F.concat(TOKENS[tokens](text_col), F.array(F.lit(PRIOR))).alias("_tokens"))
    places = F.explode("_tokens").alias("token")
    names = [f"_s{i}_{j}" for i in range(len(wanted)) for j in range(num_labels)]
    sums = [F.sum(F.col(f"_w{i}")[j]).alias(f"_s{i}_{j}") for i in range(len(wanted)) for j in range(num_labels)]
    if wide.count() <= HEAD_TOKENS:  # one number
        found = words.select(*keys, places).join(F.broadcast(wide), "token", "left").groupBy(*keys).agg(*sums)
    else:
        largest = F.greatest(*[F.array_max(f"_w{i}") for i in range(len(wanted))], F.lit(None).cast("long"))
        head = written(wide.orderBy(F.col("token") != PRIOR, F.desc_nulls_last(largest), "token").limit(HEAD_TOKENS), "model-head")
        words = written(words, "text-tokens").select(*keys, places)
        outside = F.broadcast(head.select("token")), "token", "left_anti"
        common = words.join(F.broadcast(head), "token", "left").groupBy(*keys).agg(*sums)
        rare = words.join(*outside).join(wide.join(*outside), "token").groupBy(*keys).agg(*sums)
        found = common.unionByName(rare).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])

    def shares(i: int) -> Column:
        logs = F.array(*[F.col(f"_s{i}_{j}").cast("double") for j in range(num_labels)])
        known = F.transform(logs, lambda x: F.coalesce(x, F.lit(float("-inf"))))
        nothing = F.array_repeat(F.lit(0.0), num_labels)
        return F.when(F.size(F.filter(logs, lambda x: x.isNotNull())) == 0, nothing).otherwise(softmax(known, 1.0 / SCALE))

    return found.select(*keys, *[shares(i).alias(f"{prefix}{t}") for i, t in enumerate(wanted)])
