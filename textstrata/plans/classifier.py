"""A bundle of per-target models used as one classifier (C1-C3, C6, IO7).

``BundleClassifier.from_directory(path)`` loads the shared featuriser and one
model per target (a missing directory fails before any job);
``classifier(texts, cutoff)`` labels every row of a DataFrame of texts with
distinct labels across the targets in their order; ``classifier.scores(texts)``
gives each target's full ranked distribution.  Both are lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.operators import pick, train
from textstrata.operators.labels import DEFAULT_TARGETS, LITHOLOGY_LABELS, label2id
from textstrata.sources import io


class BundleClassifier:
    def __init__(self, models: Mapping, targets: Sequence[str], label_ids: Mapping[str, int],
                 text_col: str = "text") -> None:
        self.models = dict(models)
        self.targets = list(targets)
        self.label_ids = dict(label_ids)
        self.text_col = text_col

    @classmethod
    def from_directory(cls, path: str, targets: Sequence[str] = DEFAULT_TARGETS,
                       label_ids: Mapping[str, int] | None = None,
                       text_col: str = "text") -> BundleClassifier:
        """Load ``<path>/features`` and ``<path>/<target>`` for every target.

        Label ids default to the ten-class table (nine classes and ``none``),
        which every target shares so that picks compare the same names.
        """
        models = io.load_bundle(path, ["features", *targets])
        return cls(models, targets, label_ids or label2id(LITHOLOGY_LABELS, with_none=True), text_col)

    def _scored(self, texts: DataFrame) -> DataFrame:
        src = texts if self.text_col in texts.columns else texts.withColumnRenamed(texts.columns[0], self.text_col)
        return train.score(src, self.models, self.targets, max(self.label_ids.values()) + 1)

    def __call__(self, texts: DataFrame, cutoff: float = 0.0) -> DataFrame:
        """Each row gets ``<target>_label`` and ``<target>_score`` (fallback ``none``, -1)."""
        scored = self._scored(texts)
        picked = pick.pick_labels(scored, {t: f"s_{t}" for t in self.targets}, self.label_ids, cutoff)
        return picked.drop(*[f"s_{t}" for t in self.targets])

    def scores(self, texts: DataFrame) -> DataFrame:
        """Each row gets ``<target>_ranked``: the full distribution, best first."""
        id2name = {v: k for k, v in self.label_ids.items()}
        scored = self._scored(texts)
        return scored.select(*[c for c in scored.columns if not c.startswith("s_")],
                             *[pick.rank_scores(F.col(f"s_{t}"), id2name).alias(f"{t}_ranked")
                               for t in self.targets])
