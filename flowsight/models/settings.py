"""Model settings. ``detection`` and ``bundle`` are the two published sets; ``quick`` is for trials."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    forest_trees: int = 160
    forest_depth: int = 10
    boost_rounds: int = 140
    boost_depth: int = 8
    boost_step: float = 0.08
    boost_rows: float = 0.9
    boost_columns: float = 0.9
    isolation_trees: int = 180
    isolation_sample: int = 256
    kernel_features: int = 128
    # hidden layers of the reconstruction network, and steps (passes over all rows) that fit it and the one-class SVM
    network_layers: tuple[int, ...] = (32, 16, 32)
    descent_passes: int = 24
    # share of rows that each detector leaves out; the SVM's nu
    contamination: float = 0.1
    min_votes: int = 2
    # the scores that vote
    detectors: tuple[str, ...] = ("isolation_score", "kernel_score", "autoencoder_error")
    seed: int = 42
    # classifiers learn from about this many rows, chosen by hash within each label; None: from all rows
    fit_rows: int | None = None
    # labels a classifier accepts, and one-against-rest fits that run side by side
    most_classes: int = 100
    parallel_fits: int = 4


PRESETS: dict[str, Settings] = {
    "detection": Settings(),
    "bundle": Settings(
        forest_trees=120, forest_depth=8, boost_rounds=120, boost_depth=6, isolation_trees=160, contamination=0.12
    ),
    "legacy_outliers": Settings(
        isolation_trees=150, contamination=0.12, min_votes=1, detectors=("isolation_score", "kernel_score")
    ),
    "quick": replace(
        Settings(), forest_trees=20, forest_depth=6, boost_rounds=6, boost_depth=4, boost_step=0.3, isolation_trees=60,
        descent_passes=16,
    ),
}
