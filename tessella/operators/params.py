"""Parameters of the splitters. A value out of range is replaced, not refused."""

from __future__ import annotations

from dataclasses import dataclass

#: What stands in for values out of range.
FALLBACK = {"split_size": 0.8, "batch_size": 100, "num_epochs": 5, "swap_probability": 0.1, "threshold_proportion": 0.1, "decay": 0.1, "num_clusters": 20, "num_communities": 5, "num_subsamples": 100, "sigma": 2.0, "learning_rate": 1e-4}


@dataclass(frozen=True)
class Params:
    """``split_size`` is the share of the train side. ``seed`` decides all that is random."""

    split_size: float = 0.75
    shuffle: bool = True
    batch_size: int = 100
    num_epochs: int = 50
    swap_probability: float = 0.1
    threshold_proportion: float = 0.1
    decay: float = 0.1
    num_clusters: int = 5
    num_communities: int = 5
    num_subsamples: int = 10000
    sigma: float = 2.0
    alpha: float = 0.2
    learning_rate: float = 1e-4
    drop_excess: bool = True
    seed: int = 12345

    def __post_init__(self):
        put = lambda name: object.__setattr__(self, name, FALLBACK[name])
        if not 0 < self.split_size < 1:
            put("split_size")
        for name in ("batch_size", "num_epochs", "num_clusters", "num_communities"):
            if getattr(self, name) <= 0:
                put(name)
        for name in ("swap_probability", "threshold_proportion", "decay", "sigma"):
            if getattr(self, name) < 0:
                put(name)
        if self.num_subsamples < 100:
            put("num_subsamples")
        if self.learning_rate <= 0:
            put("learning_rate")
