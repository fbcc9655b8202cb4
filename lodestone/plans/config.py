"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from lodestone.operators import model
from lodestone.operators.decide import GRID
from lodestone.operators.features import GROUPS


@dataclass(frozen=True)
class Paths:
    data: str
    output: str
    model: str

    def source(self, split: str, number: int) -> str:
        return f"{self.data}/{split}/{split}_source{number}.tsv"

    @property
    def truth(self) -> str:
        return f"{self.data}/train/train_ground_truth.tsv"

    @property
    def matching(self) -> str:
        return f"{self.output}/matching_results.tsv"

    @property
    def candidates(self) -> str:
        return f"{self.output}/candidate_pairs.tsv"


def set_paths(data: str = "dataset", output: str = "output", model: str = "model") -> Paths:
    return Paths(data.rstrip("/"), output.rstrip("/"), model.rstrip("/"))


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    max_df: int = 2000
    by_country: bool = True
    prune_top_n: int = 10
    prune_min_prob: float = 0.01
    prune_folds: int = 2
    match_folds: int = 3
    groups: list[str] = field(default_factory=lambda: list(GROUPS))
    pruner: dict = field(default_factory=lambda: dict(model.PRUNER))
    matcher: dict = field(default_factory=lambda: dict(model.MATCHER))
    grid: list[float] = field(default_factory=lambda: list(GRID))
    resolve_conflicts: bool = True
    max_per_s1: int | None = None
    per_source: bool = False
    holdout: float = 0.2
    seed: int = 42
    loco_min_s1: int = 50
    strict_split: bool = False  # True: in validate the pruner never sees a held-out record's labels
    embeddings: str | None = None  # Parquet of (entity_id, vector) of all records, for a third blocker

    def but(self, **changes) -> Config:
        return replace(self, **changes)
