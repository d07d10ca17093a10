"""Settings of a run, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, field


def _within(name: str, value: float, low: float, high: float, open_ends: bool = False) -> None:
    if not (low < value < high if open_ends else low <= value <= high):
        raise ValueError(f"{name} must be in {'(' if open_ends else '['}{low}, {high}{')' if open_ends else ']'}, not {value}")


@dataclass(frozen=True)
class AnomalyConfig:
    use_zscore: bool = True
    use_iqr: bool = True
    use_isolation_forest: bool = True
    use_categorical: bool = True
    use_missing: bool = True
    z_threshold: float = 3.0
    missing_threshold: int = 1
    contamination: float = 0.01
    n_estimators: int = 100
    random_state: int = 42
    #: Skip all detectors on tables without a numeric column.
    numeric_gate: bool = False

    def __post_init__(self):
        _within("contamination", self.contamination, 0, 0.5, open_ends=True)
        if self.missing_threshold < 1 or self.n_estimators < 1:
            raise ValueError("missing_threshold and n_estimators must be at least 1")


@dataclass(frozen=True)
class MappingConfig:
    references: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    threshold: float = 0.7
    epsilon: float = 0.05
    force: bool = False

    def __post_init__(self):
        _within("threshold", self.threshold, 0, 1)
        _within("epsilon", self.epsilon, 0, 1)


@dataclass(frozen=True)
class SourceConfig:
    """Where datasets come from: ``local`` with a root, or ``sql`` with a query or a schema."""

    type: str
    root: str | None = None
    query: str | None = None
    schema: str | None = None
    max_rows: int | None = None

    def __post_init__(self):
        if self.type not in ("local", "sql"):
            raise ValueError(f"Unknown source type: {self.type}")
        if self.type == "local" and not self.root:
            raise ValueError("A local source needs a root")
        if self.type == "sql" and not (self.query or self.schema):
            raise ValueError("A SQL source needs a query or a schema")
