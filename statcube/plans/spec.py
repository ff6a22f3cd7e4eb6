"""Crosstab specification."""

from __future__ import annotations

from dataclasses import dataclass, field

from statcube.operators.filters import as_list, validate_axes

MAX_ROW_DIMS = 2
MAX_COL_DIMS = 2


@dataclass(frozen=True)
class CrosstabSpec:
    """tab × rows (1–2) × cols (0–2) of sum(metric) under IN filters."""

    tab: str
    rows: tuple[str, ...]
    cols: tuple[str, ...] = ()
    metric: str = "CNT"
    filters: dict = field(default_factory=dict)
    probe: str = "prefix"

    @staticmethod
    def of(tab: str, rows, cols=(), metric: str = "CNT", filters: dict | None = None,
           probe: str = "prefix") -> CrosstabSpec:
        spec = CrosstabSpec(tab, tuple(as_list(rows)), tuple(as_list(cols)), metric,
                            {k: list(v) for k, v in (filters or {}).items()}, probe)
        spec.validate()
        return spec

    def validate(self) -> None:
        if not self.tab:
            raise ValueError("a crosstab needs a tab dimension")
        if not 1 <= len(self.rows) <= MAX_ROW_DIMS:
            raise ValueError(f"1 to {MAX_ROW_DIMS} row dimensions expected, got {list(self.rows)}")
        if len(self.cols) > MAX_COL_DIMS:
            raise ValueError(f"at most {MAX_COL_DIMS} column dimensions expected, got {list(self.cols)}")
        validate_axes(self.tab, self.rows, self.cols)

    def check_columns(self, columns) -> None:
        missing = [c for c in (self.tab, *self.rows, *self.cols, self.metric) if c not in columns]
        if missing:
            raise ValueError(f"columns not in the cube: {missing}")
