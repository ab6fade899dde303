"""A named table with its profile and metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tallyward.operators.masking import mask_frame, name_masked_columns
from tallyward.operators.profile import LIVE_SAMPLE_ROWS, TableProfile, build_profile
from tallyward.plans.catalog import MetricDefinition, generate_metrics


@dataclass
class Dataset:
    """A lazy table; profile and metrics are made on first use and kept. A live one is profiled on a few rows."""

    name: str
    df: DataFrame
    masked_columns: tuple[str, ...] = ()
    sample: int | None = None
    live: bool = False
    _profile: TableProfile | None = field(default=None, repr=False)
    _metrics: dict[str, MetricDefinition] | None = field(default=None, repr=False)

    @classmethod
    def from_frame(cls, df: DataFrame, name: str = "data", mask: bool = True, **options: object) -> Dataset:
        """Wrap a frame, masked once, and register it as a temp view of its name."""
        masked = tuple(name_masked_columns(df)) if mask else ()
        table = mask_frame(df) if mask else df
        table.createOrReplaceTempView(name)
        return cls(name, table, masked, **options)

    @property
    def profile(self) -> TableProfile:
        """Profile of the table; the first access runs one aggregation."""
        if self._profile is None:
            sample = LIVE_SAMPLE_ROWS if self.live and self.sample is None else self.sample
            self._profile = build_profile(self.df, self.name, sample=sample, with_examples=True)
        return self._profile

    @property
    def metrics(self) -> Mapping[str, MetricDefinition]:
        """Generated metrics by name."""
        if self._metrics is None:
            self._metrics = generate_metrics(self.profile)
        return self._metrics
