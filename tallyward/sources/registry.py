"""Named datasets and the raw tables joins may use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyward.dataset import Dataset
from tallyward.operators.joins import join_view
from tallyward.plans.catalog import JoinPolicy


class DatasetRegistry:
    """Datasets by name with a default, and raw tables by name. Names of datasets ignore case and outer blanks."""

    def __init__(self) -> None:
        self._datasets: dict[str, Dataset] = {}
        self._tables: dict[str, DataFrame] = {}
        self.default_name: str | None = None

    @staticmethod
    def _key(name: str | None) -> str:
        return (name or "").strip().lower()

    def add(self, name: str | None, dataset: Dataset, make_default: bool = False) -> None:
        """Register a dataset; the first one becomes the default."""
        key = self._key(name or "default")
        self._datasets[key] = dataset
        if make_default or self.default_name is None:
            self.default_name = key

    def get(self, name: str | None = None) -> Dataset:
        """The named dataset, or the default when there is none of that name."""
        if not self._datasets:
            raise ValueError("no dataset is loaded")
        return self._datasets.get(self._key(name), self._datasets[self.default_name])

    def has(self, name: str) -> bool:
        return self._key(name) in self._datasets

    def names(self) -> list[str]:
        return sorted(self._datasets)

    def __len__(self) -> int:
        return len(self._datasets)

    def __contains__(self, name: str) -> bool:
        return self.has(name)

    def register_table(self, name: str, df: DataFrame) -> None:
        """Register a raw table for joins."""
        self._tables[name] = df

    def table(self, name: str) -> DataFrame:
        """A raw table; raises ValueError when unknown."""
        if name not in self._tables:
            raise ValueError(f"unknown table {name!r}")
        return self._tables[name]

    def joined_view(self, policy: JoinPolicy, null_safe: bool = True) -> DataFrame:
        """The lazy view an approved policy describes; a policy that is not approved is refused."""
        if policy.status != "approved":
            raise ValueError(f"join policy {policy.name!r} is not approved")
        return join_view(self.table(policy.left_table), self.table(policy.right_table), policy, null_safe)
