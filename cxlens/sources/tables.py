"""The table registry: name -> DataFrame for the nine marketplace tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame

TABLE_NAMES = ("customers", "orders", "order_items", "products", "product_categories",
               "sellers", "payments", "reviews", "geolocation")


class Tables(Mapping):
    """Immutable mapping of the nine tables; attribute access for convenience."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        missing = [n for n in TABLE_NAMES if n not in frames]
        if missing:
            raise KeyError(f"missing tables: {missing}")
        self._frames = {n: frames[n] for n in TABLE_NAMES}

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["_frames"][name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    def replace(self, **frames: DataFrame) -> "Tables":
        return Tables({**self._frames, **frames})

    def register(self, prefix: str = "") -> None:
        """Expose every table to Spark SQL as a temp view."""
        for name, df in self._frames.items():
            df.createOrReplaceTempView(prefix + name)
