"""Navigation of a stored relation column by column; every step is one filter or aggregate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Navigator:
    """Stands at a column of *df* with the columns before it bound to values."""

    def __init__(self, df: DataFrame, columns: list[str], bound: tuple[Any, ...] = (), held: DataFrame | None = None):
        self.df, self.columns, self.bound, self.held = df, columns, bound, held

    @property
    def column(self) -> str:
        return self.columns[len(self.bound)]

    def _rows(self) -> DataFrame:
        out = self.df
        for c, v in zip(self.columns, self.bound):
            out = out.where(F.col(c) == F.lit(v))
        return out

    def scan(self, ordered: bool = False) -> DataFrame:
        """Distinct values of the current column."""
        out = self.held if self.held is not None else self._rows().select(self.column).distinct()
        return out.orderBy(self.column) if ordered else out

    def hold(self) -> Navigator:
        """The same place with the values of its column kept in executors' memory, or on their disks, for scans to come;
        ``navigator.held.unpersist()`` frees them."""
        return Navigator(self.df, self.columns, self.bound, self.scan().persist())

    def look_up(self, value: Any) -> Navigator:
        """Bind the current column and step to the next."""
        if len(self.bound) + 1 >= len(self.columns):
            raise ValueError("there is no column below the last")
        return Navigator(self.df, self.columns, (*self.bound, value))

    def exists(self) -> bool:
        return not self._rows().limit(1).isEmpty()

    def dump(self) -> DataFrame:
        """Values of the current column with the multiplicity below them."""
        weight = F.sum("mult") if "mult" in self.df.columns else F.count("*")
        return self._rows().groupBy(self.column).agg(weight.alias("mult"))


def look_up(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Whole records of *df* that agree with *values*; columns left out are enumerated."""
    for c, v in values.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def restrict(df: DataFrame, column: str, domain: DataFrame | list) -> DataFrame:
    """Rows whose *column* lies in *domain*: a short list, or a DataFrame of one column."""
    if isinstance(domain, DataFrame):
        return df.join(domain.toDF(column), column, "left_semi")
    return df.where(F.col(column).isin(domain))
