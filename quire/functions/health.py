"""Registered health checkers over parsed documents, all folded into one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checker:
    """``finds`` is true on rows that speak against a document's health; ``penalty`` is taken off a score of 1 once more than ``most`` rows do."""

    name: str
    finds: Column
    penalty: float
    severity: str = "Warning"
    most: int = 0


@dataclass
class Checkers:
    registered: dict[str, Checker] = field(default_factory=dict)

    def register(self, checker: Checker) -> None:
        if checker.name in self.registered:
            raise ValueError(f"{checker.name} is registered already")
        if not 0 <= checker.penalty <= 1:
            raise ValueError("a penalty is between 0 and 1")
        self.registered[checker.name] = checker

    def unregister(self, name: str) -> None:
        del self.registered[name]

    def check(self, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, score, problems array<struct<name, severity, n>>) of every key in ``rows``: one pass, whatever the number of checkers.

        Problems are in the order in which checkers were registered; the score is never
        below 0. A checker whose condition is null on a row does not count it. Without
        checkers every score is 1.
        """
        own = list(self.registered.values())
        counts = [F.count_if(F.coalesce(c.finds, F.lit(False))).alias(f"n{k}") for k, c in enumerate(own)]
        by = rows.groupBy(key).agg(*(counts or [F.count(F.lit(1)).alias("n")]))
        broken = [F.col(f"n{k}") > c.most for k, c in enumerate(own)]
        score = F.lit(1.0)
        for c, bad in zip(own, broken):
            score = score - F.when(bad, F.lit(float(c.penalty))).otherwise(0.0)
        each = [F.when(bad, F.struct(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), F.col(f"n{k}").alias("n"))) for k, (c, bad) in enumerate(zip(own, broken))]
        problems = F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<name:string,severity:string,n:bigint>>")
        return by.select(key, F.round(F.greatest(F.lit(0.0), score), 6).alias("score"), problems.alias("problems"))
