"""One-class boundary on random Fourier features, trained by distributed sub-gradients."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from . import ranking


class OneClass:
    """Linear one-class machine on seeded cosine features of standardised, weighted vectors."""

    def __init__(self, features: list[str], nu: float = fixed.ONE_CLASS_NU, width: int = 256, steps: int = 40, seed: int = 42):
        self.features, self.nu, self.width, self.steps, self.seed = features, nu, width, steps, seed

    def _maps(self, gamma: float):
        rng = np.random.default_rng(self.seed)
        return (rng.normal(0.0, np.sqrt(2.0 * gamma), (len(self.features), self.width)),
                rng.uniform(0.0, 2.0 * np.pi, self.width))

    def _map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.width) * np.cos(x @ self.frequencies + self.phases)

    def _sums(self, scaled: DataFrame, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums over all rows: mapped features below the offset, all mapped features, and the weight below it.

        Tasks add up their own rows, Spark adds up the tasks; one row per mapped feature reaches the driver.
        """
        features, mapped, width = self.features, self._map, self.width

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            below, everything = np.zeros(width + 1), np.zeros(width + 1)
            for batch in batches:
                z = np.column_stack([mapped(batch[features].to_numpy(float)), np.ones(len(batch))])
                n = batch["n"].to_numpy(float)
                below += (n * (z[:, :-1] @ w < rho)) @ z
                everything += n @ z
            yield pd.DataFrame({"k": np.arange(width + 1), "below": below, "everything": everything})

        parts = scaled.mapInPandas(partial, "k int, below double, everything double")
        sums = parts.groupBy("k").agg(F.sum("below").alias("below"), F.sum("everything").alias("everything")).toPandas().sort_values("k")
        if sums.empty:
            return np.zeros(width), np.zeros(width), 0.0
        return sums["below"].to_numpy()[:-1], sums["everything"].to_numpy()[:-1], float(sums["below"].iloc[-1])

    def fit(self, scaled: DataFrame) -> "OneClass":
        """One small job per step; the offset ends as the nu-quantile of the decisions, its best value for the weights."""
        total = float(scaled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        self.frequencies, self.phases = self._maps(1.0 / len(self.features))
        self.weights, self.offset = np.zeros(self.width), 0.0
        if not total:
            return self
        _, everything, _ = self._sums(scaled, self.weights, 0.0)
        w, kept = everything / total, np.zeros(self.width)
        rho = float(w @ w) * 0.5
        for step in range(2, self.steps + 1):
            pull, _, weight = self._sums(scaled, w, rho)
            rate = 1.0 / step
            rho -= rate * (weight / (self.nu * total) - 1.0) * float(w @ w)
            w = w - rate * (w - pull / (self.nu * total))
            if step > self.steps // 2:
                kept = kept + w
        self.weights = kept / max(self.steps - self.steps // 2, 1)
        decided = self._decided(scaled, "decision")
        self.offset = ranking.exact_percentiles(decided, "decision", {"cut": self.nu}, "n")["cut"]
        return self

    def decide(self, scaled: DataFrame, name: str = "decision") -> DataFrame:
        """Add w.z minus the learned offset: negative outside the boundary."""
        return self._decided(scaled, name).withColumn(name, F.round(F.col(name) - F.lit(self.offset), 9))

    def _decided(self, scaled: DataFrame, name: str) -> DataFrame:
        features, weights, mapped = self.features, self.weights, self._map

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(**{name: np.round(mapped(batch[features].to_numpy(float)) @ weights, 9)})

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema.fields)
        return scaled.mapInPandas(run, f"{kinds}, `{name}` double")
