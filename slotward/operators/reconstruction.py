"""Reconstruction error through a narrow linear bottleneck."""

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, health


class Bottleneck:
    """Principal components fitted on all rows, applied to any table of imputed features."""

    def __init__(self, features: list[str], k: int = fixed.BOTTLENECK):
        self.features, self.k = features, k

    def fit(self, rows: DataFrame) -> "Bottleneck":
        values = rows.select(*health.imputed(self.features, fill_rest=True))
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="raw")
        assembled = self.assembler.transform(values)
        self.scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(assembled)
        self.pca = PCA(k=self.k, inputCol="scaled", outputCol="code").fit(self.scaler.transform(assembled))
        return self

    def error(self, imputed: DataFrame, name: str = "mse") -> DataFrame:
        """Mean squared reconstruction error: what the orthonormal code does not keep of the norm."""
        coded = self.pca.transform(self.scaler.transform(self.assembler.transform(imputed)))
        norm = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)
        lost = F.greatest((norm("scaled") - norm("code")) / len(self.features), F.lit(0.0))
        return coded.withColumn(name, F.round(lost, 9)).drop("raw", "scaled", "code")
