"""The operator registry: a name, its DataFrame builder and, where SQL can say it, the SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.numbers import bigints
from . import tables_sql

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a builder; `ctes` names the last shared table the SQL needs."""

    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return bigints(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = tables_sql.with_tables(ctes, sql)
        return build

    return register
