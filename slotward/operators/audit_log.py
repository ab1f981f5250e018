"""Audit log of tool calls: nested records in a table that grows by appends, once per session and step.

Arguments and metadata are maps, evidence is a variant, so that every tool keeps its own fields. The table is
partitioned by day (days since 1970), and a step keeps its time, so an append looks for known steps only in the days it touches.
A repeated or interrupted append can simply be sent again. One writer at a time appends to a log.

Defined cases: rows without session or step are refused; of rows with one session and step in one append the
earliest stays (equal times: the smallest record); a null time is day -1; latency is kept to two digits.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import path_exists

#: The fields of a record and their types.
FIELDS = {
    "session_id": "string", "step": "bigint", "timestamp": "timestamp_ntz", "thought": "string", "tool_name": "string",
    "tool_args": "map<string,string>", "evidence": "variant", "conclusion": "string", "latency_ms": "double",
    "tool_status": "string", "data_staleness_hours": "double", "audit_metadata": "map<string,string>",
}
KEY = ["session_id", "step"]
PARTS = 64  # rows of a heavy day are written by several tasks


def records(rows: DataFrame) -> DataFrame:
    """Rows as records: missing fields are null, arguments an empty map, the status SUCCESS; other columns go."""
    none = {"tool_args": F.create_map().cast(FIELDS["tool_args"]), "tool_status": F.lit("SUCCESS"), "latency_ms": F.lit(0.0)}
    given = {n: F.col(n).cast(kind) if n in rows.columns else F.lit(None).cast(kind) for n, kind in FIELDS.items()}
    named = {n: F.coalesce(c, none[n]) if n in none else c for n, c in given.items()}
    named["latency_ms"] = F.round(named["latency_ms"], 2)
    return rows.select(*[c.alias(n) for n, c in named.items()]).filter(F.col("session_id").isNotNull() & F.col("step").isNotNull())


def _once(rows: DataFrame) -> DataFrame:
    """One record per session and step; the choice is a mergeable aggregate, so a repeated step never meets in one task."""
    order = F.struct(F.col("timestamp").alias("at"), F.to_json(F.struct(*[n for n in FIELDS if n not in KEY])).alias("text"))
    best = rows.groupBy(*KEY).agg(F.min_by(F.struct(*[n for n in FIELDS if n not in KEY]), order).alias("record"))
    return best.select(*KEY, "record.*").select(*FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log; no rows if there is none yet."""
    if not path_exists(spark, path):
        kinds = ", ".join(f"{n} {kind}" for n, kind in FIELDS.items())
        return spark.createDataFrame([], kinds)
    return spark.read.parquet(path).select(*FIELDS)


def append(rows: DataFrame, path: str) -> None:
    """Add the records whose session and step are not in the log."""
    spark = rows.sparkSession
    new = _once(records(rows)).withColumn("day", F.coalesce(F.unix_date(F.to_date("timestamp")), F.lit(-1)))
    if path_exists(spark, path):
        # The semi join on the partition column leaves only the folders of the appended days to read.
        known = spark.read.parquet(path).select(*KEY, "day").join(new.select("day").distinct(), "day", "left_semi")
        new = new.join(known, [*KEY, "day"], "left_anti").select(*FIELDS, "day")
    spread = new.repartition("day", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)))
    spread.write.mode("append").partitionBy("day").parquet(path)


def of_tool(log: DataFrame, tool: str) -> DataFrame:
    return log.filter(F.col("tool_name") == tool)


def evidence_field(path: str, kind: str):
    """A field of the evidence, null where a tool does not return it."""
    return F.try_variant_get(F.col("evidence"), path, kind)


def sessions(log: DataFrame) -> DataFrame:
    """Per session: steps, tools in use, first and last time, conclusions reached and the newest one."""
    concluded = F.when(F.col("conclusion").isNotNull(), F.struct("timestamp", "step"))
    return log.groupBy("session_id").agg(
        F.count("*").alias("steps"), F.array_join(F.sort_array(F.collect_set("tool_name")), ",").alias("tools"),
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.count("conclusion").alias("conclusions"), F.max_by("conclusion", concluded).alias("last_conclusion"))
