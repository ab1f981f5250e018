"""Scans and sinks: tables are written to the shared folder and read back."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..session import fresh_path, table_names
from ..sources import binding, scan, sinks
from . import tables
from .registry import query

TEXT_TIME = "date_format({}, 'yyyy-MM-dd HH:mm:ss')"
SQL_TIME = "strftime(event_time, '%Y-%m-%d %H:%M:%S')"


def text_export(spark, sf, source):
    raw = binding.raw_export(spark, sf, source)
    time = [c for c in fixed.TIME_COLUMNS if c in raw.columns][0]
    return raw.withColumn(time, F.expr(TEXT_TIME.format(time)))


def write_exports(spark, sf, sources=("ping", "hpe", "dell")):
    """CSV exports of the sources, one folder, named like dated exports."""
    folder = fresh_path(spark, "exports")
    for source in sources:
        sinks.publish_csv(text_export(spark, sf, source), f"{folder}/{source}_export_20260702")
    return folder


RAW_SQL = {"vm_name": "machine_name", "server_name": "machine_name", "vm_ip": "ip_address",
           "timestamp": SQL_TIME, "recorded_at": SQL_TIME, "comments": "CAST(NULL AS VARCHAR)"}


def raw_sql(source):
    return f"SELECT {', '.join(f'{RAW_SQL.get(c, c)} AS {c}' for c in fixed.RAW_COLUMNS[source])} FROM {source}"


@query("src01_csv_scan", raw_sql("hpe"), "hpe")
def _(spark, sf):
    folder = write_exports(spark, sf, ["hpe"])
    return scan.read_csv(spark, f"{folder}/hpe_export_20260702", scan.export_schema("hpe"))


@query("src02_source_inventory")
def _(spark, sf):
    parts = [scan.inventory(binding.table(spark, sf, n)) for n in table_names(spark, sf)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
          "orders", "pages", "part", "region", "supplier")


@query("src02_inventory_rows", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT CAST(count(*) AS BIGINT) FROM {t}) AS rows" for t in TABLES))
def _(spark, sf):
    """Rows per table found in the folder."""
    counts = [binding.table(spark, sf, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n in table_names(spark, sf)]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out.select("table_name", "rows")


def _pattern_sql(source):
    every = list(dict.fromkeys(fixed.RAW_COLUMNS["ping"] + fixed.RAW_COLUMNS["hpe"] + fixed.RAW_COLUMNS["dell"]))
    cols = [f"{RAW_SQL.get(c, c)} AS {c}" if c in fixed.RAW_COLUMNS[source] else f"CAST(NULL AS VARCHAR) AS {c}" for c in every]
    return f"SELECT '{source}' AS source, {', '.join(cols)} FROM {source}"


@query("src03_pattern_scan", " UNION ALL ".join(_pattern_sql(s) for s in ("ping", "hpe", "dell")), "dell")
def _(spark, sf):
    folder = write_exports(spark, sf)
    return scan.read_pattern(spark, folder, {s: f"{s}*20260702*" for s in ("ping", "hpe", "dell")})


@query("src04_parquet_scan", "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    rows = scan.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_returnflag", "l_quantity"])
    return rows.filter(F.col("l_quantity") > 45).select("l_orderkey", "l_returnflag")


@query("snk01_parquet_sink", "SELECT observation_id, telemetry_source, substr(monitoring_slot, 1, 10) AS slot_date FROM gold", "gold")
def _(spark, sf):
    path = fresh_path(spark, "gold")
    sinks.publish_parquet(tables.gold(spark, sf), path, F.substring("monitoring_slot", 1, 10))
    stored = scan.read_parquet(spark, path, ["observation_id", "telemetry_source", "slot_date"])
    return stored.withColumn("slot_date", F.date_format("slot_date", "yyyy-MM-dd"))


@query("snk02_csv_sink", raw_sql("dell"), "dell")
def _(spark, sf):
    folder = write_exports(spark, sf, ["dell"])
    return scan.read_csv(spark, f"{folder}/dell_export_20260702", scan.export_schema("dell"))


def _tag(name, tag):
    return f"count(*) FILTER (WHERE telemetry_source = '{tag}') AS {name}"


@query("snk03_metadata_sink", f"""
SELECT count(*) AS rows, {_tag('ping_only_rows', 'Ping Only')}, {_tag('ping_dell_rows', 'Ping + Dell')}, {_tag('ping_hpe_rows', 'Ping + HPE')},
       {_tag('ping_hpe_dell_rows', 'Ping + HPE + Dell')}, count(DISTINCT machine_name) AS machines,
       count(DISTINCT monitoring_slot) AS slots, 28::BIGINT AS columns, '{','.join(fixed.GOLD_COLUMNS)}' AS column_names FROM gold""", "gold")
def _(spark, sf):
    path = fresh_path(spark, "gold-summary")
    gold = tables.gold(spark, sf)
    sinks.publish_summary(gold, path)
    return spark.read.schema(sinks.summary(gold).schema).json(path)


@query("snk04_round_trip", """
SELECT count(*) AS source_rows, count(*) AS stored_rows, true AS both_read, true AS same_content, true AS same_schema FROM gold""", "gold")
def _(spark, sf):
    path = fresh_path(spark, "gold")
    gold = tables.gold(spark, sf)
    sinks.publish_parquet(gold, path)
    return sinks.verify_written(gold, spark.read.parquet(path))
