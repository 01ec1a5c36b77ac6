"""Stand-ins for alert and flow tables on the driver's tables: the same columns in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALERT_COLUMNS = (
    "event_id AS alert_id", "ts AS t", "concat('ns', user_id % 3) AS ns", "concat('u', user_id) AS src", "concat('svc_', event_type) AS dst",
    "CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'other' END AS proto",
    "CAST(user_id % 5 AS {text}) AS service", "value / (value + 20.0) AS score",
    "CASE WHEN value / (value + 20.0) >= 0.5 THEN 'Attack' ELSE 'Benign' END AS decision",
)
FLOW_COLUMNS = (
    "concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey, ':', CAST(CAST(l_shipdate AS DATE) AS {text})) AS record_id",
    "l_suppkey AS tuple_key", "(l_discount + 0.0) * 100000.0 AS duration_ms", "l_quantity AS fwd_packets", "(l_tax + 0.0) * 100.0 AS bwd_packets",
    "l_extendedprice AS fwd_bytes", "l_extendedprice * (l_tax + 0.0) AS bwd_bytes", "l_suppkey AS dst_port",
    "CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'R' THEN 'udp' ELSE 'other' END AS protocol",
    "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label", "l_quantity / 50.0 AS score", "l_shipdate AS start_ts",
)


def _sql(columns: tuple[str, ...], table: str) -> str:
    return "SELECT " + ", ".join(c.format(text="VARCHAR") for c in columns) + f" FROM {table}"


ALERTS_SQL, FLOWS_SQL = _sql(ALERT_COLUMNS, "events"), _sql(FLOW_COLUMNS, "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zone-less times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored detections with their end points, from `events`."""
    return table(spark, sf_dir, "events").selectExpr(*[c.format(text="STRING") for c in ALERT_COLUMNS])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network flows with label, score and start, from `lineitem`."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[c.format(text="STRING") for c in FLOW_COLUMNS])
