"""Readers and sinks: checked CSV, host-event and sensor JSON with reject routes, manifests, reports."""

from __future__ import annotations

import csv
import functools
import hashlib
import io
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import normalize as n
from tidewatch.sources.adapters import route_sensor_lines, sensor_flow  # noqa: F401  (part of the readers' surface)


def _widths(value: Column) -> Column:
    """Fields of a CSV line: one more than its commas outside of quotes; a quote that is left open reaches to the end."""
    return F.regexp_count(F.regexp_replace(value, r'"[^"]*("|$)', ""), F.lit(",")) + 1


def preflight_csv(spark: SparkSession, path: str, required: Mapping[str, Sequence[str]], sample: int = 10) -> DataFrame:
    """One row: rows, the required fields without any alias in the header, and the widths of the first lines."""
    columns = {c.strip().lower() for c in spark.read.option("header", True).csv(path).columns}
    missing = sorted(f for f, aliases in required.items() if not columns & {a.lower() for a in aliases})
    widths = sorted({r["w"] for r in spark.read.text(path).limit(sample + 1).select(_widths(F.col("value")).alias("w")).collect()})
    rows = spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("rows", F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("missing"), F.array(*[F.lit(w) for w in widths]).alias("widths"))


def feature_names(spark: SparkSession, metadata: str, encoding: str = "windows-1252") -> list[str]:
    """Column names from a metadata CSV with a Name column, in order of its No. column."""
    content = spark.read.format("binaryFile").load(metadata).first()["content"]  # a few dozen lines
    rows = list(csv.DictReader(io.StringIO(content.decode(encoding))))
    rows = [{k.strip().lower(): v for k, v in r.items()} for r in rows]
    return [r["name"].strip().lower() for r in sorted(rows, key=lambda r: int(r["no."]))]


def read_headerless(spark: SparkSession, paths: Sequence[str], names: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Headerless CSV of exactly len(names) columns, all text, with `file`; short or long rows fail the read.

    Pass `columns` to read a few: the scan is pruned to them."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", True).csv(list(paths))
    return df.select(*(columns or names), F.col("_metadata.file_name").alias("file"))


def read_headered(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Headered CSV whose files each have exactly the set `names` as header, in any order; ragged rows fail the read.

    The headers come from the files' first blocks, one row a file; files of one order are read together."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "nth").alias("head")).collect()
    orders: dict[tuple[str, ...], list[str]] = {}
    for head in heads:
        found = tuple(c.strip() for c in next(csv.reader([head["head"]])))
        if sorted(found) != sorted(names):
            raise ValueError(f"header differs: missing {sorted(set(names) - set(found))}, unknown {sorted(set(found) - set(names))}")
        orders.setdefault(found, []).append(head["file"])
    if not orders:
        raise ValueError(f"header differs: missing {sorted(names)}, unknown []")
    parts = []
    for found, files in orders.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in found])
        df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(files)
        parts.append(df.select(*names, F.col("_metadata.file_name").alias("file")))
    return functools.reduce(DataFrame.unionByName, parts)


def with_row_numbers(df: DataFrame, file: str = "file") -> DataFrame:
    """`df`, as read from files, with row_no, from 1 in each file, in file order.

    A file is read in blocks: rows are numbered within their block, in which they come in order, and the rows of the blocks
    before it are added. No task sees more than a block."""
    block = F.col("_metadata.file_block_start")
    rows = df.select(*df.columns, F.col("_metadata.file_path").alias("_path"), block.alias("_block"), F.monotonically_increasing_id().alias("_nth"))
    counts = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_path", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_nth"))
    return rows.withColumn("_inside", inside).join(counts, ["_path", "_block"]).select(*df.columns, (F.col("_before") + F.col("_inside")).alias("row_no"))


def classify_json_lines(lines: DataFrame, value: str = "value", reserved: Sequence[str] = ()) -> DataFrame:
    """`lines` with `issue`: blank, invalid_json, not_an_object or reserved_field; null for good lines."""
    text = F.trim(F.col(value))
    kind = F.expr(f"schema_of_variant(try_parse_json(trim({value})))")
    clash = F.lit(False)
    for field in reserved:
        clash |= F.expr(f"try_variant_get(try_parse_json(trim({value})), '$.{field}', 'string') is not null")
    issue = F.when(text == "", "blank").when(F.expr(f"try_parse_json(trim({value})) is null"), "invalid_json").when(~kind.startswith("OBJECT"), "not_an_object").when(clash, "reserved_field")
    return lines.withColumn("issue", issue)


def canonical_flow(raw: DataFrame, names: Mapping[str, Sequence[str]], duration_scale: float = 1.0) -> DataFrame:
    """Raw text rows to canonical flows through alias lists: src, dst, src_port, dst_port, protocol, start, duration
    (times `duration_scale` is milliseconds), packets and bytes of both ways, label."""

    def pick(field: str) -> Column:
        have = [F.col(f"`{a}`") for a in names.get(field, ()) if a in raw.columns]
        return n.first_present(*have) if have else F.lit(None).cast("string")

    duration = n.finite_double(pick("duration"), 0.0) * duration_scale
    rows = raw.withColumns(
        {
            "src": pick("src"), "dst": pick("dst"), "src_port": n.port_number(pick("src_port")), "dst_port": n.port_number(pick("dst_port")), "protocol": n.protocol_name(pick("protocol")),
            "start": n.any_timestamp(pick("start")), "duration_ms": duration, "label": n.strict_long(pick("label"), 0, 1),
            **{c: n.strict_long(pick(c), 0) for c in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")},
        }
    )
    return rows.withColumn("end", n.end_time(F.col("start"), F.col("duration_ms")))


def flow_checks() -> list[tuple[str, str, Column]]:
    """The record constraints of canonical flows, in order."""
    c = F.col
    out = [(f, "missing_or_negative", c(f) >= 0) for f in ("duration_ms", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")]
    out += [("dst_port", "out_of_range", c("dst_port").between(0, 65535)), ("protocol", "unknown", c("protocol").isNotNull())]
    out += [("fwd_bytes", "bytes_without_packets", ~((c("fwd_packets") == 0) & (c("fwd_bytes") > 0))), ("bwd_bytes", "bytes_without_packets", ~((c("bwd_packets") == 0) & (c("bwd_bytes") > 0)))]
    return out


def route_rejects(df: DataFrame, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """`df` with rejected (struct of the first failing field and its reason, or null) and accepted."""
    return df.withColumn("rejected", n.first_failure(checks)).withColumn("accepted", F.col("rejected").isNull())


def host_event(raw: DataFrame) -> DataFrame:
    """Host-event rows in canonical form, typed by event code."""
    #: Process and network event codes of the host sensor and the audit log.
    kinds = {"process_create": (1, 4688), "network_connect": (3, 5156), "file_create": (11,), "registry": (12, 13, 14), "dns": (22,), "logon": (4624,), "logon_failure": (4625,)}
    code = n.strict_long(F.col("event_code"))
    kind = F.lit("other")
    for name, codes in kinds.items():
        kind = F.when(code.isin(*codes), name).otherwise(kind)
    return raw.withColumns({"event_code": code, "event_kind": F.when(code.isNull(), "unknown").otherwise(kind)})


def streamed_digests(files: DataFrame, block: int = 8 << 20) -> DataFrame:
    """`files` with the SHA-256 of the file at `path` as `found`, for files of any size: a task streams through one file at a time, a
    block in memory. Paths are of the stores that Arrow's file systems reach (a shared folder, HDFS, S3, GCS, Azure); null for others."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = files.columns
    kinds = [to_arrow_type(f.dataType) for f in files.schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                digest = hashlib.sha256()
                try:
                    store, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    found = None
                else:
                    with store.open_input_stream(at) as stream:
                        while part := stream.read(block):
                            digest.update(part)
                    found = digest.hexdigest()
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1).cast(k) for c, k in zip(batch.columns, kinds, strict=True)], pa.array([found], pa.string())], [*names, "found"])

    # A file a partition: they are few and large.
    many = max(1, files.count())
    return files.repartition(many).mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("found", T.StringType())]))


def verify_manifest(spark: SparkSession, root: str, manifest: DataFrame, largest: int = 2_000_000_000, depth: int = 1, streamed: bool = True) -> DataFrame:
    """(file, status) for a manifest of (file, sha256, required): verified, mismatch, missing, optional_missing or unregistered. A file
    is named by the last `depth` parts of its path.

    Files over `largest` bytes do not fit a binary value: they are streamed (see `streamed_digests`), and too_large without `streamed` or
    where their store cannot be streamed from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("file")
    read = files.where(F.col("length") <= largest).select(name, F.sha2("content", 256).alias("found"))
    large = files.where(F.col("length") > largest).select("path", name)
    large = streamed_digests(large).select("file", "found") if streamed else large.select("file", F.lit(None).cast("string").alias("found"))
    have = read.unionByName(large).withColumn("there", F.lit(True))
    both = manifest.join(have, "file", "full_outer")
    gone = F.col("there").isNull()
    status = (
        F.when(F.col("sha256").isNull(), "unregistered").when(gone & F.col("required"), "missing").when(gone, "optional_missing")
        .when(F.col("found").isNull(), "too_large").when(F.lower("sha256") == F.col("found"), "verified").otherwise("mismatch")
    )
    return both.select("file", status.alias("status"))


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as JSON; it exists only if the job that made it succeeded."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_assignments(df: DataFrame, path: str, order: Sequence[str], expected: int) -> None:
    """Ordered gzip CSV; fails if the number of rows written differs from `expected`."""
    from pyspark.sql import Observation

    seen = Observation("assignments")
    # Counted behind the order: the range partitioner reads what is before it twice.
    df.orderBy(*order).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    if seen.get["n"] != expected:
        raise ValueError(f"wrote {seen.get['n']} rows, expected {expected}")


def write_matrices(df: DataFrame, path: str, features: Sequence[str], split: str = "disposition") -> None:
    """Feature columns as Parquet, one folder a split."""
    df.select(split, *features).write.mode("overwrite").partitionBy(split).parquet(path)
