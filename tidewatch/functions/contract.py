"""The versioned predictor contract: which columns a model may see, in which order, and their fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.digests import length_prefix, prefixed, text

#: The contract's columns with their kinds, in order.
CONTRACT = (
    ("duration_ms", "float"), ("fwd_packets", "integer"), ("bwd_packets", "integer"), ("fwd_bytes", "integer"), ("bwd_bytes", "integer"), ("packets_per_second", "float"),
    ("bytes_per_second", "float"), ("fwd_packet_length_mean", "float"), ("bwd_packet_length_mean", "float"), ("dst_port", "integer"), ("protocol", "category"),
)
#: Columns that identify or label a row and must never reach a model.
FORBIDDEN = frozenset(
    "schema_version source_dataset source_file filename source_row_number row_number source_timestamp flow_id timestamp_start timestamp_end src_ip dst_ip src_port label attack_category "
    "attack_name risk_score event_id record_id event_record_id ingestion_id __mordor_ingestion_id process_guid host user username command_line secret".split()
)


def check_model_fields(names: Sequence[str], contract: Sequence[tuple[str, str]] = CONTRACT) -> None:
    """Raise for columns that a model must not see, and for any other deviation from the contract or its order."""
    bad = sorted(FORBIDDEN.intersection(names))
    if bad:
        raise ValueError(f"forbidden model fields: {', '.join(bad)}")
    if list(names) != [name for name, _ in contract]:
        raise ValueError("the model fields are not those of the contract, in its order")


def project(df: DataFrame, contract: Sequence[tuple[str, str]] = CONTRACT, keep: Sequence[str] = ()) -> DataFrame:
    """The contract's columns of `df` in its order, and nothing else but the row keys named in `keep`."""
    names = [name for name, _ in contract]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns of the contract are missing: {', '.join(missing)}")
    out = df.select(*keep, *names)
    check_model_fields([c for c in out.columns if c not in keep], contract)
    return out


def _double_bytes(values: Column) -> Column:
    """The eight big-endian IEEE bytes of a double."""

    @F.arrow_udf("binary")
    def encoded(values: pa.Array) -> pa.Array:
        raw = np.asarray(values.fill_null(0.0).to_numpy(zero_copy_only=False), ">f8").tobytes()
        held = pa.array([raw[i : i + 8] for i in range(0, len(raw), 8)], pa.binary())
        return pc.if_else(values.is_valid(), held, pa.scalar(None, pa.binary()))

    return encoded(values)


def feature_fingerprint(domain: str, contract: Sequence[tuple[str, str]] = CONTRACT) -> Column:
    """SHA-256 (hex) over the contract's columns: name and typed value each, length-prefixed and big-endian, so that equal
    vectors have equal fingerprints on any machine. Null where a value is null or a float is not finite."""
    parts, fine = [], F.lit(True)
    for name, kind in contract:
        value = F.col(name)
        if kind == "integer":
            encoded = F.concat(F.lit(b"i"), F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0")))
        elif kind == "float":
            number = value.cast("double")
            fine &= ~F.isnan(number) & (F.abs(number) < float("inf"))
            encoded = F.concat(F.lit(b"f"), _double_bytes(number))
        elif kind == "category":
            encoded = F.concat(F.lit(b"s"), prefixed(text(value)))
        else:
            raise ValueError(f"unknown kind {kind}")
        fine &= value.isNotNull()
        parts += [length_prefix(F.lit(name.encode())), F.lit(name.encode()), encoded]
    return F.when(fine, F.sha2(F.concat(F.lit(domain.encode() + b"\0"), *parts), 256))
