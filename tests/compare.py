"""Shared helpers: a local session, and order-free comparison of Spark and DuckDB results."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("codeatlas-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{_kind(t.value_type)}>"
    return str(t)


def rows_equal(got: pa.Table, want: pa.Table) -> tuple[bool, str]:
    """Same columns by name and type, and the same rows in any order."""
    a, b = sorted(got.column_names), sorted(want.column_names)
    if a != b:
        return False, f"columns {a} vs {b}"
    kinds = [(c, _kind(got.schema.field(c).type), _kind(want.schema.field(c).type)) for c in a]
    off = [k for k in kinds if k[1] != k[2]]
    rows = lambda t: sorted(
        (tuple(_plain(v) for v in r) for r in zip(*[t.column(c).to_pylist() for c in a])), key=repr
    )
    x, y = rows(got), rows(want)
    if x != y:
        sx, sy = set(x), set(y)
        only_x = [r for r in x if r not in sy][:2] if len(x) < 300_000 else []
        only_y = [r for r in y if r not in sx][:2] if len(x) < 300_000 else []
        return False, f"{len(x)} vs {len(y)} rows; only spark {only_x}; only sql {only_y}"
    return (False, f"types {off}") if off else (True, "")
