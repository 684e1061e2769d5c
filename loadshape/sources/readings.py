"""Reading raw meter files and mapping them to the canonical columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw column names accepted for each canonical column, best first.
ALIASES: dict[str, tuple[str, ...]] = {
    "household_id": ("LCLid", "ClientID", "household_id"),
    "timestamp": ("DateTime", "reading_datetime", "timestamp", "tstamp"),
    "energy_kwh": ("KWH/hh (per half hour)", "energy(kWh/hh)", "energy_kwh", "kwh"),
    "tariff_group": ("stdorToU", "tariff_group", "tariff"),
    "acorn_group": ("Acorn", "Acorn_grouped", "acorn_group"),
}
REQUIRED = ("household_id", "timestamp", "energy_kwh")


def map_columns(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """Rename to canonical names (first alias present wins) and cast tolerantly.

    A value that cannot be read as its type becomes NULL.  A missing optional
    column stays missing, other columns are kept as they are.
    """
    found = {}
    for name, candidates in aliases.items():
        raw = next((c for c in candidates if c in df.columns), None)
        if raw is not None:
            found[raw] = name
        elif name in required:
            raise ValueError(f"no column for '{name}' among {df.columns}")
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(raw: str):
        name = found.get(raw, raw)
        c = F.col(f"`{raw}`")
        if name == "energy_kwh" and raw in found:
            c = c.try_cast("double")
        elif name == "timestamp" and raw in found:
            if not isinstance(types[raw], (T.TimestampType, T.TimestampNTZType)):
                c = c.cast("string")
            c = c.try_cast("timestamp_ntz")
        elif name in ("household_id", "tariff_group") and raw in found:
            c = c.cast("string")
        return c.alias(name)

    return df.select(*[column(raw) for raw in df.columns])


def read_readings(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    columns: Sequence[str] | None = None,
    aliases: Mapping[str, Sequence[str]] | None = ALIASES,
) -> DataFrame:
    """Read CSV/TXT or Parquet files, folders or globs of them.

    Text is read as strings in one pass (no inference scan); its column names
    come from the header line unless ``columns`` names them.  Rows with too few
    or too many fields are kept with what could be read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    suffix = paths[0].rstrip("/*").rsplit(".", 1)[-1].lower()
    fmt = fmt or {"csv": "csv", "txt": "csv", "parquet": "parquet"}.get(suffix)
    if fmt == "parquet":
        df = spark.read.parquet(*paths)
    elif fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        if columns:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        else:
            reader = reader.option("inferSchema", False)
        df = reader.csv(paths)
    else:
        raise ValueError(f"unsupported file format: {paths[0]}")
    return map_columns(df, aliases) if aliases else df


def preview(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows, in a stated order if one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
