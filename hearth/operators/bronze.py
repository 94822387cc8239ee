"""Bronze: tolerant schema enforcement, temporal keys and audit columns.

Only columns that are present are touched; extra columns pass through; a bad
value becomes NULL, never an error (ANSI mode is on, so every coercion is a
``try_`` form).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.scalar import quarter_id, title_case, try_double, try_long, zfill

STRING_COLS = ("house_type", "sales_type", "region", "area", "city", "address")
NULLABLE_INT_COLS = ("year_build", "no_rooms")
FLOAT_COLS = (
    "purchase_price", "sqm", "sqm_price",
    "%_change_between_offer_and_purchase",
    "nom_interest_rate%", "dk_ann_infl_rate%",
    "yield_on_mortgage_credit_bonds%",
)


def _date_expr(df: DataFrame, unit: str) -> F.Column:
    dt = df.schema["date"].dataType
    c = F.col("date")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dt, T.DateType):
        return c.cast("timestamp")
    if isinstance(dt, T.StringType):
        return F.coalesce(F.expr("try_to_timestamp(`date`)"),
                          F.timestamp_seconds(F.expr("try_cast(`date` as bigint)")))
    seconds = c.cast("double")
    if unit == "ms":
        seconds = seconds / 1e3
    elif unit == "ns":
        seconds = seconds / 1e9
    return F.timestamp_seconds(seconds)


def enforce_schema(df: DataFrame, date_unit: str = "s") -> DataFrame:
    cols: dict[str, F.Column] = {}
    for c in STRING_COLS:
        if c in df.columns:
            cols[c] = title_case(F.col(c).cast("string"))
    for c in NULLABLE_INT_COLS:
        if c in df.columns:
            cols[c] = try_long(c)
    for c in FLOAT_COLS:
        if c in df.columns:
            cols[c] = try_double(c)
    if "date" in df.columns:
        cols["date"] = _date_expr(df, date_unit)
    if "zip_code" in df.columns:
        cols["zip_code"] = zfill("zip_code", 4)
    return df.withColumns(cols)


def add_temporal_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "year_sale": F.year("date").cast("int"),
        "quarter_id": quarter_id("date"),
    })


def add_audit_columns(df: DataFrame, source_file: str | None = None) -> DataFrame:
    src = F.lit(source_file) if source_file is not None else F.col("_metadata.file_name")
    return df.withColumns({"_bronze_ingest_ts": F.current_timestamp(), "_source_file": src})


def bronze(df: DataFrame, source_file: str | None = None, date_unit: str = "s", audit: bool = True) -> DataFrame:
    out = add_temporal_keys(enforce_schema(df, date_unit))
    return add_audit_columns(out, source_file) if audit else out
