"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(c: str | Column) -> Column:
    """Python ``str.title`` after ``strip``: every run of letters gets an upper
    first letter and lower rest; other characters are kept. NULL stays NULL.

    ASCII letters and spaces (with one mark before a space, as in ``Alm. Salg``) go through ``initcap``, which gives the same
    there and takes less time; only other text is cut into runs."""
    s = F.trim(col(c))
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cut = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")
    return F.when(s.rlike(r"^[A-Za-z ]*(?:[.,-] [A-Za-z ]*)?\z"), F.initcap(s)).otherwise(cut)


def zfill(c: str | Column, width: int = 4) -> Column:
    """``str.zfill``: left-pad with zeros, never truncate."""
    s = F.trim(col(c).cast("string"))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def finite(c: str | Column) -> Column:
    """NaN and +/-Inf become NULL (pandas treats them as missing)."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def try_double(c: str | Column) -> Column:
    return finite(F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c.try_cast("double"))


def try_long(c: str) -> Column:
    # pandas to_numeric then Int64: "3.0" is 3, "3.5" would fail the Int64 cast
    d = F.expr(f"try_cast(`{c}` as double)")
    return F.when(d == F.floor(d), d.cast("long"))


def quarter_id(ts: str | Column) -> Column:
    t = col(ts)
    return F.concat(F.year(t).cast("string"), F.lit("-Q"), F.quarter(t).cast("string"))


def qid_year(q: str | Column) -> Column:
    return F.substring(col(q), 1, 4).cast("int")


def qid_num(q: str | Column) -> Column:
    return F.substring(col(q), -1, 1).cast("int")


def all_false_if_null(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def round_to(c: str | Column, digits: int = 4) -> Column:
    """round(x * 10^d) / 10^d: the same arithmetic as the oracle SQL, so both
    engines land on the same double (no decimal-string tie differences)."""
    m = float(10 ** digits)
    return F.round(col(c).cast("double") * m) / m


def round_doubles(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Round every float column and widen every integral column to bigint
    (outputs are compared with the oracle by schema and value hash)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and digits is not None:
            out.append(round_to(F.col(f"`{f.name}`"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f"`{f.name}`").cast("long").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    return [c for c in cols if c in df.columns]
