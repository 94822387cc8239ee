"""
and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearth.functions.scalar import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}
DIGITS: dict[str, int | None] = {}
SCHEMA_DIR = "/root/testdata/sf0.001"


def register(name: str, ops: tuple[str, ...] = (), sql: str | None = None, digits: int | None = 4):
    """Register ``fn(spark, sf_dir) -> DataFrame``; float outputs are rounded to
    ``digits`` so value hashes are comparable with the oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPERATORS[name] = ops
        DIGITS[name] = digits
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


def load_all() -> None:
    from hearth.plans import q_describe, q_extra, q_features, q_hypotheses, q_medallion, q_models, q_profile, q_text  # noqa: F401


def rounded_oracle(schema_dir: str = SCHEMA_DIR) -> dict[str, str]:
    """Oracle SQL with the same float rounding the Spark side applies. The
    float columns of each statement are found with DuckDB ``DESCRIBE`` over
    a schema-only copy of the tables (no rows are needed)."""
    import duckdb

    from hearth.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{schema_dir}/{t}.parquet') LIMIT 0")
    out = {}
    widen = ("INTEGER", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER", "USMALLINT", "UTINYINT")
    for name, sql in ORACLE.items():
        d = DIGITS.get(name)
        cols = con.execute(f"DESCRIBE {sql}").fetchall()
        rep = []
        for c in cols:
            n, t = c[0], c[1]
            if t in ("DOUBLE", "FLOAT", "REAL") or t.startswith("DECIMAL"):
                if d is not None:
                    m = float(10 ** d)
                    rep.append(f'round(CAST("{n}" AS DOUBLE) * {m}) / {m} AS "{n}"')
                elif t.startswith("DECIMAL"):
                    rep.append(f'CAST("{n}" AS DOUBLE) AS "{n}"')
            elif t in widen:
                rep.append(f'CAST("{n}" AS BIGINT) AS "{n}"')
        out[name] = f"SELECT * REPLACE ({', '.join(rep)}) FROM ({sql})" if rep else sql
    return out
