"""Shapiro-Wilk test over all rows (Q7): expected normal order statistics joined to the ranks of a distributed sort, one sum."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.quantile import rank_within_groups

# --- fixed values -------------------------------------------------------------
# Normal quantile function, rational approximations (Wichura 1988): numerator and denominator of the centre, the near and the far tail.
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
        2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
       (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
        7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
# Corrections of the two outer weights in powers of 1 / sqrt(n) from the first on (Royston 1992).
OUTER = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
# Mean and log deviation of the transformed statistic, up to 11 rows in powers of n, from 12 on in powers of log n.
SMALL_GAMMA, SMALL_MEAN, SMALL_DEVIATION = (-2.273, 0.459), (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_DEVIATION = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
# ------------------------------------------------------------------------------


def _poly(coefficients: Sequence[float], x):
    """c0 + c1 x + c2 x^2 ..."""
    out = None
    for c in reversed(coefficients):
        out = c if out is None else out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    central = 0.180625 - q * q
    tail = F.when(r <= 5, _poly(NEAR[0], r - 1.6) / _poly(NEAR[1], r - 1.6)).otherwise(_poly(FAR[0], r - 5.0) / _poly(FAR[1], r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _poly(CENTRE[0], central) / _poly(CENTRE[1], central)).otherwise(F.signum(q) * tail)


def shapiro_wilk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column_name, n, w_stat)`` of each column over all its values (NULL and NaN left out); null below 3 values or without spread."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("_p")).select("_p.*")
    r = rank_within_groups(long.where("x IS NOT NULL AND NOT isnan(x)"), ["column_name"], ["x"])
    n, i = F.col("_n").cast("double"), F.col("_rank") + 1
    r = r.withColumn("m", normal_quantile((i - 0.375) / (n + 0.25)))
    at = lambda rank, c: F.sum(F.when(i == rank, F.col(c)))
    s = r.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.var_pop("x").alias("v"),
        at(F.lit(1), "x").alias("x1"), at(F.lit(2), "x").alias("x2"), at(F.col("_n") - 1, "x").alias("y2"), at(F.col("_n"), "x").alias("y1"),
        at(F.col("_n"), "m").alias("m1"), at(F.col("_n") - 1, "m").alias("m2"))
    u = 1 / F.sqrt(F.col("n"))
    root = F.sqrt("mm")
    a1 = F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(u * _poly(OUTER, u) + F.col("m1") / root)
    a2 = u * _poly(SECOND, u) + F.col("m2") / root
    m1, m2 = F.col("m1"), F.col("m2")
    two = F.col("n") > 5
    phi = F.when(two, (F.col("mm") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).otherwise(F.try_divide(F.col("mm") - 2 * m1 * m1, 1 - 2 * a1 * a1))
    outer, second = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    inner = F.when(F.col("n") == 3, F.lit(0.0)).otherwise((F.col("mx") - m1 * outer - F.when(two, m2 * second).otherwise(0.0)) / F.sqrt(phi))
    total = inner + a1 * outer + F.when(two, a2 * second).otherwise(0.0)
    w = F.when((F.col("n") >= 3) & (F.col("v") > 0), F.least(total * total / (F.col("v") * F.col("n")), F.lit(1.0)))
    return s.select("column_name", "n", w.alias("w_stat"))


@F.pandas_udf(T.DoubleType())
def _upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))


def shapiro_wilk_p(stats: DataFrame) -> DataFrame:
    """``stats`` with the p-value of ``w_stat`` (Royston's approximation, stated for up to 5,000 values and less exact beyond) and ``is_normal`` at 5 %."""
    n, w = F.col("n").cast("double"), F.col("w_stat")
    lost = F.log(1 - w)
    ln = F.log(n)
    small = (-F.log(_poly(SMALL_GAMMA, n) - lost) - _poly(SMALL_MEAN, n)) / F.exp(_poly(SMALL_DEVIATION, n))
    large = (lost - _poly(LARGE_MEAN, ln)) / F.exp(_poly(LARGE_DEVIATION, ln))
    exact = 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75)))  # three values
    z = F.when(n >= 12, large).when(n > 3, small)
    p = F.when(F.col("n") == 3, F.greatest(exact, F.lit(0.0))).otherwise(_upper_tail(z))
    return stats.withColumn("p_value", p).withColumn("is_normal", F.col("p_value") > 0.05)


def shapiro_wilk_sql(table: str, cols: Sequence[str]) -> str:
    """CTE ``sw`` (column_name, n, w_stat) over ``table`` in DuckDB SQL."""
    poly = lambda c, x: "(" + " + ".join(f"{v!r}::DOUBLE * power({x}, {i})" for i, v in enumerate(c)) + ")"
    frac = lambda f, x: f"({poly(f[0], x)} / {poly(f[1], x)})"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(\"{c}\" AS DOUBLE) AS x FROM {table} WHERE \"{c}\" IS NOT NULL" for c in cols)
    return f"""sw0 AS ({rows}),
sw1 AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY x) AS i, count(*) OVER (PARTITION BY column_name) AS n FROM sw0),
sw2 AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM sw1),
sw3 AS (SELECT *, sqrt(-ln(least(p, 1 - p))) AS r FROM sw2),
sw4 AS (SELECT *, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {frac(CENTRE, "(0.180625 - (p - 0.5) * (p - 0.5))")}
                   WHEN r <= 5 THEN sign(p - 0.5) * {frac(NEAR, "(r - 1.6)")} ELSE sign(p - 0.5) * {frac(FAR, "(r - 5.0)")} END AS m FROM sw3),
sw5 AS (SELECT column_name, n, sqrt(sum(m * m)) AS root, sum(m * m) AS mm, 1 / sqrt(n) AS u, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2 FROM sw4 GROUP BY column_name, n),
sw6 AS (SELECT *, u * {poly(OUTER, "u")} + m1 / root AS a1, u * {poly(SECOND, "u")} + m2 / root AS a2 FROM sw5),
sw7 AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM sw6),
sw8 AS (SELECT column_name, n, x, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / sqrt(phi) END AS a
        FROM sw4 JOIN sw7 USING (column_name, n)),
sw AS (SELECT column_name, n, power(sum(a * x), 2) / (var_pop(x) * n) AS w_stat FROM sw8 GROUP BY column_name, n)"""
