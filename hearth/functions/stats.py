"""Grouped descriptive statistics with pandas semantics.

``grouped_stats(df, keys, specs)`` computes, per group (NULL keys dropped, as
pandas ``groupby`` does), any mix of count / mean / std (ddof 1) / min / max /
sum and exact quantiles. The moment-type statistics are one partial-aggregated
``groupBy``; quantiles go through :mod:`hearth.functions.quantile` and are
joined back on the (small) per-group table.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.dist import t_quantile
from hearth.functions.quantile import attach_quantiles

QUANTILE_FNS = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q10": 0.10, "q90": 0.90, "q33": 1 / 3, "q67": 2 / 3}

# For the SQL oracle only: the Cornish-Fisher expansion of t(0.975, nu) around the normal
# quantile (exact to ~1e-9 for nu >= 30). The engine solves the tail probability instead.
Z975 = 1.959963984540054


def t975(nu: Column) -> Column:
    """t(0.975, nu) on aggregated rows; NULL below one degree of freedom."""
    return t_quantile(F.lit(0.05), nu)


def t975_sql(nu: str) -> str:
    z = Z975
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    n = f"CAST({nu} AS DOUBLE)"
    return f"({z!r} + {g1!r} / {n} + {g2!r} / ({n} * {n}) + {g3!r} / ({n} * {n} * {n}) + {g4!r} / ({n} * {n} * {n} * {n}))"


def _agg(fn: str, c: str) -> Column:
    x = F.col(c)
    if fn == "count":
        return F.count(x)
    if fn == "size":
        return F.count(F.lit(1))
    if fn == "mean":
        return F.avg(x)
    if fn == "std":
        return F.stddev_samp(x)
    if fn == "var":
        return F.var_samp(x)
    if fn == "min":
        return F.min(x)
    if fn == "max":
        return F.max(x)
    if fn == "sum":
        return F.sum(x)
    raise ValueError(fn)


def grouped_stats(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, str, str]],
                  mode: str = "exact") -> DataFrame:
    """specs: (output name, function, column). Functions: count (non-null),
    size (rows), mean, std, var, min, max, sum, median, q25, q75, q10, q90,
    q33, q67, or ``qNN.NNN`` for any probability."""
    keys = list(keys)
    src = df
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    plain = [(n, f, c) for n, f, c in specs if not _is_q(f)]
    quants: OrderedDict[str, list[tuple[float, str]]] = OrderedDict()
    for n, f, c in specs:
        if _is_q(f):
            quants.setdefault(c, []).append((_prob(f), n))
    out = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[_agg(f, c).alias(n) for n, f, c in plain])
    out = attach_quantiles(out, src, keys, quants, mode)
    return out.select(*keys, *[n for n, _, _ in specs])


def _is_q(f: str) -> bool:
    return f in QUANTILE_FNS or (f.startswith("q") and f[1:].replace(".", "", 1).isdigit() and "." in f)


def _prob(f: str) -> float:
    return QUANTILE_FNS[f] if f in QUANTILE_FNS else float(f[1:])


def sql_agg(fn: str, c: str) -> str:
    qc = f'"{c}"'
    if fn == "count":
        return f"count({qc})"
    if fn == "size":
        return "count(*)"
    if fn == "mean":
        return f"avg({qc})"
    if fn == "std":
        return f"stddev_samp({qc})"
    if fn == "var":
        return f"var_samp({qc})"
    if fn in ("min", "max", "sum"):
        return f"{fn}({qc})"
    if _is_q(fn):
        return f"quantile_cont({qc}, {_prob(fn)!r})"
    raise ValueError(fn)


def sql_grouped_stats(src: str, keys: Sequence[str], specs: Sequence[tuple[str, str, str]]) -> str:
    """The DuckDB twin of ``grouped_stats`` as a sub-select."""
    keys = list(keys)
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
    cols = ", ".join([*keys, *[f"{sql_agg(f, c)} AS {n}" for n, f, c in specs]])
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"(SELECT {cols} FROM {src} WHERE {where}{grp})"


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r over the rows where both are there; NULL (not an error) if one of them is constant."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
