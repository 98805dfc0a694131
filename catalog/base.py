"""Registry of checked queries: a Spark callable and, where SQL can express it,
the same result in DuckDB SQL over the same views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from terravane.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rnd(col, digits: int = 6) -> Column:
    """Round half up by floor, the same arithmetic in both engines."""
    scale = float(10**digits)
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def _expand_rounding(sql: str) -> str:
    """RND(x) / RND4(x) / RND2(x) in oracle text -> the formula of :func:`rnd`."""
    pattern = re.compile(r"\bRND(\d?)\(")
    while True:
        m = pattern.search(sql)
        if not m:
            return sql
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        digits = int(m.group(1) or 6)
        scale = 10**digits
        inner = sql[m.end() : i - 1]
        sql = f"{sql[: m.start()]}(FLOOR(CAST({inner} AS DOUBLE) * {scale}e0 + 0.5e0) / {scale}e0){sql[i:]}"


def _with_views(sql: str) -> str:
    """Prefix the CTEs of every view the text uses."""
    needed = views.closure(name for name in views.VIEWS if re.search(rf"\b{name}\b", sql))
    ctes = ",\n".join(f"{name} AS ({views.VIEWS[name]})" for name in needed)
    body = sql.strip()
    recursive = ""
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        recursive, body = "RECURSIVE ", re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
        rest = f",\n{body}"
    elif re.match(r"WITH\b", body, re.I):
        rest = ",\n" + re.sub(r"^WITH\s+", "", body, flags=re.I)
    else:
        rest = f"\n{body}"
    if not ctes:
        return sql
    return f"WITH {recursive}{ctes}{rest}"


def query(name: str, sql: str | None = None):
    """Register ``fn(v)`` under ``name``; ``v`` gives the views of one data folder."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(views.Views(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _with_views(_expand_rounding(sql))
        return fn

    return register
