"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded for comparison across engines; never -0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


PROFILE = """
base AS (
  SELECT c_nationkey AS entity, year(l_shipdate)::INT AS year, floor((l_quantity - 1) / 5)::INT AS bin, l_linestatus AS side, sum(l_quantity) AS pop
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), spine AS (
  SELECT entity, year, b::INT AS bin, side FROM (SELECT DISTINCT entity, year FROM base), range(10) t(b), (VALUES ('O'), ('F')) v(side)
), cells AS (
  SELECT entity, year, bin, side, (bin + CASE WHEN side = 'F' THEN 10 ELSE 0 END)::INT AS pos, coalesce(pop, 0.0)::DOUBLE AS pop FROM spine LEFT JOIN base USING (entity, year, bin, side)
), prof AS (
  SELECT *, sum(pop) OVER (PARTITION BY entity, year) AS total, pop / sum(pop) OVER (PARTITION BY entity, year) AS s FROM cells
), p AS (
  SELECT *, sum(s) OVER (PARTITION BY entity, year, side ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM prof
), t AS (
  SELECT entity, year, bin, total, s, m, f, sum(s) OVER (PARTITION BY entity, year ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT entity, year, bin, total, sum(s) AS s, sum(s) FILTER (side = 'O') AS m, sum(s) FILTER (side = 'F') AS f FROM prof GROUP BY ALL)
), k AS (SELECT DISTINCT entity, year, total FROM prof)"""


def on_profiles(body: str, ctes: str = "") -> str:
    """SQL over cells, prof and p (share s and per-side running sum c by entity, year, pos), t (both sides together) and k (totals)."""
    return f"WITH {PROFILE}{',' + ctes if ctes else ''} {body}"
