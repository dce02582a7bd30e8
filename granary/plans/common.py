"""Shared inputs of the registered queries, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import Tables

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LONG_SQL = (
    "(SELECT feature, v FROM lineitem UNPIVOT (v FOR feature IN "
    "(l_quantity, l_extendedprice, l_discount, l_tax)))"
)


def line_nulls(t: Tables) -> DataFrame:
    """lineitem with nulls by rule; the table itself has none."""
    return t.lineitem.withColumns(
        {
            "l_discount": F.when(F.col("l_linenumber") % 7 != 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_quantity") < 45, F.col("l_tax")),
        }
    )


LINE_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, CASE WHEN l_linenumber % 7 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_quantity < 45 THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""


def part_nulls(t: Tables) -> DataFrame:
    return t.part.withColumns(
        {
            "p_type": F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")),
            "p_size": F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")),
        }
    )


PART_NULLS_SQL = """(SELECT p_partkey, p_name, p_brand,
  CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p_type,
  CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size, p_retailprice FROM part)"""


def scored_events(t: Tables) -> DataFrame:
    """events with a model-free score (with ties) and a 0/1 label."""
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        (F.floor(F.col("value") * 0.5 - F.length("event_type")) / 10.0 + 0.0).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


SCORED_SQL = """(SELECT event_id, ts, user_id, event_type, value,
  floor(value * CAST(0.5 AS DOUBLE) - length(event_type)) / CAST(10 AS DOUBLE) + 0 AS score,
  CAST(event_type = 'error' AS INT) AS label FROM events)"""
