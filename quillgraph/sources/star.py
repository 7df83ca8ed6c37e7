"""The star schema as a property graph. Ids are ``Label:key``."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .graph import EdgeTable, NodeTable, PropertyGraph


def key(label: str, column: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str, small_parts_only: bool = False) -> PropertyGraph:
    """small_parts_only: leaves out parts with p_size over 25, so that the other ends of their edges are stubs."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    part = read["part"].filter("p_size <= 25") if small_parts_only else read["part"]
    full = not small_parts_only
    g = PropertyGraph(spark)
    for label, df, column in (("Region", read["region"], "r_regionkey"), ("Nation", read["nation"], "n_nationkey"), ("Customer", read["customer"], "c_custkey"), ("Supplier", read["supplier"], "s_suppkey"), ("Order", read["orders"], "o_orderkey"), ("Part", part, "p_partkey")):
        g.node_tables[label] = NodeTable(df, key(label, column), key=column)
    g.node_tables["Event"] = NodeTable(read["events"], key("Event", "event_id"), label_column="event_type", key="event_id")
    g.node_tables["User"] = NodeTable(read["events"].select("user_id").distinct(), key("User", "user_id"), key="user_id")
    lines = tuple(read["lineitem"].columns)
    returned = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    g.edge_tables = {
        "IN_REGION": [EdgeTable(read["nation"], key("Nation", "n_nationkey"), key("Region", "n_regionkey"), ("Nation",), ("Region",), keys=("n_nationkey", "n_regionkey"))],
        "IN_NATION": [EdgeTable(read["customer"], key("Customer", "c_custkey"), key("Nation", "c_nationkey"), ("Customer",), ("Nation",), keys=("c_custkey", "c_nationkey")), EdgeTable(read["supplier"], key("Supplier", "s_suppkey"), key("Nation", "s_nationkey"), ("Supplier",), ("Nation",), keys=("s_suppkey", "s_nationkey"))],
        "PLACED": [EdgeTable(read["orders"], key("Customer", "o_custkey"), key("Order", "o_orderkey"), ("Customer",), ("Order",), ("o_orderdate", "o_totalprice"), keys=("o_custkey", "o_orderkey"))],
        "CONTAINS": [EdgeTable(read["lineitem"], key("Order", "l_orderkey"), key("Part", "l_partkey"), ("Order",), ("Part",), lines, returned, single=False, complete=full, keys=("l_orderkey", "l_partkey"))],
        "SUPPLIED_BY": [EdgeTable(read["lineitem"], key("Order", "l_orderkey"), key("Supplier", "l_suppkey"), ("Order",), ("Supplier",), lines, single=False, keys=("l_orderkey", "l_suppkey"))],
        "OF": [EdgeTable(read["lineitem"].select("l_partkey", "l_suppkey").distinct(), key("Part", "l_partkey"), key("Supplier", "l_suppkey"), ("Part",), ("Supplier",), complete=full, keys=("l_partkey", "l_suppkey"))],
        "DID": [EdgeTable(read["events"], key("User", "user_id"), key("Event", "event_id"), ("User",), ("Event",), ("ts", "value"), F.when(F.col("event_type") == "error", -1).otherwise(1), keys=("user_id", "event_id"))],
    }
    return g
