"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The data graph links parts that share an order, on the first two lines of it (fixture F1): the graph that the
baseline's figures are for. large_ queries run on the graph of all lines (fixture F4), beyond the broadcast bound."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom import CATALOGUE, Graph, compile_plan


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 2").select("l_orderkey", "l_partkey")
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("src")).join(lines.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey")
    times: dict[str, float] = {}

    def timed(name: str, f):
        began = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    g = Graph.from_edges(pairs)
    timed("load", lambda: g.num_edges)
    compile_plan(g, CATALOGUE["triangle"], "edge", "none", scheduler="structural").run()  # compiles the first plan
    timed("triangles_raw", lambda: g.raw_triangles().agg(F.sum("triangles")).first())
    counts = {}
    for name in ("triangle", "wedge", "diamond", "square", "star3", "path4", "p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8"):
        kind = "edge_iep" if name in ("wedge", "star3", "path4") else "edge"
        counts[name] = timed(name, lambda: compile_plan(g, CATALOGUE[name], kind, "none", scheduler="structural").run().result)  # noqa: B023
    g.unpersist()
    # A graph above the broadcast bound (fixture F4: all lines of an order), whose plans shuffle.
    whole = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    big = Graph.from_edges(whole.select("l_orderkey", F.col("l_partkey").alias("src")).join(whole.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey"))
    timed("large_load", lambda: big.num_edges)
    for name in ("triangle", "p1"):
        counts[f"large_{name}"] = timed(f"large_{name}", lambda: compile_plan(big, CATALOGUE[name], "edge", "eager", scheduler="structural").run().result)  # noqa: B023
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "matches": counts, "sf": os.path.basename(os.path.normpath(sf_dir))}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
