"""python -m graphloom prep | run | batch | profile | compare: the command line."""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import LOWERINGS, compile_plan
from .graph import Graph
from .patterns import CATALOGUE
from .plans.pruning import PRUNING
from .plans.schedule import SCHEDULERS
from .sources import files, logs


def _spark() -> SparkSession:
    return SparkSession.builder.appName("graphloom").getOrCreate()


def _graph(args: argparse.Namespace) -> Graph:
    spark, path = _spark(), args.path_to_graph
    stored = any(files.exists(spark, files.join(path, f)) for f in ("meta.json", "meta.txt"))
    return Graph.from_preprocessed(spark, path, args.reorder) if stored else Graph.from_snap(spark, path, args.reorder)


def prep(args: argparse.Namespace) -> int:
    spark = _spark()
    g = Graph.from_snap(spark, args.path_to_graph)
    folder = args.path_to_graph if files.is_folder(spark, args.path_to_graph) else args.path_to_graph.rpartition("/")[0] or "."
    meta = (g.save_binary if args.binary else g.save)(args.out or folder)
    print(meta)
    return 0


def _once(args: argparse.Namespace, g: Graph, scheduler: str, pruning: str):
    adjacency = CATALOGUE.get(args.query.lower(), args.query)
    plan = compile_plan(g, adjacency, args.query_type, pruning, args.parallel_type, scheduler, args.lowering)
    common = {"exp_id": args.exp_id, "graph": g.name, "pattern": args.query, "adjacency": adjacency, "size": plan.pattern_size, "query_type": plan.query_type, "scheduler": scheduler, "pruning_type": plan.pruning_type, "parallel_type": plan.parallel_type}
    if args.log_dir:
        logs.append(files.join(args.log_dir, "compile_log.csv"), logs.COMPILE_COLUMNS, common | {"plan_seconds": f"{plan.plan_seconds:.6f}", "compile_seconds": 0})
    result = plan.run(num_threads=args.threads, timeout=args.timeout, metrics=bool(args.log_dir))
    if args.log_dir:
        row = common | {"threads": args.threads, "run_seconds": logs.run_time(result.seconds, result.finished), "matches": result.num_matches, "matches_per_second": f"{result.matches_per_second:.1f}", "allocated": result.allocated}
        logs.append(files.join(args.log_dir, "run_log.csv"), logs.RUN_COLUMNS, row)
    return plan, result


def run(args: argparse.Namespace) -> int:
    plan, result = _once(args, _graph(args), args.scheduler, args.pruning_type)
    logs.logger().info("%s", plan.describe())
    print(f"{result.num_matches} matches in {logs.readable_time(result.seconds)}" + ("" if result.finished else " (Time Out)"))
    return 0 if result.finished else 1


def batch(args: argparse.Namespace) -> int:
    """Every query of a CSV file (columns exp_id, query and any options of run) on one graph, each under the timeout; a query
    that fails or times out does not end the others."""
    g, bad = _graph(args), 0
    for row in csv.DictReader(files.read(_spark(), args.queries).decode().splitlines()):
        one = argparse.Namespace(**vars(args) | {k: v for k, v in row.items() if v and k in ("exp_id", "query", "query_type", "pruning_type", "parallel_type", "scheduler", "lowering")})
        try:
            _, result = _once(one, g, one.scheduler, one.pruning_type)
            print(f"{one.exp_id}: {result.num_matches} matches in {logs.readable_time(result.seconds)}" + ("" if result.finished else " (Time Out)"))
            bad += not result.finished
        except Exception as e:  # reported, and the next one runs
            print(f"{one.exp_id}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            bad += 1
    return int(bad > 0)


def profile(args: argparse.Namespace) -> int:
    """Counters by vertex, degree, offset, triangles and level as CSV folders, for each pruning type."""
    g = _graph(args)
    d, t = g.degrees(), g.raw_triangles()
    for pruning in args.prunings:
        plan, result = _once(args, g, args.scheduler, pruning)
        work = plan.work().join(d, "vid").join(t, "vid").persist()
        for name, key in (("vid", "vid"), ("deg", "degree"), ("offset", "offset"), ("triangle", "triangles"), ("loop", "level")):
            out = work.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("reads", "neighbours", "auxiliary", "tests")]).where(f"reads > 0 AND {key if name == 'triangle' else 1} > 0")
            out.write.mode("overwrite").csv(files.join(args.out, f"{args.exp_id}_{pruning}_{name}"), header=True)
        work.unpersist()
        print(f"{pruning}: {result.num_matches} matches in {logs.readable_time(result.seconds)}")
    return 0


def compare(args: argparse.Namespace) -> int:
    """All schedulers must agree."""
    g = _graph(args)
    found = {s: _once(args, g, s, args.pruning_type)[1].num_matches for s in SCHEDULERS}
    print(found)
    return 0 if len(set(found.values())) == 1 else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prep", help="edge-list text to a stored graph")
    p.add_argument("--path_to_graph", required=True)
    p.add_argument("--out")
    p.add_argument("--binary", action="store_true", help="raw arrays and meta.txt instead of Parquet")
    p.set_defaults(call=prep)
    for name, call in (("run", run), ("batch", batch), ("profile", profile), ("compare", compare)):
        p = sub.add_parser(name)
        p.add_argument("--path_to_graph", required=True)
        p.add_argument("--query", required=name != "batch", help=f"an adjacency string, or one of {', '.join(CATALOGUE)}")
        p.add_argument("--query_type", default="edge")
        p.add_argument("--pruning_type", default="none", help=", ".join(PRUNING))
        p.add_argument("--parallel_type", default="nested_rt")
        p.add_argument("--scheduler", default="structural", help=", ".join(SCHEDULERS))
        p.add_argument("--lowering", default="join", choices=LOWERINGS)
        p.add_argument("--threads", type=int, default=0)
        p.add_argument("--exp_id", default="0")
        p.add_argument("--reorder", action="store_true")
        p.add_argument("--timeout", type=float, default=24 * 3600.0)
        p.add_argument("--log_dir")
        if name == "batch":
            p.add_argument("--queries", required=True, help="a CSV file")
        if name == "profile":
            p.add_argument("--out", required=True)
            p.add_argument("--prunings", nargs="+", default=["none", "static", "eager", "costmodel"])
        p.set_defaults(call=call)
    args = parser.parse_args(argv)
    return args.call(args)


if __name__ == "__main__":
    sys.exit(main())
