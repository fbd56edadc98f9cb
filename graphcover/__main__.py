"""Command line: ``discover``, ``score``, ``f1``, ``density``, ``metis`` and ``snap``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from graphcover.operators.graph import canonical_edges
from graphcover.operators.metrics import average_f1, estimated_p, metric_suite
from graphcover.plans.discover import discover_communities, run_log_lines
from graphcover.sources import files
from graphcover.sources.params import format_params, read_params


def _nodes(spark: SparkSession, n: int):
    return spark.range(1, n + 1).withColumnRenamed("id", "node")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphcover")
    sub = parser.add_subparsers(dest="command", required=True)
    discover = sub.add_parser("discover", help="find communities; files go beside --out")
    discover.add_argument("config")
    discover.add_argument("--edges", help="edge list; the configuration's file by default")
    discover.add_argument("--out", default=".")
    score = sub.add_parser("score", help="structural metrics of a community file")
    score.add_argument("config")
    score.add_argument("communities")
    score.add_argument("--edges")
    score.add_argument("--first-id", type=int, choices=(0, 1), default=1, help="the id of the first node in both files")
    f1 = sub.add_parser("f1", help="average F1 against a ground truth")
    f1.add_argument("communities")
    f1.add_argument("truth")
    f1.add_argument("--out", default=".")
    density = sub.add_parser("density", help="estimate p from chosen communities of a ground truth")
    density.add_argument("config")
    density.add_argument("truth")
    density.add_argument("chosen", help="a file of community numbers, from 1")
    density.add_argument("--edges")
    density.add_argument("--first-id", type=int, choices=(0, 1), default=1, help="the id of the first node in both files")
    metis = sub.add_parser("metis", help="METIS graph to edge list")
    metis.add_argument("graph")
    metis.add_argument("out")
    metis.add_argument("--first-id", type=int, choices=(0, 1), default=1)
    snap = sub.add_parser("snap", help="edge list to SNAP edge list")
    snap.add_argument("edges")
    snap.add_argument("out")
    snap.add_argument("nodes", type=int)
    snap.add_argument("count", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphcover").getOrCreate()
    if args.command == "discover":
        params = read_params(spark, args.config)
        if params.verbose:
            print("\n".join(format_params(params)))
        edges = files.read_edges(spark, args.edges or params.edge_file)
        files.check_counts(edges, params.num_nodes, params.num_edges)
        name = (args.edges or params.edge_file).rstrip("/").rpartition("/")[2]
        live = f"{args.out}/CLOG_{params.test_id}_{name}" if params.logs else None
        found = discover_communities(edges, params, _nodes(spark, params.num_nodes), live)
        files.write_communities(found.cover, f"{args.out}/C_{params.test_id}_{name}")
        files.write_lines(spark, run_log_lines(found, params.logs), f"{args.out}/log_{params.test_id}_{name}")
    elif args.command == "score":
        params = read_params(spark, args.config)
        shift = args.first_id - 1
        edges = files.read_edges(spark, args.edges or params.edge_file, shift)
        metric_suite(edges, files.read_communities(spark, args.communities, shift), _nodes(spark, params.num_nodes)).show(truncate=False)
    elif args.command == "density":
        shift = args.first_id - 1
        edges = files.read_edges(spark, args.edges or read_params(spark, args.config).edge_file, shift)
        truth = files.read_communities(spark, args.truth, shift)
        print(f"p {estimated_p(edges, truth, files.read_ids(spark, args.chosen)).first()[0]}")
    elif args.command == "f1":
        began = time.time()
        value = average_f1(files.read_communities(spark, args.communities), files.read_communities(spark, args.truth)).first()[0]
        name = args.communities.rstrip("/").rpartition("/")[2].rpartition(".")
        report = files.f1_report(value, time.time() - began, args.communities, args.truth)
        files.write_lines(spark, report, f"{args.out}/f1_{name[0] or name[2]}")
        print("\n".join(report))
    elif args.command == "metis":
        lines = files.numbered_lines(spark, args.graph)
        files.write_edges(files.parse_metis(lines, args.first_id), args.out)
        files.write_lines(spark, [str(x) for x in files.metis_header(lines).first()], f"{args.out.rstrip('/')}_dim")
    else:
        files.write_snap(canonical_edges(files.read_edges(spark, args.edges)), args.out, args.nodes, args.count)


if __name__ == "__main__":
    main()
