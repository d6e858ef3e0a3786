"""Command line: synthetic-baselines, doctor, export, validate."""

from __future__ import annotations

import argparse
import json
import sys

from latticebits import __version__


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("latticebits").config("spark.ui.enabled", "false").getOrCreate()


def _client(args):
    from latticebits.operators.graph import STRICT_STRATEGIES
    from latticebits.sources.services import ExportConfig, ParquetClient

    config = ExportConfig(args.version, max_nodes=args.max_nodes, max_pairs=args.max_candidate_pairs, strategies=tuple(args.strategy) if args.strategy else STRICT_STRATEGIES)
    return ParquetClient(_session(), args.root, (args.version,), (config.node_table, config.type_table, config.event_table)), config


def baselines(args) -> dict | list:
    from pyspark.sql import functions as F

    from latticebits.operators import evaluate, splits, synthetic

    rows = splits.permutation_split(synthetic.pairs(_session(), n_nodes=args.nodes, n_pairs=args.pairs, seed=args.seed), ["pair_id"], 0.3, args.seed + 1)
    results = evaluate.model_comparison(rows, F.col("part") == "train", F.col("part") == "test").cache()
    evaluate.save_results(results, args.output)
    return [r.asDict() for r in results.orderBy("model").collect()]


def doctor(args) -> dict:
    from latticebits.sources import services

    return services.doctor(*_client(args))


def export(args) -> dict:
    from latticebits.sources import services

    return services.export(*_client(args), args.output)


def validate(args) -> dict:
    from latticebits.sources import tables

    return tables.validate_export(_session(), args.path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("latticebits")
    p.add_argument("--version", action="version", version=__version__, dest="show")
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("synthetic-baselines")
    s.add_argument("--nodes", type=int, default=500)
    s.add_argument("--pairs", type=int, default=40_000)
    s.add_argument("--seed", type=int, default=7)
    s.add_argument("--output", default="results/synthetic_baselines.json")
    s.set_defaults(run=baselines)
    for name, run in (("doctor", doctor), ("export", export)):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("--version", type=int, required=True)
        s.add_argument("--max-nodes", type=int, default=500)
        s.add_argument("--max-candidate-pairs", type=int, default=5_000_000)
        s.add_argument("--strategy", action="append", help="axon proofreading strategy of nodes; repeat for several (default: axon_fully_extended)")
        if name == "export":
            s.add_argument("--output", default="data/cache/pilot")
        s.set_defaults(run=run)
    s = sub.add_parser("validate")
    s.add_argument("path")
    s.set_defaults(run=validate)
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import PySparkException

    args = parser().parse_args(argv)
    try:
        print(json.dumps(args.run(args), indent=2))
    except (ValueError, RuntimeError, OSError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0
