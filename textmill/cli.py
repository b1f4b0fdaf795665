"""Command line: ``python -m textmill.cli infer`` and ``python -m textmill.cli evaluate``."""

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import profiles as P
from .functions import prompts, tables
from .operators import statistics, voting
from .plans.text_to_table import Options, mock_generator, text_to_table
from .sources import config, files
from .session import local


def _named(path: str | None):
    """The object of ``module:name``."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _options(args: argparse.Namespace) -> Options:
    load = _named(args.generator)
    generate = prompts.model(load) if load else mock_generator
    return config.options(config.read(args.config) if args.config else {}, regime=args.regime, generate=generate)


def infer(spark: SparkSession, args: argparse.Namespace) -> str:
    """The table of one text."""
    if args.input_file:
        with open(args.input_file, encoding="utf-8") as f:
            text = f.read()
    elif args.text:
        text = args.text
    else:
        raise SystemExit("give --text or --input_file")
    return text_to_table(spark.createDataFrame([(0, text)], "doc_id long, text string"), _options(args)).first()["markdown"]


def evaluate(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Scores of the plan on test examples, with intervals; the lines of the results."""
    examples = statistics.numbered(files.read_instances(spark, args.test_data).withColumn("_no", F.monotonically_increasing_id()), "_no").withColumnRenamed("i", "id")
    examples = examples.select("id", "text", "table")
    made = text_to_table(examples.select(F.col("id").alias("doc_id"), "text"), _options(args))
    both = examples.join(made.select(F.col("doc_id").alias("id"), F.col("markdown").alias("generated")), "id")
    ask = _named(args.judge)
    if ask is not None:
        judged = voting.judge(both, prompts.model(ask)).select("id", F.col("journalistic_value").alias("judged"))
        both = both.join(judged, "id")
    scored = tables.evaluate(both.withColumnRenamed("table", "reference"), journalistic=F.col("judged") if ask is not None else None)
    report = statistics.report(scored, P.JUDGE_KEYS, resamples=args.bootstrap_b).cache()
    files.write_results(report, args.output)
    return [r["line"] for r in files.results_table(report).orderBy("no").collect()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textmill")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("infer", "evaluate"):
        p = commands.add_parser(name)
        p.add_argument("--regime", default="dynamic", choices=["static", "dynamic"])
        p.add_argument("--generator", help="module:function that loads a generator; a fixed table without")
        p.add_argument("--config", help="YAML settings of the plan")
    commands.choices["infer"].add_argument("--text")
    commands.choices["infer"].add_argument("--input_file")
    p = commands.choices["evaluate"]
    p.add_argument("--test_data", required=True)
    p.add_argument("--judge", help="module:function that loads a judge; journalistic value is 0 without")
    p.add_argument("--bootstrap_b", type=int, default=10_000)
    p.add_argument("--output", default="evaluation_results")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or local()
    if args.command == "infer":
        print(infer(spark, args))
    else:
        print("\n".join(evaluate(spark, args)))


if __name__ == "__main__":
    main()
