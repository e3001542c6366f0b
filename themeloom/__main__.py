"""The three jobs as commands, for ``spark-submit`` or ``python -m themeloom``.

    generate-categories RESPONSES CATEGORIES     propose categories from a sample
    build-codeframe RESPONSES CATEGORIES CODEFRAME   code every distinct answer
    apply-codeframe RESPONSES CATEGORIES CODEFRAME OUT   write the indicator table

Paths are CSV files or folders; ``RESPONSES`` and ``OUT`` ending in ``.parquet``
are Parquet. Ledgers make the first two restartable.
"""

from __future__ import annotations

import argparse
import functools
import importlib
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from themeloom.clients import ChatClient, ModelClient
from themeloom.config import CodingSettings
from themeloom.operators.audits import failed_answers
from themeloom.plans.jobs import categorized_output, create_codeframe, extend_codeframe, generate_categories
from themeloom.sources.csv_tables import (
    read_categories,
    read_codeframe_multi,
    read_codeframe_single,
    read_responses,
    write_codeframe,
    write_csv,
    write_parquet,
)
from themeloom.tables import clear_scratch, materialize

log = logging.getLogger("themeloom")


def _client_factory(name: str, model: str) -> Callable[[], ModelClient]:
    module, _, attribute = name.partition(":")
    factory = getattr(importlib.import_module(module), attribute)
    return functools.partial(factory, model) if factory is ChatClient else factory


def _parser() -> argparse.ArgumentParser:
    defaults = CodingSettings()
    parser = argparse.ArgumentParser(prog="themeloom", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for job, paths in (
        ("generate-categories", ["responses", "categories"]),
        ("build-codeframe", ["responses", "categories", "codeframe"]),
        ("apply-codeframe", ["responses", "categories", "codeframe", "out"]),
    ):
        command = jobs.add_parser(job)
        for path in paths:
            command.add_argument(path)
        command.add_argument("--overwrite", action="store_true", help="replace what is at the output path")
        command.add_argument("--encoding", help="of the responses; found from their bytes by default")
        command.add_argument("--single-line", action="store_true", help="no line breaks inside answers: large files split")
        if job != "generate-categories":
            command.add_argument("--multicode", action="store_true", help="an answer may have several categories")
        if job != "apply-codeframe":
            command.add_argument("--question", default=defaults.question)
            command.add_argument("--client", default="themeloom.clients:ChatClient", help="module:factory")
            command.add_argument("--model", default=defaults.model)
            command.add_argument("--ledger", help="table of paid replies to go on from; a hosted model needs one")
            command.add_argument("--fence-only", action="store_true", help="keep json and backticks inside names")
            command.add_argument("--seed", default=defaults.seed, help="of the sample of answers")
            for name in (
                "concurrency", "calls_per_task", "requests_per_minute", "tokens_per_minute",
                "expected_reply_tokens", "max_attempts",
            ):
                command.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(defaults, name))
        if job == "generate-categories":
            command.add_argument("--count", type=int, default=defaults.number_of_categories)
            command.add_argument("--sample-size", type=int, default=defaults.sample_size)
        if job == "build-codeframe":
            command.add_argument("--extend", help="a codeframe whose answers are known already, to be written with the new ones")
            command.add_argument("--batch-size", type=int, default=defaults.batch_size)
            command.add_argument("--strict-length", action="store_true", help="a reply must have a code per answer")
    return parser


def _settings(options: argparse.Namespace) -> CodingSettings:
    given = vars(options)
    names = {"number_of_categories": "count", "is_multicode": "multicode"}
    fields = CodingSettings.__dataclass_fields__
    return CodingSettings(**{f: given[names.get(f, f)] for f in fields if given.get(names.get(f, f)) is not None})


def _responses(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    if options.responses.endswith(".parquet"):
        return spark.read.parquet(options.responses)
    return read_responses(spark, options.responses, options.encoding, multi_line=not options.single_line)


def main(arguments: Sequence[str] | None = None) -> None:
    options = _parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName(f"themeloom {options.job}").getOrCreate()
    try:
        _run(spark, options)
    finally:
        clear_scratch(spark)


def _run(spark: SparkSession, options: argparse.Namespace) -> None:
    settings = _settings(options)
    mode = "overwrite" if options.overwrite else "error"
    responses = _responses(spark, options)

    if options.job == "generate-categories":
        factory = _client_factory(options.client, settings.model)
        categories = generate_categories(responses, factory, settings, options.ledger)
        rows = materialize(categories, "categories").orderBy("ord").select("category")
        write_csv(rows, options.categories, header=False, one_file=True, mode=mode)
        return

    if options.job == "build-codeframe":
        names = read_categories(spark, options.categories)
        factory = _client_factory(options.client, settings.model)
        if options.extend:
            read = read_codeframe_multi if settings.is_multicode else read_codeframe_single
            codeframe = extend_codeframe(read(spark, options.extend), responses, names, factory, settings, options.ledger)
        else:
            codeframe = create_codeframe(responses, names, factory, settings, options.ledger)
        codeframe = materialize(codeframe, "codeframe")
        write_codeframe(codeframe, options.codeframe, mode=mode)
        log.info("%d answers could not be coded", failed_answers(codeframe).count())
        return

    coded, failed, unknown = categorized_output(spark, responses, options.categories, options.codeframe, settings)
    log.info("%d answers were not coded", failed.count())
    log.info("%d codes are not among the categories", unknown.count())
    write = write_parquet if options.out.endswith(".parquet") else write_csv
    write(coded, options.out, rows_from=responses, mode=mode)


if __name__ == "__main__":
    main()
