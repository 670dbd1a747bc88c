"""What the jobs share: their command lines, counts of what is read and written, and tables that may not exist yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and what counts its rows while it is written; no scan of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def earlier(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main(name: str, arguments: list[str], default: str, run: Callable[..., dict]) -> None:
    """Reads the command line, and creates and stops the only session that a job makes itself."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for argument in arguments:
        parser.add_argument(f"--{argument}", required=True, help="a path that Spark can open")
    parser.add_argument("--config", default=default, help="a JSON file on this machine")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = config(given.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(json.dumps(run(spark, **given, settings=settings)))
    finally:
        spark.stop()
