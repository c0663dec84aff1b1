"""What the jobs share: configuration, arguments, log lines."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

log = logging.getLogger("loomstore.jobs")


def settings(defaults: dict, path: str | None = None, **changes) -> dict:
    """The defaults, overridden by a JSON file and by ``changes``; names that the job doesn't know are an error."""
    out = dict(defaults)
    given = {}
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    given |= changes
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return out | given


def arguments(text: str, *names: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=text)
    for n in names:
        parser.add_argument(f"--{n}", required=True)
    parser.add_argument("--config", help="a JSON file")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    """The command line's session; it stops it, too."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
