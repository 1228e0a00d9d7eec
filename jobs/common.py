"""What the jobs share: configuration, logging and the session of a command line."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def configured(default: str, text: str | None = None) -> dict:
    """The settings in a job's own file, with those of a text over them; unknown names are errors."""
    known = tomllib.loads(Path(default).with_suffix(".toml").read_text())
    more = tomllib.loads(text) if text else {}
    if unknown := set(more) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | more


def rows_of(df: DataFrame, log: logging.Logger, did: str, path: str) -> int:
    """The number of rows of a table that was read or written, which is logged."""
    n = df.count()
    log.info("%s %d rows: %s", did, n, path)
    return n


@contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """The session with some settings changed, which get their old values back."""
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def command(doc: str, run: Callable[[SparkSession, str, str, dict], dict], default: str, words: list[str] | None = None) -> dict:
    """Runs a job from the command line, in a session of its own."""
    p = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("source", help="table to read")
    p.add_argument("out", help="folder to write below")
    p.add_argument("--config", help="TOML file with settings that differ from the job's own")
    a = p.parse_args(words)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(default).stem).getOrCreate()
    try:
        text = "\n".join(r[0] for r in spark.read.text(a.config, wholetext=True).collect()) if a.config else None
        return run(spark, a.source, a.out, configured(default, text))
    finally:
        spark.stop()
