"""A session with the settings that the results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "nimbora", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; anything else by ``conf`` (dots as __)."""
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return build.config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
