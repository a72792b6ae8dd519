"""A session with the settings that the library's results rely on."""

from pyspark.sql import SparkSession


def session(name: str = "palimpsest", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; ``conf`` (with dots as __) adds to or overrides them."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
