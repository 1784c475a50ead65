"""Models and staged tables that several queries of one session share, built on first use."""

from collections.abc import Callable

from pyspark.sql import SparkSession

_built: dict[tuple, object] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """The result of `build` for this application, folder and name; later calls reuse it."""
    slot = (spark.sparkContext.applicationId, folder, name)
    if slot not in _built:
        _built[slot] = build()
    return _built[slot]


def forget() -> None:
    """Drops all results, as before their staged tables are removed or once the input tables are written anew."""
    _built.clear()
