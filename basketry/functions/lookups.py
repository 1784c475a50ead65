"""Joining a large table to a smaller one."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from basketry.session import staged


def lookup(facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Joins `table` (one row per key) to `facts`.

    The table is written first, so Catalyst knows its bytes and broadcasts it only under the session's
    threshold. Beyond that adaptive execution splits the facts of a hot key over several tasks.
    """
    return facts.join(staged(table, "lookup"), list(on), how)
