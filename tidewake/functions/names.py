"""Names of helper columns that clash with none of a table's own."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as no column of df has (letter case plays no part)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def guarded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator of a table (its first argument) whose helper columns begin with an underscore: the table's own columns that do,
    and are not named by an argument, are put aside meanwhile, so that none is taken for a helper or dropped with them."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        named = {x for a in (*args, *options.values()) for x in (a if isinstance(a, (list, tuple)) else [a]) if isinstance(x, str)}
        aside = {c: f"own {i} {c}" for i, c in enumerate(df.columns) if c.startswith("_") and c not in named}
        out = operator(df.withColumnsRenamed(aside) if aside else df, *args, **options)
        return out.withColumnsRenamed({v: k for k, v in aside.items() if v in out.columns}) if aside else out

    return run
