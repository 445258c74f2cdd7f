"""The repository that a directory belongs to, on the host whose logs are read."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import written

#: Parents that are looked at, a limit of the accounting.
MOST_PARENTS = 64


def root_of(folder: str) -> str:
    """The nearest folder upwards that holds .git (a folder, or the file of a worktree); the folder itself without one, or if it is gone."""
    path = Path(folder)
    if not path.is_dir():
        return folder
    for at in [path, *path.parents][:MOST_PARENTS]:
        if (at / ".git").exists():
            return str(at).replace("\\", "/")
    return folder


def with_roots(rows: DataFrame, column: str = "cwd", into: str = "root") -> DataFrame:
    """rows and the root of each directory; every directory is looked up once. Null and nothing have none."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({column: batch[column], into: [root_of(x) for x in batch[column]]})

    folders = rows.select(F.col(column).cast("string").alias(column)).where(F.coalesce(column, F.lit("")) != "").distinct()
    # Written, so that Spark knows its size: rows without a directory have one key, and would be dealt to one task.
    roots = written(folders.mapInPandas(look_up, f"{column} string, {into} string"), "roots")
    return rows.join(roots, column, "left")
