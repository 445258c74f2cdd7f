"""What the training-data operators share: tables, settings of a session, small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python; texts are of any length, so batches are short.
BATCH_ROWS = "500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(df: DataFrame) -> DataFrame:
    """df; what goes to Python from now on goes BATCH_ROWS rows at a time, which bounds both sides of the exchange."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


#: Stands for a missing id inside the operators, after every id.
NO_ID = (1 << 63) - 1


def ids(column: str = "doc_id") -> Column:
    """The id as a long that is never null, for Python and for comparisons."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def with_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Missing ids as nulls again."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in columns})


def whole(text: str | Column = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
