"""Reading, caching and writing tables (inventory A)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import assert_unique
from tallyloom.ordered import row_index

BOARD_SCHEMA = T.StructType(
    [
        T.StructField("Rank", T.IntegerType()),
        T.StructField("PublicScore", T.DoubleType()),
        T.StructField("PrivateScore", T.DoubleType()),
    ]
)


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a parquet or a headered CSV file; CSV needs a schema so that no inference pass runs."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError("CSV sources need an explicit schema")
    return spark.read.schema(schema).csv(path, header=True)


def load_keyed(spark: SparkSession, path: str, key: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Scan with a declared key; raises when the key repeats."""
    df = load(spark, path, schema)
    assert_unique(df, key)
    return df


def load_cols(spark: SparkSession, path: str, cols: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Scan only the named columns (the projection reaches the file reader)."""
    return load(spark, path, schema).select(*cols)


def head_n(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by key, the small "toy" variant of a table (top-n, no full sort)."""
    return df.orderBy(*key).limit(n)


def slice_sample(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group, so that each group is present in the sample.

    Rows are numbered chunk by chunk, so one large group is never sorted in one task.
    """
    return row_index(df, group, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def load_dates(spark: SparkSession, path: str, cols: Sequence[str], fmt: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan and parse the named text columns as timestamps; unreadable text becomes null."""
    df = load(spark, path, schema)
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)) for c in cols})


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its success marker, asked of the folder's own file system."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cache_features(df: DataFrame, directory: str, version: str, overwrite: bool = False) -> DataFrame:
    """Compute once and reuse; a half-written folder has no success marker and is written again."""
    spark, path = df.sparkSession, f"{directory}/{version}"
    if overwrite or not _is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage_blocks(blocks: dict[str, DataFrame], key: Sequence[str], directory: str) -> DataFrame:
    """Write each feature block as its own file set, then join the blocks on the key.

    Staging cuts the plan between blocks, so each block's work is done exactly once.
    """
    staged = [cache_features(block, directory, name) for name, block in blocks.items()]
    out = staged[0]
    for block in staged[1:]:
        out = out.join(block, list(key), "inner")
    return out


def write_predictions(df: DataFrame, path: str) -> None:
    """Write predictions as headered CSV, one file per partition."""
    df.write.mode("overwrite").csv(path, header=True)


def load_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """A leaderboard file with rank, public and private score."""
    return spark.read.schema(BOARD_SCHEMA).csv(path, header=True)
