"""Global shuffle and sharding in two passes.

Pass one scatters the records over buckets that fit into a task's memory, by a seeded hash of the row's number, so
neither a hot key nor repeated rows fill a bucket.  Pass two puts each bucket into a fixed order, shuffles it by
Fisher and Yates with a generator seeded by the bucket, and writes it.  The buckets in turn are the shuffled table;
the shards are even ranges of it, so their counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import work_dir
from tallyloom.llm.common import row_numbers, store

SEED = 20240229
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: list[int]) -> list[int]:
    """A uniform permutation of ``range(n)``."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []
    for i, j in zip(range(n - 1, 0, -1), draws):
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, path: str, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows of ``docs`` (a stored table) in shuffled order below ``path``: ``bucket``, ``pos`` in it, and the row as ``row``."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_numbers(docs).alias("number"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(buckets)))

    def shuffle(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        table = table.take(pa.array(fisher_yates(table.num_rows, [seed, table.column("bucket")[0].as_py()]), pa.int64()))
        return pa.table({"bucket": table.column("bucket"), "pos": pa.array(np.arange(table.num_rows)), "row": table.column("row")})

    schema = docs.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("pos"), F.struct(*docs.columns).alias("row")).schema
    shuffled = rows.groupBy("bucket").applyInArrow(shuffle, schema)
    shuffled.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def shards(shuffled: DataFrame, n_shards: int = 8) -> DataFrame:
    """The shuffled rows with their ``shard`` and gapless ``slot`` in it.

    The manifest has one row per bucket of some megabytes; the buckets' first positions are its running sums.
    """
    manifest = shuffled.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    manifest = store(manifest, "manifest")  # its size is known then, and decides how it is joined to the records
    at = F.col("first") + F.col("pos")
    out = shuffled.join(manifest, "bucket").withColumns({"place": at, "shard": F.expr(f"int(((first + pos) * {n_shards}) div total)")})
    start = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return out.select("row", "shard", (F.col("place") - start).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document row: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null).

    The records themselves are written, shuffled, below ``path`` (by default the shared folder).  Null text has size one
    and the checksum of an empty text; repeated rows are records of their own; an empty table gives an empty
    result.  Other columns travel with their record, whatever their names.
    """
    out = shards(external_shuffle(docs, path or work_dir(docs.sparkSession, "shards"), text_col), n_shards)
    text = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    return out.select(
        F.col("row")[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
