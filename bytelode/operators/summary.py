"""Tables of measured runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarize_runs(runs: DataFrame, keys: list[str], baseline: str, method: str = "method", seconds: str = "seconds", raw: str = "raw_bytes", comp: str = "comp_bytes") -> DataFrame:
    """Median (the upper of two) and best time, MB/s, ratio, bytes and speed-up against a baseline method; rank by speed. ``keys`` has one name at least."""
    times = F.sort_array(F.collect_list(seconds))
    out = runs.groupBy(*keys, method).agg(F.count("*").alias("runs"), F.element_at(times, F.floor(F.size(times) / 2).cast("int") + 1).alias("median_s"), F.min(seconds).alias("best_s"), F.first(raw).alias("raw_bytes"), F.avg(comp).alias("mean_bytes"), F.min(comp).alias("min_bytes"), F.max(comp).alias("max_bytes"))
    out = out.withColumn("mb_s", F.col("raw_bytes") / F.col("median_s") / 1e6).withColumn("ratio", F.col("raw_bytes") / F.col("mean_bytes"))
    base = out.where(F.col(method) == baseline).select(*keys, F.col("mb_s").alias("__base"))
    joined = out.join(base, keys, "left")
    return joined.withColumn("speedup", F.col("mb_s") / F.col("__base")).drop("__base").withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("mb_s"))))


def split_members(blobs: DataFrame, n: int, content: str = "content") -> DataFrame:
    """Each blob in n members of equal size, the last with the rest."""
    size = F.octet_length(content)
    step = F.floor(size / n).cast("int")
    rows = blobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ordinal"))
    length = F.when(F.col("ordinal") == n - 1, size - step * (n - 1)).otherwise(step)
    return rows.withColumn("data", F.col(content).substr(F.col("ordinal") * step + 1, length)).drop(content)
