"""Operators of resumable work: caches, pending rows, running estimates, guards, retries, states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taleforge.functions.text import cache_key


def pending(ids: DataFrame, done: DataFrame, *, key: str = "id") -> DataFrame:
    """Rows not completed yet; failed ones are pending again."""
    return ids.join(done.where("status = 'completed'").select(key).distinct(), key, "left_anti")


def requeued(state: DataFrame, files: DataFrame, *, least_bytes: int = 1) -> DataFrame:
    """Completed rows whose file is missing or empty go back to pending."""
    there = files.where(F.col("length") >= least_bytes).select(F.col("path").alias("wav"), F.lit(True).alias("_there")).distinct()
    lost = (F.col("status") == "completed") & F.col("_there").isNull()
    return state.join(there, "wav", "left").withColumn("status", F.when(lost, "pending").otherwise(F.col("status"))).drop("_there")


def cached(rows: DataFrame, cache: DataFrame, stage: str, content: str) -> DataFrame:
    """Rows with the stored value of their content, or null where it has to be made."""
    keyed = rows.withColumn("cache_key", cache_key(stage, content))
    return keyed.join(cache.select(F.col("key").alias("cache_key"), "value"), "cache_key", "left")


def rolling_eta(results: DataFrame, *, total: Column, order: str = "id", last: int = 20, by: list[str] | None = None) -> DataFrame:
    """Mean time of the last successes times what is left, after each success."""
    w = W.partitionBy(*(by or [])).orderBy(order)
    good = results.where("status = 'completed'")
    out = good.withColumns({"mean_s": F.avg("took_s").over(w.rowsBetween(1 - last, 0)), "done": F.row_number().over(w)})
    return out.withColumn("eta_s", F.col("mean_s") * (total - F.col("done")))


def failure_guard(results: DataFrame, *, order: str = "id", by: list[str] | None = None, least: int = 20, share: float = 0.15) -> DataFrame:
    """Running counts, and whether the run stops at this row."""
    w = W.partitionBy(*(by or [])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    failed = F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).over(w)
    out = results.withColumns({"processed": F.count("*").over(w), "failed": failed})
    return out.withColumn("stop", (F.col("processed") >= least) & (F.col("failed") / F.col("processed") > share))


def retried(attempts: DataFrame, *, most: int = 3, key: str = "id") -> DataFrame:
    """The final state of each row from its attempts (id, attempt, ok): completed at the first success among the allowed ones."""
    some = attempts.where(F.col("attempt") <= most)
    return some.groupBy(key).agg(F.count("*").alias("attempts"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("succeeded_at")).withColumn("status", F.when(F.col("succeeded_at").isNull(), "failed").otherwise("completed"))


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's rows from its path if they were written there as a whole, else made, written and read back."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def compatible(state: DataFrame, engine: str) -> DataFrame:
    """Whether a state was made by the engine in force; otherwise it is archived."""
    return state.withColumn("action", F.when(F.col("engine") == engine, "resume").otherwise("archive"))


def upserted(state: DataFrame, news: DataFrame, *, key: str = "id", order: str = "seq") -> DataFrame:
    """The newest row of each key of an old state and a batch of news."""
    both = state.unionByName(news)
    newest = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), order).alias("_r"))
    return newest.select(key, "_r.*")


def log_lines(rows: DataFrame, *, at: str, level: str, message: Column) -> DataFrame:
    """S21, F18: 'time | LEVEL | message' in UTC."""
    return rows.select(F.concat_ws(" | ", F.date_format(F.col(at).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.upper(level), message).alias("line"))


def speaker_batches(segments: DataFrame) -> DataFrame:
    """A5: the order of work with a speaker's rows together, large batches first, then by first row."""
    w = W.partitionBy("speaker")
    rows = segments.withColumns({"batch": F.count("*").over(w), "first_id": F.min("id").over(w)})
    return rows.select("speaker", "id", "batch", "first_id")
