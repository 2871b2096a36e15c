"""Operators that lay results out in time and on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def chapter_offsets(chapters: DataFrame, *, book: str, order: str = "chapter", duration: str = "duration") -> DataFrame:
    """Start and end of each chapter in its book."""
    w = W.partitionBy(book).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(duration).over(w)
    return chapters.withColumn("end_at", end).withColumn("start_at", F.col("end_at") - F.col(duration))


def markers(chapters: DataFrame, *, book: str, order: str = "chapter") -> DataFrame:
    """Chapter marks with ids chp000 on and times in whole milliseconds."""
    n = F.row_number().over(W.partitionBy(book).orderBy(order))
    return chapters.select(book, order, F.format_string("chp%03d", n - 1).alias("mark"), F.floor(F.col("start_at") * 1000).cast("bigint").alias("start_ms"), F.floor(F.col("end_at") * 1000).cast("bigint").alias("end_ms"))


def wav_path(chapter: Column, segment: Column) -> Column:
    """S17."""
    return F.format_string("wavs/ch%02d/seg_%04d.wav", chapter.cast("int"), segment.cast("int"))


def announcement(number: Column, title: Column) -> Column:
    """What is read out at a chapter's start."""
    name = F.format_string("Chapter %d", number.cast("int"))
    return F.when(F.coalesce(F.length(F.trim(title)), F.lit(0)) > 0, F.concat(name, F.lit(": "), title)).otherwise(name)


def chapter_duration(pieces: DataFrame, *, key: str = "chapter", lead_ms: int = 800, tail_ms: int = 100) -> DataFrame:
    """Length of a chapter in ms: its announcement and the silence after it, segments, gaps and the tail."""
    return pieces.groupBy(key).agg((F.sum("duration_ms") + F.sum(F.coalesce("gap_ms", F.lit(0))) + F.coalesce(F.max("announcement_ms") + lead_ms, F.lit(0)) + tail_ms).alias("chapter_ms"))


def fade_ms(duration_ms: Column, fade: int = 8) -> Column:
    """An edge fade, at most half of the segment."""
    return F.least(F.lit(fade), F.floor(duration_ms / 2).cast("int"))


def mastering_flags(before_peak: Column, after_peak: Column, before_lufs: Column, after_lufs: Column) -> Column:
    """Whether mastering made the peak more than 1 dB louder or the loudness more than 6 LUFS quieter."""
    return F.array_join(F.filter(F.array(F.when(after_peak - before_peak > 1.0, F.lit("peak")), F.when(before_lufs - after_lufs > 6.0, F.lit("loudness"))), lambda x: x.isNotNull()), ",")


def normalising_gain(lufs: Column, duration_ms: Column, target: float = -19.0) -> Column:
    """Gain in dB to the target loudness; none for silence or under 400 ms."""
    silent = lufs.isNull() | (lufs == float("-inf"))
    return F.when(silent | (duration_ms < 400), 0.0).otherwise(target - lufs)


def dry_run(segments: DataFrame) -> DataFrame:
    """Chapters, segments, seconds of audio and of work, and bytes that a run would take."""
    out = segments.agg(F.count_distinct("chapter").alias("chapters"), F.count("*").alias("segments"))
    return out.withColumns({"audio_s": F.col("segments") * 3.0, "work_s": F.col("segments") * 4.5, "disk_bytes": F.col("segments") * 144000})
