"""Voice references: a clip, its transcript and its quality for every character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleforge.functions.signal import duration_udf, reference_snr_udf
from taleforge.sources.readers import with_transcripts

#: Fixed value: clips under so many decibels are marked as noisy.
NOISY_DB = 15


def voice_references(voices: DataFrame, clips: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(name, path, transcript, duration_s, snr_score, noisy) of each voice (name, path).

    clips has path and content, transcripts path and transcript. Each clip is measured once, however many voices share
    it. A clip that is missing has no level and lasts 0 seconds; one that is broken lasts as long as its size says.
    """
    used = clips.join(voices.select("path").distinct(), "path", "left_semi")
    measured = used.select("path", duration_udf()("content").alias("duration_s"), reference_snr_udf()("content").alias("snr_score"))
    out = with_transcripts(voices.join(measured, "path", "left"), transcripts)
    return out.select("name", "path", "transcript", F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), "snr_score", F.coalesce(F.col("snr_score") < NOISY_DB, F.lit(False)).alias("noisy"))
