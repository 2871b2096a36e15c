"""The relational envelope of external models: batching, caching, retries, validation, defaults. Models are pluggable."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleforge.functions.text import cache_key

Client = Callable[[str], str]
ATTEMPTS = 3


def stub(prompt: str) -> str:
    """A deterministic stand-in for a model: JSON made from the prompt's checksum."""
    n = zlib.crc32(prompt.encode())
    return json.dumps({"answer": ["merge", "keep_separate", "uncertain"][n % 3], "confidence": round(n % 101 / 100, 2)})


def structured(prompt: str, client: Client, required: tuple[str, ...], attempts: int = ATTEMPTS) -> tuple[str | None, int]:
    """A model's valid JSON object and the calls it took; none after the last attempt. Fences are stripped, bare arrays wrapped."""
    for k in range(1, attempts + 1):
        try:
            said = client(prompt).strip()
            if said.startswith("```"):
                said = said.split("\n", 1)[-1].rsplit("```", 1)[0]
            found = json.loads(said)
            if isinstance(found, list):
                found = {required[0]: found}
            if isinstance(found, dict) and all(r in found for r in required):
                return json.dumps(found, sort_keys=True), k
        except (ValueError, RuntimeError):
            pass
    return None, attempts


def called(rows: DataFrame, *, key: str, prompt: str, stage: str, required: tuple[str, ...], client: Client = stub, cache: DataFrame | None = None) -> DataFrame:
    """(key, cache_key, response, calls) of each row; answers at hand cost no call, equal prompts are asked once, failures are null and not cached."""
    asked = rows.select(key, F.col(prompt).alias("_p")).withColumn("cache_key", cache_key(stage, "_p"))
    new = asked.select("cache_key", "_p").groupBy("cache_key").agg(F.first("_p").alias("_p"))
    held = None
    if cache is not None:
        held = cache.select(F.col("key").alias("cache_key"), F.col("value").alias("response"), F.lit(0).alias("calls"))
        new = new.join(held, "cache_key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [structured(p, client, required) for p in frame["_p"]]
            yield pd.DataFrame({"cache_key": frame["cache_key"], "response": [m[0] for m in made], "calls": [m[1] for m in made]})

    answers = new.mapInPandas(run, "cache_key string, response string, calls int")
    answers = answers if held is None else answers.unionByName(held)
    return asked.join(answers, "cache_key", "left").select(key, "cache_key", "response", "calls")


def chosen(rows: DataFrame, *, key: str, prompt: str, ids: str, client: Callable[[str, int], str | None], attempts: int = ATTEMPTS) -> DataFrame:
    """(key, choice, calls): a model's answer if it is one of the row's valid ids (an array), asked again up to attempts times; else null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for said, valid in zip(frame["_p"], frame["_ids"], strict=True):
                answers = ((client(said, n), n) for n in range(1, attempts + 1))
                out.append(next(((a, n) for a, n in answers if a is not None and a in valid), (None, attempts)))
            yield pd.DataFrame({"_k": frame["_k"], "choice": [c for c, _ in out], "calls": [n for _, n in out]})

    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("_k"), F.col(prompt).alias("_p"), F.coalesce(ids, F.array().cast("array<string>")).alias("_ids"))
    return asked.mapInPandas(run, f"_k {kind}, choice string, calls int").withColumnRenamed("_k", key)


def model_for(memory_gb: float, override: str | None = None) -> str:
    """The larger local model from 16 GB on."""
    return override or ("large" if memory_gb >= 16 else "small")


def workers_for(model: str) -> int:
    """32 calls at once for a remote command, one for a local model."""
    return 32 if model.startswith("remote") else 1


class SpeechEngine:
    """What a speech engine offers; this one gives silence in proportion to the text. A subclass calls a real one."""

    name, version, rate = "silence", "1", 24_000

    def __init__(self) -> None:
        self.references: dict[str, str] = {}

    def generate(self, text: str, reference: str, character: str | None = None) -> tuple[int, int]:
        """(samples, rate) of a text; a character's reference is prepared once."""
        self.references.setdefault(character or reference, reference)
        return int(len(text) / 15 * self.rate), self.rate


def synthesized(segments: DataFrame, engine: Callable[[], SpeechEngine] = SpeechEngine, attempts: int = 2) -> DataFrame:
    """(id, status, duration_s, attempts) of each segment (id, text, clip, speaker), one engine a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for frame in frames:
            out = []
            for i, text, clip, speaker in zip(frame["id"], frame["text"], frame["clip"], frame["speaker"], strict=True):
                status, seconds, n = "failed", 0.0, 0
                while status == "failed" and n < attempts:
                    n += 1
                    try:
                        made, rate = own.generate(text, clip, speaker)
                        status, seconds = "completed", made / rate
                    except RuntimeError:
                        continue
                out.append((i, status, seconds, n))
            yield pd.DataFrame(out, columns=["id", "status", "duration_s", "attempts"])

    return segments.select("id", "text", "clip", "speaker").mapInPandas(run, "id bigint, status string, duration_s double, attempts int")
