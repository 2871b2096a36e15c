"""Operators that match characters to voices: agreement, candidates, similarity, uniqueness, clips."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taleforge.functions.text import AGE_KEYWORDS, gender_of
from taleforge.functions.vectors import cosine

#: Syllables a second of each pace.
PACE_RATE = {"fast": 5.5, "rapid": 6.0, "clipped": 5.5, "moderate": 4.0, "measured": 3.5, "slow": 2.5, "deliberate": 3.0, "languid": 2.0}
#: Asks that are broadcast at most, and parts that offers are dealt in beyond.
ASKS, PARTS = 20_000, 64
TARGET_S, LEAST_S, MOST_S, LEAST_BYTES, BYTES_PER_S = 12.5, 5.0, 25.0, 120_000, 48_000


def speaker_index(annotations: DataFrame) -> DataFrame:
    """(speaker, traits) rows of all annotators to one row a speaker: sorted traits, gender, and how often each was given."""
    counts = annotations.select("speaker", F.explode("traits").alias("trait")).groupBy("speaker", "trait").agg(F.count("*").cast("int").alias("n"))
    out = counts.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("trait", "n"))).alias("_a"))
    out = out.select("speaker", F.transform("_a", lambda x: x["trait"]).alias("traits"), F.map_from_entries("_a").alias("agreement"))
    return out.withColumns({"trait_text": F.array_join("traits", ", "), "gender": gender_of("traits")})


def dialogue_counts(segments: DataFrame, *, speaker: str = "speaker") -> DataFrame:
    """A1: lines of each speaker, without the narrator, unknown and empty ones."""
    some = segments.where((F.col("type") == "dialogue") & ~F.col(speaker).isin("", "narrator", "unknown"))
    return some.groupBy(speaker).agg(F.count("*").alias("n_dialogue"))


def cast_classes(characters: DataFrame, counts: DataFrame, *, threshold: int = 5, large: int = 20) -> DataFrame:
    """Each character's lines and whether it is major; a large cast raises the threshold to a twentieth of all lines."""
    limit = characters.agg(F.count("*").alias("c")).join(counts.agg(F.coalesce(F.sum("n_dialogue"), F.lit(0)).alias("t")), F.lit(True))
    limit = limit.select(F.when(F.col("c") > large, F.greatest(F.lit(threshold), F.floor(F.col("t") / 20))).otherwise(F.lit(threshold)).alias("threshold"))
    out = characters.join(counts.withColumnRenamed("speaker", "name"), "name", "left").withColumn("n_dialogue", F.coalesce("n_dialogue", F.lit(0)))
    return out.join(F.broadcast(limit), F.lit(True)).withColumn("is_major", F.col("n_dialogue") >= F.col("threshold"))


def candidates(characters: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each character's speakers by gender, then by age; a filter that leaves none is dropped.

    characters (name, gender, age_range) are few kinds: pairs are made for the distinct kinds of gender and age only.
    """
    kinds = characters.select("gender", "age_range").distinct()
    ages = F.create_map(*(x for k, v in AGE_KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    kinds = kinds.withColumn("_k", F.coalesce(F.try_element_at(ages, F.col("age_range")), F.array().cast("array<string>")))
    pool = speakers.select("speaker", "traits", F.col("gender").alias("_g"))
    rows = pool.withColumn("_one", F.lit(1)).join(F.broadcast(kinds.withColumn("_one", F.lit(1))), "_one")
    wants = F.lower("gender").isin("male", "female")
    rows = rows.withColumn("_fit", ~wants | (F.col("_g") == F.lower("gender")))
    kind = W.partitionBy("gender", "age_range")
    rows = rows.withColumn("_any", F.max("_fit").over(kind)).where(F.col("_fit") | ~F.col("_any"))
    rows = rows.withColumn("_old", F.exists("traits", lambda t: F.exists("_k", lambda k: t.contains(k))))
    rows = rows.withColumn("_any", F.max("_old").over(kind)).where(F.col("_old") | ~F.col("_any"))
    return rows.select("gender", "age_range", "speaker")


def best_matches(asks: DataFrame, offers: DataFrame, *, k: int, taken: DataFrame | None = None, weak: float = 0.5) -> DataFrame:
    """Each ask's k most similar offers, without those taken; weak matches are marked.

    asks (name, vector) are a stated set: up to ASKS are broadcast, more meet the offers in blocks that are dealt in parts.
    An ask with a column ``own`` is never offered that speaker; the top k are kept before the shuffle.
    """
    pool = offers if taken is None else offers.join(taken.select("speaker").distinct(), "speaker", "left_anti")
    own = F.col("own") if "own" in asks.columns else F.lit(None)
    few = asks.select("name", F.col("vector").alias("_v"), own.alias("_own"), F.lit(1).alias("_one"))
    n = few.count()
    if n <= ASKS:
        met = pool.withColumn("_one", F.lit(1)).join(F.broadcast(few), "_one")
    else:
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        blocks = -(-n // ASKS)
        many = few.withColumn("_block", deal("name", blocks)).withColumn("_part", each(PARTS))
        met = pool.withColumn("_part", deal("speaker", PARTS)).withColumn("_block", each(blocks)).join(many, ["_block", "_part"])
    pairs = met.where("_own is null or _own <> speaker").select("name", "speaker", cosine(F.col("_v"), F.col("vector")).alias("score"))
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "speaker"))
    out = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.withColumn("warning", F.when(F.col("score") < weak, "weak match"))


def assigned_voices(segments: DataFrame, voices: DataFrame, default: DataFrame, columns: list[str]) -> DataFrame:
    """Segments with their speaker's voice, or the narrator's where there is none."""
    out = segments.join(F.broadcast(voices) if voices.count() <= 100_000 else voices, "speaker", "left")
    one = default.limit(1).select(*(F.col(c).alias(f"_{c}") for c in columns))
    return out.join(F.broadcast(one), F.lit(True), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def duplicate_speakers(assignments: DataFrame) -> DataFrame:
    """Of the characters on one speaker the surest keeps it (ties: the earlier one)."""
    w = W.partitionBy("speaker").orderBy(F.desc("confidence"), "pos")
    return assignments.withColumn("rank", F.row_number().over(w)).withColumn("keeps", F.col("rank") == 1)


def cooccurring(segments: DataFrame, *, key: str = "chapter") -> DataFrame:
    """Alphabetical pairs of speakers with dialogue in one chapter."""
    said = segments.where((F.col("type") == "dialogue") & ~F.col("speaker").isin("", "narrator", "unknown")).select(key, "speaker").distinct()
    a, b = said.toDF(key, "a"), said.toDF(key, "b")
    return a.join(b, key).where("a < b").select("a", "b").distinct()


def minor_conflicts(assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """U8: characters that share a voice and a chapter; the less sure of the two has to move (ties: the later one)."""
    x, y = assignments.alias("x"), assignments.alias("y")
    shared = x.join(y, (F.col("x.speaker") == F.col("y.speaker")) & (F.col("x.pos") < F.col("y.pos"))).select(F.col("x.speaker").alias("speaker"), F.col("x.name").alias("p"), F.col("y.name").alias("q"), F.when(F.col("y.confidence") <= F.col("x.confidence"), F.col("y.name")).otherwise(F.col("x.name")).alias("mover"))
    met = pairs.toDF("lo", "hi")
    return shared.withColumns({"lo": F.least("p", "q"), "hi": F.greatest("p", "q")}).join(met, ["lo", "hi"], "left_semi").select("speaker", "p", "q", "mover")


def enforce_uniqueness(assignments: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """Majors get voices of their own, minors that meet in a chapter too; one cast at a time.

    assignments: book, pos, name, speaker, confidence, is_major; pool: book, name, ord, speaker; pairs: book, a, b.
    A cast has tens of rows, and each step takes voices away from the next: one bounded group a book.
    """
    whole = assignments.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "speaker", "confidence", "is_major"))).alias("cast"))
    offers = pool.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("name", "ord", "speaker"))).alias("pool"))
    met = pairs.groupBy("book").agg(F.collect_set(F.struct("a", "b")).alias("met"))
    rows = whole.join(offers, "book", "left").join(met, "book", "left")

    def solve(batches):
        for frame in batches:
            out = []
            for book, cast, offers, met in zip(frame["book"], frame["cast"], frame["pool"], frame["met"], strict=True):
                out += _solved(book, cast, offers if offers is not None else [], met if met is not None else [])
            yield pd.DataFrame(out, columns=["book", "pos", "name", "speaker", "confidence", "moved", "warning"])

    kinds = {f.name: f.dataType.simpleString() for f in assignments.schema.fields}
    return rows.mapInPandas(solve, f"book {kinds['book']}, pos int, name string, speaker string, confidence double, moved boolean, warning string")


def _solved(book, cast, offers, met) -> list[tuple]:
    now = {r["name"]: [r["pos"], r["speaker"], r["confidence"], False, None] for r in cast}
    taken = {r["speaker"] for r in cast}
    wishes: dict[str, list[str]] = {}
    for r in offers:
        wishes.setdefault(r["name"], []).append(r["speaker"])

    def move(name: str, reason: str, stuck: str | None) -> None:
        free = next((s for s in wishes.get(name, []) if s not in taken), None)
        if free is not None:
            taken.add(free)
            now[name][1:] = [free, 0.3, True, now[name][4] or reason]
        elif stuck:
            now[name][4] = stuck

    def shared(major: bool) -> list[list]:
        groups: dict[str, list] = {}
        for r in cast:
            if bool(r["is_major"]) == major:
                groups.setdefault(r["speaker"], []).append(r)
        return [g for g in groups.values() if len(g) > 1]

    for group in shared(True):
        for r in sorted(group, key=lambda r: -r["confidence"])[1:]:
            move(r["name"], "Reassigned for uniqueness", "Shares speaker with another major character — no alternative available")
    meet = {(r["a"], r["b"]) for r in met}
    for group in shared(False):
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if tuple(sorted((a["name"], b["name"]))) in meet:
                    move((b if b["confidence"] <= a["confidence"] else a)["name"], "Reassigned for co-occurrence", None)
    return [(book, v[0], k, *v[1:]) for k, v in now.items()]


def _first(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each group in an order; partial results are merged, no group is sorted."""
    return rows.groupBy(by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def best_clip(clips: DataFrame, *, order: list[str], low: float = LEAST_S, high: float = MOST_S) -> DataFrame:
    """Each speaker's clip nearest the target length; without one in range the first of all."""
    good = F.col("duration").between(low, high)
    score = F.when(good, 1.0 / (1.0 + F.abs(F.col("duration") - TARGET_S))).otherwise(0.0)
    return _first(clips.withColumns({"in_range": good, "score": score}), "speaker", [~F.coalesce("in_range", F.lit(False)), -F.col("score"), *map(F.col, order)])


def target_rate(pace_style: Column, pace: Column) -> Column:
    """Syllables a second by the pace's style, or else by the pace; null if neither is known."""
    rates = F.create_map(*(x for k, v in PACE_RATE.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(rates, pace_style), F.try_element_at(rates, pace))


def reference_clips(clips: DataFrame, *, size: str = "bytes", expressiveness: str = "expr", path: str = "path") -> DataFrame:
    """Each speaker's clip by expressiveness and length among those in range, else its largest.

    Scores that are equal to nine digits are ties, which go to the smaller path.
    """
    d = F.col(size) / F.lit(float(BYTES_PER_S))
    rows = clips.withColumn("duration", d)
    good = (F.col(size) >= LEAST_BYTES) & F.col("duration").between(LEAST_S, MOST_S)
    score = 0.8 * F.col(expressiveness) + 0.2 / (1.0 + F.abs(F.col("duration") - TARGET_S))
    rows = rows.withColumns({"in_range": good, "score": F.when(good, score)})
    rank = F.when(F.col("in_range"), F.round("score", 9)).otherwise(F.coalesce(F.col(size).cast("double"), F.lit(-1.0)))
    out = _first(rows, "speaker", [~F.coalesce("in_range", F.lit(False)), -rank, F.col(path)])
    return out.select("speaker", path, "duration", "in_range", "score")


def voice_check(checks: DataFrame, *, threshold: float = 0.6, by: list[str] | None = None) -> DataFrame:
    """Counts of a consistency run; a similarity of exactly 1 was skipped."""
    done = F.col("similarity") != 1.0
    good = F.col("similarity") >= threshold
    counts = [F.count_if(done).alias("checked"), F.count_if(done & good).alias("passed"), F.count_if(done & ~good).alias("flagged"), F.count_if(~done).alias("skipped")]
    return checks.groupBy(*(by or [])).agg(*counts)
