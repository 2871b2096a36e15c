"""Speech acts, blocks, quotes and boundaries as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleforge.functions.text import EDGE_AFTER, EDGE_BEFORE, LETTER, SPACE

#: Verbs, pronouns and abbreviations that decide a speech act.
SHOUT = "shout|scream|yell|bellow|roar|exclaim|bark|thunder"
WHISPER = "whisper|murmur|hiss|breathe|mutter|mumble"
THOUGHT = "thought|wondered|mused|pondered|reflected|realized|considered"
NOT_SHOUTED = [
    "I", "OK", "USA", "FBI", "CIA", "DNA", "CEO", "PhD", "MRS", "MR", "MS", "DR", "NYC",
    "THE", "AND", "BUT", "FOR", "NOT", "YOU", "ALL", "CAN", "HAD", "HER", "WAS", "ONE", "OUR", "OUT",
]
#: Classes of elements that break a scene.
BREAK_CLASSES = ["break", "separator", "divider"]
CURLY_OPEN, CURLY_CLOSE, SINGLE_OPEN, SINGLE_CLOSE = "“", "”", "‘", "’"
#: Volume in dB and speed of each act; first names of the columns.
DELIVERY = {"spoken": (0.0, 1.0), "whispered": (-4.5, 1.0), "shouted": (4.5, 1.08), "thought": (-3.0, 0.93)}
#: Mean, deviation, least and largest pause in ms at each kind of boundary.
PAUSES = {"paragraph": (450, 75, 300, 600), "speaker_change": (600, 100, 400, 900), "scene": (2200, 300, 1800, 3000), "chapter": (3500, 400, 2800, 4500)}

SCENE_BREAK = rf"^[{SPACE}]*(\*[{SPACE}]*\*[{SPACE}]*\*|[-—]{{3,}}|#{{1,6}})[{SPACE}]*$"


def stem(verbs: str) -> str:
    return f"(?i){EDGE_BEFORE}({verbs})(ed|ing|s)?{EDGE_AFTER}"


def shouted_words(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"({LETTER}+)"), 1)
    return F.filter(runs, lambda w: w.rlike("^[A-Z]{3,}$") & ~w.isin(NOT_SHOUTED))


def speech_act(text: Column, context: Column) -> Column:
    """(act, confidence); the context's verbs come first, then marks and capitals of the text."""
    made = lambda act, sure: F.struct(F.lit(act).alias("act"), F.lit(sure).alias("confidence"))
    return (
        F.when(context.rlike(stem(SHOUT)), made("shouted", 0.9))
        .when(context.rlike(stem(WHISPER)), made("whispered", 0.9))
        .when(context.rlike(f"(?i){EDGE_BEFORE}({THOUGHT}){EDGE_AFTER}"), made("thought", 0.9))
        .when(context.rlike(f"(?i){EDGE_BEFORE}to[{SPACE}]+(her|him|them|it)self{EDGE_AFTER}"), made("thought", 0.9))
        .when(text.rlike("!{2,}") | (F.size(shouted_words(text)) > 0), made("shouted", 0.7))
        .otherwise(made("spoken", 0.5))
    )


def has_quote(text: Column) -> Column:
    """A double or curly quote of any kind."""
    return text.rlike("[\"“”‘’]")


def scene_break(text: Column) -> Column:
    """Only three stars, dashes, or hashes."""
    return text.rlike(SCENE_BREAK)


def break_class(classes: Column) -> Column:
    """An element's class that breaks a scene."""
    return F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, BREAK_CLASSES))), F.lit(False))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def quote_signal(text: Column) -> Column:
    """Whether a block leaves a quotation open; null if it says nothing about it."""
    found = F.lit(None).cast("boolean")
    straight = _count(text, '"')
    found = F.when(straight > 0, straight % 2 == 1).otherwise(found)
    for a, b in ((SINGLE_OPEN, SINGLE_CLOSE), (CURLY_OPEN, CURLY_CLOSE)):
        found = F.when(_count(text, a) + _count(text, b) > 0, _count(text, a) > _count(text, b)).otherwise(found)
    return found


def block_type(tag: Column, text: Column, classes: Column, was_open: Column) -> Column:
    """By tag, CSS class, scene break, quotes, and an open quotation, in this order."""
    return (
        F.when(tag.rlike("^h[1-6]$"), "chapter_heading")
        .when(tag == "hr", "scene_break")
        .when(break_class(classes), "scene_break")
        .when(scene_break(text), "scene_break")
        .when(tag == "blockquote", "dialogue")
        .when(has_quote(text) | was_open, "dialogue")
        .otherwise("narration")
    )


def quote_parts(text: Column) -> Column:
    """A block's alternating parts (type, text); curly quotes decide if there is one, else straight ones."""
    curly = F.regexp_extract_all(text, F.lit("(“[^”]*(?:”|$)|[^“]+)"), 1)
    straight = F.regexp_extract_all(text, F.lit('("[^"]*(?:"|$)|[^"]+)'), 1)
    parts = F.when(text.rlike("[“”]"), curly).otherwise(straight)
    stripped = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, f"^[{SPACE}]+|[{SPACE}]+$", "")), lambda p: p != "")
    mark = F.when(text.rlike("[“”]"), CURLY_OPEN).otherwise('"')
    typed = F.transform(stripped, lambda p: F.struct(F.when(F.left(p, F.lit(1)) == mark, "dialogue").otherwise("narration").alias("type"), p.alias("text")))
    whole = F.array(F.struct(F.lit("dialogue").alias("type"), text.alias("text")))
    return F.when(F.size(typed) <= 1, whole).otherwise(typed)


def boundary(prev_type: Column, prev_speaker: Column, this_type: Column, this_speaker: Column) -> Column:
    """What lies between two segments; null before the first."""
    return (
        F.when(prev_type.isNull(), F.lit(None).cast("string"))
        .when(this_type == "chapter_heading", "chapter")
        .when((this_type == "scene_break") | (prev_type == "scene_break"), "scene")
        .when(~prev_speaker.eqNullSafe(this_speaker), "speaker_change")
        .otherwise("paragraph")
    )


def pause_ms(kind: Column, noise: Column) -> Column:
    """A pause for a boundary from a standard normal number, within the kind's limits, whole ms."""
    pick = lambda i: F.coalesce(*(F.when(kind == k, F.lit(float(v[i]))) for k, v in PAUSES.items()))
    return F.least(F.greatest(pick(0) + pick(1) * noise, pick(2)), pick(3)).cast("int")


def delivery(act: Column) -> Column:
    """Volume and speed of an act; unknown acts are spoken."""
    pick = lambda i: F.coalesce(*(F.when(act == k, F.lit(v[i])) for k, v in DELIVERY.items()), F.lit(DELIVERY["spoken"][i]))
    return F.struct(pick(0).alias("volume_db"), pick(1).alias("speed_factor"))
