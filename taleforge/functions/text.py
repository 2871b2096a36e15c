"""Column functions over text. Python's word characters and white space are spelled out as Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() and split() see it, and a word's letters.
SPACE = r"\s\x1c-\x1f\x85\xa0  -     　"
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LETTER = r"[\p{L}\p{N}_]"
EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"

#: Titles, and keywords of ages and tones.
TITLES = ["mr", "mrs", "miss", "ms", "dr", "sir", "lady", "lord", "captain", "colonel"]
AGE_KEYWORDS = {
    "child": ["young", "childish"],
    "young adult": ["young", "adult-like"],
    "middle-aged": ["adult-like", "middle-aged"],
    "elderly": ["old", "middle-aged"],
}
TONE_KEYWORDS = {
    "dark": ["dark", "shadow", "death", "blood", "fear", "horror", "grim"],
    "light": ["laugh", "smile", "joy", "happy", "bright", "cheerful", "funny"],
    "romantic": ["love", "heart", "passion", "desire", "embrace", "tender"],
}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """without white space at both ends, Unicode white space included."""
    return F.trim(col(x), F.lit(BLANKS))


def name_key(x: Column | str) -> Column:
    return strip(F.lower(col(x)))


def words(x: Column | str) -> Column:
    """Parts between white space; none of a blank string."""
    return F.filter(F.split(col(x), f"[{SPACE}]+"), lambda w: w != "")


def token_estimate(x: Column | str) -> Column:
    """a token is four characters."""
    return F.floor(F.length(col(x)) / 4)


def word_set(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(x)), F.lit(f"({LETTER}+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(shared.cast("double"), (F.size(F.array_union(a, b))).cast("double")))


def contains_name(a: Column | str, b: Column | str, least: int = 3) -> Column:
    """equal, or the shorter (of ``least`` letters or more) inside the longer."""
    x, y = name_key(a), name_key(b)
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | ((F.length(short) >= least) & long.contains(short))


def surname(x: Column | str) -> Column:
    return F.lower(F.try_element_at(words(x), F.lit(-1)))


def given(x: Column | str) -> Column:
    """All but the last word, in lower case."""
    w = words(x)
    return F.lower(F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " "))


def surname_conflict(a: Column | str, b: Column | str) -> Column:
    """two full names with the same last word and different first ones."""
    full = (F.size(words(a)) >= 2) & (F.size(words(b)) >= 2)
    return F.coalesce(full & (surname(a) == surname(b)) & (given(a) != given(b)), F.lit(False))


def _undotted(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\.+$", "")


def title_match(a: Column | str, b: Column | str) -> Column:
    """same surname (a final dot aside), one name led by a title and the other by a first name."""
    x, y = words(a), words(b)
    full = (F.size(x) >= 2) & (F.size(y) >= 2)
    same = _undotted(F.try_element_at(x, F.lit(-1))) == _undotted(F.try_element_at(y, F.lit(-1)))
    titled = [_undotted(F.try_element_at(w, F.lit(1))).isin(TITLES) for w in (x, y)]
    return F.coalesce(full & same & (titled[0] != titled[1]), F.lit(False))


def slug(x: Column | str) -> Column:
    """F8: lower-case ASCII letters, digits and single hyphens; spaces become hyphens."""
    s = F.regexp_replace(F.translate(strip(F.lower(col(x))), " ", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-|-$", "")


def book_slug(stem: Column | str) -> Column:
    """F8 of a file's stem: underscores are spaces; 'book' if nothing is left."""
    s = slug(F.translate(col(stem), "_", " "))
    return F.when(s == "", "book").otherwise(s)


def chapter_slug(title: Column | str, number: Column | str) -> Column:
    """F8 of a chapter: its number in two digits, then the title's slug or 'chapter-N'."""
    s, n = slug(F.coalesce(col(title), F.lit(""))), col(number).cast("int")
    return F.format_string("%02d-%s", n, F.when(s == "", F.format_string("chapter-%d", n)).otherwise(s))


def cache_key(stage: Column | str, content: Column | str) -> Column:
    """content address of a stage's input."""
    return F.sha2(F.concat(stage if isinstance(stage, Column) else F.lit(stage), F.lit(":"), col(content)), 256)


def fence_stripped(x: Column | str) -> Column:
    """the body of a fenced block, or the text itself; white space around it goes."""
    inner = F.regexp_extract(col(x), r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?```\s*$", 1)
    return strip(F.when(inner != "", inner).otherwise(col(x)))


def clock(seconds: Column | str) -> Column:
    """1h 02m 03s, or 2m 03s."""
    s = F.floor(col(seconds)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).otherwise(F.format_string("%dm %02ds", m, r))


def one_decimal(x: Column) -> Column:
    """A double of 0 or more with one decimal, rounded by its exact value and to even in ties, as printf does.

    What the product leaves out of ten times x decides where the product is a tie.
    """
    s = x * 10
    rest = (x * 8 - s) + x * 2  # exact: near terms, and a rounding error is a double
    tenths = F.rint(F.when(s % 1 == 0.5, s + F.signum(rest) / 4).otherwise(s)).cast("bigint")
    return F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10)


def byte_size(n: Column | str) -> Column:
    """in GB, MB or KB with one decimal."""
    x = col(n).cast("double")
    by = lambda gb, mb, kb: F.when(x >= 1073741824, gb).when(x >= 1048576, mb).otherwise(kb)
    return F.concat(F.when(x < 0, "-").otherwise(""), one_decimal(F.abs(x) / by(1073741824, 1048576, 1024)), by(" GB", " MB", " KB"))


def mime_type(path: Column | str) -> Column:
    """of an image by its suffix; JPEG if unknown."""
    p = F.lower(col(path))
    return F.when(p.endswith(".png"), "image/png").when(p.endswith(".gif"), "image/gif").otherwise("image/jpeg")


def known(x: Column | str) -> Column:
    """Null in place of the literal 'unknown'."""
    return F.nullif(col(x), F.lit("unknown"))


def preferred(a: Column | str, b: Column | str, a_first: Column) -> Column:
    """The known one of two values; of two known ones a's where a_first holds."""
    x, y = known(a), known(b)
    return F.coalesce(F.when(a_first, F.coalesce(x, y)).otherwise(F.coalesce(y, x)), F.lit("unknown"))


def keyword_hits(x: Column | str, keywords: list[str]) -> Column:
    """how many of the keywords occur in the text, as substrings."""
    low = F.lower(col(x))
    return sum((F.when(low.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))


def gender_of(traits: Column | str) -> Column:
    """by 'masculine' or 'feminine' in any trait; unknown if both or neither."""
    man = F.exists(col(traits), lambda t: t.contains("masculine"))
    woman = F.exists(col(traits), lambda t: t.contains("feminine"))
    return F.when(man & ~woman, "male").when(woman & ~man, "female").otherwise("unknown")
