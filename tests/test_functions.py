"""Literal cases of the column functions, and restated sequential rules on random input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleforge.functions import signal, speech, splitting, text, vectors


def one(spark, **columns):
    return lambda expr: spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expr.alias("r")).head().r


def table(spark, rows, schema, expr):
    return [r.r for r in spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}").select("i", expr.alias("r")).orderBy("i").collect()]


def test_surname_conflicts(spark):
    rows = [("Mr. Bennet", "Mrs. Bennet", True), ("Mr. Darcy", "Darcy", False), ("Miss Darcy", "Georgiana Darcy", True), ("Mr. Smith", "Mr. Smith", False), ("Mr. Darcy", "Mrs. Bennet", False), ("Darcy", "Bennet", False), ("", " ", False)]
    assert table(spark, [r[:2] for r in rows], "a string, b string", text.surname_conflict("a", "b")) == [r[2] for r in rows]


def test_title_and_substring_rules(spark):
    rows = [("Miss Darcy", "Georgiana Darcy", True), ("Mr. Bennet", "Mrs. Bennet", False), ("Dr Watson.", "John Watson", True), ("Watson", "Dr Watson", False), ("Ann Lee", "Bea Lee", False)]
    assert table(spark, [r[:2] for r in rows], "a string, b string", text.title_match("a", "b")) == [r[2] for r in rows]
    rows = [("Al", "Alfred", False), ("Alf", "alfred ", True), ("Al", " AL", True), ("x", "y", False)]
    assert table(spark, [r[:2] for r in rows], "a string, b string", text.contains_name("a", "b")) == [r[2] for r in rows]


def test_jaccard_of_descriptions(spark):
    rows = [("hello world foo", "hello world bar", 0.5), ("a b", "A  b", 1.0), ("a", "b", 0.0), ("", "x", 0.0), ("é_1", "é_1!", 1.0)]
    assert table(spark, [r[:2] for r in rows], "a string, b string", text.jaccard(text.word_set("a"), text.word_set("b"))) == [r[2] for r in rows]


def test_speech_acts(spark):
    rows = [
        ("Stop right there!", "he shouted,", "shouted", 0.9), ("Get out!", " she yelled at him.", "shouted", 0.9), ("Be quiet", "she whispered,", "whispered", 0.9), ("This", "he thought,", "thought", 0.9),
        ("This is ridiculous", "she said to herself,", "thought", 0.9), ("x", "he muttered to himself.", "whispered", 0.9), ("STOP RIGHT THERE", "", "shouted", 0.7), ("The FBI agent arrived", "", "spoken", 0.5),
        ("Stop!!", "", "shouted", 0.7), ("Hello!", "", "spoken", 0.5), ("No!!", "she whispered,", "whispered", 0.9), ("x", "the dog's bark", "shouted", 0.9), ("x", "she breathed", "spoken", 0.5), ("ÉSTOP", "", "spoken", 0.5),
    ]
    got = table(spark, [r[:2] for r in rows], "t string, c string", speech.speech_act(F.col("t"), F.col("c")))
    assert [(r.act, r.confidence) for r in got] == [r[2:] for r in rows]


def test_block_types(spark):
    rows = [
        ("h2", "Chapter 3", [], True, "chapter_heading"), ("hr", "", [], True, "scene_break"), ("p", "* * *", [], False, "scene_break"), ("p", "***", [], False, "scene_break"), ("p", "---", [], False, "scene_break"), ("p", "———", [], False, "scene_break"),
        ("p", "x", ["divider"], False, "scene_break"), ("blockquote", "Dear John", [], False, "dialogue"), ("p", "The cat's meow echoed.", [], False, "narration"), ("p", "“I have been thinking", [], False, "dialogue"),
        ("p", "The rain continued.", [], True, "dialogue"), ("p", "it’s late", [], False, "dialogue"), ("h6", "x", [], False, "chapter_heading"), ("p", "## a", [], False, "narration"),
    ]
    got = table(spark, [r[:4] for r in rows], "tag string, t string, k array<string>, o boolean", speech.block_type(F.col("tag"), F.col("t"), F.col("k"), F.col("o")))
    assert got == [r[4] for r in rows]


def test_carried_quotes_equal_a_sequential_fold(spark):
    from taleforge.operators.segments import carry_state

    rng = random.Random(8)
    rows = []
    for c in range(40):
        now = False
        for p in range(15):
            t = "".join(rng.choice(['"', "“", "”", "‘", "’", "a", "b", " "]) for _ in range(rng.randrange(6))) or "x"
            tag = rng.choice(["p", "p", "p", "h1", "hr"])
            before = now
            if tag != "p":
                now = False
            elif "“" in t or "”" in t:
                now = t.count("“") > t.count("”")
            elif "‘" in t or "’" in t:
                now = t.count("‘") > t.count("’")
            elif '"' in t:
                now = t.count('"') % 2 == 1
            rows.append((c, p, tag, t, [], before, now))
    df = spark.createDataFrame(rows, "chapter int, pos int, tag string, text string, classes array<string>, b boolean, a boolean")
    assert carry_state(df).where("was_open <> b or open <> a").count() == 0


def test_quote_parts(spark):
    def plain(t):
        curly, inside, now, out = "“" in t or "”" in t, False, "", []
        for ch in t:
            if not inside and ch == ("“" if curly else '"'):
                out.append(("narration", now.strip()))
                now, inside = ch, True
            elif inside and ch == ("”" if curly else '"'):
                out.append(("dialogue", (now + ch).strip()))
                now, inside = "", False
            else:
                now += ch
        out = [p for p in [*out, ("dialogue" if inside else "narration", now.strip())] if p[1]]
        return out if len(out) > 1 else [("dialogue", t)]

    rng = random.Random(3)
    texts = ['"Run!" she screamed.', "no quote", "“a” b “c", " x ", ""] + ["".join(rng.choice('"“”ab .') for _ in range(rng.randrange(12))) for _ in range(400)]
    got = table(spark, [(t,) for t in texts], "t string", speech.quote_parts(F.col("t")))
    assert [[(p.type, p.text) for p in g] for g in got] == [plain(t) for t in texts]


def test_slugs_clocks_and_sizes(spark):
    assert table(spark, [("The Name of the Wind",), ("my_book (2024)",), ("***",)], "t string", text.book_slug("t")) == ["the-name-of-the-wind", "my-book-2024", "book"]
    rows = [("The Journey", 1, "01-the-journey"), ("", 1, "01-chapter-1"), ("Chapter 3: The Quest!", 3, "03-chapter-3-the-quest"), (None, 112, "112-chapter-112"), ("—", 9, "09-chapter-9")]
    assert table(spark, [r[:2] for r in rows], "t string, n int", text.chapter_slug("t", "n")) == [r[2] for r in rows]
    assert table(spark, [(59.9,), (61.0,), (3723.0,)], "s double", text.clock("s")) == ["0m 59s", "1m 01s", "1h 02m 03s"]
    assert table(spark, [(512,), (3 << 20,), (5 << 30,)], "n bigint", text.byte_size("n")) == ["0.5 KB", "3.0 MB", "5.0 GB"]


def test_sizes_round_by_their_exact_value(spark):
    """As printf does: ties go to even, and a double just below or above a tie is none."""
    rng = random.Random(4)
    sizes = [0.25 * 1024, 0.75 * 1024, 446.25 * 1024, 0.35 * 1024, 2.35 * 1024, 806.25 * 1048576, -0.25 * 1024, 1023.95 * 1024, 0.0] + [rng.randrange(1 << 20) / 20 * 1024 for _ in range(200)] + [rng.random() * 2**41 for _ in range(50)]
    plain = lambda x: f"{x / 2**30:.1f} GB" if x >= 2**30 else f"{x / 2**20:.1f} MB" if x >= 2**20 else f"{x / 2**10:.1f} KB"
    assert table(spark, [(x,) for x in sizes], "n double", text.byte_size("n")) == [plain(x) for x in sizes]


def test_fences_traits_and_rounding(spark):
    assert table(spark, [("```json\n{}\n```",), (" {} ",), ("```\n[1]```",)], "t string", text.fence_stripped("t")) == ["{}", "{}", "[1]"]
    rows = [(["very masculine"], "male"), (["feminine", "calm"], "female"), (["masculine", "feminine"], "unknown"), ([], "unknown")]
    assert table(spark, [r[:1] for r in rows], "t array<string>", text.gender_of("t")) == [r[1] for r in rows]
    assert table(spark, [(0.5,), (1.5,), (2.5,)], "x double", vectors.half_even(F.col("x"))) == [0.0, 2.0, 2.0]


def test_cosine(spark):
    rows = [([1.0, 2.0], [2.0, 4.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    got = table(spark, [r[:2] for r in rows], "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")))
    assert got == pytest.approx([r[2] for r in rows])


def test_pauses_stay_within_their_limits(spark):
    got = table(spark, [("scene", 0.0), ("scene", 99.0), ("scene", -99.0), ("paragraph", 0.5)], "k string, z double", speech.pause_ms(F.col("k"), F.col("z")))
    assert got == [2200, 3000, 1800, 487]


def test_long_sentences_are_cut_where_they_can_be():
    words = "word " * 120
    for t in (words.strip(), "a, " * 200, "x" * 900, "short", "a" * 200 + ", " + "b" * 300 + " c"):
        parts = splitting.long_sentence(t)
        assert "".join(parts).replace(" ", "") == t.replace(" ", "")
        if " " in t[:280] and len(max(t.split(), key=len)) < 200:
            assert max(map(len, parts)) <= 280
    assert splitting.long_sentence("x" * 900) == ["x" * 280, "x" * 620]


def test_chapters_are_cut_at_the_best_breaks():
    assert splitting.chapter_chunks("abc", 10) == ["abc"]
    t = "a" * 1500 + "[SCENE_BREAK]" + "b" * 1500
    assert splitting.chapter_chunks(t, 2000) == ["a" * 1500, "[SCENE_BREAK]" + "b" * 1500]
    t = "\n\n".join("p" * 1200 for _ in range(3)) + "\n\nshort"
    assert [len(c) for c in splitting.chapter_chunks(t, 1300)] == [1209, 1200, 1200][::-1] or all(len(c) >= 1000 for c in splitting.chapter_chunks(t, 1300))
    assert all(len(c) <= 1300 for c in splitting.chapter_chunks("\n".join("q" * 600 for _ in range(6)), 1300))


def wav(x, rate=24_000):
    from taleforge.functions.signal import samples

    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if x.ndim == 1 else x.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((x * 32767).astype("<i2").tobytes())
    assert samples(out.getvalue())[1] == rate
    return out.getvalue()


def test_signal_metrics():
    t = np.arange(72_000) / 24_000
    tone = 0.5 * np.sin(2 * np.pi * 440 * t)
    speechlike = (np.sin(2 * np.pi * 200 * t) + np.sin(2 * np.pi * 350 * t)) * 0.3 * (0.5 + 0.5 * np.sin(2 * np.pi * 4 * t))
    a, b = signal.clip_metrics(wav(tone)), signal.clip_metrics(wav(speechlike))
    assert a["duration_s"] == pytest.approx(3.0) and a["snr_db"] > 10 and a["energy_variance"] < 1e-4
    assert b["energy_variance"] > a["energy_variance"] and 2 < b["syllable_rate"] < 6
    assert signal.clip_metrics(wav(tone[:24_000]))["snr_db"] == 0.0
    assert signal.reference_snr(wav(np.zeros(24_000))) is None and signal.reference_snr(wav(tone)) == 60.0 and signal.reference_snr(None) is None
    both = np.stack([tone, tone], 1)
    assert signal.clip_metrics(wav(both))["duration_s"] == pytest.approx(3.0)
    assert signal.header_duration(b"x" * 48_000) == 1.0
    louder = signal.delivered(tone * 0.5, "shouted")
    assert len(louder) == int(len(tone) / 1.08) and np.abs(louder).max() > 0.4
    assert (signal.delivered(tone, "sung") == tone).all()


def test_autocorrelation_pitch_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    x, rate = rng.standard_normal(6000) * 0.1 + np.sin(np.arange(6000) / 9) * 0.5, 8000
    size, low, high, found = 240, 16, 133, []
    for s in range(0, len(x) - size, 80):
        f = x[s : s + size]
        c = np.correlate(f, f, "full")[size - 1 :]
        p = int(c[low:high].argmax()) + low
        if np.abs(f).max() >= 0.01 and c[p] > 0.3 * c[0]:
            found.append(rate / p)
    assert signal.pitch_variance(x, rate) == pytest.approx(np.var(found))
