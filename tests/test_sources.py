"""Sources read as files, scans that end early, choices, stages made once, and the rows of chapters."""

import re

from pyspark.sql import functions as F

from taleforge.functions.splitting import long_sentence
from taleforge.operators import models, progress, segments
from taleforge.sources import readers


def test_a_scan_ends_after_the_last_wanted_key_and_more_rows(spark):
    data = [(n, "a" if n % 7 == 0 else "b" if n in (20, 25, 33, 90) else "z", n != 20) for n in range(100)]
    df = spark.createDataFrame(data, "n int, k string, has_content boolean")

    def plain(wanted, more):
        left, after, out = set(wanted), 0, []
        for n, k, good in data:
            if k in wanted:
                if not good:
                    continue
                out.append(n)
                left.discard(k)
            if not left:
                after += 1
                if after > more:
                    break
        return out

    for wanted, more in ((["a", "b"], 5), (["a", "b"], 100), (["a", "none"], 5), (["b"], 0)):
        asked = spark.createDataFrame([(w,) for w in wanted], "k string")
        got = readers.scanned_rows(df, asked, key="k", order="n", more=more)
        assert sorted(r.n for r in got.collect()) == plain(wanted, more), (wanted, more)


def test_settings_keep_what_is_known(spark):
    lines = spark.createDataFrame(enumerate([" A = 1=2 ", "#B=3", "C", "=4", "A=5", "D=6", ""]), "pos int, value string")
    known = spark.createDataFrame([("D",)], "key string")
    assert [tuple(r) for r in readers.env_values(lines, known).collect()] == [("A", "1=2")]


def test_stage_documents_are_read_as_lines(spark, tmp_path):
    df = spark.createDataFrame([(n, f"t{n}\n”") for n in range(5)], "id int, t string")
    readers.write_documents(df.coalesce(1), str(tmp_path / "doc"))
    got = readers.read_documents(spark, str(tmp_path / "doc"), "id int, t string", lines=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_choices_are_asked_three_times_at_most(spark):
    df = spark.createDataFrame([(1, "p", ["c2"]), (2, "p", ["c9"]), (3, "p", None), (4, "p", ["c1", "c2"])], "k int, p string, ids array<string>")
    got = models.chosen(df, key="k", prompt="p", ids="ids", client=lambda said, n: None if n == 3 else f"c{n}")
    assert sorted(map(tuple, got.collect())) == [(1, "c2", 2), (2, None, 3), (3, None, 3), (4, "c1", 1)]


def test_a_stage_is_made_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert progress.made_once(spark, path, lambda: spark.range(3)).count() == 3
    assert progress.made_once(spark, path, lambda: 1 / 0).count() == 3


def test_rows_of_chapters_equal_a_plain_loop(spark):
    long = "a" * 100 + ", " + "b" * 100 + ", " + "c" * 100
    data = [
        (1, 0, "h2", "One. Two", []), (1, 1, "p", "He said, “Go! Now.” and left.", []), (1, 2, "hr", "", []), (1, 3, "p", long + ". End.", []),
        (1, 4, "p", "“Still open", []), (1, 5, "p", "so this is said.", []), (1, 6, "p", "***", []), (1, 7, "p", "Told. Again.", []), (2, 0, "p", '"Hi," she said, "you."', []),
    ]
    df = spark.createDataFrame(data, "chapter int, pos int, tag string, text string, classes array<string>")
    kinds = {(r.chapter, r.pos): r.type for r in segments.classify_blocks(df).collect()}
    assert kinds[1, 5] == "dialogue" and kinds[1, 2] == "scene_break" and kinds[1, 7] == "narration"
    want = []
    for chapter, pos, _, text, _ in data:
        parts = [(kinds[chapter, pos], text)]
        if parts[0][0] == "dialogue":
            mark = "“" if re.search("[“”]", text) else '"'
            found = re.findall("“[^”]*(?:”|$)|[^“]+" if mark == "“" else '"[^"]*(?:"|$)|[^"]+', text)
            found = [p.strip() for p in found if p.strip()]
            parts = [("dialogue" if p[0] == mark else "narration", p) for p in found] if len(found) > 1 else [("dialogue", text)]
        for k, (kind, part) in enumerate(parts):
            said = [s.strip() for s in re.findall("[^.!?]+[.!?]*", part) if s.strip()] or [part.strip()]
            cut = [c for s in said for c in long_sentence(s)]
            want += [(chapter, pos, k, n, kind, c) for n, c in enumerate(cut)]
    got = segments.segment_rows(df).orderBy("chapter", "pos", "part", "sub")
    assert [tuple(r) for r in got.collect()] == want
    assert got.agg(F.max(F.length("text"))).collect()[0][0] <= 280 and any(len(w[5]) > 90 for w in want)
