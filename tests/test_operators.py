"""Fixtures of the relational operators, restarts, sources and the registry."""

import io
import random
import zipfile
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from taleforge.functions import text
from taleforge.operators import entities, matching, models, progress, segments, timeline
from taleforge.plans import registry
from taleforge.plans.dressing import CHARS
from taleforge.sources import readers
from taleforge.streaming import runs

registry.load()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fuzzy_pairs_equal_a_plain_loop(spark):
    names = ["tide", "diet", "Elizabeth Bennet", "Elisabeth Bennet", "Elizabet Benet", "Mr Darcy", "Mr. Darcy", "Jon", "John", "Al", "Marianne Dashwood", "Mariane Dashwod"]
    df = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    pairs = df.toDF("a", "name_a").join(df.toDF("b", "name_b"), F.col("a") < F.col("b"))
    got = {(r.a, r.b) for r in entities.fuzzy(pairs).collect()}
    want = set()
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            p, q = x.lower().strip(), y.lower().strip()
            if i < j and min(len(p), len(q)) >= 3 and SequenceMatcher(None, p, q).ratio() >= (0.9 if min(len(p), len(q)) < 6 else 0.85):
                want.add((i, j))
    assert got == want and want


def test_ratios_equal_the_standard_library():
    rng = random.Random(3)
    names = ["", "a", "é\U0001f600é", "x" * 70, "ab" * 120] + ["".join(rng.choices("abc \U0001f600", k=rng.randrange(20))) for _ in range(200)]
    pairs = [(x, y) for x in names for y in rng.sample(names, 20)]
    assert entities.ratios(*map(list, zip(*pairs, strict=True))).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]


def test_fuzzy_query_equals_a_loop_over_all_pairs(spark):
    """No two names of the table are surname conflicts: those need equal last words, and such pairs are far apart."""
    d = "/root/testdata/sf0.001"
    c = [(r.c_custkey, f"{r.c_mktsegment.lower()} {r.c_name[-4:]}") for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    want = {(i, j) for i, x in c for j, y in c if i < j and SequenceMatcher(None, x, y).ratio() >= 0.85}
    got = rows(registry.QUERIES["fuzzy_pairs"](spark, d))
    assert got == sorted(((i, i, sum(i in p for p in want)) for i, _ in c), key=repr) and len(want) >= 1537


def test_fuzzy_query_leaves_out_no_surname_conflict(spark, tmp_path):
    """Two names with the same last word and other first ones match by F5 alone, and so do their copies."""
    kinds = ["BUILDING", "BUILDINGS", "Household", "HOUSEHOLDS", "HOUSE HOLD", "AUTOMOBILE", None]
    own = [(i, f"Customer#{i % 9:09}", kinds[i % 7]) for i in range(40)]
    spark.createDataFrame(own, "c_custkey bigint, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    names = [" ".join([*([k.lower()] if k else []), c[-4:]]) for _, c, k in own]
    want = {(i, j) for j, y in enumerate(names) for i, x in enumerate(names[:j]) if SequenceMatcher(None, x, y).ratio() >= (0.9 if min(len(x), len(y)) < 6 else 0.85)}
    got = rows(registry.QUERIES["fuzzy_pairs"](spark, str(tmp_path)))
    assert got == sorted(((i, names.index(x), sum(i in p for p in want)) for i, x in enumerate(names)), key=repr)
    df = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    assert set(rows(entities.fuzzy(entities.fuzzy_candidates(df, conflicts=True)).select("a", "b"))) == want
    assert sum(r[2] for r in rows(entities.fuzzy_links(df))) < 2 * len(want)


def test_links_of_names_count_every_pair_of_copies(spark, monkeypatch):
    """Copies in mixed order, names that match in one order only, long and short names, surname conflicts, several tiles."""
    monkeypatch.setattr(entities, "TILE", 40)
    rng = random.Random(7)
    names = ["".join(rng.choices("aabcde 12", k=rng.randrange(1, 16))) for _ in range(60)] + ["household 0112", "household 1201", "x" * 70, "x" * 69 + "y", "Mr Bennet", "Mrs Bennet", "Zoë Bennet", None, None]
    names += [n[:k] + rng.choice("xyz") + n[k + 1 :] for n in names if n and (k := rng.randrange(len(n))) >= 0]
    names += [rng.choice([str.upper, str.lower])(n) for n in names if n for _ in range(rng.randrange(3))]
    own = list(zip(rng.sample(range(10_000), len(names)), names, strict=True))
    df = spark.createDataFrame(own, "idx bigint, name string")
    pairs = rows(entities.fuzzy(entities.fuzzy_candidates(df)).select("a", "b"))
    plain = df.toDF("a", "name_a").join(df.toDF("b", "name_b"), F.col("a") < F.col("b"))
    assert set(pairs) == {(r.a, r.b) for r in entities.fuzzy(plain.where(~text.surname_conflict("name_a", "name_b"))).collect()}
    keys = {i: n and n.lower().strip() for i, n in own}
    got = rows(entities.fuzzy_links(df))
    assert got == sorted(((i, min(j for j in keys if keys[j] == k), sum(i in p for p in pairs)) for i, k in keys.items()), key=repr) and len(pairs) > 100


def test_links_of_orphans_count_every_pair(spark):
    rng = random.Random(6)
    cast = [(i, rng.choice(["Ann", "Ann Lee", " Bo "]), ["x"] * rng.randrange(3), rng.choice(["male", "female", "other", None]), rng.random() < 0.8) for i in range(80)]
    df = spark.createDataFrame(cast, "idx bigint, name string, aliases array<string>, gender string, is_named boolean")
    judged = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(600)], "a bigint, b bigint")
    pairs = [tuple(p) for p in entities.orphan_pairs(df, judged).collect()]
    got = {r.idx: r for r in entities.orphan_links(df, judged).collect()}
    assert len(got) == 80 and len(pairs) > 100
    for i, name, aliases, gender, named in cast:
        r = got[i]
        assert r.orphan == (named and len(name.split()) == 1 and len(aliases) <= 1)
        assert r.class_id == min((c[0] for c in cast if c[4] and c[3] == gender), default=None) if named and gender else r.class_id is None
        assert (r.n_links, r.n_asked) == (sum(p[0] == i for p in pairs), sum(p[1] == i for p in pairs))


def test_orphan_query_equals_sql_over_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    pairs = f"""with {CHARS}, p as (select idx, case when idx % 40 = 3 then split_part(name, ' ', 1) else name end as name, gender, is_named from chars), o as (select * from p where is_named and not contains(name, ' '))
      select o.idx, p.idx other from o join p on p.gender = o.gender and p.is_named and p.idx <> o.idx where not (abs(o.idx - p.idx) = 6)"""
    with duckdb.connect() as c:
        c.execute(f"create view part as select * from '{d}/part.parquet'")
        found = c.execute(pairs).fetchall()
        assert rows(registry.QUERIES["orphan_pairs"](spark, d)) == sorted(c.execute(registry.ORACLES["orphan_pairs"]).fetchall(), key=repr)
    got = registry.QUERIES["orphan_pairs"](spark, d).collect()
    assert found and {r.idx: (r.n_links, r.n_asked) for r in got} == {r.idx: (sum(f[0] == r.idx for f in found), sum(f[1] == r.idx for f in found)) for r in got}


def test_fuzzy_candidates_lose_no_pair(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("aabcde 12", k=rng.randrange(3, 16))) for _ in range(150)]
    names += [n[:k] + rng.choice("xyz") + n[k + 1 :] for n in names if (k := rng.randrange(len(n))) >= 0]
    df = spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")
    keys = [n.lower().strip(" ") for n in names]
    want = {(i, j) for j, y in enumerate(keys) for i, x in enumerate(keys[:j]) if min(len(x), len(y)) >= 3 and SequenceMatcher(None, x, y).ratio() >= (0.9 if min(len(x), len(y)) < 6 else 0.85)}
    got = [(r.a, r.b) for r in entities.fuzzy(entities.fuzzy_candidates(df, conflicts=True)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_every_profile_has_its_place(spark):
    d = "/root/testdata/sf0.001"
    p = sorted((r.p_partkey % 5 == 0, r.p_name.lower(), r.p_partkey) for r in spark.read.parquet(f"{d}/part.parquet").collect())
    assert len(p) > 50 and rows(registry.QUERIES["sorted_registry"](spark, d)) == sorted(((x[2], k) for k, x in enumerate(p, 1)), key=repr)


def test_closure_of_pairs(spark):
    pairs = [(5, 4), (4, 3), (9, 8), (3, 3)] + [(i, i + 1) for i in range(20, 40)]
    got = dict(rows(entities.merge_components(spark.createDataFrame(pairs, "a bigint, b bigint"))))
    assert got == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8} | {i: 20 for i in range(20, 41)}


def test_profiles_fold_in_order(spark):
    kind = "chapter int, pos int, name string, aliases array<string>, gender string, age_range string, traits array<string>, description string, is_named boolean"
    a = (1, 0, "Lizzy ", ["Eliza", ""], "unknown", "young", [f"t{i}" for i in range(20)], "short", False)
    b = (2, 0, "lizzy", ["Lizzy "], "female", "unknown", [f"u{i}" for i in range(20)], "a longer one", True)
    got = entities.fold_profiles(spark.createDataFrame([b, a], kind), key=text.name_key("name"), order=["chapter", "pos"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.name, r.aliases, r.gender, r.age_range, r.description, r.is_named, r.n) == ("Lizzy ", ["Eliza", "lizzy"], "female", "young", "a longer one", True, 2)
    assert r.traits == [f"t{i}" for i in range(20)] + [f"u{i}" for i in range(10)]


def test_uniqueness_of_voices(spark):
    a = [(1, 0, "A", "100", 0.9, True), (1, 1, "B", "100", 0.7, True), (1, 2, "m", "200", 0.5, False), (1, 3, "n", "200", 0.6, False), (1, 4, "o", "200", 0.4, False)]
    pool = [(1, "B", 0, "100"), (1, "B", 1, "300"), (1, "m", 0, "300"), (1, "m", 1, "400")]
    df = spark.createDataFrame(a, "book int, pos int, name string, speaker string, confidence double, is_major boolean")
    offers = spark.createDataFrame(pool, "book int, name string, ord int, speaker string")
    met = spark.createDataFrame([(1, "m", "n")], "book int, a string, b string")
    got = {r.name: (r.speaker, r.confidence, r.moved) for r in matching.enforce_uniqueness(df, offers, met).collect()}
    assert got == {"A": ("100", 0.9, False), "B": ("300", 0.3, True), "m": ("400", 0.3, True), "n": ("200", 0.6, False), "o": ("200", 0.4, False)}


def test_large_casts_raise_the_threshold(spark):
    names = spark.createDataFrame([("Mr. Darcy",), ("Elizabeth Bennet",), ("Mary",)], "name string")
    counts = spark.createDataFrame([("Mr. Darcy", 8), ("Elizabeth Bennet", 6), ("Mary", 2)], "speaker string, n_dialogue bigint")
    major = lambda t, c=counts, n=names: {r.name for r in matching.cast_classes(n, c, threshold=t).collect() if r.is_major}
    assert major(5) == {"Mr. Darcy", "Elizabeth Bennet"} and major(7) == {"Mr. Darcy"}
    assert major(5, counts.limit(0)) == set()
    many = names.union(spark.range(30).select(F.col("id").cast("string")))
    assert major(5, counts.union(spark.createDataFrame([("0", 200)], "s string, n bigint")), many) == {"0"}


def test_packing_of_sentences(spark):
    texts = ["", "One. Two! Three?", "a" * 300 + ". " + "b" * 300 + ". tail.", ("s" * 100 + ". ") * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.c for r in df.select("i", segments.packed(segments.sentences(F.col("t")), 580, 200).alias("c")).orderBy("i").collect()]
    assert got[0] == [] and got[1] == ["One. Two! Three?"] and len(got[2]) == 2
    for t, c in zip(texts, got, strict=True):
        assert " ".join(c).replace(" ", "") == t.replace(" ", "")


def test_work_resumes_where_it_stopped(spark, tmp_path):
    kind = "id bigint, status string"
    for k in range(2):
        spark.createDataFrame([(10 * k + i, "new") for i in range(5)], kind).write.json(str(tmp_path / "in"), mode="append")
        source = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        runs.process_available(source, lambda d: d.withColumn("status", F.lit("completed")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        done = spark.read.parquet(str(tmp_path / "out"))
        assert done.count() == 5 * (k + 1) and done.where("status = 'completed'").count() == 5 * (k + 1)
    assert progress.pending(spark.range(16), done).count() == 6


def test_hourly_counts_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = runs.hourly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.table("hours").select("event_type", "n")) == rows(registry.QUERIES["event_windows"](spark, "/root/testdata/sf0.001").select("event_type", "n"))


def test_guard_needs_enough_rows(spark):
    r = spark.createDataFrame([(i, "failed" if i < 5 else "completed") for i in range(25)], "id int, status string")
    got = {x.id: x.stop for x in progress.failure_guard(r).collect()}
    assert not any(got[i] for i in range(19)) and got[19] and got[24]


def test_model_calls_retry_validate_and_cache(spark):
    said = iter(["nonsense", '```json\n{"a": 1}\n```'])
    assert models.structured("p", lambda p: next(said), ("a",)) == ('{"a": 1}', 2)
    assert models.structured("p", lambda p: "[1]", ("a",)) == ('{"a": [1]}', 1)
    assert models.structured("p", lambda p: "{}", ("a",)) == (None, 3)
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, p string")
    first = models.called(df, key="k", prompt="p", stage="s", required=("answer",))
    assert {r.calls for r in first.collect()} == {1}
    cache = first.select(F.col("cache_key").alias("key"), F.col("response").alias("value")).distinct()
    assert {r.calls for r in models.called(df, key="k", prompt="p", stage="s", required=("answer",), cache=cache).collect()} == {0}
    assert models.model_for(16) == "large" and models.model_for(8) == "small" and models.workers_for("remote-x") == 32 and models.workers_for("small") == 1


def test_blocks_of_a_page():
    page = '<html><head><title>t</title><script>var x="<p>no</p>"</script></head><body><nav><p>menu</p></nav><div class="a b"><p>One &amp; <b>two</b></p><hr class="break"/><p> </p></div><section role="doc-toc"><p>toc</p></section><h2>Head<br>line</h2><p>open<p>next</body></html>'
    got = [(b["tag"], b["text"], b["classes"]) for b in readers.html_blocks(page)]
    assert got == [("div", "One & two", ["a", "b"]), ("p", "One & two", []), ("hr", "", ["break"]), ("h2", "Head line", []), ("p", "open", []), ("p", "next", [])]
    assert [b["tag"] for b in readers.html_blocks(page, "leaf")] == ["p", "hr", "h2", "p", "p"]
    assert readers.html_blocks(None) == []


def epub(path):
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><meta name="cover" content="c"/></metadata>
    <manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" media-type="application/xhtml+xml"/><item id="c" href="x.png" media-type="image/png"/></manifest>
    <spine><itemref idref="b"/><itemref idref="n" linear="no"/><itemref idref="gone"/><itemref idref="a"/><itemref idref="c"/></spine><guide><reference type="Text" href="a.xhtml#x"/></guide></package>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", opf)
        for k in "abn":
            z.writestr(f"O/{k}.xhtml", f"<body><h1>{k}</h1></body>")


def test_books(spark, tmp_path):
    epub(tmp_path / "x.epub")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    got = readers.read_epubs(spark, str(tmp_path)).orderBy("spine_pos").collect()
    assert [(r.book_id, r.spine_pos, r.href, r.title, r.author, r.guide, r.cover, r.cover_mime) for r in got] == [("x", 0, "O/b.xhtml", "T", "Unknown Author", False, "O/x.png", "image/png"), ("x", 1, "O/a.xhtml", "T", "Unknown Author", True, "O/x.png", "image/png")]
    assert readers.epub_rows(io.BytesIO().getvalue()) == []


def test_annotators_files(spark, tmp_path):
    one = "100|very masculine,adult-like, calm,\n200|very feminine,young\nbad\n300|a|b\n"
    two = "100|masculine,calm\n200|feminine,fluent\n"
    for name, body in (("a.csv", one), ("b.csv", two)):
        (tmp_path / name).write_text(body)
    got = {r.speaker: r for r in matching.speaker_index(readers.read_annotations(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])).collect()}
    assert {k: v.gender for k, v in got.items()} == {"100": "male", "200": "female"}
    assert got["100"].agreement["calm"] == 2 and got["100"].trait_text == "adult-like, calm, masculine, very masculine"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_annotations(spark, [str(tmp_path / "none.csv")]).collect()


def test_metadata_overrides_directories_and_transcripts(spark, tmp_path):
    lines = spark.createDataFrame(enumerate(["; c", "1 | F | train-a | x", "2|M", "", "1|F|train-b"]), "pos bigint, value string")
    assert rows(readers.piped_metadata(lines)) == [("1", "train-b")]
    body = "# c\ncharacters:\n  Mr Darcy:\n    speaker_id: '12'\n    voice_profile:\n      pitch: low # deep\n      tone: \"dry\"\n  Anne:\n    voice_profile:\n      pace: slow\n"
    (tmp_path / "o.yaml").write_text(body)
    got = {r.name: (r.speaker_id, r.voice_profile) for r in readers.read_overrides(spark, str(tmp_path / "o.yaml")).collect()}
    assert got == {"Mr Darcy": ("12", {"pitch": "low", "tone": "dry"}), "Anne": (None, {"pace": "slow"})}
    assert readers.read_overrides(spark, str(tmp_path / "none.yaml")).collect() == []
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wav").write_bytes(b"12345")
    files = readers.read_directory(spark, str(tmp_path / "w")).withColumn("path", F.regexp_replace("path", ".*/", ""))
    notes = spark.createDataFrame([("a.normalized.txt", " hi ")], "path string, transcript string")
    assert rows(readers.with_transcripts(files, notes)) == [("a.wav", 5, "hi")]
    readers.write_documents(spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"), str(tmp_path / "doc"))
    assert readers.read_documents(spark, str(tmp_path / "doc"), "id int, t string").count() == 2


def test_announcements_and_markers(spark):
    df = spark.createDataFrame([(1, "The Start"), (2, " "), (3, None)], "n int, t string")
    assert [r.s for r in df.select("n", timeline.announcement(F.col("n"), F.col("t")).alias("s")).orderBy("n").collect()] == ["Chapter 1: The Start", "Chapter 2", "Chapter 3"]
    c = spark.createDataFrame([(1, 1, 2.5), (1, 2, 1.25)], "book int, chapter int, duration double")
    assert rows(timeline.markers(timeline.chapter_offsets(c, book="book"), book="book")) == [(1, 1, "chp000", 0, 2500), (1, 2, "chp001", 2500, 3750)]


def test_every_query_is_documented_and_named_once():
    assert len(registry.QUERIES) > 80 and set(registry.ORACLES) <= set(registry.QUERIES)
    assert all(f.__doc__ for f in registry.QUERIES.values())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs_on_the_smallest_tables(spark, name):
    if name in ("alias_overlap", "merge_components"):
        pytest.skip("covered by a fixture")
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).collect()


def test_breaks_by_class_close_a_quotation(spark):
    blocks = [(1, 0, "p", "“He began", []), (1, 1, "p", "and went on", []), (1, 2, "p", "x", ["fancy", "divider"]), (1, 3, "p", "The rain fell.", []), (1, 4, "p", "“Again", []), (1, 5, "hr", "", []), (1, 6, "p", "Night.", [])]
    got = segments.classify_blocks(spark.createDataFrame(blocks, "chapter int, pos int, tag string, text string, classes array<string>")).orderBy("pos").collect()
    assert [r.type for r in got] == ["dialogue", "dialogue", "scene_break", "narration", "dialogue", "scene_break", "narration"]


def test_dots_within_sentences(spark):
    said = "Mr. Darcy paid 3.50 to J. Smith. “Why?” he asked... Then\nDr. No left!"
    assert spark.range(1).select(segments.sentences(F.lit(said)).alias("s")).head().s == ["Mr. Darcy paid 3.50 to J. Smith.", "“Why?", "” he asked...", "Then\nDr. No left!"]


def test_traits_come_in_the_order_of_their_places(spark, tmp_path):
    """Places beyond a chapter's hundred thousand, and a name's only profile that repeats a trait, equal the SQL."""
    parts = [(150000, "hot bolt", "B", "SMALL", 1), (7, "hot bolt", "B", "PROMO", 2), (3, "large rod", "B", "LARGE", 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = rows(registry.QUERIES["trait_union_cap"](spark, str(tmp_path)))
    with duckdb.connect() as c:
        c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
        assert got == sorted(c.execute(registry.ORACLES["trait_union_cap"]).fetchall(), key=repr)
    assert got == [("hot bolt", "hot,bolt,promo,trait7,small,trait0"), ("large rod", "large,rod,trait3")]


def test_a_capital_after_a_letter_beyond_ascii_holds_its_dot(spark):
    """As in the SQL, whose word boundaries are ASCII."""
    got = spark.range(1).select(segments.sentences(F.lit("FÜR. UND. MICIÓN. Ende.")).alias("s")).head().s
    assert got == ["FÜR. UND.", "MICIÓN. Ende."]


def test_closure_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(entities, "EDGES", 9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5)]
    got = {tuple(r) for r in entities.merge_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}
    with pytest.raises(RuntimeError):
        entities.merge_components(spark.createDataFrame(edges, "a bigint, b bigint"), most_rounds=1)


def test_many_asks_meet_offers_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    offers = spark.createDataFrame(rows, "speaker bigint, vector array<double>")
    asks = offers.where("speaker % 3 = 0").selectExpr("concat('c', speaker) as name", "vector", "speaker as own")
    few = {tuple(r) for r in matching.best_matches(asks, offers, k=5).select("name", "rank", "speaker").collect()}
    monkeypatch.setattr(matching, "ASKS", 4)
    assert {tuple(r) for r in matching.best_matches(asks, offers, k=5).select("name", "rank", "speaker").collect()} == few and len(few) == 100
    assert not any(name == f"c{s}" for name, _, s in few)
