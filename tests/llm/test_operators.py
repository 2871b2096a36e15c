"""The corpus operators on small tables: brute force, and odd rows of every kind."""

import hashlib
import math
import re
import tracemalloc
import wave
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taleforge.llm import audio_fingerprint as audio
from taleforge.llm import additive_quantisation as aq
from taleforge.llm import bloom_lm, common, graph, language_id, license_scan
from taleforge.llm import ngram_jaccard as jaccard
from taleforge.llm import quality_cotraining as quality
from taleforge.llm.additive_quantisation import nearest
from taleforge.llm.bpe import decode_table, encode_table, word_bpe
from taleforge.llm.ngram_jaccard import ngram_jaccard
from taleforge.llm.packing import pack
from taleforge.llm.queries import op4_ngram_jaccard, op8_chroma_fingerprint
from taleforge.llm.sharding import SlotMap, shard

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, cid bigint"
#: Nulls, empty and blank texts, ties, repeated rows and ids, a very long text, and columns named as the operators' own.
ODD = [
    (1, "The cat sat on the mat and looked at the moon all night long.", "en", "a", 60, 1, 1),
    (2, "the cat sat on the mat and looked at the moon all night long.", "en", "a", 60, 1, 1),
    (3, None, None, None, None, None, None),
    (4, "", "en", "", 0, 0, 0),
    (5, " \n\t ", "en", "b", 4, 0, 0),
    (6, "one two", "en", "b", 7, 0, 0),
    (7, "One  two", "fr", "b", 8, 0, 0),
    (7, "One  two", "fr", "b", 8, 0, 0),
    (8, " ".join(f"word{i}" for i in range(4000)), "en", "c", 30000, 0, 0),
    (9, " ".join(f"word{i}" for i in range(4000)) + " more", "en", "c", 30005, 0, 0),
    (None, "one two", "en", "d", 7, 0, 0),
    (10, "12 34 !!", "de", "d", 8, 0, 0),
    (11, "x" * 5000, "de", "d", 5000, 0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets(texts, n=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def linked(rows, num, den, n=4):
    """Component of each row by comparing all pairs."""
    s = sets([t for _, t in rows], n)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j]) if min(len(s[i]), len(s[j])) * den >= num * max(len(s[i]), len(s[j])) else 0
            if both and den * both >= num * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(s[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_jaccard_on_odd_rows(odd, empty):
    got = [tuple(r) for r in ngram_jaccard(odd, n=4, num=85, den=100).collect()]
    assert sorted(got, key=repr) == linked([(r[0], r[1]) for r in ODD], 85, 100)
    assert ngram_jaccard(empty).collect() == []


def test_jaccard_finds_what_all_pairs_find(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choice(vocab, 40))
    rows = []
    for k in range(40):
        base = rng.choice(vocab, int(rng.integers(5, 160))).tolist()
        for _ in range(int(rng.integers(1, 7))):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[at] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(words) + (f" {common}" if k % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for n, num, tile in ((4, 85, 1024), (5, 80, 3), (4, 60, 2)):
        monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
        got = [tuple(r) for r in ngram_jaccard(docs, n=n, num=num, den=100).collect()]
        assert sorted(got, key=repr) == linked(rows, num, 100, n)


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Texts about the threshold apart, in runs of many tiles, beside a class that many tasks see."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "the same words in a row each time") for i in range(60)]
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)
    got = [tuple(r) for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), n=4, num=85, den=100).collect()]
    assert sorted(got, key=repr) == linked(rows, 85, 100)


def test_op4_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op4_ngram_jaccard(spark, "/root/testdata/sf0.001").collect()), key=repr) == linked(rows, 85, 100)


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_components_in_one_task_or_many(spark, monkeypatch, per_task):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", per_task)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_shards_are_gapless_and_even(odd, empty, spark):
    rows, made = shard(odd, shards=3)
    got = rows.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8) for r in ODD)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.text_crc32 == (zlib.crc32(t.encode()) if (t := dict((x[0], x[1]) for x in ODD)[r.doc_id]) is not None else None) for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert made.table(spark).count() == 4096 and SlotMap.read(made.table(spark)) == made
    kept = []
    _, edited = shard(odd, shards=3, old=made, stored=kept)
    assert (edited.version, edited.shard) == (made.version + 1, made.shard) and {r.version for r in kept[0].collect()} == {1, 2}
    assert shard(empty)[0].collect() == []


def test_neighbours_are_exact_on_few_rows_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(100, None), (101, [0.0] * 8), (102, [1.0] * 7 + [None]), (120, [float("nan")] * 8), (140, [float("inf")] * 8), (160, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    got = nearest(df, queries=F.col("vec_id") % 20 == 0, k=20).collect()
    exact = vectors.astype(float)
    for q in (0, 20, 40):
        s = exact @ exact[q]
        want = [i for i in np.lexsort((np.arange(60), -s)).tolist() if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want and [r.rank for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], s[want], atol=1e-12)
    assert {r.query_id for r in got} == {0, 20, 40}
    assert nearest(df.limit(0), queries=F.col("vec_id") % 20 == 0).collect() == []
    few = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>"), queries=F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def brute_neighbours(ids, x, k=20):
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        out[q] = set(ids[np.lexsort((ids, -s))[:k]].tolist())
    return out


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = rows.toPandas()
    ids, x = frame["vec_id"].to_numpy(), np.array(frame["embedding"].tolist(), float)
    got = nearest(rows, queries=F.col("vec_id") % 20 == 0, k=20).toPandas()
    at = {i: n for n, i in enumerate(ids.tolist())}
    assert np.allclose(got["score"], [x[at[a]] @ x[at[b]] for a, b in zip(got["query_id"], got["vec_id"], strict=True)], atol=1e-12)
    mine = got.groupby("query_id")["vec_id"].agg(set)
    want = brute_neighbours(ids, x)
    assert np.mean([len(want[q] & mine[q]) / 20 for q in want]) >= 0.95


def test_codes_and_not_the_rerank_decide():
    """At the depth of the query the codes' own scores hold the neighbours of 50,000 rows; codes dealt anew at random don't."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50_000, 64))
    x *= rng.uniform(0.5, 2, (len(x), 1))
    books = aq.learn(x[: aq.SAMPLE_ROWS])
    units, norms = aq.directions(x)
    codes = np.concatenate([books.encode(units[a : a + 2048]) for a in range(0, len(x), 2048)])
    ids = np.arange(len(x))
    hits = {}
    for name, c in (("codes", codes), ("noise", rng.permutation(codes))):
        scan = aq.Scan(aq.Codebooks(books.words, aq.CODEWORDS), np.zeros(aq.CODEWORDS, int), ids[:60], x[:60], aq.RERANK)
        for a in range(0, len(x), 4096):
            scan.feed(0, ids[a : a + 4096], norms[a : a + 4096], c[a : a + 4096])
        out = scan.close().to_pandas().groupby("query_id")["id"].agg(set)
        exact = x[:60] @ x.T
        exact[np.arange(60), np.arange(60)] = -np.inf
        hits[name] = np.mean([len(set(np.argsort(-exact[q])[:20].tolist()) & out[q]) / 20 for q in range(60)])
    assert hits["codes"] >= 0.9 and hits["noise"] < 0.1


def test_clustered_rows_visit_few_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 4
    x = centres[np.arange(4000) % 40] + 0.3 * rng.standard_normal((4000, 16))
    assert aq.learn(x).visited < aq.CODEWORDS // 2
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), queries=F.col("vec_id") % 20 == 0, k=20).toPandas()
    mine, want = got.groupby("query_id")["vec_id"].agg(set), brute_neighbours(np.arange(4000), x)
    assert np.mean([len(want[q] & mine[q]) / 20 for q in want]) >= 0.95


def test_repeated_ids_copies_and_other_lengths(spark):
    rows = [(i % 3, [1.0, float(i % 3)]) for i in range(300)] + [(100 + i, [2.0, 0.5]) for i in range(300)] + [(900, [1.0, 2.0, 3.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), queries=F.col("vec_id").isin(0, 100), k=20).collect()
    mine = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert mine[0] == [(100 + i, 2.0) for i in range(20)]
    assert mine[100] == [(101 + i, 4.25) for i in range(20)]
    few = spark.range(40_000).selectExpr("id % 3 as vec_id", "array(1f, cast(id % 3 as float)) as embedding")  # so few ids that no hash may fall into the sample
    assert {r.query_id for r in nearest(few, queries=F.col("vec_id") == 0, k=20).collect()} == {0}


def test_quality_on_odd_rows_and_held_out_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fit(odd, labels) is None
    assert {r.keep for r in quality.score(odd, None).collect()} == {True}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("keep", "quality", "quality_score").toPandas()
    assert ((held["keep"]) == (held["quality"] == 1)).mean() > 0.95
    assert held["quality_score"].between(0, 1).all()
    out = quality.score(odd, model)
    assert out.count() == len(ODD) and quality.score(empty, model).count() == 0
    assert out.columns[: len(odd.columns)] == odd.columns


def windows(text):
    """(dice, name) of every stretch as long as a template that begins where one of its bigrams says."""
    words, out = license_scan.normalised(text), []
    pairs = list(zip(words, words[1:], strict=False))
    for name, template in license_scan.TEMPLATES.items():
        own = license_scan.normalised(template)
        known = list(zip(own, own[1:], strict=False))
        for s in {i - j for i, a in enumerate(pairs) for j, b in enumerate(known) if a == b} if set(pairs) & set(known) else ():
            got = Counter(pairs[max(s, 0) : s + len(known)])
            dice = 2 * sum((got & Counter(known)).values()) / (sum(got.values()) + len(known))
            if dice >= license_scan.THRESHOLD:
                out.append((dice, name))
    return out


def test_licences_on_odd_rows_and_against_plain_python(spark, odd, empty):
    texts = ["Released under the MIT License.", "prose before\nreleased UNDER the mit licence!\nand after", "x\n\n" + license_scan.TEMPLATES["ISC"].replace("software", "program") + "\n\ny", "ﬀ Licensed under CC BY-NC 4.0. x", None, "", "under the the the the"]
    texts += [license_scan.TEMPLATES[k] for k in license_scan.TEMPLATES]
    split = lambda k: re.sub(r"\. (?=[A-Z0-9])", ".\n\n", license_scan.TEMPLATES[k])
    prose = " ".join(f"word{i} of the" for i in range(200))
    embedded = {len(texts) + n: k for n, k in enumerate(["MIT", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0-header", "GPL-3.0-header"])}
    texts += [f"{prose}\n\n{split(k)}\n\n{prose}" for k in embedded.values()]
    embedded |= {len(texts): "MIT-notice", len(texts) + 1: "MIT"}
    texts += ["Copyright (c) 2020 Foo. Released under the MIT License.", f"{prose} {license_scan.TEMPLATES['MIT'].replace('Software', 'program', 3)} {prose}"]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        parts = set((t or "").split("\n")) | set(re.split(r"\n[ \t\r]*\n", t or "")) | {t or ""}
        hits = [(license_scan.dice(license_scan.normalised(p), license_scan.normalised(v)), k, p) for p in parts for k, v in license_scan.TEMPLATES.items()]
        hits = [h for h in hits if h[0] >= license_scan.THRESHOLD]
        inside = windows(t or "")
        best = max([h[:2] for h in hits] + inside, default=(None, None))
        assert (got[i].license_id, got[i].n_passages) == (best[1], len({h[2] for h in hits}))
        assert got[i].dice == (pytest.approx(best[0]) if hits or inside else None)
        assert got[i].licenses == sorted({h[1] for h in [*hits, *inside]})
    assert all(k in got[i].licenses for i, k in embedded.items())
    assert license_scan.license_scan(odd).count() == len(ODD) and license_scan.license_scan(empty).count() == 0


def test_language_model_scores(spark, odd, empty):
    held = F.col("doc_id") % 7 == 2
    got = bloom_lm.score(odd, train=~held).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for r in ODD if r[0] is not None and r[0] % 7 != 2 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0] is None, r[0] or 0, len(t := tokens(r[1])), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r in ODD))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert bloom_lm.score(empty, train=~held).collect() == []
    alone = bloom_lm.score(odd, train=F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in alone} == {(0, 0)} and all(r.base_score == 0 for r in alone)


def test_scores_against_exact_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    made = [bloom_lm.stream(*common.text_bytes(pa.array([r.text], pa.string()))) for r in rows]
    held = [r.doc_id % 7 == 2 for r in rows]
    tokens, before = (np.concatenate([m[k] for m, h in zip(made, held, strict=True) if not h]) for k in (0, 1))
    known = Counter(bloom_lm.word_gram(tokens).tolist()) + Counter(bloom_lm.pair_gram(before, tokens).tolist())
    known[int(bloom_lm.word_gram(np.array([bloom_lm.BEGIN]))[0])] = held.count(False)

    class Exact:
        def levels(self, grams):
            return bloom_lm.level(np.array([known[g] for g in grams.tolist()], np.int64))

    model = bloom_lm.Model(Exact(), len(tokens), len(set(tokens.tolist())), np.zeros(len(bloom_lm.LEVELS) + 1))
    both, word, context = model.read(tokens, before)
    share, alone = model.parts(both, word, context, own=1)
    total = np.stack([np.bincount(context, np.log(w * share + (1 - w) * alone), len(model.weights)) for w in bloom_lm.WEIGHTS], 1)
    model = bloom_lm.Model(Exact(), model.tokens, model.distinct, bloom_lm.WEIGHTS[total.argmax(1)])
    got = {r.doc_id: r.score for r in bloom_lm.score(docs, train=F.col("doc_id") % 7 != 2).collect()}
    for r, m in zip(rows, made, strict=True):
        assert got[r.doc_id] == pytest.approx(float(model.logs(m[0], m[1])[0].sum()), rel=1e-3)


def test_rare_words_come_by_the_shuffle(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: r for r in bloom_lm.score(docs, train=F.col("doc_id") % 7 != 2).collect()}
    monkeypatch.setattr(bloom_lm, "FREQUENT", 50)
    b = bloom_lm.score(docs, train=F.col("doc_id") % 7 != 2).collect()
    assert all(r.n_known == a[r.doc_id].n_known and r.base_score == pytest.approx(a[r.doc_id].base_score) for r in b)
    held = [r for r in b if not r.trained]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_the_filter_grows_with_what_is_counted_and_is_read_in_parts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ask = lambda: {r.doc_id: (r.n_known, r.score) for r in bloom_lm.score(docs, train=F.col("doc_id") % 7 != 2).collect()}
    roomy = ask()
    monkeypatch.setattr(bloom_lm, "FILTER_BITS", 1 << 14)  # far fewer bits than there are grams
    monkeypatch.setattr(bloom_lm, "PART_BYTES", 20_000)
    made, parts = [], bloom_lm._broadcast
    monkeypatch.setattr(bloom_lm, "_broadcast", lambda *a: made.append(parts(*a)) or made[-1])
    grown = ask()
    bits = np.concatenate([b.value.bits for b in made[0].held])
    assert len(made[0].held) > 3 and np.unpackbits(bits).mean() < 0.3
    assert {k: v[0] for k, v in grown.items()} == {k: v[0] for k, v in roomy.items()}
    assert np.mean([abs(grown[k][1] - roomy[k][1]) / abs(roomy[k][1]) for k in roomy]) < 0.05


def test_encoding_on_odd_rows(odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in encode_table(odd, path).collect())
    want = Counter()
    for r in ODD:
        ids = other.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), np.array(ids, "<u4").tobytes(), other.decode(ids, skip_special_tokens=False))] += 1
    assert got == want and encode_table(empty, path).collect() == []
    sums = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_table(odd, path, digest=True).collect())
    assert sums == Counter({(i, n, hashlib.sha256(a).hexdigest(), hashlib.sha256(b.encode()).hexdigest()): k for (i, n, a, b), k in want.items()})


def test_encoding_holds_no_whole_text():
    work = word_bpe(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"))
    text = "It's a LONG story\nof 42 knights, <|endoftext|> naïve ones. " * 300
    for size in (1, 7, 1000):
        parts = list(work.stream(text[a : a + size] for a in range(0, len(text), size)))
        assert (b"".join(p[0] for p in parts), "".join(p[1] for p in parts)) == work.encode(text)
    tracemalloc.start()
    n = sum(len(ids) for ids, _ in work.stream(text[:10_000] for _ in range(2000)))  # 20 MB of text
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 10_000_000 and most < 4_000_000


def test_decoding_by_state_machines(spark):
    from tokenizers import Tokenizer

    texts = ["naïve café — 漢字 😀", "", "a<|endoftext|>b", " \n\t x"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        other = Tokenizer.from_file(path)
        rows = [(k, other.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)] + [(9, other.encode("😀", add_special_tokens=False).ids[:1])]
        got = {r.doc_id: r.decoded for r in decode_table(spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in rows] + [(10, None)], "doc_id bigint, ids binary"), path).collect()}
        assert got == {i: other.decode(x, skip_special_tokens=False) for i, x in rows} | {10: ""}


def test_recordings_are_found_again(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((101, 64)))] + [(150, None), (200, [float("nan")] * 64), (250, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    prints = audio.fingerprints(audio.recordings(vectors))
    asked = audio.fingerprints(audio.recordings(vectors, queries=F.col("vec_id") % 50 == 0))
    found = audio.alignments(asked, prints).collect()
    assert sorted((r.query_id, r.match_id, r.offset) for r in found) == [(0, 0, 16), (50, 50, 16), (100, 100, 16)]
    assert {r.id for r in prints.where("n_codes = 0").collect()} == {150, 200, 250}
    assert audio.alignments(asked.limit(0), prints).collect() == []


def test_alignments_against_all_pairs_and_offsets():
    rng = np.random.default_rng(12)
    base = [audio.fingerprint(audio.decode(audio.melody([float(x) for x in rng.standard_normal(64)]))) for _ in range(6)]
    asked = [base[0][5:40], base[3][20:], base[5].copy(), rng.integers(0, 2**32, 50, dtype=np.uint32)]
    asked[2][::7] ^= np.uint32(0x00010001)
    want = []
    for q, a in enumerate(asked):
        for r, b in enumerate(base):
            tried = [(*audio.bit_error(a, b, o), o) for o in range(1 - len(a), len(b))]
            good = [(error, -n, o) for error, n, o in tried if n >= audio.OVERLAP and error <= audio.ERRORS]
            want += [(q, r, min(good)[2])] if good else []
    assert [x[:3] for x in audio.align(asked, base)] == want and {(q, r) for q, r, _ in want} >= {(0, 0), (1, 3), (2, 5)}


def test_wav_files_of_24_bits(tmp_path):
    x = np.sin(np.arange(6000) / 9) * 0.5
    raw = (x * 8388607).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    with wave.open(str(tmp_path / "x.wav"), "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(3)
        file.setframerate(audio.RATE)
        file.writeframes(raw)
    assert np.allclose(audio.decode((tmp_path / "x.wav").read_bytes()), x, atol=1e-6)


def test_every_alignment_is_returned(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((102, 64)))]
    same = {0, 7, 50, 100}
    rows = [(i, rows[0][1] if i in same else v) for i, v in rows]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op8_chroma_fingerprint(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.vec_id, r.offset) for r in got if r.query_id is not None) == [(q, i, 16) for q in (0, 50, 100) for i in sorted(same)]
    assert {r.vec_id for r in got if r.query_id is None} == set(range(102)) - same and len(got) == 98 + 12


def test_languages_of_odd_rows_and_held_out_accuracy(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    held = F.col("doc_id") % 5 == 0
    model = language_id.fit(docs, path, keep=~held, rows=60)
    got = language_id.identify(docs.where(held), model).select("lang", "lang_pred", "score").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    out = language_id.identify(odd, model).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if not re.search(r"[^\W\d_]", r.text or ""))
    assert all(r.lang_pred in model.languages for r in out if re.search(r"[^\W\d_]", r.text or ""))
    assert language_id.identify(empty, model).collect() == []
    numerals = spark.createDataFrame([(1, "½² ①  Ⅷ 12"), (2, "ª½")], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in language_id.identify(numerals, model).orderBy("doc_id").collect()] == [True, False]
    unspaced = spark.createDataFrame([("ab" * 80, "x"), ("cd" * 80, "y")], "text string, lang string").withColumn("doc_id", F.lit(1))
    learned = language_id.fit(unspaced, path, keep=F.lit(True))
    assert [r.lang_pred for r in language_id.identify(unspaced, learned).orderBy("text").collect()] == ["x", "y"]
    nothing = language_id.fit(empty, path, keep=F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in docs:
        want[(i, tuple(other.encode(t or "", add_special_tokens=False).ids + [0]))] += 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    have = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for i, ids in {k: None for k in want}:
        at = 0
        while at < len(ids):
            fits = [k for k in have if have[k] and k[0] == i and k[1] == at and k[4] == len(ids) and k[3] == zlib.crc32(np.array(ids[at : at + k[2]], "<u4").tobytes())]
            assert fits, (i, at)
            at += fits[0][2]


def test_packing_of_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(pack(odd, path).collect(), [(r[0], r[1]) for r in ODD])
    assert pack(empty, path).collect() == []
    same = spark.createDataFrame([(i, "word " * 700) for i in range(40)], "doc_id bigint, text string")
    check_packing(pack(same, path).collect(), [(i, "word " * 700) for i in range(40)])


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing(pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality(spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert np.mean([i in ids for i, q in labels.items() if q == 1]) > 0.97 and np.mean([i in ids for i, q in labels.items() if q == 0]) < 0.1
    spoken = p.language(spark, kept, sf)
    assert spoken.count() == kept.count()  # all of these have a language
    single = p.near_duplicates(spark, spoken, sf)
    rows = [(r.doc_id, r.text) for r in spoken.select("doc_id", "text").collect()]
    got = {r.doc_id for r in single.select("doc_id").collect()}
    assert got == {c for _, _, c in linked(rows, 80, 100, 5)}
    assert len(got) < len(rows) and single.columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert p.quality(spark, docs, str(tmp_path)).count() == len(ODD)
    spoken = p.language(spark, docs, str(tmp_path))
    assert {3, 4, 5, 10}.isdisjoint({r.doc_id for r in spoken.collect()})
    single = sorted((r.doc_id for r in p.near_duplicates(spark, docs, str(tmp_path)).collect()), key=repr)
    assert single == sorted([1, 3, 4, 5, 6, 8, 10, 11, None], key=repr)
    check_packing(p.packing(spark, docs, str(tmp_path)).collect(), [(r[0], r[1]) for r in ODD])
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_no_local_paths_or_local_checkpoints():
    root = Path(__file__).resolve().parents[2]
    for f in [*root.glob("taleforge/**/*.py"), root / "corpus_pipeline.py"]:
        assert ".localCheckpoint" not in f.read_text()
