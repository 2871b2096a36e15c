"""Queries of sources and sinks: the test tables written as the files that a source reads, and read back."""

from __future__ import annotations

import io
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from taleforge.functions import signal
from taleforge.operators.entities import shared_path
from taleforge.operators.models import chosen
from taleforge.operators.progress import made_once
from taleforge.operators.voices import voice_references
from taleforge.plans.dressing import SEG, seg, table
from taleforge.plans.registry import query
from taleforge.sources import readers

#: Clips: samples a second and samples of their quiet beginning (whole frames).
RATE, QUIET = 8000, 5760


def _epub(book: int, turns: list) -> bytes:
    """A book of turns: some documents are not linear or missing, some books have no title, author, cover or end."""
    items, refs = "", ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        for t in turns:
            n = t["turn"]
            items += f'<item id="t{n}" href="text/t{n}.xhtml" media-type="application/xhtml+xml"/>'
            refs += f'<itemref idref="t{n}"' + (' linear="no"/>' if n % 5 == 4 else "/>")
            if n % 7 != 6:
                z.writestr(f"OEBPS/text/t{n}.xhtml", f"<p>{t['text']}</p>")
        meta = f"<title>Book {book}</title>" * (book % 4 > 0) + f"<creator>Author {book % 10}</creator>" * (book % 3 > 0)
        if book % 2 == 0:
            meta += '<meta name="cover" content="c"/>'
            items += '<item id="c" href="images/cover.png" media-type="image/png"/>'
        guide = '<guide><reference type="text" href="text/t1.xhtml#start"/></guide>' * (book % 5 == 0)
        z.writestr("OEBPS/book.opf", f"<package><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{refs}</spine>{guide}</package>")
    data = out.getvalue()
    return data[: len(data) // 2] if book % 11 == 10 else data


@query("epub_spine", """select conv_id::varchar book_id, (row_number() over (partition by conv_id order by turn) - 1)::int spine_pos, 'OEBPS/text/t' || turn || '.xhtml' href, case when conv_id % 4 = 0 then 'Unknown Title' else 'Book ' || conv_id end title,
  case when conv_id % 3 = 0 then 'Unknown Author' else 'Author ' || conv_id % 10 end author, conv_id % 5 = 0 and turn = 1 guide, case when conv_id % 2 = 0 then 'OEBPS/images/cover.png' end cover, case when conv_id % 2 = 0 then 'image/png' end cover_mime, md5('<p>' || text || '</p>') digest
  from conversations where conv_id % 11 <> 10 and turn % 5 <> 4 and turn % 7 <> 6""")
def epub_spine(spark, d):
    """Conversations as EPUB files; linear documents in order with title, author, guide and cover."""

    @F.pandas_udf("binary")
    def made(book: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series([_epub(b, t) for b, t in zip(book, turns, strict=True)])

    books = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    files = books.select(F.concat(F.lit("books/"), F.col("conv_id").cast("string"), F.lit(".epub")).alias("path"), made("conv_id", "t").alias("content"))
    return readers.epub_documents(files).select("book_id", "spine_pos", "href", "title", "author", "guide", "cover", "cover_mime", F.md5("html").alias("digest"))


@query("annotation_files", """select p_brand speaker, p_partkey % 3 annotator, replace(p_name, ' ', ',') || ',calm' traits, count(*) n from part where p_partkey % 10 not in (7, 8) group by all""")
def annotation_files(spark, d):
    """Three annotators' files with spaces, empty traits, and lines of one or three fields, which are skipped."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    traits = F.concat(F.lit(" "), F.array_join(F.split("p_name", " "), " , "), F.lit(",, calm ,"))
    line = F.when(k % 10 == 7, F.col("p_brand")).when(k % 10 == 8, F.concat_ws("|", "p_brand", traits, F.lit("more"))).otherwise(F.concat_ws("|", "p_brand", traits))
    paths = [shared_path(spark, f"annotator-{n}") for n in range(3)]
    for n, path in enumerate(paths):
        p.where(k % 3 == n).select(line.alias("value")).write.text(path)
    rows = readers.read_annotations(spark, paths)
    return rows.select("speaker", F.col("annotator").cast("bigint").alias("annotator"), F.array_join("traits", ",").alias("traits")).groupBy("speaker", "annotator", "traits").agg(F.count("*").alias("n"))


@query("stage_documents", f"with {SEG} select id, book, chapter, pos, type, speaker, confidence, md5(text) digest from seg")
def stage_documents(spark, d):
    """Segments written as JSON by book and read with a fixed schema."""
    path = shared_path(spark, "segments-json")
    readers.write_documents(seg(spark, d), path, by=["book"])
    rows = readers.read_documents(spark, path, "id bigint, chapter bigint, pos int, type string, speaker string, confidence double, text string, book int", lines=True)
    return rows.select("id", "book", "chapter", "pos", "type", "speaker", "confidence", F.md5("text").alias("digest"))


@query("override_files", "select n_name as name, case when n_nationkey % 3 <> 0 then 'v' || n_nationkey end speaker_id, case when n_nationkey % 2 = 0 then 'deep' end pitch from nation")
def override_files(spark, d):
    """A file of overrides with comments and blank lines."""
    n = F.col("n_nationkey")
    voice = F.when(n % 3 != 0, F.concat(F.lit("    speaker_id: 'v"), n.cast("string"), F.lit("'  # chosen by hand\n"))).otherwise("\n")
    profile = F.when(n % 2 == 0, "    voice_profile:\n      pitch: deep\n").otherwise("    # no profile\n")
    entry = F.concat(F.lit("  "), "n_name", F.lit(":\n"), voice, profile)
    file = table(spark, d, "nation").agg(F.concat(F.lit("characters:\n"), F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("value"))
    path = shared_path(spark, "overrides")
    file.coalesce(1).write.text(path)
    return readers.read_overrides(spark, path).select("name", "speaker_id", F.try_element_at("voice_profile", F.lit("pitch")).alias("pitch"))


@query("directory_sizes", "select n_nationkey k, (strlen(n_name) + 1)::bigint length from nation")
def directory_sizes(spark, d):
    """The files of a directory with their sizes; their contents are not read."""
    path = shared_path(spark, "directory")
    table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    files = readers.read_directory(spark, path, "*.txt")
    return files.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("bigint").alias("k"), "length")


@query("clip_transcripts", "select s_suppkey k, case when s_suppkey % 3 <> 0 then s_name end transcript from supplier")
def clip_transcripts(spark, d):
    """Clips beside the transcript of the same stem, trimmed."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, d, "supplier")
    files = s.select("s_suppkey", F.concat(F.lit("a.b/"), k, F.lit(".wav")).alias("path"))
    notes = s.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("a.b/"), k, F.lit(".normalized.txt")).alias("path"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("transcript"))
    return readers.with_transcripts(files, notes).select(F.col("s_suppkey").alias("k"), "transcript")


@query("env_lines", "select 'K' || n_nationkey as key, n_name || '=x' as value from nation where n_nationkey % 5 <> 0 and n_nationkey % 7 <> 3")
def env_lines(spark, d):
    """Settings that are not known yet; comments and lines without a key are skipped, the first of a key counts."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    one = F.concat(F.when(k % 7 == 3, " # K").otherwise("  K"), k.cast("string"), F.lit(" = "), "n_name", F.lit("=x "))
    lines = n.select(F.explode(F.array(F.struct(one.alias("value"), k.alias("pos")), F.struct(F.when(k % 7 == 3, "= none").otherwise(F.concat(F.lit("K"), k.cast("string"), F.lit("=later"))).alias("value"), (k + 1000).alias("pos")), F.struct(F.lit("none").alias("value"), (k + 2000).alias("pos")))).alias("l")).select("l.*")
    return readers.env_values(lines, n.where(k % 5 == 0).select(F.concat(F.lit("K"), k.cast("string")).alias("key")))


@query("streamed_scan", """with e as (select event_id, user_id, event_type <> 'error' has_content, user_id % 40 = 7 wanted from events), f as (select user_id, min(event_id) filter (where has_content) first from e where wanted group by 1),
  c as (select case when count(*) = count(first) then max(first) end complete from f), r as (select event_id, row_number() over (order by event_id) n from e, c where event_id >= complete and (not wanted or has_content)), z as (select min(event_id) stop from r where n = 101)
  select event_id, user_id from e, z where wanted and has_content and (stop is null or event_id <= stop)""")
def streamed_scan(spark, d):
    """Rows of wanted users that a scan sees which ends a hundred rows after all of them were found."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("has_content"))
    return readers.scanned_rows(e, e.where("user_id % 40 = 7").select("user_id"), key="user_id", order="event_id").select("event_id", "user_id")


def _clip(k: int) -> bytes:
    """A quiet beginning, then a loud rest; broken clips have no header."""
    n = RATE * (2 + k % 3)
    if k % 7 == 3:
        return bytes(n)
    x = np.full(n, 8000 + 100 * (k % 50), "<i2")
    x[:QUIET] = 20 + k % 50
    x[1::2] *= -1
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(RATE)
        f.writeframes(x.tobytes())
    return out.getvalue()


def _clips(spark, d):
    @F.pandas_udf("binary")
    def made(k: pd.Series) -> pd.Series:
        return pd.Series([_clip(n) for n in k])

    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.concat(F.lit("c/"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("path"), made("s_suppkey").alias("content"))


_CLIPS = f"""c as (select s_suppkey k, s_name, s_suppkey % 7 = 3 broken, {RATE} * (2 + s_suppkey % 3) n, (8000 + 100 * (s_suppkey % 50))::double loud, (20 + s_suppkey % 50)::double quiet from supplier)"""


@query("clip_levels", f"with {_CLIPS} select k, case when broken then round(n / 48000.0::double, 9) else n / {RATE}.0::double end duration_s, case when broken then 0.0 else round(20 * log10(sqrt(({QUIET} * quiet * quiet + (n - {QUIET}) * loud * loud) / n) / quiet), 6) end::double snr_db, case when not broken then round(20 * log10(loud / quiet), 1) end::double reference_db from c")
def clip_levels(spark, d):
    """Lengths and levels of clips, broken ones by their size."""
    c = _clips(spark, d).select("s_suppkey", signal.duration_udf()("content").alias("duration_s"), signal.clip_metrics_udf()("content").alias("m"), signal.reference_snr_udf()("content").alias("reference_db"))
    return c.select(F.col("s_suppkey").alias("k"), F.round("duration_s", 9).alias("duration_s"), F.round("m.snr_db", 6).alias("snr_db"), "reference_db")


@query("voice_table", f"with {_CLIPS} select 'n' || k as name, 'c/' || k || '.wav' path, case when k % 2 = 0 then s_name end transcript, case when k % 9 = 1 then 0.0 when broken then round(n / 48000.0::double, 9) else n / {RATE}.0::double end::double duration_s, case when not broken and k % 9 <> 1 then round(20 * log10(loud / quiet), 1) end::double snr_score, false noisy from c")
def voice_table(spark, d):
    """Clip, transcript, length and level of each voice; some clips and transcripts are missing."""
    c = _clips(spark, d)
    names = c.select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"), "path")
    notes = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("c/"), F.col("s_suppkey").cast("string"), F.lit(".normalized.txt")).alias("path"), F.col("s_name").alias("transcript"))
    return voice_references(names, c.where("s_suppkey % 9 <> 1"), notes).withColumn("duration_s", F.round("duration_s", 9))


@query("valid_choice", "with t as (select c_custkey k, length(c_name) + c_custkey n from customer), a as (select k, n, list_filter([1, 2, 3], lambda i: (n + i * i) % 7 < 3) ok from t) select k, case when len(ok) > 0 then 'v' || (n + ok[1] * ok[1]) % 7 end choice, case when len(ok) > 0 then ok[1] else 3 end::int calls from a")
def valid_choice(spark, d):
    """A model's choice among valid ids, asked three times at most."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.length("c_name") + F.col("c_custkey")).cast("string").alias("p"), F.array(*[F.lit(f"v{i}") for i in range(3)]).alias("ids"))
    return chosen(c, key="k", prompt="p", ids="ids", client=lambda said, n: f"v{(int(said) + n * n) % 7}")


@query("stage_skip", "select r_regionkey k, r_name as name from region")
def stage_skip(spark, d):
    """A stage whose output exists is not made again."""
    path = shared_path(spark, "stage")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    made_once(spark, path, lambda: r)
    return made_once(spark, path, lambda: r.limit(0))
