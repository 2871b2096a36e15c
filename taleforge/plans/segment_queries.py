"""Queries over segments, blocks and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taleforge.functions import speech, text
from taleforge.operators import segments as ops
from taleforge.operators import timeline
from taleforge.plans.dressing import LINES, SEG, SPOKEN, TIMELINE, lines, seg, spoken, table
from taleforge.plans.dressing import timeline as timeline_rows
from taleforge.plans.registry import query

EDGE = r"[^\p{L}\p{N}_]"
_STEM = lambda verbs: rf"(?i)(^|{EDGE})({verbs})(ed|ing|s)?({EDGE}|$)"
_ACT = rf"""case when regexp_matches(context, '{_STEM(speech.SHOUT)}') then 'shouted:0.9' when regexp_matches(context, '{_STEM(speech.WHISPER)}') then 'whispered:0.9'
  when regexp_matches(context, '(?i)(^|{EDGE})({speech.THOUGHT})({EDGE}|$)') or regexp_matches(context, '(?i)(^|{EDGE})to\s+(her|him|them|it)self({EDGE}|$)') then 'thought:0.9'
  when regexp_matches(text, '!{{2,}}') or len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{3,}}') and w not in ({", ".join(f"'{w}'" for w in speech.NOT_SHOUTED)}))) > 0 then 'shouted:0.7' else 'spoken:0.5' end"""
_CONTEXT = """context as (select *, concat_ws(' ', left(lag(text, 2) over w, 200), left(lag(text, 1) over w, 200)) || ' ' || concat_ws(' ', left(lead(text, 1) over w, 200), left(lead(text, 2) over w, 200)) context
  from spoken window w as (partition by chapter order by pos))"""


@query("seg_context_speech_act", f"with {SPOKEN}, {_CONTEXT}, acts as (select {_ACT} a from context where type = 'dialogue') select split_part(a, ':', 1) act, split_part(a, ':', 2)::double confidence, count(*) n from acts group by all")
def seg_context_speech_act(spark, d):
    """W3, P16, A15."""
    acts = ops.speech_acts(spoken(spark, d)).where("act is not null")
    return acts.groupBy("act", F.col("act_confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query("low_conf_override", f"""with {SPOKEN}, {_CONTEXT}, acts as (select id, text, {_ACT} a from context where type = 'dialogue'), rules as (select id, text, split_part(a, ':', 1) act, split_part(a, ':', 2)::double confidence from acts)
  select id, case when confidence < 0.8 and id % 3 = 0 then 'thought' else act end act, case when confidence < 0.8 and id % 3 = 0 then 0.95 else confidence end::double confidence from rules""")
def low_conf_override(spark, d):
    """A model's answers for rows the rules are not sure of, by id."""
    rules = ops.speech_acts(spoken(spark, d)).where("act is not null").select("id", "act", F.col("act_confidence").alias("confidence"))
    model = rules.where("confidence < 0.8 and id % 3 = 0").select("id", F.lit("thought").alias("m_act"), F.lit(0.95).alias("m_conf"))
    return rules.join(model, "id", "left").select("id", F.coalesce("m_act", "act").alias("act"), F.coalesce("m_conf", "confidence").alias("confidence"))


_SIGNAL = """signals as (select *, case when regexp_matches(tag, '^h[1-6]$') or tag = 'hr' or divider or text = '***' then false
  when contains(text, '“') or contains(text, '”') then len(text) - len(replace(text, '“', '')) > len(text) - len(replace(text, '”', ''))
  when contains(text, '‘') or contains(text, '’') then len(text) - len(replace(text, '‘', '')) > len(text) - len(replace(text, '’', ''))
  when contains(text, '"') then (len(text) - len(replace(text, '"', ''))) % 2 = 1 end signal from lines),
state as (select *, coalesce(last_value(signal ignore nulls) over (partition by chapter order by pos rows between unbounded preceding and 1 preceding), false) was_open,
  coalesce(last_value(signal ignore nulls) over (partition by chapter order by pos rows between unbounded preceding and current row), false) now_open from signals)"""


@query("seg_carry_state", f"with {LINES}, {_SIGNAL} select chapter, pos, was_open, now_open from state")
def seg_carry_state(spark, d):
    """W1."""
    return ops.carry_state(lines(spark, d)).select("chapter", "pos", "was_open", F.col("open").alias("now_open"))


_TYPE = """case when regexp_matches(tag, '^h[1-6]$') then 'chapter_heading' when tag = 'hr' or divider or text = '***' then 'scene_break' when tag = 'blockquote' or was_open or regexp_matches(text, '["“”‘’]') then 'dialogue' else 'narration' end"""


@query("seg_block_classify", f"with {LINES}, {_SIGNAL} select chapter, {_TYPE} type, count(*) n, sum(pos) as pos_sum from state group by all")
def seg_block_classify(spark, d):
    """P1-P4 over W1."""
    return ops.classify_blocks(lines(spark, d)).groupBy("chapter", "type").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("seg_quote_split", f"""with {LINES}, parts as (select chapter, pos, text, list_filter(list_transform(case when regexp_matches(text, '[“”]') then regexp_extract_all(text, '“[^”]*(?:”|$)|[^“]+') else regexp_extract_all(text, '"[^"]*(?:"|$)|[^"]+') end, lambda p: trim(p, ' ')), lambda p: p <> '') p from lines where pos % 17 <> 16),
  typed as (select chapter, pos, case when len(p) <= 1 then [{{'type': 'dialogue', 'text': text}}] else list_transform(p, lambda x: {{'type': case when left(x, 1) = (case when regexp_matches(text, '[“”]') then '“' else '"' end) then 'dialogue' else 'narration' end, 'text': x}}) end q from parts)
  select chapter, pos, len(q)::int n, sum(len(u.text))::bigint chars, count_if(u.type = 'dialogue') quoted from (select chapter, pos, q, unnest(q) u from typed) group by chapter, pos, q""")
def seg_quote_split(spark, d):
    """T3, F1."""
    rows = lines(spark, d).where("pos % 17 <> 16").withColumn("q", speech.quote_parts(F.col("text")))
    return rows.select("chapter", "pos", F.size("q").alias("n"), F.explode("q").alias("u")).groupBy("chapter", "pos", "n").agg(F.sum(F.length("u.text")).alias("chars"), F.count_if(F.col("u.type") == "dialogue").alias("quoted"))


@query("seg_sentences", """with s as (select doc_id, unnest(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '\\b(Mr|Mrs|Ms|Dr|Prof|Capt|Col|Gen|Lt|Sgt|Rev|Hon|St|Jr|Sr|vs|etc|[A-Z])\\.', '\\1' || chr(1), 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[^.!?]+[.!?]*'), lambda x: regexp_replace(translate(x, chr(1), '.'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) s from documents) select doc_id, count(*) n, max(length(s))::int longest, count_if(length(s) > 280) long from s group by 1""")
def seg_sentences(spark, d):
    """T1 by rules: the trained splitter is not available."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(ops.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"), F.count_if(F.length("s") > 280).alias("long"))


@query("seg_ids", f"with {SEG} select book, chapter, pos, row_number() over (partition by book order by chapter, pos) - 1 as seq from seg")
def seg_ids(spark, d):
    """W2."""
    return ops.sequential_ids(seg(spark, d), book="book", chapter="chapter", order=["pos"]).select("book", "chapter", "pos", "seq")


@query("seg_chunk_pack", """with recursive s as (select doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '\\b(Mr|Mrs|Ms|Dr|Prof|Capt|Col|Gen|Lt|Sgt|Rev|Hon|St|Jr|Sr|vs|etc|[A-Z])\\.', '\\1' || chr(1), 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[^.!?]+[.!?]*'), lambda x: regexp_replace(translate(x, chr(1), '.'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') l from documents),
  f as (select doc_id, l, 1 i, 0 done, length(l[1]) now, 0 longest from s where len(l) > 0
   union all select doc_id, l, i + 1, case when now + 1 + length(l[i + 1]) > 580 then done + 1 else done end, case when now + 1 + length(l[i + 1]) > 580 then length(l[i + 1]) else now + 1 + length(l[i + 1]) end, longest from f where i < len(l))
  select doc_id, case when now < 200 and done > 0 then done else done + 1 end::int n from f where i = len(l)""")
def seg_chunk_pack(spark, d):
    """Sentences packed to 580 characters, a tail under 200 merged back."""
    rows = table(spark, d, "documents").select("doc_id", ops.packed(ops.sentences(F.col("text")), 580, 200).alias("c"))
    return rows.where(F.size("c") > 0).select("doc_id", F.size("c").alias("n"))


@query("chunk_sub_ids", f"with {SEG} select id || '.' || (u.i - 1) sub_id, id parent_id, length(u.t)::int n from (select id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'t': t, 'i': i}})) u from seg)")
def chunk_sub_ids(spark, d):
    """Parts of a segment with ids of their own and their parent's."""
    rows = seg(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("k", "part"))
    return rows.select(F.concat_ws(".", F.col("id").cast("string"), F.col("k").cast("string")).alias("sub_id"), F.col("id").alias("parent_id"), F.length("part").alias("n"))


_BLOCK = "select page_id, unnest(regexp_extract_all(html, '<(?:h1|p|li)[^>]*>([^<]*)<', 1)) t from pages"
_TOC = r"regexp_matches(s, '(?i)^table\s+of\s+contents$') or regexp_matches(s, '(?i)^(?:chapter\s+\d+\s*)+$') or (regexp_matches(s, '(?i)^(?:\d+\s+)*(?:chapter\s+\d+\s*)*(?:\d+\s*)*$') and length(s) > 10) or regexp_matches(trim(split_part(s, 'Chapter', 1)), '(?i)^table\s+of\s+contents$')"


@query("page_toc_filter", f"with b as ({_BLOCK}), c as (select page_id, case when length(t) % 11 = 0 then 'Chapter ' || length(t) || ' Chapter 7' when length(t) % 13 = 0 then 'Table of  Contents Chapter 1' when length(t) % 17 = 0 then '12 13 chapter 14 15' else t end s from b) select page_id, count(*) n, count_if({_TOC}) toc from c group by 1")
def page_toc_filter(spark, d):
    """P5: blocks dressed as entries of a table of contents are told from others."""
    t = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(?:h1|p|li)[^>]*>([^<]*)<"), 1)).alias("t"))
    n = F.length("t")
    s = F.when(n % 11 == 0, F.concat(F.lit("Chapter "), n.cast("string"), F.lit(" Chapter 7"))).when(n % 13 == 0, "Table of  Contents Chapter 1").when(n % 17 == 0, "12 13 chapter 14 15").otherwise(F.col("t"))
    return t.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(ops.toc_text(s)).alias("toc"))


@query("page_title", "with b as (select page_id, unnest(list_transform(regexp_extract_all(html, '<(?:h1|h2|h3)[^>]*>([^<]*)<', 1), lambda x, i: {'x': x, 'i': i})) u from pages), m as (select page_id, min_by(u.x, u.i) filter (where trim(u.x) <> '') title from b group by 1) select p.page_id, coalesce(title, '') title from pages p left join m using (page_id)")
def page_title(spark, d):
    """The first heading with text."""
    b = table(spark, d, "pages").select("page_id", F.posexplode_outer(F.regexp_extract_all("html", F.lit("<(?:h1|h2|h3)[^>]*>([^<]*)<"), 1)).alias("i", "x"))
    return b.groupBy("page_id").agg(F.coalesce(F.min_by("x", F.when(F.trim("x") != "", F.col("i"))), F.lit("")).alias("title"))


_CHAPTERS = """ch as (select conv_id book, turn pos, case when turn % 4 = 1 then 'Part ' || turn when turn % 4 = 2 then 'IX' else '' end opening, case when turn >= 5 then 'About the  Author' when turn = 4 then 'Epilogue' when turn % 4 = 1 then 'Part' else '' end headings, length(text) % 9 <> 0 has_body, conv_id % 5 = 0 and turn = 2 guide from conversations),
tests as (select *, not has_body or (headings <> '' and not regexp_matches(headings, '(?i)epilogue|afterword|coda|postscript') and regexp_matches(headings, '(?i)about\\s+the\\s+author')) droppable, regexp_matches(opening, '(?i)^part|^[ivxlcdm]+$') opens from ch)"""


@query("story_bounds", f"with {_CHAPTERS} select book, pos, pos >= coalesce(min(pos) filter (where guide) over (partition by book), min(pos) filter (where opens) over (partition by book), min(pos) over (partition by book)) and not bool_and(droppable) over (partition by book order by pos rows between current row and unbounded following) in_story from tests")
def story_bounds(spark, d):
    """P7, P8, W7."""
    turn = F.col("turn")
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("book"), turn.alias("pos"), F.when(turn % 4 == 1, F.concat(F.lit("Part "), turn.cast("string"))).when(turn % 4 == 2, "IX").otherwise("").alias("opening"),
        F.when(turn >= 5, "About the  Author").when(turn == 4, "Epilogue").when(turn % 4 == 1, "Part").otherwise("").alias("headings"), (F.length("text") % 9 != 0).alias("has_body"), ((F.col("conv_id") % 5 == 0) & (turn == 2)).alias("guide"),
    )
    return ops.story_bounds(c).select("book", "pos", "in_story")


@query("guide_suffix", "with g as (select conv_id book, 'text/ch' || (conv_id % 4) || '.html' href from conversations group by 1), n as (select conv_id book, turn pos, case when conv_id % 2 = 0 then 'OEBPS/text/ch' else 'ch' end || turn || '.html' as name from conversations) select n.book, min(pos) pos from g join n on g.book = n.book and (ends_with(n.name, g.href) or ends_with(g.href, n.name)) group by 1")
def guide_suffix(spark, d):
    """A guide's reference and a document's name, either a suffix of the other, within a book."""
    c = table(spark, d, "conversations")
    g = c.select(F.col("conv_id").alias("book"), F.concat(F.lit("text/ch"), (F.col("conv_id") % 4).cast("string"), F.lit(".html")).alias("href")).distinct()
    n = c.select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), F.concat(F.when(F.col("conv_id") % 2 == 0, "OEBPS/text/ch").otherwise("ch"), F.col("turn").cast("string"), F.lit(".html")).alias("name"))
    return n.join(g, "book").where(F.endswith("name", F.col("href")) | F.endswith("href", F.col("name"))).groupBy("book").agg(F.min("pos").alias("pos"))


@query("narrator_mode", f"""with {SEG}, told as (select book, (case when id % 2 = 0 then 'I said to myself, ' else 'They said ' end) || text as text, row_number() over (partition by book order by chapter, pos) n from seg where type = 'narration'),
  m as (select book, avg(case when text like 'I said%' or regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(I |my |me |mine )') then 1.0 else 0.0 end) s from told where n <= 20 group by 1)
  select distinct b.book, case when s > 0.3 then 'first_person' else 'third_person' end narrator_mode from seg b left join m using (book)""")
def narrator_mode(spark, d):
    """P23, W10."""
    s = seg(spark, d)
    s = s.withColumn("text", F.concat(F.when(F.col("id") % 2 == 0, "I said to myself, ").otherwise("They said "), "text"))
    return ops.narrator_mode(s, book="book", order=["chapter", "pos"])


@query("book_tone", f"""with {SEG}, told as (select book, (case when book % 3 = 0 then 'Dark blood. ' when book % 3 = 1 then 'A happy smile of joy. ' else '' end) || text as text, row_number() over (partition by book order by chapter, pos) n from seg where type = 'narration'),
  t as (select book, lower(string_agg(text, ' ' order by n)) t from told where n <= 10 group by 1),
  k as (select book, {", ".join("len(list_filter([" + ", ".join(f"'{w}'" for w in v) + f"], lambda w: contains(t, w))) {k}" for k, v in text.TONE_KEYWORDS.items())} from t)
  select distinct s.book, case when k.book is null then 'neutral' when dark > light and dark > romantic then 'dark' when light > dark and light > romantic then 'light' when romantic > dark and romantic > light then 'romantic' else 'literary' end tone from seg s left join k using (book)""")
def book_tone(spark, d):
    """P22, F20, W10."""
    s = seg(spark, d)
    s = s.withColumn("text", F.concat(F.when(F.col("book") % 3 == 0, "Dark blood. ").when(F.col("book") % 3 == 1, "A happy smile of joy. ").otherwise(""), "text"))
    return ops.book_tone(s, text.TONE_KEYWORDS, book="book", order=["chapter", "pos"])


@query("chapter_text_concat", f"with {SEG} select chapter, md5(string_agg('[' || upper(type) || '] ' || text, chr(10) order by pos)) digest, count(*) n from seg where trim(text, ' ') <> '' group by 1")
def chapter_text_concat(spark, d):
    """A20, A2."""
    s = seg(spark, d)
    n = s.where(F.length(text.strip("text")) > 0).groupBy("chapter").agg(F.count("*").alias("n"))
    return ops.chapter_text(s).join(n, "chapter").select("chapter", F.md5("chapter_text").alias("digest"), "n")


@query("token_budget", f"with {SEG}, t as (select chapter, pos, length(text) // 4 tokens from seg), r as (select *, sum(tokens) over (partition by chapter order by pos rows unbounded preceding) running_tokens from t) select chapter, pos, tokens::bigint tokens, running_tokens::bigint running_tokens from r where running_tokens <= 300")
def token_budget(spark, d):
    """F9, W8."""
    return ops.token_budget(seg(spark, d), key="chapter", order=["pos"], budget=300).select("chapter", "pos", "tokens", "running_tokens")


@query("chapter_filter", f"with {SEG} select chapter, count(*) n from seg where chapter = 3 group by 1 order by chapter")
def chapter_filter(spark, d):
    """P10, O8."""
    return seg(spark, d).where("chapter = 3").groupBy("chapter").agg(F.count("*").alias("n")).orderBy("chapter")


@query("non_dialogue_speaker", f"with {SEG} select id, case when type <> 'dialogue' then 'narrator' else 'unknown' end speaker, case when type <> 'dialogue' then 1.0 else 0.0 end::double confidence from seg")
def non_dialogue_speaker(spark, d):
    """P9, F19."""
    told = F.col("type") != "dialogue"
    return seg(spark, d).select("id", F.when(told, "narrator").otherwise("unknown").alias("speaker"), F.when(told, 1.0).otherwise(0.0).alias("confidence"))


@query("attribution_join", f"""with {SEG}, answers as (select id segment_id, 'a' || (id % 9) speaker, 0.5 confidence, 1 n from seg where id % 3 <> 0 union all select id, 'b' || (id % 4), 0.75, 2 from seg where id % 5 = 0),
  last as (select segment_id, max_by(speaker, n) speaker, max_by(confidence, n) confidence from answers group by 1)
  select s.id, case when type <> 'dialogue' then 'narrator' else coalesce(l.speaker, 'unknown') end speaker, case when type <> 'dialogue' then 1.0 else coalesce(l.confidence, 0.0) end::double confidence from seg s left join last l on l.segment_id = s.id""")
def attribution_join(spark, d):
    """Answers by segment, the last of repeated ones; without any the speaker is unknown."""
    s = seg(spark, d).select("id", "type")
    a = s.where("id % 3 <> 0").select("id", F.concat(F.lit("a"), (F.col("id") % 9).cast("string")).alias("speaker"), F.lit(0.5).alias("confidence"), F.lit(1).alias("n"))
    a = a.union(s.where("id % 5 = 0").select("id", F.concat(F.lit("b"), (F.col("id") % 4).cast("string")), F.lit(0.75), F.lit(2)))
    last = a.groupBy("id").agg(F.max_by(F.struct("speaker", "confidence"), "n").alias("l"))
    told = F.col("type") != "dialogue"
    return s.join(last, "id", "left").select("id", F.when(told, "narrator").otherwise(F.coalesce("l.speaker", F.lit("unknown"))).alias("speaker"), F.when(told, 1.0).otherwise(F.coalesce("l.confidence", F.lit(0.0))).alias("confidence"))


_PCT = lambda c: f"round_even(100.0 * count_if({c}) / count(*), 0)::bigint"


@query("confidence_bands", f"with {SEG} select book, count(*) n, {_PCT('confidence >= 0.8')} high_pct, {_PCT('confidence >= 0.5 and confidence < 0.8')} medium_pct, {_PCT('confidence < 0.5')} low_pct, count_if(confidence < 0.7) flagged from seg where type = 'dialogue' group by 1")
def confidence_bands(spark, d):
    """A9, P19, F17."""
    c, n = F.col("confidence"), F.count("*")
    pct = lambda x: F.bround(F.try_divide(100.0 * F.count_if(x), n), 0).cast("bigint")
    return seg(spark, d).where("type = 'dialogue'").groupBy("book").agg(n.alias("n"), pct(c >= 0.8).alias("high_pct"), pct((c >= 0.5) & (c < 0.8)).alias("medium_pct"), pct(c < 0.5).alias("low_pct"), F.count_if(c < 0.7).alias("flagged"))


_TW = "window w as (partition by chapter order by l_linenumber, l_partkey, l_suppkey, l_shipdate)"
_BOUNDARY = "case when lag(type) over w is null then null when type = 'chapter_heading' then 'chapter' when type = 'scene_break' or lag(type) over w = 'scene_break' then 'scene' when lag(speaker) over w is distinct from speaker then 'speaker_change' else 'paragraph' end"


@query("boundary_class", f"with {TIMELINE}, b as (select chapter, {_BOUNDARY} boundary from timeline {_TW}) select boundary, count(*) n, count(distinct chapter) chapters from b group by 1")
def boundary_class(spark, d):
    """W4."""
    return ops.boundaries(timeline_rows(spark, d)).groupBy("boundary").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))


@query("pause_limits", "select kind, mean_ms::double mean_ms, floor(least(greatest(mean_ms + std * 0.5, lo), hi))::int typical_ms, lo::int shortest_ms, hi::int longest_ms from (values ('paragraph', 450.0, 75, 300, 600), ('speaker_change', 600.0, 100, 400, 900), ('scene', 2200.0, 300, 1800, 3000), ('chapter', 3500.0, 400, 2800, 4500)) t(kind, mean_ms, std, lo, hi)")
def pause_limits(spark, d):
    """Pauses from fixed numbers in place of random ones."""
    kinds = spark.createDataFrame([(k, float(v[0])) for k, v in speech.PAUSES.items()], "kind string, mean_ms double")
    pause = lambda z: speech.pause_ms(F.col("kind"), F.lit(z))
    return kinds.select("kind", "mean_ms", pause(0.5).alias("typical_ms"), pause(-100.0).alias("shortest_ms"), pause(100.0).alias("longest_ms"))


@query("chapter_duration", f"with {TIMELINE} select chapter, (sum(duration * 1000) + sum(case when type = 'narration' then 450 else 0 end) + coalesce(max(case when type = 'chapter_heading' then 1500 end) + 800, 0) + 100)::bigint chapter_ms from timeline group by 1")
def chapter_duration(spark, d):
    """D11, M15."""
    t = timeline_rows(spark, d).select("chapter", (F.col("duration") * 1000).cast("bigint").alias("duration_ms"), F.when(F.col("type") == "narration", 450).alias("gap_ms"), F.when(F.col("type") == "chapter_heading", 1500).alias("announcement_ms"))
    return timeline.chapter_duration(t)


@query("chapter_offsets", "with c as (select l_suppkey book, l_orderkey chapter, sum(l_quantity) duration from lineitem group by all) select book, chapter, duration, sum(duration) over w end_at, sum(duration) over w - duration start_at from c window w as (partition by book order by chapter rows unbounded preceding)")
def chapter_offsets(spark, d):
    """W5, A11."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("chapter")).agg(F.sum("l_quantity").alias("duration"))
    return timeline.chapter_offsets(c, book="book")


@query("chapter_markers", "with c as (select l_suppkey book, l_orderkey chapter, sum(l_quantity) duration from lineitem group by all), o as (select book, chapter, sum(duration) over w e, sum(duration) over w - duration s, row_number() over (partition by book order by chapter) n from c window w as (partition by book order by chapter rows unbounded preceding)) select book, chapter, format('chp{:03d}', n - 1) mark, floor(s * 1000)::bigint start_ms, floor(e * 1000)::bigint end_ms from o")
def chapter_markers(spark, d):
    """S19."""
    return timeline.markers(chapter_offsets(spark, d), book="book")


@query("wav_paths", "select event_id, format('wavs/ch{:02d}/seg_{:04d}.wav', (event_id % 120)::int, event_id::int) path from events")
def wav_paths(spark, d):
    """S17."""
    return table(spark, d, "events").select("event_id", timeline.wav_path(F.col("event_id") % 120, F.col("event_id")).alias("path"))


@query("announcements", "with c as (select o_orderkey n, case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else o_orderpriority end title from orders), f as (select o_orderkey n, 'ann/' || o_orderkey || '.wav' path from orders where o_orderkey % 3 = 0) select c.n, case when coalesce(length(trim(title)), 0) > 0 then 'Chapter ' || c.n || ': ' || title else 'Chapter ' || c.n end said, path from c left join f using (n)")
def announcements(spark, d):
    """P27, J23."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    c = o.select(k.alias("n"), F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("title"))
    f = o.where(k % 3 == 0).select(k.alias("n"), F.concat(F.lit("ann/"), k.cast("string"), F.lit(".wav")).alias("path"))
    return c.join(f, "n", "left").select("n", timeline.announcement(F.col("n"), F.col("title")).alias("said"), "path")


@query("dry_run", f"with {SEG} select count(distinct chapter) chapters, count(*) segments, count(*) * 3.0::double audio_s, count(*) * 4.5::double work_s, count(*) * 144000 disk_bytes from seg")
def dry_run(spark, d):
    """P25, A22."""
    return timeline.dry_run(seg(spark, d))


@query("signal_rules", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, least(8, floor(l_quantity / 2))::int fade, case when (l_discount - 0.05) * 30 > 1.0 then 'peak' else '' end || case when (l_discount - 0.05) * 30 > 1.0 and l_tax * 100 > 6.0 then ',' else '' end || case when l_tax * 100 > 6.0 then 'loudness' else '' end flags, round(case when l_quantity * 20 < 400 then 0.0 else -19.0 + l_quantity end, 6) gain_db from lineitem")
def signal_rules(spark, d):
    """The rules; the signal chain itself is an external codec."""
    x = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    flags = timeline.mastering_flags(F.lit(0.0), (F.col("l_discount") - 0.05) * 30, F.col("l_tax") * 100, F.lit(0.0))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", timeline.fade_ms(q).alias("fade"), flags.alias("flags"), F.round(timeline.normalising_gain(-q, q * 20), 6).alias("gain_db"))


@query("delivery_params", "select event_type act, count(*) n, max(case event_type when 'whispered' then -4.5 when 'shouted' then 4.5 when 'thought' then -3.0 else 0.0 end)::double volume_db, max(case event_type when 'shouted' then 1.08 when 'thought' then 0.93 else 1.0 end)::double speed_factor from (select case event_type when 'error' then 'shouted' when 'view' then 'whispered' when 'click' then 'thought' when 'signup' then 'sung' else 'spoken' end event_type from events) group by 1")
def delivery_params(spark, d):
    """P24, D8."""
    e = table(spark, d, "events")
    t = F.col("event_type")
    act = F.when(t == "error", "shouted").when(t == "view", "whispered").when(t == "click", "thought").when(t == "signup", "sung").otherwise("spoken")
    return e.select(act.alias("act")).groupBy("act").agg(F.count("*").alias("n")).select("act", "n", speech.delivery(F.col("act")).alias("p")).select("act", "n", "p.volume_db", "p.speed_factor")


@query("batches_of_12", "select p_partkey, ((row_number() over (partition by p_brand order by p_partkey) - 1) // 12)::int batch, p_brand from part")
def batches_of_12(spark, d):
    """W13."""
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.floor((F.row_number().over(w) - 1) / 12).cast("int").alias("batch"), "p_brand")


@query("page_blocks")
def page_blocks(spark, d):
    """The blocks of all pages; tested on fixtures, the page format has no SQL parser."""
    from taleforge.sources.readers import page_blocks as blocks

    rows = blocks(table(spark, d, "pages"), key="page_id")
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("seg_pieces")
def seg_pieces(spark, d):
    """Sentences of all documents, long ones cut; tested against the limit and on fixtures."""
    from taleforge.functions.splitting import long_sentence_udf

    s = table(spark, d, "documents").select("doc_id", F.posexplode(ops.sentences(F.col("text"))).alias("k", "s"))
    p = s.select("doc_id", F.explode(long_sentence_udf()("s")).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("p")).alias("longest"), F.sum(F.length("p")).alias("chars"))


@query("seg_rows")
def seg_rows(spark, d):
    """The numbered rows of all chapters; tested against a plain loop over blocks."""
    rows = ops.segment_rows(lines(spark, d)).withColumn("book", F.col("chapter") % 16)
    rows = ops.sequential_ids(rows, book="book", chapter="chapter", order=["pos", "part", "sub"])
    return rows.groupBy("book", "chapter", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.min("seq").alias("first"))


@query("chapter_chunks")
def chapter_chunks(spark, d):
    """Whole documents cut to chunks of 4,000 characters."""
    from taleforge.functions.splitting import chapter_chunks_udf

    c = table(spark, d, "documents").select("doc_id", F.explode(chapter_chunks_udf(4000)("text")).alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("chars"))


@query("model_envelope")
def model_envelope(spark, d):
    """M1, M3-M9: one call for each distinct chapter text, answers by a deterministic stub."""
    from taleforge.operators.models import called

    texts = ops.chapter_text(seg(spark, d))
    done = called(texts, key="chapter", prompt="chapter_text", stage="extraction", required=("answer", "confidence"))
    return done.select("chapter", "cache_key", F.get_json_object("response", "$.answer").alias("answer"), "calls")


@query("synthesis_run")
def synthesis_run(spark, d):
    """Every segment through the engine interface."""
    from taleforge.operators.models import synthesized

    return synthesized(seg(spark, d).select("id", "text", "speaker", F.lit("narrator.wav").alias("clip")))
