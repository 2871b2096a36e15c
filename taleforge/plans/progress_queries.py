"""Queries of resumable runs, files, formats and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleforge.functions import text
from taleforge.functions import vectors as v
from taleforge.operators import progress as ops
from taleforge.plans.dressing import RUNS, SEG, runs, seg, table
from taleforge.plans.registry import query
from taleforge.sources.readers import piped_metadata


@query("pending_anti", f"with {RUNS} select id from runs where status <> 'completed' or id % 5 = 0")
def pending_anti(spark, d):
    """J9, X1."""
    r = runs(spark, d)
    return ops.pending(r.select("id"), r.where("id % 5 <> 0"))


@query("checkpoint_upsert", "select l_suppkey id, max(l_orderkey * 1000000 + l_partkey) seq, count(*) > 0 known from lineitem group by 1")
def checkpoint_upsert(spark, d):
    """The newest state of each key."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("seq"), F.lit(True).alias("known"))
    return ops.upserted(x.where("seq % 2 = 0"), x.where("seq % 2 = 1")).select("id", "seq", "known")


@query("requeue_missing", f"with {RUNS}, files as (select 'w/' || event_id path from events where event_id % 7 <> 0 and event_id % 11 <> 0) select id, case when status = 'completed' and f.path is null then 'pending' else status end status from runs left join files f on f.path = 'w/' || id")
def requeue_missing(spark, d):
    """Lost and empty files."""
    state = runs(spark, d).select("id", "status", F.concat(F.lit("w/"), F.col("id").cast("string")).alias("wav"))
    files = table(spark, d, "events").where("event_id % 7 <> 0").select(F.concat(F.lit("w/"), F.col("event_id").cast("string")).alias("path"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(10).alias("length"))
    return ops.requeued(state, files).select("id", "status")


@query("engine_compat", "select o_orderkey id, case when o_orderstatus = 'F' then 'resume' else 'archive' end as action from orders")
def engine_compat(spark, d):
    """X3."""
    return ops.compatible(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("engine")), "F").select("id", "action")


@query("retry_attempts", "with a as (select l_orderkey id, l_linenumber attempt, bool_or(l_returnflag = 'A') ok from lineitem where l_linenumber <= 3 group by all) select id, count(*) attempts, min(attempt) filter (where ok) succeeded_at, case when bool_or(ok) then 'completed' else 'failed' end status from a group by 1")
def retry_attempts(spark, d):
    """X4, M14."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("attempt")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("ok"))
    return ops.retried(a, most=3).select("id", "attempts", "succeeded_at", "status")


@query("rolling_eta", f"with {RUNS}, g as (select *, row_number() over (partition by run order by id) done, avg(took_s) over (partition by run order by id rows between 19 preceding and current row) m from runs where status = 'completed'), t as (select run, count(*) total from runs group by 1) select id, run, done::int done, round(m * (total - done) + 1e-7, 2) eta_s from g join t using (run)")
def rolling_eta(spark, d):
    """W6, X9."""
    r = runs(spark, d)
    total = r.groupBy("run").agg(F.count("*").alias("total"))
    return ops.rolling_eta(r.join(total, "run"), total=F.col("total"), by=["run"]).select("id", "run", "done", F.round(F.col("eta_s") + 1e-7, 2).alias("eta_s"))


@query("failure_guard", f"with {RUNS}, g as (select id, run, count(*) over w processed, sum(case when status = 'failed' then 1 else 0 end) over w failed from runs window w as (partition by run order by id rows unbounded preceding)) select id, run, processed, failed::bigint failed, processed >= 20 and failed / processed > 0.15 stop from g")
def failure_guard(spark, d):
    """W12, A18, X5."""
    return ops.failure_guard(runs(spark, d), by=["run"]).select("id", "run", "processed", "failed", "stop")


@query("cache_hits", "with c as (select distinct sha256('attribution:' || text) k, length(text) v from documents where doc_id % 3 = 0) select doc_id, sha256('attribution:' || text) cache_key, c.v is not null hit from documents left join c on c.k = sha256('attribution:' || text)")
def cache_hits(spark, d):
    """S14, F10, X6."""
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 3 = 0").select(text.cache_key("attribution", "text").alias("key"), F.length("text").alias("value")).distinct()
    return ops.cached(docs.select("doc_id", "text"), cache, "attribution", "text").select("doc_id", "cache_key", F.col("value").isNotNull().alias("hit"))


@query("speaker_batches", f"with {SEG} select speaker, id, count(*) over (partition by speaker) batch, min(id) over (partition by speaker) first_id from seg")
def speaker_batches(spark, d):
    """A5: the batch order is (batch desc, first_id, id)."""
    return ops.speaker_batches(seg(spark, d))


@query("log_lines", "select strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' | ' || upper(event_type) || ' | ' || 'user ' || user_id line from events")
def log_lines(spark, d):
    """S21, F18."""
    return ops.log_lines(table(spark, d, "events"), at="ts", level="event_type", message=F.concat(F.lit("user "), F.col("user_id").cast("string")))


@query("slugify", r"""select p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(t), ' ', '-'), '_', '-'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g') slug,
  case when p_partkey % 10 = 0 then format('{:02d}-chapter-{}', p_size, p_size) else format('{:02d}-', p_size) || regexp_replace(regexp_replace(replace(lower(p_name), ' ', '-'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g') end chapter from (select *, p_name || '_(' || p_type || ')  - ' || p_brand as t from part)""")
def slugify(spark, d):
    """F8."""
    p = table(spark, d, "part")
    t = F.concat("p_name", F.lit("_("), "p_type", F.lit(")  - "), "p_brand")
    return p.select("p_partkey", text.book_slug(t).alias("slug"), text.chapter_slug(F.when(F.col("p_partkey") % 10 == 0, " ! ").otherwise(F.col("p_name")), "p_size").alias("chapter"))


@query("format_durations", """with s as (select o_orderkey, floor(o_totalprice / 10)::bigint s, (o_totalprice * 3000)::double b from orders) select o_orderkey, case when s >= 3600 then format('{}h {:02d}m {:02d}s', s // 3600, s % 3600 // 60, s % 60) else format('{}m {:02d}s', s // 60, s % 60) end took,
  case when b >= 1073741824 then printf('%.1f GB', b / 1073741824) when b >= 1048576 then printf('%.1f MB', b / 1048576) else printf('%.1f KB', b / 1024) end size from s""")
def format_durations(spark, d):
    """F13, A11."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", text.clock(F.col("o_totalprice") / 10).alias("took"), text.byte_size(F.col("o_totalprice") * 3000).alias("size"))


@query("scalar_rules", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(power(10.0, (l_discount * 100 - 5) / 20), 6) gain, round(20 * log10(greatest(l_tax, 1e-10)), 6) db, round_even(l_quantity / 2, 0) half_even, case l_linenumber % 4 when 0 then 'image/png' when 1 then 'image/gif' else 'image/jpeg' end mime, l_linenumber % 3 = 0 placeholder from lineitem")
def scalar_rules(spark, d):
    """F16, F17, F21, P12."""
    x = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    path = F.concat(F.lit("cover"), F.when(n % 4 == 0, ".PNG").when(n % 4 == 1, ".gif").when(n % 4 == 2, ".webp").otherwise(".jpg"))
    clip = F.when(n % 3 == 0, "AUDIO_DIR/x.wav").otherwise("x/AUDIO_DIR/x.wav")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.round(v.gain(F.col("l_discount") * 100 - 5), 6).alias("gain"), F.round(v.decibel(F.col("l_tax")), 6).alias("db"), v.half_even(F.col("l_quantity") / 2).alias("half_even"), text.mime_type(path).alias("mime"), F.startswith(clip, F.lit("AUDIO_DIR/")).alias("placeholder"))


@query("fence_strip", r"""select event_id, (props->>'$.k')::int k from events""")
def fence_strip(spark, d):
    """JSON answers inside code fences."""
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  ```\n"), "props", F.lit("```  "))).otherwise(F.col("props"))
    return e.select("event_id", F.from_json(text.fence_stripped(said), "k int")["k"].alias("k"))


@query("split_lookup", "with m as (select l_suppkey::varchar speaker, max_by(l_returnflag, l_orderkey * 1000000 + l_partkey) split from lineitem group by 1), need as (select s_suppkey::varchar speaker from supplier union all select 'x' || s_suppkey from supplier where s_suppkey % 9 = 0) select speaker, split, split is null unmapped from need left join m using (speaker) where speaker not in (select s_suppkey::varchar from supplier where s_suppkey % 4 = 0)")
def split_lookup(spark, d):
    """Needed speakers without those at hand, with their split if it is known; the last line of a key counts."""
    x = table(spark, d, "lineitem")
    k, at = F.col("l_suppkey").cast("string"), F.col("l_orderkey") * 1000000 + F.col("l_partkey")
    lines = x.select(F.concat_ws(" | ", k, F.lit("x"), "l_returnflag").alias("value"), at.alias("pos"))
    lines = lines.union(x.select(F.concat(F.lit("; "), k, F.lit(" | x | none")), at + 10**15)).union(x.select(F.concat(k, F.lit(" | none")), at + 10**15))
    known = piped_metadata(lines).toDF("speaker", "split")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    need = s.select(F.col("k").cast("string").alias("speaker")).union(s.where("k % 9 = 0").select(F.concat(F.lit("x"), F.col("k").cast("string"))))
    at_hand = s.where("k % 4 = 0").select(F.col("k").cast("string").alias("speaker"))
    return need.join(at_hand, "speaker", "left_anti").join(known, "speaker", "left").select("speaker", "split", F.col("split").isNull().alias("unmapped"))


@query("remote_scan", "select l_suppkey speaker, l_quantity duration, l_shipdate from lineitem where l_suppkey in (3, 17, 42)")
def remote_scan(spark, d):
    """The list of speakers is pushed into the scan, which reads three columns."""
    return table(spark, d, "lineitem").where(F.col("l_suppkey").isin(3, 17, 42)).select(F.col("l_suppkey").alias("speaker"), F.col("l_quantity").alias("duration"), "l_shipdate")


@query("directory_totals", "select l_suppkey speaker, count(*) files, sum(l_quantity * 1000)::bigint bytes from lineitem group by 1")
def directory_totals(spark, d):
    """A19, C5."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("speaker")).agg(F.count("*").alias("files"), F.sum(F.col("l_quantity") * 1000).cast("bigint").alias("bytes"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(spark, d):
    """Extension beyond the reference: the batch form of the event-time stream in streaming/."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
