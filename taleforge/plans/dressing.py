"""The test tables dressed as books, casts, clips and runs: each view in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark: SparkSession, d: str) -> DataFrame:
    """conversations as segments of chapters of sixteen books."""
    c = table(spark, d, "conversations")
    told = F.col("role") == "system"
    return c.select(
        (F.col("conv_id") % 16).cast("int").alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").cast("int").alias("pos"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
        F.when(told, "narration").otherwise("dialogue").alias("type"), "text",
        F.when(told, "narrator").otherwise(F.concat("role", F.lit("_"), (F.col("conv_id") % 7).cast("string"))).alias("speaker"), ((F.length("text") % 101) / 100.0).alias("confidence"),
    )


SEG = """seg as (select cast(conv_id % 16 as int) book, conv_id chapter, cast(turn as int) pos, conv_id * 100000 + turn id,
  case when role = 'system' then 'narration' else 'dialogue' end type, text,
  case when role = 'system' then 'narrator' else role || '_' || cast(conv_id % 7 as varchar) end speaker, (length(text) % 101) / 100.0::double confidence from conversations)"""


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """seg with verbs, marks and capitals of all kinds of speech acts."""
    s, k = seg(spark, d), F.col("id")
    lead = F.when(k % 11 == 0, "He shouted, ").when(k % 13 == 0, "she whispered, ").when(k % 17 == 0, "he wondered ").when(k % 19 == 0, "he hummed to  himself ").when(k % 23 == 0, "STOP the FBI ").when(k % 29 == 0, "OK USA ").otherwise("")
    return s.withColumn("text", F.concat(lead, "text", F.when(k % 31 == 0, "!!").otherwise("")))


SPOKEN = f"""{SEG}, spoken as (select * replace (case when id % 11 = 0 then 'He shouted, ' when id % 13 = 0 then 'she whispered, ' when id % 17 = 0 then 'he wondered ' when id % 19 = 0 then 'he hummed to  himself ' when id % 23 = 0 then 'STOP the FBI ' when id % 29 = 0 then 'OK USA ' else '' end || text || case when id % 31 = 0 then '!!' else '' end as text) from seg)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """documents as chapters of paragraphs, some of them with quotes or as scene breaks."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.when(F.col("pos") % 17 == 16, "***").when(F.col("pos") % 5 == 0, F.concat(F.lit("“"), "line")).when(F.col("pos") % 5 == 3, F.concat("line", F.lit("”"))).otherwise(F.col("line"))
    tag = F.when(F.col("pos") % 23 == 0, "h2").when(F.col("pos") % 29 == 7, "blockquote").when(F.col("pos") % 31 == 11, "hr").otherwise("p")
    classes = F.when(F.col("pos") % 37 == 5, F.array(F.lit("divider"))).otherwise(F.array(F.lit("plain")))
    return rows.select("chapter", "pos", tag.alias("tag"), text.alias("text"), classes.alias("classes"))


LINES = """raw_lines as (select doc_id chapter, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
lines as (select chapter, cast(pos as int) pos, case when pos % 23 = 0 then 'h2' when pos % 29 = 7 then 'blockquote' when pos % 31 = 11 then 'hr' else 'p' end tag,
  case when pos % 17 = 16 then '***' when pos % 5 = 0 then '“' || line when pos % 5 = 3 then line || '”' else line end as text, pos % 37 = 5 divider from raw_lines)"""


def chars(spark: SparkSession, d: str) -> DataFrame:
    """part as character profiles of chapters."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_size").alias("chapter"), k.alias("pos"), k.alias("idx"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"),
        F.when(k % 3 == 0, "male").when(k % 3 == 1, "female").otherwise("unknown").alias("gender"), F.when(k % 4 == 0, "child").when(k % 4 == 1, "elderly").otherwise("unknown").alias("age_range"),
        F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("traits"), F.concat_ws(" ", "p_name", "p_type").alias("description"), (k % 5 != 0).alias("is_named"),
    )


CHARS = """chars as (select p_size chapter, p_partkey pos, p_partkey idx, p_name as name, [p_brand] aliases,
  case p_partkey % 3 when 0 then 'male' when 1 then 'female' else 'unknown' end gender, case p_partkey % 4 when 0 then 'child' when 1 then 'elderly' else 'unknown' end age_range,
  string_split(p_name || ' ' || lower(p_type), ' ') traits, p_name || ' ' || p_type description, p_partkey % 5 <> 0 is_named from part)"""


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """part as trait lists of three annotators about the brands' speakers."""
    p = table(spark, d, "part")
    more = F.when(F.col("p_partkey") % 50 < 2, F.array(F.lit("very masculine"))).when(F.col("p_size") % 7 == 3, F.array(F.lit("slightly feminine"), F.lit("young"))).otherwise(F.array(F.lit("calm")))
    some = F.when(F.substring("p_brand", -1, 1).isin("1", "2", "3"), more).otherwise(F.array(F.lit("calm")))
    return p.select(F.col("p_brand").alias("speaker"), (F.col("p_partkey") % 3).alias("annotator"), F.concat(F.split("p_name", " "), some).alias("traits"))


ANNOTATIONS = """annotations as (select p_brand speaker, p_partkey % 3 annotator, list_concat(string_split(p_name, ' '), case when right(p_brand, 1) in ('1', '2', '3') then
  case when p_partkey % 50 < 2 then ['very masculine'] when p_size % 7 = 3 then ['slightly feminine', 'young'] else ['calm'] end else ['calm'] end) traits from part)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """events as results of a run of each user."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("took_s"), "ts", "event_type")


RUNS = "runs as (select event_id id, user_id run, case when event_type = 'error' then 'failed' else 'completed' end status, value took_s, ts, event_type from events)"


def clips(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as clips of suppliers' speakers; ord has no ties."""
    x = table(spark, d, "lineitem")
    path = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    return x.select(F.col("l_suppkey").alias("speaker"), F.col("l_quantity").alias("duration"), path.alias("path"), (F.col("l_quantity") * 30000).cast("bigint").alias("bytes"), (F.col("l_discount") * 400).alias("snr"), (F.col("l_extendedprice") / 10).alias("pitch"), (F.col("l_tax") / 10).alias("energy"), F.col("l_linenumber").cast("double").alias("rate"))


CLIPS = """clips as (select l_suppkey speaker, l_quantity duration, l_suppkey || '/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || strftime(l_shipdate, '%Y%m%d') path,
  cast(l_quantity * 30000 as bigint) bytes, l_discount * 400 snr, l_extendedprice / 10 pitch, l_tax / 10 energy, l_linenumber::double rate from lineitem)"""


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as attributed segments of orders' chapters."""
    x = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") == 7, "scene_break").when(F.col("l_returnflag") == "R", "narration").when(F.col("l_returnflag") == "A", "dialogue").otherwise("chapter_heading")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return x.select(F.col("l_orderkey").alias("chapter"), order.alias("pos"), (F.col("l_suppkey") % 5).alias("speaker"), kind.alias("type"), F.col("l_quantity").alias("duration"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


TIMELINE = """timeline as (select l_orderkey chapter, l_suppkey % 5 speaker, case when l_linenumber = 7 then 'scene_break' when l_returnflag = 'R' then 'narration' when l_returnflag = 'A' then 'dialogue' else 'chapter_heading' end type,
  l_quantity duration, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem)"""


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """speakers of seg assigned to few voices."""
    n = seg(spark, d).where(F.col("type") == "dialogue").groupBy(F.col("speaker").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.select("name", F.concat(F.lit("v"), (F.length("name") % 2 + F.col("n") % 3).cast("string")).alias("speaker"), ((F.col("n") % 10) / 10.0).alias("confidence"), F.col("first").alias("pos"), (F.col("n") % 2 == 0).alias("is_major"))


ASSIGNMENTS = """assignments as (select speaker as name, 'v' || cast(length(speaker) % 2 + count(*) % 3 as varchar) speaker, (count(*) % 10) / 10.0::double confidence, min(id) pos, count(*) % 2 = 0 is_major
  from seg where type = 'dialogue' group by seg.speaker)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("speaker"), F.col("embedding").alias("vector"), "label")
