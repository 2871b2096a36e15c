"""Licence scan: passages of a text against licence templates by the Dice coefficient of word bigrams.

DataFrame functions only, one row in and one row out, no shuffle. A text's passages are its lines, its
paragraphs (between blank lines) and the whole. A passage is normalised (lower case, runs of anything but
a-z and 0-9 become one space); its bigrams count with their multiplicity, so a passage of w words has
w - 1. Dice >= t needs t / (2 - t) <= size / template size <= (2 - t) / t: other templates are pruned by
the word count alone, before any bigram is made.

A licence within a longer passage is found by windows: stretches of the whole text's bigrams as long as the
template, laid wherever one of its bigrams meets the template's own. A window can only reach t if the text holds
nearly t / (2 - t) of the template's distinct bigrams, and so can a passage of it: other templates are pruned first.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleforge.llm.license_templates import TEMPLATES

THRESHOLD = 0.8


def normalised(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ").split(" ")


def bigrams(words: list[str]) -> list[str]:
    """Each bigram with the number of its earlier occurrences, so that a set of them stands for the multiset."""
    seen: Counter[str] = Counter()
    out = []
    for a, b in zip(words, words[1:], strict=False):
        out.append(f"{a} {b}#{seen[f'{a} {b}']}")
        seen[f"{a} {b}"] += 1
    return out


def dice(a: list[str], b: list[str]) -> float:
    x, y = set(bigrams(a)), set(bigrams(b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def needed(template: list[str], threshold: float) -> int:
    """Distinct bigrams of a template (its bigrams in order) that a text must hold for some window to reach the threshold."""
    return max(1, len(set(template)) - int((1 - threshold / (2 - threshold)) * len(template) + 1e-9))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """(id_col, license_id, dice, n_passages, licenses) of every row.

    license_id: the template of the best passage or window (ties: the later name in code-point order), null if none
    reaches the threshold; dice: its coefficient; n_passages: distinct passages that match some template (windows
    overlap and are not counted); licenses: all template names found, sorted. Null and empty texts match nothing (n_passages 0). Rows
    may repeat; other columns, whatever their names, are not read.
    """
    made = [{"name": k, "b": bigrams(normalised(v))} for k, v in (templates or TEMPLATES).items()]
    made = [t | {"n": len(t["b"]), "s": [x.rpartition("#")[0] for x in t["b"]]} for t in made if t["b"]]
    made = [t | {"p": sorted(set(t["s"])), "need": needed(t["s"], threshold)} for t in made]
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9  # a little room for rounding
    least, most = min(t["n"] for t in made) * low, max(t["n"] for t in made) * high
    kinds = "array<struct<name:string,b:array<string>,n:int,s:array<string>,p:array<string>,need:int>>"
    every = F.array(*(F.lit(x) for x in sorted({x for t in made for x in t["p"]})))
    known = F.from_json(F.lit(json.dumps(made)), kinds)
    # translate: lower() would also fold other scripts' letters into a-z
    lowered = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    flat = docs.select(F.col(id_col).alias("__id"), F.coalesce(lowered, F.lit("")).alias("__t")).withColumn("__known", known)
    # templates that the whole text holds enough bigrams of; for most texts there is none, and no passage is made
    flat = flat.withColumn("__all", F.expr("split(trim(regexp_replace(__t, '[^a-z0-9]+', ' ')), ' ')"))
    paired = "zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> concat(a, ' ', b))"
    flat = flat.withColumn("__a", F.expr(paired.format(w="__all"))).withColumn("__met", F.array_intersect("__a", every))
    flat = flat.withColumn("__k", F.expr("filter(__known, k -> size(__met) >= k.need and size(array_intersect(__met, k.p)) >= k.need)")).drop("__met", "__known")
    passages = "array_except(concat(split(__t, '\\n'), split(__t, '\\n[ \\t\\r]*\\n')), array(__t))"
    words = f"concat(transform({passages}, p -> split(trim(regexp_replace(p, '[^a-z0-9]+', ' ')), ' ')), array(__all))"
    fitting = f"if(size(__k) = 0, cast(array() as array<array<string>>), filter({words}, w -> size(w) - 1 between {least!r} and {most!r}))"
    flat = flat.withColumn("__w", F.expr(fitting)).drop("__t", "__all")
    flat = flat.withColumn("__g", F.expr(f"transform(__w, w -> {paired.format(w='w')})")).drop("__w")
    starts = "array_distinct(flatten(transform(__a, (b, i) -> if(array_contains(k.p, b), transform(filter(transform(k.s, (x, j) -> struct(x as x, j as j)), y -> y.x = b), y -> i - y.j), cast(array() as array<int>)))))"
    laid = f"transform(__k, k -> struct(k as k, transform({starts}, s -> slice(__a, greatest(s, 0) + 1, k.n + least(s, 0))) as g))"
    marked = "transform(g, (b, i) -> concat(b, '#', cast(size(filter(slice(g, 1, i), y -> y = b)) as string)))"
    enough = f"2 * size(filter(g, b -> array_contains(x.k.p, b))) >= {threshold - 1e-9!r} * (size(g) + x.k.n)"
    judged = f"transform(filter(x.g, g -> {enough}), g -> struct(2d * size(array_intersect({marked}, x.k.b)) / (size(g) + x.k.n) as dice, x.k.name as name, -1 as at))"
    flat = flat.withColumn("__v", F.expr(f"if(size(__k) = 0, null, filter(flatten(transform({laid}, x -> {judged})), h -> h.dice >= {threshold!r}))")).drop("__a")
    fits = f"size(g) between {low!r} * k.n and {high!r} * k.n and arrays_overlap(g, k.p)"
    some = f"filter(transform(__g, g -> struct(g as g, filter(__k, k -> {fits}) as c)), x -> size(x.c) > 0)"
    flat = flat.withColumn("__c", F.expr(some)).drop("__g", "__k")
    tagged = "transform(x.g, (b, i) -> concat(b, '#', cast(size(filter(slice(x.g, 1, i), y -> y = b)) as string)))"
    hits = f"flatten(transform(__c, (x, at) -> transform(x.c, k -> struct(2d * size(array_intersect({tagged}, k.b)) / (size(x.g) + k.n) as dice, k.name as name, at as at))))"
    flat = flat.withColumn("__h", F.expr(f"filter({hits}, h -> h.dice >= {threshold!r})"))
    flat = flat.withColumn("__f", F.expr("if(__v is null, __h, concat(__h, __v))"))
    return flat.select(
        F.col("__id").alias(id_col), F.expr("array_max(__f).name").alias("license_id"), F.expr("array_max(__f).dice").alias("dice"),
        F.expr("size(array_distinct(transform(__h, h -> h.at)))").cast("bigint").alias("n_passages"), F.expr("array_sort(array_distinct(transform(__f, h -> h.name)))").alias("licenses"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows as license_scan() over ``documents`` in DuckDB, by joining all bigrams; licences joined by commas."""
    known = ", ".join(f"('{k}', '{' '.join(normalised(v))}')" for k, v in TEMPLATES.items())
    need = ", ".join(f"('{k}', {needed([x.rpartition('#')[0] for x in bigrams(normalised(v))], threshold)})" for k, v in TEMPLATES.items())
    counted = "select {key}, list_extract(w, i) || ' ' || list_extract(w, i + 1) as b, count(*) as c from (select {key}, w, unnest(range(1, len(w))) as i from {rows}) group by all"
    return f"""with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t\r]*\n'), [t]))) as p from d),
w as (select doc_id, p, string_split(trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'), ' '), ' ') as w from p), s as (select * from w where len(w) between 4 and 600),
k as (select name, string_split(v, ' ') as w from (values {known}) as x(name, v)),
a as ({counted.format(key="doc_id, p", rows="s")}), b as ({counted.format(key="name", rows="k")}),
m as (select a.doc_id, a.p, b.name, sum(least(a.c, b.c)) as n from a join b on a.b = b.b group by all),
h as (select m.doc_id, m.p, m.name, 2 * m.n::double / (len(s.w) + len(k.w) - 2) as dice from m join s on s.doc_id = m.doc_id and s.p = m.p join k on k.name = m.name),
al as (select doc_id, string_split(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' '), ' ') as w from d),
ga as (select doc_id, i - 1 as i, list_extract(w, i) || ' ' || list_extract(w, i + 1) as b from (select doc_id, w, unnest(range(1, len(w))) as i from al)),
tk as (select name, j - 1 as j, list_extract(w, j) || ' ' || list_extract(w, j + 1) as b from (select name, w, unnest(range(1, len(w))) as j from k)),
ca as (select x.doc_id, y.name from (select distinct doc_id, b from ga) x join (select distinct name, b from tk) y using (b) join (values {need}) as n(name, need) on n.name = y.name group by x.doc_id, y.name, n.need having count(*) >= n.need),
di as (select distinct ca.doc_id, ca.name, ga.i - tk.j as s from ca join ga on ga.doc_id = ca.doc_id join tk on tk.name = ca.name and tk.b = ga.b),
wi as (select di.doc_id, di.name, di.s, ga.b, count(*) as c from di join k on k.name = di.name join ga on ga.doc_id = di.doc_id and ga.i >= di.s and ga.i < di.s + len(k.w) - 1 group by all),
wn as (select doc_id, name, s, sum(c) as n from wi group by all),
wo as (select wi.doc_id, wi.name, wi.s, sum(least(wi.c, b.c)) as o from wi join b on b.name = wi.name and b.b = wi.b group by all),
wd as (select wo.doc_id, null::varchar as p, wo.name, 2 * wo.o::double / (wn.n + len(k.w) - 1) as dice from wo join wn on wn.doc_id = wo.doc_id and wn.name = wo.name and wn.s = wo.s join k on k.name = wo.name),
g as (select doc_id, p, name, dice from h where dice >= {threshold!r} union all select * from wd where dice >= {threshold!r}),
r as (select doc_id, (max(struct_pack(dice := dice, name := name))).name as license_id, max(dice) as dice, count(distinct p) as n_passages, string_agg(distinct name, ',' order by name) as licenses from g group by 1)
select d.doc_id, r.license_id, r.dice, coalesce(r.n_passages, 0) as n_passages, coalesce(r.licenses, '') as licenses from d left join r using (doc_id)"""
