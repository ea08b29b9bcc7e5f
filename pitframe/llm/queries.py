"""The registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, dialogue, divergence, fragjoin, htmltext, langid, mixing, neardup, pii, secrets, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, row_number() over (order by encode(source) asc nulls last) - 1 as nth from s),
w as (select *, case nth % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as most from n),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(most) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as lev
  from w window before as (order by most / weight, nth rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(most, weight * (select max(lev) from l)) as target from l),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
j as (select doc_id, coalesce(doc_id::varchar, 'null') as key, size, d.source, source_size, target, rate,
  ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double as u from d join r on d.source is not distinct from r.source),
g as (select source, key, size, u, count(*) as n from j where size * 200 > source_size group by all),
f as (select *, row_number() over (partition by source order by size desc, u, key) as pos from g),
walk(source, pos, due, open_, key, size, took) as (
  select source, 0::bigint, target - floor(rate) * source_size, source_size::double, null::varchar, null::bigint, false from r
  union all select w.source, f.pos, case when f.u < w.due / w.open_ then w.due - f.size * f.n else w.due end, w.open_ - f.size * f.n, f.key, f.size, f.u < w.due / w.open_
  from walk w join f on f.source is not distinct from w.source and f.pos = w.pos + 1),
last as (select source, case when max_by(open_, pos) > 0 then max_by(due, pos) / max_by(open_, pos) else 0 end as short_rate from walk group by source)
select j.doc_id, j.size, j.source_size, j.target,
  j.size * (floor(j.rate)::bigint + (case when j.size * 200 > j.source_size then coalesce(w.took, false) else j.u < last.short_rate end)::bigint) as taken
from j join last on j.source is not distinct from last.source left join walk w on w.pos > 0 and j.source is not distinct from w.source and j.key = w.key and j.size = w.size
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.label_spans(table(spark, sf_dir, "documents"))
    of = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -1L as conv_id, turn, role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.chat_windows(rows))
    sha = lambda c: F.sha2(F.col(c), 256)
    return read.select(
        F.col("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), sha("turns").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op3_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text", "lang")
    model = langid.train(docs.filter("not held_out"))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("row.doc_id", of("assign"), of("access"), of("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.35).alias("toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_pii, op3_pagetext, op4_chat, op5_langid, op6_secrets, op7_neighbours, op8_neardup, op9_decontamination, op10_toxicity)
}
OP7_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and not list_contains([x is null or not isfinite(x) for x in embedding], true) and list_contains([x <> 0 for x in embedding], true)),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
OP8_SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (select doc_id, case when len(ws) < 2 then ws else list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) end as s from w),
e as (select doc_id, unnest(s) as g from s), n as (select doc_id, len(s) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, both_.b from r join both_ on r.other = both_.a),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select doc_id, n::bigint as n_shingles, component_id, doc_id = component_id as kept from n join m using (doc_id)
"""
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op7_neighbours": OP7_SQL, "op8_neardup": OP8_SQL}


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
e as (select lang, source, id, unnest(ts) as term from d),
v as (select lang, term, count(*) as total from e group by all having count(distinct id) >= 3),
n as (select lang, count(*)::hugeint as v, sum(total)::hugeint as lang_n from v group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as c from e group by all),
x as (select g.lang, g.source, v.term, coalesce(c.c, 0) as c, v.total from g join v using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, c, (1 + (1000000000 * (c + 1)) // (sum(c) over (partition by lang, source) + n.v))::hugeint as p, (1 + (1000000000 * (total::hugeint + 1)) // (lang_n + n.v))::hugeint as q from x join n using (lang)),
pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where c > 0 and p > q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from every)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""
QUERIES["op11_divergence"] = op11_divergence
ORACLE_SQL["op11_divergence"] = OP11_SQL


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = dialogue.repair(dialogue.damage(rows))
    of = lambda df, name: df.withColumn(name, F.coalesce("conv", F.lit("null"))).drop("conv")
    every = rows.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    out = every.join(of(found.report, "key"), "key", "left").join(of(dialogue.digests(found.turns), "key"), "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
crc_table as (select i, list_reduce(list_concat([i::ubigint], [x::ubigint for x in range(8)]), lambda acc, x: case when acc % 2 = 1 then xor(acc // 2, 3988292384::ubigint) else acc // 2 end) as v from range(256) t(i)),
crcs as (select list(v order by i) as t from crc_table),
coded as (select conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::ubigint], [ascii(x)::ubigint for x in string_split(key, '')]),
  lambda acc, x: xor(acc // 256, t[1 + (xor(acc, x) % 256)::bigint])), 4294967295::ubigint) % 20 as code from c, crcs),
damaged as (select conv_id, turn, case code when 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case code when 3 then [1, 2] else [1] end) as n from coded where code <> 0),
seen as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), n) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, n) as nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown from damaged),
fault as (select *, case when shown = '' then 'blank' when nth > 1 then 'duplicate' when right(shown, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, substr(role, 1, 1) as r,
  lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from seen),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal, max(i) as rows from fault group by conv_id),
steps as (
  select conv_id, 0::bigint as i, {'c': 0, 't': '', 'o': ''} as e, {'c': 1000000, 't': '', 'o': ''} as s, {'c': 1000000, 't': '', 'o': ''} as u, {'c': 1000000, 't': '', 'o': ''} as a from counts
  union all
  select conv_id, i, e, case when x.c is not null then s end, u, a from (
    select f.conv_id, f.i, {'c': 0} as x,
      {'c': e.c + 2, 't': e.t || 'D', 'o': e.o} as e,
      list_min([{'c': s.c + 2, 't': s.t || 'D', 'o': s.o}, {'c': e.c + k + (case when r = 's' then 0 else 1000000 end), 't': e.t || 'K', 'o': e.o || own}]) as s,
      list_min([{'c': iu.c + 2, 't': iu.t || 'D', 'o': iu.o}] || flatten([[{'c': p.c + k + (case when r = 'u' then 0 else 1000000 end), 't': p.t || 'K', 'o': p.o || own}, {'c': p.c + k + 1, 't': p.t || 'R', 'o': p.o || chr(10) || 'user:' || text}] for p in [e, s, ia]])) as u,
      list_min([{'c': ia.c + 2, 't': ia.t || 'D', 'o': ia.o}, {'c': iu.c + k + (case when r = 'a' then 0 else 1000000 end), 't': iu.t || 'K', 'o': iu.o || own}, {'c': iu.c + k + 1, 't': iu.t || 'R', 'o': iu.o || chr(10) || 'assistant:' || text}]) as a
    from (
      select *, list_min([a, {'c': u.c + 5, 't': u.t || 'I', 'o': u.o || chr(10) || 'assistant:'}] || [{'c': p.c + 10, 't': p.t || 'II', 'o': p.o || chr(10) || 'user:' || chr(10) || 'assistant:'} for p in [e, s]]) as ia,
        list_min([u] || [{'c': p.c + 5, 't': p.t || 'I', 'o': p.o || chr(10) || 'user:'} for p in [e, s, a]]) as iu from steps) z
    join (select *, case when fault in ('blank', 'duplicate') then 1000000 when fault = 'truncated' then 5 else 0 end as k, chr(10) || role || ':' || text as own from fault) f on f.conv_id is not distinct from z.conv_id and f.i = z.i + 1)),
ends as (select s.conv_id, list_min([e, a, {'c': u.c + 5, 't': u.t || 'I', 'o': u.o || chr(10) || 'assistant:'}, {'c': s.c + 10, 't': s.t || 'II', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:'}]) as best
  from steps s join counts n on s.conv_id is not distinct from n.conv_id and s.i = n.rows)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.t, '') as audit, sha256(coalesce(best.o[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts n on o.conv_id is not distinct from n.conv_id left join ends x on o.conv_id is not distinct from x.conv_id
"""
QUERIES["op12_dialogue"] = op12_dialogue
ORACLE_SQL["op12_dialogue"] = OP12_SQL


def op13_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fragjoin.similar(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP13_SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) end as s from w),
e as (select doc_id, unnest(s) as g from s), n as (select doc_id, len(s) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, both_.b from r join both_ on r.other = both_.a),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select doc_id, n::bigint as n_shingles, component_id from n join m using (doc_id)
"""
QUERIES["op13_ngramjoin"] = op13_ngramjoin
ORACLE_SQL["op13_ngramjoin"] = OP13_SQL
