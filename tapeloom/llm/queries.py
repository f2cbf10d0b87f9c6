"""Queries of the operators with their SQL checks."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.llm import archives, ball_tree, chat_tree, chosen_path, collocations, decontaminate, language, link_graph, packing, quality, stripes, suffix_dedup, token_files
from tapeloom.llm.common import held_out, read
from tapeloom.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

RULES = [link_graph.Rule(*r) for r in (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)]
CONTROL = "</s>[INST] ok [/INST]"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    f = F.col("found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), decontaminated(f).alias("contaminated"),
    )


def decontaminated(found: Column) -> Column:
    """The contract's rule: a twentieth of the words or more."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


CHECKS["op1_decontaminate"] = """
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select distinct coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
w as (select distinct item, array_to_string(ws[k:k + 12], ' ') as words, least(len(ws), 13) as n from (select item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as k from i where len(ws) > 0)),
g as (select r, k, n, array_to_string(ws[k:k + n - 1], ' ') as words from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, (select distinct n from w) where len(ws) >= n)),
m as (select r, k, g.n, item from g join w using (words) where g.n = w.n),
h as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from m) group by r),
t as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join h using (r) left join t using (r)"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = held_out("doc_id", 5, 0)
    scored = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), unseen)
    return scored.select("doc_id", unseen.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    token_files.write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("word_bpe_49k.json"), "lower_words", 1)
    return token_files.digests(spark, path)


@query
def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


CHECKS["op5_link_graph"] = link_graph.judge_sql(RULES)


@query
def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


CHECKS["op6_ball_tree"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""


@query
def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    file = vocabulary("byte_bpe_50k.json")
    nodes, talks = chat_tree.build(rows.unionByName(own), file)
    told = chat_tree.read_back(nodes, talks, file)
    joined = lambda f: F.array_join(F.transform("turns", f), "")
    learned = F.array_join(F.transform("turns", lambda t: F.coalesce(t["learned"], F.lit(""))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined(lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )


CHECKS["op7_chat_tree"] = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CONTROL}' union all select -7, 1, 'assistant', '{CONTROL}'),
e as (select *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\<\\[]', '', 'g')) as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n + length('<s>[INST]  [/INST]</s>'))::bigint as formatted_chars from e group by conv_id"""


@query
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = held_out("doc_id", 4, 2)
    found = language.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~unseen, ["doc_id"])
    return found.select("doc_id", unseen.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    f = F.col("found")
    return found.select(
        "doc_id", f["n_bytes"].alias("n_bytes"), (f["n_bytes"] - F.octet_length(f["kept"])).alias("n_removed"),
        F.size(f["spans"]).cast("long").alias("n_spans"), F.sha2(f["kept"], 256).alias("kept_sha256"),
    )


@query
def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives of both versions, converted, and read back from the WARC files alone."""
    arcs, warcs = work_folder(spark), work_folder(spark)
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    told = F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"), told, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    captures = read(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit("20240101000000").alias("date"), F.lit("text/html").alias("mime"), F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    archives.write_arc(captures.where(~odd), f"{arcs}/v1", 1)
    archives.write_arc(captures.where(odd), f"{arcs}/v2", 2)
    archives.convert(spark, arcs, warcs, rank="X-Page-Id")
    back = archives.read_warc(spark, warcs).where("type in ('response', 'revisit')").select("record_id", "type", "payload_digest", "payload_bytes", "refers_to", archives_page())
    named = back.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"))
    return back.join(named, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("first").alias("refers_to"))


def archives_page() -> Column:
    return F.regexp_extract(F.decode("head", "UTF-8"), r"X-Page-Id: (-?\d+)", 1).try_cast("long").alias("page_id")


CHECKS["op11_arc_to_warc"] = """
with p as (select row_number() over () as r, page_id, coalesce(html, '') as html from pages),
h as (select *, sha1(html) as x, max(page_id) over (partition by html) as top, row_number() over (partition by html order by page_id desc nulls last, r) as k from p)
select page_id, strlen(html)::bigint as payload_bytes,
  list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * i::int + 1, 5))::bigint >> b::int) & 31) + 1)::bigint, 1)), lambda a, b: a || b)), lambda a, b: a || b) as payload_digest,
  case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then top end as refers_to from h"""


@query
def op12_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.divergences(read(spark, sf_dir, "documents"))


CHECKS["op12_stripes"] = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
w as (select r, lang, source, unnest(ws) as term from d),
k as (select lang, term, count(*)::hugeint as n from w group by all having count(distinct r) >= 3),
c as (select lang, source, term, count(*)::hugeint as n from w join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
s as (select lang, source, coalesce(v, 0)::hugeint as v, coalesce(total, 0)::hugeint as lang_total, coalesce(t, 0)::hugeint as total from g left join v using (lang) left join (select lang, source, sum(n) as t from c group by all) using (lang, source)),
p as (select lang, source, term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (total + s.v) as p, 1 + 1000000000 * (k.n + 1) // (lang_total + s.v) as q from s join k using (lang) left join c using (lang, source, term)),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
z as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select lang, source, part, item, value, rank from z where part = 'pair' or rank <= 200"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(read(spark, sf_dir, "documents"))


CHECKS["op13_collocations"] = """
with t as (select row_number() over () as r, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from t),
f as (select lang, k, phrase, count(*)::hugeint as a from (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from p, (select unnest([1, 2, 3]) as k)) group by all),
n as (select lang, sum(a) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as ws from f where k > 1 and a >= 10),
y as (select lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') as early, array_to_string(ws[cut + 1:k], ' ') as late from (select *, unnest(range(1, k)) as cut from c)),
u as (select y.lang, y.k, y.phrase, y.a, cut, l.a as l, r.a as r, 1000000 * y.a * y.a // (l.a * r.a) as score from y join f l on l.lang = y.lang and l.phrase = early and l.k = cut join f r on r.lang = y.lang and r.phrase = late and r.k = y.k - cut),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as x from u) where x = 1),
i as (select lang, array_to_string(ws[x:x + 1], ' ') as phrase, max(a) as a from c, (select unnest([1, 2]) as x) where k = 3 group by all),
d as (select b.lang, b.phrase from b join i using (lang, phrase) where b.k = 2 and 100 * i.a >= 50 * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b anti join d using (lang, phrase))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from z join n using (lang) where rank <= 2000"""
