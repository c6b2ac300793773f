"""The registered queries of the text operators, over whole tables and whole texts."""

from __future__ import annotations

import os

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackflow.llm import frames, language, line_dedup, mixing, near_dedup, page_text, passages, personal_data, pieces, prefix_trie, quality, runs, simhash, topk, words
from trackflow.llm.registry import QUERIES, SQL, query, table
from trackflow.operators.tables import materialise

# Python workers may start in a folder from which the package cannot be imported.
for _module in (frames, language, line_dedup, mixing, near_dedup, page_text, passages, personal_data, pieces, prefix_trie, quality, runs, simhash, topk, words):
    cloudpickle.register_pickle_by_value(_module)

__all__ = ["QUERIES", "SQL"]

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# The vocabulary file: a parameter, not part of this library.
PIECES = os.environ.get("TRACKFLOW_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

OP1_SQL = rf"""
with l as (
  select doc_id, x.i as i, x.line as line,
    translate(regexp_replace(regexp_replace(x.line, '^{WHITE}+', ''), '{WHITE}+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s, n: struct_pack(i := n, line := s))) as x
    from documents) d),
common as (select key from l where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select l.*, common.key is not null as bad from l left join common using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where bad))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not bad), '')) as kept_sha256
from m group by doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.drop_common_lines(docs, min_docs=10)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w),
n as (select w.doc_id, count(s.shingle) as n from w left join s using (doc_id) group by w.doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i.n >= 75 * (x.n + y.n - i.n)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select doc_id as a, doc_id as b from n union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, n.n::bigint as n_shingles, component_id, doc_id = component_id as kept from n join c using (doc_id)
"""


@query("op2_near_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
win as (
  select doc_id, x.i as i, x.k as k from (
    select doc_id, unnest(case when len(w) < 35 then [] else
      list_transform(range(1, len(w) - 33), lambda i: struct_pack(i := i, k := array_to_string(w[i:i + 34], ' '))) end) as x from w) t),
bad as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from win) t where n > 1),
pos as (select distinct doc_id, unnest(range(i, i + 35)) as p from bad),
words as (select doc_id, x.p as p, x.word as word from (
  select doc_id, unnest(list_transform(w, lambda v, n: struct_pack(p := n, word := v))) as x from w) t),
k as (select words.doc_id, count(pos.p) as removed, string_agg(word, ' ' order by words.p) filter (where pos.p is null) as kept
  from words left join pos on pos.doc_id = words.doc_id and pos.p = words.p group by words.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(k.removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


@query("op10_passages", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = personal_data.of_kinds(personal_data.BASE)
    counts = [F.size(personal_data.of_kinds((k,))).cast("long").alias(f"n_{k}") for k in personal_data.BASE]
    digest = F.sha2(personal_data.listed(base), 256).alias("base_sha256")
    return found.select(F.col("row.doc_id"), *counts, digest, personal_data.listed(F.col("spans")).alias("spans"))


OP4_SQL = r"""
with a as (
  select page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)(</article>|$)', 1), ''), '(?s)<!--.*?-->', '', 'g') as a
  from pages),
b as (
  select page_id, url, list_transform(
    string_split_regex(replace(replace(replace(a, '<br>', ' '), '<b>', ''), '</b>', ''), '</?(p|h1|h2|h3|div|ul|ol|li|section|blockquote)( [^>]*)?>'),
    lambda t: trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as b
  from a),
c as (select page_id, url, array_to_string(list_filter(b, lambda t: t <> ''), chr(10) || chr(10)) as text from b)
select page_id, url, text, length(text)::bigint as n_chars from c
"""


@query("op4_page_text", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op6_topk", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(topk.build_index(vectors), vectors.filter("vec_id % 50 = 0"), k=5)


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", taken)


@query("op7_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(PIECES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    found = pieces.encoded(docs, model, keep=["doc_id", "whole"])
    read = pieces.digests(model, F.col("pieces"), F.col("n_best"))
    checked = found.select("row.doc_id", "pieces", "scores", read.alias("read"), "row.whole")
    return checked.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.col("read")[0]["pieces_sha256"].alias("pieces_sha256"),
        F.col("scores")[0].alias("best_score"),
        F.element_at("scores", -1).alias("last_score"),
        F.size("scores").cast("long").alias("n_best"),
        F.col("read")[0]["decoded_sha256"].alias("decoded_sha256"),
        F.forall("read", lambda r: r["decoded_sha256"] == F.col("whole")).alias("exact"),
        F.sha2(F.concat_ws(",", F.col("read")["pieces_sha256"]), 256).alias("n_best_sha256"),
    )


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.judge(docs, labels.select("doc_id", "quality"))
    return found.select("doc_id", *quality.FORM, "base_failed", "kept", F.round("score", 9).alias("score"))


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts whose crc32(doc_id) is divisible by 10 the words from a place on repeat with a period, as the query's contract sets."""
    h = F.crc32(F.col("doc_id").cast("string"))
    every = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1)))
    split = docs.select("doc_id", "text", every.alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words").cast("long")
    sized = split.withColumns({"n": n, "a": F.when(n > 0, F.col("g") % n)})
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    placed = sized.withColumn("p", F.when(F.col("n") > 0, period))
    again = F.expr("transform(words, (w, i) -> words[if(i < a, i, cast(a + (i - a) % p as int))])")
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(with_planted_runs(docs))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.shorter")
    return top.select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


OP13_SQL = """
with t as (
  select conv_id, turn, length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '') as told,
    length(coalesce(text, ''))::bigint as size
  from conversations where conv_id is not null),
o as (select conv_id, told, size, row_number() over (partition by conv_id order by turn nulls first, sha256(told)) as pos from t),
c as (
  select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(
      [4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint),
      lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)),
    4294967295) % 6 as h
  from (select distinct conv_id from o) d),
r as (
  select c.conv_id, 0 as part, pos, told, size from c join o on o.conv_id = c.base and pos <= h
  union all select c.conv_id, 1, pos, told, size from c join o on o.conv_id = c.conv_id and pos > h),
p as (
  select conv_id, size, row_number() over w as depth, list(told) over w as prefix, count(*) over (partition by conv_id) as n
  from r window w as (partition by conv_id order by part, pos)),
a as (
  select conv_id, prefix, depth, size, depth = n as ends from p
  union all select conv_id, []::varchar[], 0, 0, not exists (select 1 from r where r.conv_id = c.conv_id) from c),
n as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from a group by prefix, depth),
k as (select prefix[1:depth - 1] as prefix, count(*) as n_children from n where depth > 0 group by 1),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (prefix)),
s as (
  select prefix[1:up] as prefix, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * size) as saved
  from (select m.*, unnest(range(depth + 1)) as up from m) u group by 1)
select m.conv_id, m.depth::bigint as depth, q.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, m.ends_sha256
from m join s using (prefix) left join n q on m.depth > 0 and q.prefix = m.prefix[1:m.depth - 1]
"""


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation with its first turns replaced by those of its hundred's first one, as the query's contract sets."""
    own = materialise(prefix_trie.paths(conversations))
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    met = own.select("conv_id", "path", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    kept = F.slice(F.col("path"), F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    rebuilt = F.concat(F.coalesce(F.slice(F.col("head"), F.lit(1), F.col("h")), F.slice("path", 1, 0)), kept)
    return met.select("conv_id", rebuilt.alias("path"))


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(rebuilt_paths(table(spark, sf_dir, "conversations")))
