"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_trie, decontaminate, embedding_dedup, html_extract, ngram_join, packing, quality, sharding, source_audit, suffix_dedup, token_count,
    token_output, url_filter,
)
from .common import scratch, table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join_documents(table(spark, sf_dir, "documents"), ngram_join.Join(n=4, share=85))
    return joined.select("doc_id", "n_shingles", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines_removed n_words_removed base_failed kept"
    return quality.judge(table(spark, sf_dir, "documents")).select(columns.split())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"), 24, columns=["doc_id"])
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), suffix_dedup.Repeats(200))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end=1)
    return token_output.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two halves: contents of the second that the first had aren't encoded again. All are looked up in the cache."""
    docs, tokenizer = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    cache, half = scratch(spark, "token-counts"), F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for n in (0, 1):
        token_count.remember(docs.where(half == n), tokenizer, cache)
    counted = token_count.look_up(docs, tokenizer, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = conversation_trie.turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.shared_beginnings(paths, block=100, most=6))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), embedding_dedup.Near(share=0.95))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"), source_audit.Audit(min_docs=10, top=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_html_extract": op7_html_extract,
    "op8_token_output": op8_token_output,
    "op9_url_filters": op9_url_filters,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_source_audit": op13_source_audit,
}

#: White space and words as every operator here takes them.
_WS = r"[\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op9_url_filters": r"""
with rules(h, p, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls as (select distinct url,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path from pages),
best as (select url, arg_max(h || p, length(h || p)) as rule, arg_max(action, length(h || p)) as verdict
  from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by url)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from pages join urls on pages.url is not distinct from urls.url left join best on pages.url = best.url
""",
    "op3_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, doc_id, source, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, i, array_to_string(ws[i:i + 7], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w)),
dup as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
rep as (select r, sum(least(8, coalesce(nxt - i, 8))) as n from
  (select r, i, lead(i) over (partition by r order by i) as nxt from dup) group by r),
l as (select r, doc_id, source, t, x, i, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as y
  from (select r, doc_id, source, t, unnest(ls) as x, generate_subscripts(ls, 1) as i from w)),
n as (select r, doc_id, source, t, x, i, trim(regexp_replace(y, '{_WS}', ' ', 'g'), ' ') as y from l),
f as (select a.source, y from (select source, y, count(distinct (doc_id, t)) as c from n group by all) a
  join (select source, count(distinct (doc_id, t)) as o from d group by all) b on a.source is not distinct from b.source
  where c >= 20 and 100 * c > 8 * o),
gone as (select r, count(*) as nl, sum(len(list_filter(regexp_split_to_array(x, '{_WS}'), lambda z: z <> ''))) as nw
  from n join f on n.source is not distinct from f.source and n.y = f.y group by r),
s as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
  coalesce(nl, 0)::bigint as n_lines_removed, coalesce(nw, 0)::bigint as n_words_removed
  from w left join rep using (r) left join gone using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select *, not base_failed and not (n_words_removed > 0 and (n_words - n_words_removed < 20
  or 100 * n_words_removed > 60 * n_words)) as kept from b
""",
    "op11_conversation_trie": """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
p as (select conv_id, list({'r': role, 't': text} order by turn nulls first, role, text) as ts from t group by conv_id),
h as (select conv_id, ts, conv_id - conv_id % 100 as base,
  list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295::bigint) as crc from p),
r as (select h.conv_id, list_concat(coalesce(b.ts[1:k], []), h.ts[k + 1:]) as path
  from (select *, (xor(crc, 4294967295) % 6)::bigint as k from h) h left join (select conv_id as c0, ts from p) b(c0, ts) on c0 = base),
n as (select conv_id, d, path[1:d] as node, d = len(path) as ends from (select *, unnest(range(len(path) + 1)) as d from r)),
g as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from n group by node, d),
k as (select node[1:d - 1] as parent, count(*) as n_children from g where d > 0 group by 1),
u as (select g.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * length(node[d].t) end as own from g left join k on parent = node),
s as (select a.node, count(*) filter (u.n_children = 0) as n_leaves, sum(u.own) as saved_tokens
  from (select *, unnest(range(d + 1)) as e from u) u join u a on a.d = u.e and a.node = u.node[1:u.e] group by a.node)
select u.conv_id, u.d as depth, g.conv_id as parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, u.ends_sha256
from u join s on s.node = u.node left join g on u.d > 0 and g.d = u.d - 1 and g.node = u.node[1:u.d - 1]
""",
    "op12_embedding_dedup": """
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
good as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(e, lambda x: abs(x))) > 0),
link as (select a.r as x, b.r as y, b.vec_id as other from good a join good b on a.r <> b.r and len(a.e) = len(b.e)
  where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.95 else false end),
reach as (select r as x, r as y from v union select reach.x, link.y from reach join link on reach.y = link.x),
named as (select x, min(vec_id) as component_id from reach join v on v.r = reach.y group by x),
many as (select x, count(*) as n from link group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
from v join named on named.x = r left join many on many.x = r
""",
    "op13_source_audit": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as (select r, lang, source, unnest(ts) as term from d),
kept as (select lang, term, count(*)::hugeint as n from t group by all having count(distinct r) >= 10),
grp as (select distinct lang, source from d),
cell as (select grp.lang, grp.source, kept.term, coalesce(c, 0)::hugeint as c, kept.n from grp join kept on kept.lang = grp.lang
  left join (select lang, source, term, count(*) as c from t group by all) x on x.lang = grp.lang and x.source = grp.source and x.term = kept.term),
tot as (select *, sum(c) over (partition by lang, source)::hugeint as big, count(*) over (partition by lang, source)::hugeint as v from cell),
lng as (select lang, sum(n)::hugeint as big from kept group by lang),
p as (select tot.*, 1 + (1000000000::hugeint * (c + 2)) // (tot.big + 2 * v) as p, 1 + (1000000000::hugeint * (tot.n + 2)) // (lng.big + 2 * v) as q from tot join lng using (lang)),
pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select g.lang, g.source, 'pair' as part, o.source as item, coalesce(value, 0)::bigint as value from grp g join grp o on g.lang = o.lang and g.source <> o.source
  left join pair on pair.lang = g.lang and pair.source = g.source and pair.item = o.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where c > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 10
""",
}
