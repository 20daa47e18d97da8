"""The corpus operators as queries over the given tables, with SQL where it can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import (
    alignment, embedding_dedup, language_id, mixing, near_dedup, packing, prefix_trie, quality, secret_scan, sharding, substring_dedup, token_files, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shards(table(spark, folder, "documents"), 24)
    return out.select("doc_id", sharding.row_size(F.col("text")).alias("size"),
                      F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@query
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), n=2)


@query
def op7_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measured(table(spark, folder, "documents"))


@query
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL["op10_source_mix"] = """
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 13))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from s),
r as (select *, 2.0::double * source_size / w as full_at from w),
l as (select *, (1.5::double * (sum(source_size) over ())::double
                 - 2.0::double * coalesce(sum(source_size) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
                / (sum(w) over (order by full_at, source nulls last rows between current row and unbounded following))::double as level from r),
t as (select source, source_size, least(2.0::double * source_size, coalesce((
        select arg_min(level, full_at) from l where level <= full_at) * w, 2.0::double * source_size)) as target from l),
p as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as full_rounds
      from d join t on d.source is not distinct from t.source),
p0 as (select *, target - full_rounds * source_size as left0, false as t0 from p),
""" + ",\n".join(f"""c{i} as (select *, coalesce(sum(case when not t{i - 1} and size > 0 and size <= left{i - 1} then size end)
        over (partition by source order by h), 0) as run from p{i - 1}),
m{i} as (select *, not t{i - 1} and size > 0 and size <= left{i - 1} and run <= left{i - 1} as n{i} from c{i}),
p{i} as (select * exclude (run, n{i}), left{i - 1} - coalesce(sum(case when n{i} then size end) over (partition by source), 0) as left{i},
        t{i - 1} or n{i} as t{i} from m{i})""" for i in range(1, mixing.PASSES + 1)) + f"""
select doc_id, size, source_size, target, (size * case when size > 0 then full_rounds + t{mixing.PASSES}::int else 0 end)::bigint as taken from p{mixing.PASSES}
"""


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.packed(table(spark, folder, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_pivot_permutation_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predicted(table(spark, folder, "documents"))


@query
def op1_compact_window_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, folder, "documents"))


@query
def op2_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


SQL["op2_warc_round_trip"] = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from p)
select page_id, n::bigint as payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from f
"""


@query
def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.digests(table(spark, folder, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.paths(table(spark, folder, "conversations"))))


SQL["op12_prefix_trie"] = """
with recursive t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, text, sha256(length(role)::varchar || ':' || role || text) as digest,
             row_number() over (partition by conv_id order by turn nulls first, sha256(length(role)::varchar || ':' || role || text)) as nth from t),
c0 as (select i, i as c from range(256) r(i)),
""" + "".join(f"c{k + 1} as (select i, case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end as c from c{k}),\n" for k in range(8)) + """ids as (select distinct conv_id, conv_id::varchar as s from t),
run as (select conv_id, s, 1 as pos, 4294967295::bigint as c from ids
        union all
        select r.conv_id, r.s, r.pos + 1, xor(r.c >> 8, k.c) from run r join c8 k on k.i = xor(r.c & 255, ascii(substr(r.s, r.pos, 1))::bigint) where r.pos <= length(r.s)),
h as (select conv_id, xor(c, 4294967295::bigint) % 6 as h from run where pos = length(s) + 1),
r as (select h.conv_id, o.nth, 0 as part, o.text, o.digest from h join o on o.conv_id = h.conv_id - h.conv_id % 100 and o.nth <= h.h
      union all
      select h.conv_id, o.nth, 1, o.text, o.digest from h join o on o.conv_id = h.conv_id and o.nth > h.h),
p as (select conv_id, row_number() over (partition by conv_id order by part, nth) as depth, length(text) as size,
             sha256(array_to_string(list(digest) over (partition by conv_id order by part, nth), '')) as key from r),
m as (select conv_id, 0::bigint as depth, 0 as size, 'root' as key, null::varchar as up from h
      union all
      select conv_id, depth, size, key, coalesce(lag(key) over (partition by conv_id order by depth), 'root') from p),
e as (select conv_id, max(depth) as depth from m group by conv_id),
n as (select key, any_value(up) as up, any_value(m.depth) as depth, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs,
             coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where m.depth = e.depth), '') as ends
      from m join e using (conv_id) group by key),
k as (select up, count(*) as n_children from n where up is not null group by up),
f as (select n.*, coalesce(k.n_children, 0) as n_children from n left join k on k.up = n.key),
s as (select a.key, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * f.size) as saved_tokens
      from f join m a on a.conv_id = f.conv_id and a.depth <= f.depth group by a.key)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves,
       s.saved_tokens::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from f join s using (key) left join n u on u.key = f.up
"""


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.scored(table(spark, folder, "documents"))
