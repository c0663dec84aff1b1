"""The jobs as queries: each runs twice into one new folder and gives the whole output after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_transcripts, maintain_memories
from loomstore.plans.shared import fresh_path

DAY = "2024-05-01"


def job1_index_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "job1")
    for _ in range(2):
        out = index_transcripts.run(spark, f"{sf_dir}/conversations.parquet", f"{at}/out", f"{at}/checkpoint")
    return out


def job2_maintain_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "job2")
    for _ in range(2):
        out = maintain_memories.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{at}/out", DAY)
    return out.select("id", "topic", "summary_hash", "importance", "weight", "access_count", F.array_join("keywords", " ").alias("keywords"), "merged")


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
INDEX = rf"""with m as (select coalesce(cast(conv_id as varchar),'')||'-'||coalesce(cast(turn as varchar),'') as id, max(struct_pack(r := coalesce(role,''), c := coalesce(text,''))) as m from conversations group by 1),
t as (select id, {_WORDS.format("m.r||' '||m.c")} as toks from m), e as (select id, unnest(toks) as term, len(toks) as dl from t)
select term, id, cast(count(*) as int) as tf, cast(dl as int) as dl from e group by term, id, dl"""

# at seven rounds of 0.95: the share that a round takes depends on importance and on up to five accesses
UPKEEP = rf"""with l as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id),
d as (select doc_id as id, trim(source) as topic, text as summary, case when toxic=1 then 1 when quality=1 then 3 else 2 end as rank, {_WORDS.format("text")} as toks from documents left join l using (doc_id)),
ok as (select *, sha256(lower(topic)||chr(0)||lower(trim(regexp_replace(summary,'\s+',' ','g')))) as summary_hash
from d where id is not null and topic<>'' and trim(summary)<>'' and not contains(topic||summary, chr(0)) and not regexp_matches(topic,'[\n\r\t]') and strlen(topic)<=256 and strlen(summary)<=65536),
g as (select min(id) as id, arg_min(topic,id) as topic, summary_hash, max(rank) as rank, count(*) as merged, lower(topic) as k from ok group by lower(topic), summary_hash),
e as (select id, lower(topic) as k, summary_hash, unnest(toks) as kw, generate_subscripts(toks,1) as p from ok),
w as (select *, row_number() over (partition by id order by p) as r from (select id, k, summary_hash, kw, min(p) as p from e group by all)),
f as (select k, summary_hash, kw, min(struct_pack(id := id, p := r)) as spot from w where r<=5 group by all),
kw as (select k, summary_hash, string_agg(kw, ' ' order by spot) as keywords from f group by all)
select id, topic, summary_hash, ['low','medium','high'][rank] as importance, weight, access_count, coalesce(keywords,'') as keywords, merged from (
select g.*, keywords, merged-1 as access_count, pow(1-0.05::double*(case rank when 3 then 0.5::double when 1 then 2.0::double else 1.0::double end)/(1+least(merged-1,5)*0.1::double), 7) as weight from g left join kw using (k, summary_hash)) where weight>=0.5 or rank=3"""

QUERIES = {f.__name__: f for f in (job1_index_transcripts, job2_maintain_memories)}
ORACLE_SQL = {"job1_index_transcripts": INDEX, "job2_maintain_memories": UPKEEP}
