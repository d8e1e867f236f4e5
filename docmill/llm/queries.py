"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import hpy_lm, jaccard_join, license_scan, line_crf, line_dedup, media_chunks, mixing, packing, pii_bootstrap, sharding
from docmill.llm.common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hpy_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy_lm.score_texts(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = line_crf.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.quality(docs, model)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digests(pii_bootstrap.detect_pii(documents(spark, sf_dir)))


def op6_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).drop("n_links")


def op6_jaccard_trie_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(documents(spark, sf_dir))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.read_media(media_chunks.media_containers(documents(spark, sf_dir)))


def op8_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.hilbert_shards(documents(spark, sf_dir))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    labels = F.array_union("base", F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>")))
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(labels).alias("labels"), F.least(score, F.lit(1.0)).alias("score"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_hpy_lm, op2_line_dedup, op3_line_crf, op4_vector_packing, op5_pii_bootstrap, op6_jaccard_trie, op6_jaccard_trie_links, op7_media_chunks, op8_fair_queue, op9_hilbert_shards, op10_license_diagonals, pipeline]
    return {f.__name__: f for f in ops}


#: DuckDB's \s-free form of the white space at both ends of a line.
_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (select *, {_LOW.format(f"trim(line, {_WS})")} as key from lines),
firsts as (select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key),
marked as (
  select k.*, coalesce(k.doc_id > f.first_doc, false) as dropped
  from keyed k left join firsts f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

#: The links of documents by shared shingles, and the least doc_id reachable by links.
#: The words of a shingle have no spaces, so joining them by spaces is unambiguous.
JACCARD_SQL = rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
grams as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (
  select doc_id, len(g) as n, min(doc_id) over (partition by g) as class_id
  from (select doc_id, list(gram order by gram) as g from grams group by doc_id)),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select p.a, p.b from pairs p join sizes x on p.a = x.doc_id join sizes y on p.b = y.doc_id
  where 100 * p.common >= 75 * (x.n + y.n - p.common)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, l.b from reach r join links l on r.other = l.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, coalesce(s.class_id, d.doc_id) as class_id
from documents d left join sizes s on d.doc_id = s.doc_id
left join (select doc_id, min(other) as component_id from reach group by doc_id) r on d.doc_id = r.doc_id
"""

#: The links between different sets, each set named by its least doc_id.
JACCARD_LINKS_SQL = f"""{JACCARD_SQL.split(",\nreach(")[0]}
select distinct x.class_id as class_a, y.class_id as class_b
from links l join sizes x on l.a = x.doc_id join sizes y on l.b = y.doc_id where x.class_id < y.class_id
"""


#: Weighted fair queueing over all documents at once.  Weights 3, 1, 2 go round the
#: sources in order; in order of cap by weight a source is capped if what is left, dealt
#: by weight from it on, would exceed its cap.
FAIR_QUEUE_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('17|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as u, row_number() over () as row
  from documents),
named as (
  select source, cast(sum(size) as bigint) as source_size, [3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3] as w
  from sized group by source),
capped as (
  select *, 2.0 * source_size as cap, 2.0 * source_size / w as fill from named),
levels as (
  select *, (1.5 * sum(source_size) over () - sum(cap) over f + cap) / (sum(w) over () - sum(w) over f + w) as level, row_number() over f as place
  from capped window f as (order by fill, source is null, source rows between unbounded preceding and current row)),
targets as (
  select source, source_size, case when level * w > cap then cap else least(cap, (select arg_min(level, place) from levels where level * w <= cap) * w) end as target
  from levels),
timed as (
  select s.*, t.source_size, cast(t.target as double) as target, sum(s.size) over (partition by s.source order by s.u, s.doc_id, s.row) as done
  from sized s join targets t on s.source is not distinct from t.source),
turns as (
  select row, size, u, doc_id, 0 as epoch, cast(done as double) / target as time from timed where size > 0
  union all
  select row, size, u, doc_id, 1, (source_size + cast(done as double)) / target from timed where size > 0),
used as (
  select row, size, sum(size) over (order by time, epoch, u, doc_id rows between unbounded preceding and current row) as total from turns),
taken as (select row, sum(size) as taken from used where total <= 1.5 * (select sum(size) from sized) group by row)
select t.doc_id, t.size, t.source_size, coalesce(t.target, 0.0) as target, cast(coalesce(k.taken, 0) as bigint) as taken
from timed t left join taken k on t.row = k.row
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_fair_queue": FAIR_QUEUE_SQL, "op2_line_dedup": LINE_DEDUP_SQL, "op6_jaccard_trie": JACCARD_SQL, "op6_jaccard_trie_links": JACCARD_LINKS_SQL}
