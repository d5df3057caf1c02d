"""The queries opN_<name> over the driver's tables: each runs its operator on a whole table and
derives the columns of its result from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embedding_dedup, language_id, license_scan, line_dedup, lm_score, media_sniff, minhash_dedup, mixing, packing, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 400)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def tokenizer_file() -> str:
    """Where the public vocabulary lies; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), 2048, encode_special_tokens=False)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_sniff.files(_table(spark, sf_dir, "documents"))
    tail = F.substring("samples", -32, 32)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%s;declared=%s;embedded=%d;mean=%.4f;deviation=%.4f", "type", "declared", F.size("embedded"), "mean", "deviation").alias("feature"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.trained(docs))
    return out.select("doc_id", (common.remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.score(docs.where(common.remainder(F.col("doc_id")) != 1), docs)
    return out.select("doc_id", (common.remainder(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size(F.col("text")).alias("size"))
    # Rows have a number of their own, since those alike in all columns count apart.
    docs = common.stored(docs.withColumn("row", F.monotonically_increasing_id()), "sizes")
    order = common.stored(mixing.curriculum(docs, size_col="size").select(*docs.columns, "mix.source_size", "mix.target", "at"), "mix")
    of = order.groupBy("row", "doc_id", "size", "source_size", "target")
    taken = F.coalesce(F.sum(F.when(F.col("at").isNotNull(), F.col("size"))), F.lit(0).cast("bigint"))
    return of.agg(taken.alias("taken"), F.min("at").alias("position")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), 80)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_minhash_near_dedup,
        op3_lm_scoring,
        op4_license_scan,
        op5_mixing,
        op6_embedding_dedup,
        op7_line_dedup,
        op8_packing,
        op9_media_columns,
        op10_language_id,
    )
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    # Windows of 400 bytes, by their texts: feasible on ASCII alone, so op1 is held against brute force instead.
    "op2_minhash_near_dedup": rf"""
with recursive w as (
  select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as i from w)),
n as (select doc_id, count(*) as n from s group by 1),
sets as (select doc_id, md5(string_agg(s, '' order by s)) as h from s group by 1),
class as (select doc_id, min(doc_id) over (partition by h) as rep from sets),
r as (select s.* from s join class c on c.doc_id = s.doc_id and c.rep = s.doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from r a join r b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
edges as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from edges union select b, a from edges),
reach as (
  select distinct rep as v, rep as low from class
  union
  select e.b, r.low from reach r join both_ways e on e.a = r.v where r.low < e.b),
comp as (select v, min(low) as low from reach group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.low, w.doc_id) as component_id,
       w.doc_id = coalesce(comp.low, w.doc_id) as kept
from w left join n using (doc_id) left join class c using (doc_id) left join comp on comp.v = c.rep""",
    "op5_mixing": rf"""
with d as (
  select doc_id, source, len({WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
p as (select source, h[1:3] as part, sum(size)::bigint as n from d group by 1, 2),
s as (select source, sum(n)::bigint as source_size, row_number() over (order by source nulls last) as r from p group by 1),
t as (select *, [5, 2, 1][(r - 1) % 3 + 1] as weight, 3 * source_size as top from s),
f as (
  select *, row_number() over o as place,
    ((sum(source_size) over ())::bigint - coalesce(sum(top) over (o rows between unbounded preceding and 1 preceding), 0)::bigint)::double
      / (sum(weight) over (o rows between current row and unbounded following))::double as level
  from t window o as (order by top / weight, source nulls last)),
g as (select *, min(case when level * weight <= top then place end) over () as first from f),
q as (select *, max(case when place = first then level end) over () as common_level from g),
u as (select source, source_size, least(top::double, common_level * weight) as target, [-0.5, 0.0, 0.5][(r - 1) % 3 + 1]::double as lean from q),
a as (select *, coalesce(sum(n) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from p),
x as (
  select d.*, coalesce(sum(size) over (partition by d.source, h[1:3] order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as within from d),
y as (
  select x.*, u.source_size, u.target, u.lean, a.ahead + within as start,
    case when u.source_size > 0 then floor(u.target / u.source_size)::bigint else 0 end as rounds
  from x join a on a.source is not distinct from x.source and a.part = x.h[1:3]
         join u on u.source is not distinct from x.source),
z as (
  select *, rounds + case when size > 0 and (start * 2 + size)::double <= (target - (rounds * source_size)::double) * 2 then 1 else 0 end as copies,
    least(1::double, (start + size / 2) / target) as share
  from y)
select doc_id, size, source_size, target, (size * copies)::bigint as taken,
  case when copies > 0 and target > 0 then case when lean = 0 then share
    else (sqrt((1 - lean) * (1 - lean) + 4 * lean * share) - (1 - lean)) / (2 * lean) end end as position
from z""",
}
