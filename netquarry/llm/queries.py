"""The registered opN_ queries: each applies its operator to the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, elkan, hpylm, jaccard, langid, neardup, packing, quality, secretscan, spm, topk, toxicity, turntrie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = docs.where(F.coalesce(fold("doc_id", 4), F.lit(0)) != 2)
    net = langid.train(langid.sample_windows(seen, "lang", "text", per_lang=500, windows=4))
    found = langid.identify(docs, net, "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.coalesce(fold("key", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = toxicity.train(*toxicity.sample_labelled(docs, learn, "doc_id", "text", "toxic", zeros=1800, ones=900))
    found = toxicity.score(docs, model, "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.coalesce(fold("key", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=0)
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, k=5, scale=256.0)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", threshold=0.93)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spm.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = spm.encode(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", model)
    return found.select("conv_id", "turn", F.size("ids").cast("long").alias("n_pieces"), "ids", spm.decode(found, "ids", model).alias("decoded"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(F.col("key").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secretscan.digest(base).cast("binary"), 256).alias("base_sha256"), secretscan.digest(F.col("spans")).alias("spans"), count("novel"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", n=4, percent=85)
    return found.select(F.col("key").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    found = hpylm.score(table(spark, sf_dir, "documents"), "doc_id", "text", ~held_out)
    return found.select(F.col("key").alias("doc_id"), F.coalesce(fold("key", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def site(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document: its source, and its source's part in one language."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    found = quality.judge(docs.select("doc_id", "text", "source", "lang"), model, "text", *site(docs))
    return found.select("doc_id", "score", "kept", "log_ratio", "host_mean", "path_mean")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dim=64, scale=1024.0, k=8, rounds=10, salt="3").withColumnRenamed("id", "vec_id")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bytebpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = bytebpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary).withColumn("decoded", bytebpe.decode(F.col("ids"), vocabulary))
    return found.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.trie(turntrie.rebuilt(turntrie.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_top_k, op3_packing, op4_near_duplicates, op5_sentencepiece, op6_secrets, op7_jaccard, op8_lm_score, op9_toxicity, op10_quality, op11_centroids, op12_byte_bpe, op13_turn_trie)}


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP4_SQL = """
with recursive v as (select row_number() over () as n, vec_id, label, cast(embedding as double[]) as e from embeddings),
u as (
  select * from v where vec_id is not null and label is not null and e is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
l as (
  select a.vec_id as a, b.vec_id as b, a.n as m from u a join u b on a.label = b.label and a.n <> b.n and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r as (select distinct vec_id as v, vec_id as c from v union select l.b as v, r.c from r join l on l.a = r.v),
c as (select v, min(c) as component_id from r group by v),
k as (select m, count(*) as n_links from l group by m)
select v.vec_id, coalesce(k.n_links, 0) as n_links, c.component_id, coalesce(v.vec_id = c.component_id, true) as kept
from v left join k on k.m = v.n left join c on c.v = v.vec_id
"""

OP7_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as a from documents),
s as (
  select doc_id, case when len(a) = 0 then [] when len(a) < 4 then [array_to_string(a, ' ')]
    else list_distinct([array_to_string(a[i:i + 3], ' ') for i in range(1, len(a) - 2)]) end as g from w),
e as (select doc_id, unnest(g) as x from s),
n as (select doc_id, cast(len(g) as bigint) as n from s),
i as (select p.doc_id as a, q.doc_id as b, count(*) as c from e p join e q on p.x = q.x and p.doc_id < q.doc_id group by 1, 2),
l as (select a, b from i join n u on u.doc_id = a join n v on v.doc_id = b where 100 * c >= 85 * (u.n + v.n - c)),
d as (select a, b from l union all select b, a from l),
r as (select doc_id as v, doc_id as c from n union select d.b as v, r.c from r join d on d.a = r.v)
select n.doc_id, n.n as n_shingles, m.c as component_id from n join (select v, min(c) as c from r group by v) m on m.v = n.doc_id
"""


#: One round after another: t{r} holds centroids, a{r} each vector's nearest.
OP11_SQL = (
    """
with v as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
t0 as materialized (select cast(row_number() over (order by sha256('3:' || cast(vec_id as varchar)) nulls last, e) - 1 as integer) as c, e from v qualify row_number() over (order by sha256('3:' || cast(vec_id as varchar)) nulls last, e) <= 8),
"""
    + "".join(
        f"""a{r} as materialized (
  select n, vec_id, e, min(struct_pack(d := d, c := c)) as m from (
    select v.n, v.vec_id, v.e, t.c, cast(list_sum(list_transform(list_zip(v.e, t.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v, t{r} t) group by n, vec_id, e),
"""
        + f"""s{r} as materialized (select c, i, ((s - ((s % w) + w) % w) // w) as x from (
  select m.c as c, i, cast(sum(e[i]) as hugeint) as s, cast(count(*) as hugeint) as w from a{r}, generate_series(1, 64) g(i) group by 1, 2)),
t{r + 1} as materialized (select t.c, coalesce((select list(cast(x as bigint) order by i) from s{r} s where s.c = t.c), t.e) as e from t{r} t),
""" * (r < 10)
        for r in range(11)
    )
    + """f as (select vec_id, m.c as cluster, m.d as distance from a10)
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(t10.e, ',')) as centroid_sha256 from f join t10 on t10.c = f.cluster
"""
)

#: crc32 bit by bit, as SQL has none.
OP13_SQL = """
with crc32_of_conv as (
  select conv_id, xor(list_reduce(list_concat([4294967295], list_transform(generate_series(1, length(d)), lambda i: cast(ord(d[i]) as bigint))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 6 as h
  from (select distinct conv_id, cast(conv_id as varchar) as d from conversations where conv_id is not null)),
t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (
  select conv_id, list(struct_pack(role := role, text := text) order by turn nulls first, sha256(sha256(role) || text)) as s from t group by conv_id),
h as (
  select o.conv_id, list_concat(coalesce(b.s[:x.h], []), o.s[x.h + 1:]) as s
  from o join crc32_of_conv x on x.conv_id = o.conv_id left join o b on b.conv_id = o.conv_id - o.conv_id % 100),
m as (select conv_id, s, unnest(generate_series(0, len(s))) as depth from h),
n as (
  select s[:depth] as p, depth, min(conv_id) as conv_id, count(*) as n_convs, count(distinct case when len(s) > depth then s[:depth + 1] end) as n_children,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(s) = depth), '') as ends
  from m group by 1, 2),
u as (select p, depth, unnest(generate_series(0, depth)) as up, n_convs, n_children from n),
w as (
  select p[:up] as p, count(*) filter (where n_children = 0) as n_leaves, sum(case when depth = 0 then 0 else (n_convs - 1) * length(p[depth].text) end) as saved from u group by 1)
select n.conv_id, n.depth, a.conv_id as parent_conv_id, n.n_convs, n.n_children, w.n_leaves, cast(w.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from n join w on w.p = n.p left join n a on n.depth > 0 and a.p = n.p[:n.depth - 1] and a.depth = n.depth - 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op7_jaccard": OP7_SQL, "op11_centroids": OP11_SQL, "op13_turn_trie": OP13_SQL}
