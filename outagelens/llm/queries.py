"""Registered queries: each operator over its whole table, reduced to digest columns, and the oracles that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import bpe, centroids, jaccard_join, ngram_lm, pairwise_rank, pieces, secret_scan, spelling, url_filter, vector_graph, vector_packing, warc, wrapper
from ._common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            ship(spark)
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query("""
with recursive v as (
  select row_number() over () as r, vec_id, embedding::double[] as x,
         vec_id is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding,
           lambda c: c is not null and isfinite(c))) and list_bool_or(list_transform(embedding, lambda c: c is not null and c <> 0)) as sound
  from embeddings),
s as (select r, vec_id, len(x) as n, x from v where sound),
links as (
  select a.r as ra, b.r as rb, a.vec_id as ia, b.vec_id as ib from s a join s b on a.n = b.n and a.r <> b.r
  where list_cosine_similarity(a.x, b.x) >= 0.95),
reach as (
  select r, vec_id as c from v
  union select l.rb, reach.c from reach join links l on l.ra = reach.r),
n as (select ra as r, count(*) as k from links group by ra)
select v.vec_id, coalesce(n.k, 0)::bigint as n_links, m.component_id, coalesce(v.vec_id = m.component_id, true) as kept
from v left join n using (r) join (select r, min(c) as component_id from reach group by r) m using (r)
""")
def op1_vector_graph(table) -> DataFrame:
    return vector_graph.near_vectors(table("embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query()
def op2_vector_packing(table) -> DataFrame:
    return packed(table("documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = vector_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op3_secret_battery(table) -> DataFrame:
    spans = F.col("_s_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.scan_secrets(table("documents")).select(
        "doc_id", *map(count, secret_scan.KINDS[:3]), F.sha2(secret_scan.joined(spans, secret_scan.KINDS[:3]), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"), *map(count, secret_scan.KINDS[3:]))


@query()
def op4_perplexity_bands(table) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return ngram_lm.quality_rules(table("documents")).select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in names))


@query("""
with p as (
  select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 and page_id is not null group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from d left join f using (payload_digest)
""")
def op5_warc_round_trip(table) -> DataFrame:
    number = lambda c: F.expr(f"try_cast(substr({c}, {len('<urn:page:') + 1}, length({c}) - {len('<urn:page:>')}) as bigint)")
    return warc.round_trip(table("pages")).select(
        number("record_id").alias("page_id"), "payload_bytes",
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


@query(r"""
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select distinct r, doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
         else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as g
  from w),
n as (select r, any_value(doc_id) as doc_id, count(*) as k from s group by r),
common as (
  select a.r as ra, b.r as rb, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r
  where a.doc_id is not null and b.doc_id is not null group by a.r, b.r),
links as (
  select ra, rb from common join n x on x.r = ra join n y on y.r = rb where 100 * c >= 80 * (x.k + y.k - c)),
reach as (
  select r, doc_id as c from w
  union select l.rb, reach.c from reach join links l on l.ra = reach.r)
select w.doc_id, coalesce(n.k, 0)::bigint as n_shingles, m.component_id
from w left join n using (r) join (select r, min(c) as component_id from reach group by r) m using (r)
""")
def op6_jaccard_join(table) -> DataFrame:
    return jaccard_join.similar_documents(table("documents"))


@query()
def op7_bpe_words(table) -> DataFrame:
    coded = bpe.encode_documents(table("documents"), vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op8_url_bayes(table) -> DataFrame:
    return url_filter.judge_urls(table("pages")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_wrapper_text(table) -> DataFrame:
    return wrapper.extract_main_text(table("pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op10_bradley_terry(table) -> DataFrame:
    return pairwise_rank.rank_documents(table("documents"), table("labels")).select(
        "doc_id", F.col("_r_held_out").alias("held_out"), F.col("_r_score").alias("score"), F.col("_r_predicted").alias("predicted"))


#: crc32 bit by bit, as a list of 256 values and a fold over the bytes; a word's form by joins on words without one letter
@query(r"""
with recursive table256 as materialized (
  select list_transform(range(256), lambda b: list_reduce([b::bigint] || list_transform(range(8), lambda k: 0::bigint),
         lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (select doc_id, run, count(*) as k from runs where length(run) >= 7 group by doc_id, run),
coded as (
  select run, k, xor(4294967295, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id || ':' || run, ''),
         lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, (128 + unicode(c) % 64)::bigint] end)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from counted, table256),
cut as (select case when h % 31 = 0 then run[1:(h % length(run))] || run[(h % length(run)) + 2:] else run end as word, k from coded),
w as materialized (select word, sum(k)::bigint as n from cut where length(word) >= 7 group by word having sum(k) >= 2),
holes as materialized (
  select word, n, i, word[1:i - 1] || '_' || word[i + 1:] as mask, word[1:i - 1] || word[i + 1:] as less
  from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near as (
  select a.word, b.word as other, b.n as m from holes a join holes b on a.mask = b.mask and a.word <> b.word
  union select a.word, b.word, b.n from holes a join w b on a.less = b.word
  union select b.word, a.word, a.n from holes a join w b on a.less = b.word),
best as (select word, count(*) as n_near, max(m) as m, arg_min(other, struct_pack(a := -m, b := other)) as other from near group by word),
forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n
  from w left join best using (word)),
follow as (
  select word, word as reached, 0 as step from forms
  union all select follow.word, forms.form, step + 1 from follow join forms on forms.word = follow.reached where forms.form is not null),
roots as (select word, arg_max(reached, step) as root from follow group by word)
select word, form, root, n, n_near, form_n from forms join roots using (word)
""")
def op11_spelling_gram(table) -> DataFrame:
    return spelling.spelling_variants(table("documents"))


@query()
def op12_piece_spans(table) -> DataFrame:
    coded = pieces.encode_documents(table("documents"), "piece_bpe_32k.model")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"),
                        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("end_byte"))


def _lloyd_sql(rounds: int = 10) -> str:
    """Assignment and floored means, a pair of table expressions a round."""
    def assigned(r: int) -> str:
        return (f"d{r} as (select i.r, c.k, sum((i.x - c.x) * (i.x - c.x)) as d from i join c{r} c using (j) group by i.r, c.k), "
                f"a{r} as materialized (select r, k, d from d{r} qualify row_number() over (partition by r order by d, k) = 1)")
    parts = []
    for r in range(rounds):
        parts.append(assigned(r))
        parts.append(f"s{r} as (select a.k, i.j, sum(i.x) as s, count(*) as n from a{r} a join i using (r) group by a.k, i.j), "
                     f"c{r + 1} as materialized (select c.k, c.j, case when s.n is null then c.x "
                     f"else ((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::bigint end as x from c{r} c left join s{r} s using (k, j))")
    parts.append(assigned(rounds))
    return f"""
with e as (select row_number() over () as r, vec_id, embedding::double[] as x from embeddings),
kept as (select r, vec_id, x from e where len(x) = 64 and list_bool_and(list_transform(x, lambda c: c is not null and isfinite(c)))),
i as materialized (select r, unnest(range(64)) as j, unnest(list_transform(x, lambda c: floor(1024 * c)::bigint)) as x from kept),
first as (select r, row_number() over (order by sha256('3:' || vec_id)) - 1 as k from kept where vec_id is not null
          qualify row_number() over (order by sha256('3:' || vec_id)) <= 8),
c0 as materialized (select f.k, i.j, i.x from first f join i using (r)),
{", ".join(parts)},
shown as (select k, sha256(string_agg(x::varchar, ',' order by j)) as centroid_sha256 from c{rounds} group by k)
select kept.vec_id, a.k::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia,
       (sum(a.d) over ())::bigint as inertia, shown.centroid_sha256
from a{rounds} a join kept using (r) join shown using (k)
"""


@query(_lloyd_sql())
def op13_centroid_tables(table) -> DataFrame:
    rows = centroids.cluster_vectors(table("embeddings"))
    shown = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", shown.alias("centroid_sha256"))
