"""One query for each operator of this package, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import decontam, embeddings, kmeans, langid
from strandspark.llm import mix as mixing
from strandspark.llm import shard as sharding
from strandspark.llm import pages as paging
from strandspark.llm import quality, resample, simhash, tokens, toxicity, urls
from strandspark.llm.common import cut, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("words")))
    mixed = mixing.mix(sized, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = decontam.n_hit(F.col("ranges"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS win, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM p),
s AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, k, s.n, item_id FROM s JOIN p ON s.win = p.win AND s.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")))
    return sharding.shard(rows, "size").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.digests(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM s WHERE list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.v FROM r JOIN l ON r.reached = l.u),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN k ON k.u = e.vec_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the distinct runs, with its table of 256 registers made from the polynomial.
OP11_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
w AS MATERIALIZED (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM w),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda k: ('0x' || x[k:k + 1])::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
m AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
d AS (SELECT id AS doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || sha256('7:' || id)[1:8])::BIGINT AS u FROM w LEFT JOIN m USING (id) WHERE side = 'd'),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM r) THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""

#: Rules of op12: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Every subset of a labelled URL's tokens is counted, where FP-growth prunes.
OP12_SQL = r"""
WITH c(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
x AS (SELECT page_id, r, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM x JOIN c ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
t AS MATERIALIZED (SELECT page_id, host, path, rule, v, list_sort(list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda y: y <> ''), lambda y: 'h:' || y),
  list_transform(list_filter(string_split(path, '/'), lambda y: y <> ''), lambda y: 'p:' || regexp_replace(y, '[0-9]+', '0', 'g')),
  list_transform(list_filter(list_transform(string_split(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&'), lambda y: regexp_extract(y, '^[^=]*')), lambda y: y <> ''), lambda y: 'q:' || y)))) AS ts
  FROM x LEFT JOIN l USING (page_id)),
k AS (SELECT page_id, v, array_to_string(list_filter(ts, lambda y, i: (q >> (i - 1)) & 1 = 1), ' ') AS s FROM (SELECT page_id, v, ts, unnest(range(1, (1 << len(ts))::BIGINT)) AS q FROM t)),
n AS (SELECT s, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY s) AS held FROM k WHERE v IS NOT NULL GROUP BY s, v),
m AS (SELECT s, v, n::DOUBLE / held AS confidence, n FROM n WHERE n >= (SELECT greatest(1, ceil(0.01::DOUBLE * count(*))) FROM t WHERE v IS NOT NULL AND len(ts) > 0) AND n::DOUBLE / held >= 0.8),
b AS (SELECT page_id, arg_max(m.v, (confidence, n, m.v)) AS v FROM k JOIN m USING (s) WHERE k.v IS NULL GROUP BY page_id)
SELECT t.page_id, host, path, rule, coalesce(t.v, b.v, 'allow') AS verdict FROM t LEFT JOIN b USING (page_id)
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _op13_sql(rounds: int = 10) -> str:
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8))",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c{k}.x[i]) * (v.x[i] - c{k}.x[i])))::BIGINT AS d FROM v, c{k}) GROUP BY vec_id, x)")
        if k < rounds:
            parts.append(f"m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT c, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(64)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (c))")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_languages, op3_decontaminate, op4_simhash_dedup, op5_shards, op6_token_ids, op7_toxicity, op8_main_text, op9_embedding_dedup, op10_quality, op11_importance_resampling, op12_url_filter, op13_centroids)}
SQL: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op9_embedding_dedup": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_centroids": _op13_sql()}
