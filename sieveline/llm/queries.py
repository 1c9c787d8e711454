"""The thin ``opN_<name>`` queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, filter_audit, html_text, language_id, media_ts, packing, quality_classifier, quality_rules, sentence_pieces, simhash, substring_dedup, suffix_dedup, topk_search
from .frames import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.annotate(docs, forest, ["doc_id"]).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.annotate(docs, network, ["doc_id"]).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shorten(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.annotate(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op6_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.shorten(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.digest(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: A window is repeated if its words also start in a document with a smaller id; removed words are those of the last 50 starts.
OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spots AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s, n FROM spots),
marked AS (SELECT doc_id, i, i <= n - 49 AND min(doc_id) OVER (PARTITION BY i <= n - 49, s) < doc_id AS again FROM windows),
gone AS (SELECT doc_id, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM marked)
SELECT documents.doc_id, count(word)::BIGINT AS n_words, count(CASE WHEN gone THEN 1 END)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN (SELECT * FROM spots JOIN gone USING (doc_id, i)) USING (doc_id) GROUP BY documents.doc_id
"""
#: Windows of 200 bytes in hexadecimal, those that occur twice, and the runs that they cover.
OP7_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 400) AS s FROM (SELECT doc_id, h, unnest(range(strlen(h) // 2 - 199)) AS i FROM b WHERE strlen(h) >= 400)),
again AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT md5(s) AS m FROM windows GROUP BY 1 HAVING count(*) > 1) ON md5(s) = m),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM runs GROUP BY doc_id)
SELECT b.doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string([substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END, CASE WHEN k = len(starts) THEN strlen(h) ELSE 2 * starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * ends[k] END) FOR k IN range(0, len(starts) + 1)], '') END)) AS kept_sha256
FROM b LEFT JOIN cuts USING (doc_id)
"""
#: Filters as bits of a mask, then every order and step over the counts of each mask.
OP11_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^ 	-]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT part, good, toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
sums AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE mask & (own | before) = 0) AS kept, sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS removed, sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0) AS redundant,
  sum(n) FILTER (WHERE mask = own) AS unique_fails, sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS toxic_lost FROM steps, counts GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM sums
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round as two tables: the nearest centroid of every vector, and the centroids after it."""
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, x FROM v QUALIFY j < {k})",
    ]
    nearest = "SELECT vec_id, any_value(v.x) AS x, min((list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 64 + j) AS best FROM v, c{} c GROUP BY vec_id"
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        parts.append(f"m{r} AS (SELECT j, list(s ORDER BY i) AS x FROM (SELECT best % 64 AS j, i, floor(sum(x[i]) / count(*)) AS s FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY j)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))")
    parts.append(f"last AS (SELECT vec_id, (best % 64)::INT AS cluster, best // 64 AS distance FROM ({nearest.format(rounds)}))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM last JOIN c{rounds} c ON c.j = cluster
"""


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
scores AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scores QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_quality_rules, op3_quality_classifier, op4_substring_dedup, op5_language_id, op6_media_ts, op7_suffix_dedup, op8_sentence_pieces, op9_packing, op10_simhash, op11_filter_audit, op12_centroids, op13_topk_search)}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express."""
    return {"op4_substring_dedup": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_centroids": _op12_sql(), "op13_topk_search": OP13_SQL}
