"""The corpus queries as registered, and the SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewatch.llm import binary_search, bpe, collocations, interactions, langid, mixing, pages, resample, resharding, rules, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: 4-word shingles, at most 4 differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", simhash.hex64(found.fp).alias("fingerprint"), "component_id")


def op1_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance and whether a draw of 85 % keeps it; the target are good documents."""
    docs = table(spark, sf_dir, "documents")
    return resample.resample(docs, resample.good_examples(docs, table(spark, sf_dir, "labels")), share=0.85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that each document is toxic."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's address."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from one shard a source (hashed into 40) to 40 shards of near equal bytes, as read from the rewritten shards."""
    docs = table(spark, sf_dir, "documents")
    now = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 40
    found = resharding.resharded(docs, now, shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    name = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), name, back="decoded")
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every fiftieth embedding, among all."""
    return binary_search.nearest(binary_search.codes_of(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, k=10)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each document and whether base rules and the learned list keep it."""
    found = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *rules.BASE, "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % of all words takes from each document."""
    found = mixing.queue(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of 2 and 3 words of each language that tie their words most."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, share=50, top=2000)


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of all orders of five filters keeps, removes and loses, for each source."""
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), interactions.text_filters(F.col("text")), copies="E").drop("filter")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_resample": op1_resample, "op2_toxicity": op2_toxicity, "op3_urls": op3_urls, "op4_reshard": op4_reshard, "op5_simhash": op5_simhash, "op6_langid": op6_langid, "op7_bpe": op7_bpe, "op8_nearest": op8_nearest,
    "op9_rules": op9_rules, "op10_mixing": op10_mixing, "op11_collocations": op11_collocations, "op12_interactions": op12_interactions,
    "op13_main_text": op13_main_text,
}
#: Brute force: all pairs of sign codes.
OP8_SQL = """
WITH bits AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT id, string_agg(CASE WHEN e > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS b FROM bits GROUP BY id),
d AS (SELECT q.id AS query_id, x.id AS neighbor_id, CAST(hamming(q.b, x.b) AS INT) AS distance FROM c q JOIN c x ON x.id <> q.id WHERE q.id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 10
"""
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g1 AS (SELECT lang, w[i] AS a, count(*) AS f FROM u GROUP BY ALL),
g2 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f FROM u WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM u WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang),
held AS (SELECT lang, a, b, max(f) AS most FROM (SELECT lang, a, b, f FROM g3 UNION ALL SELECT lang, b, c, f FROM g3) GROUP BY ALL),
two AS (SELECT lang, g2.a || ' ' || g2.b AS phrase, g2.f AS a, x.f AS l, y.f AS r FROM g2 JOIN g1 x USING (lang, a) JOIN (SELECT lang, a AS b, f FROM g1) y USING (lang, b)
  LEFT JOIN held USING (lang, a, b) WHERE most IS NULL OR 100 * most < 50 * g2.f),
three AS (SELECT g3.lang, g3.a || ' ' || g3.b || ' ' || g3.c AS phrase, g3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2 FROM g3
  JOIN g1 x ON x.lang = g3.lang AND x.a = g3.a JOIN g2 yz ON yz.lang = g3.lang AND yz.a = g3.b AND yz.b = g3.c
  JOIN g2 xy ON xy.lang = g3.lang AND xy.a = g3.a AND xy.b = g3.b JOIN g1 z ON z.lang = g3.lang AND z.a = g3.c),
s3 AS (SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2 FROM three),
s AS (SELECT lang, phrase, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM two
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s3)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s) JOIN n USING (lang) WHERE rank <= 2000
"""
#: Each order is walked through on its own, document by document.
OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
q AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS x FROM s),
g AS (SELECT part, fails, count(*) AS n, count(CASE WHEN good THEN 1 END) AS n_good, count(CASE WHEN bad THEN 1 END) AS n_bad FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, x, n, n_good, n_bad, fails = x AS alone, contains(fails, x) AS fails, len(list_intersect(string_split(before, ''), string_split(g.fails, ''))) > 0 AND before <> '' AND g.fails <> '' AS gone FROM g, q),
c AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails, coalesce(sum(n_good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_bad) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c
"""
ORACLES: dict[str, str] = {"op8_nearest": OP8_SQL, "op11_collocations": OP11_SQL, "op12_interactions": OP12_SQL}
