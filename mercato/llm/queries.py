"""One query per operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (backoff, bpe, curriculum, dartminhash, decisions, langid, ngramjoin, nsbounds, ordinal,
                         phrases, spotsigs, urlrules, warc)
from mercato.llm._store import new_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE: digests of each document's ids and of their decoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(docs, vocabulary).drop("text")


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document, and whether it stays."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each document and the verdict of the learned rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    judged, _ = decisions.judge(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and at which position first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return curriculum.plan(docs).select(
        "doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, compared."""
    return spotsigs.edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def learned_profiles(spark: SparkSession, sf_dir: str) -> langid.Profiles:
    """Profiles of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    training = docs.where(~langid.held_out(F.col("doc_id")))
    return langid.Profiles.collect(langid.learn(training))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.predict(docs, learned_profiles(spark, sf_dir)).drop("text")


#: Grades of the ratings: 0 of poor quality, 1 toxic, 2 neither.
GRADES = 3
#: A document is kept if it is at least as likely as this to have grade 2.
LEAST_P = 0.5


def quality_model(spark: SparkSession, sf_dir: str) -> ordinal.Model:
    """The classifier learned from ``labels``."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
        .when(F.col("quality") == 1, 2).alias("grade"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordinal.fit(docs.join(labels, "doc_id"), GRADES)


def op9_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and chance of the best grade for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = ordinal.predict(docs, quality_model(spark, sf_dir), GRADES - 1).drop("text")
    return graded.withColumn("kept", F.col("p_tail") >= LEAST_P)


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of each document by the counts over all."""
    scored = backoff.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("score", 4).alias("score"))


URL_RULES = [
    urlrules.Rule("allow", "com", "/"), urlrules.Rule("block", "example.com", "/en/"),
    urlrules.Rule("allow", "www.example.com", "/en/"), urlrules.Rule("block", "net", "/es/"),
    urlrules.Rule("block", "net", "/fr/"),
]


def op8_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, URL_RULES).drop("url")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select(
        F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op11_nsbounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after ten rounds of exact k-means."""
    return nsbounds.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return phrases.mine(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document by links of its three-word runs."""
    return ngramjoin.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_dartminhash": op2_dartminhash,
    "op3_decisions": op3_decisions,
    "op4_curriculum": op4_curriculum,
    "op5_spotsigs": op5_spotsigs,
    "op6_langid": op6_langid,
    "op7_backoff": op7_backoff,
    "op8_urlrules": op8_urlrules,
    "op9_ordinal": op9_ordinal,
    "op10_warc": op10_warc,
    "op11_nsbounds": op11_nsbounds,
    "op12_phrases": op12_phrases,
    "op13_ngramjoin": op13_ngramjoin,
}

#: DuckDB statements for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op8_urlrules": r"""
    WITH rests AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0
               THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), parts AS (
        SELECT page_id,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') AS host,
               substr(regexp_extract(rest, '^[^?#]*'),
                      length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
        FROM rests
    ), rules(action, rule_host, rule_path) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
               ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ), fits AS (
        SELECT page_id, rule_host || rule_path AS rule, action,
               row_number() OVER (PARTITION BY page_id
                                  ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
        FROM parts JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
""", "op10_warc": """
    WITH digests AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
               sha1(coalesce(html, '')) AS hex
        FROM pages
    ), fives AS (
        SELECT page_id, payload_bytes,
               list_transform(range(8), lambda k: CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT)) AS numbers
        FROM digests
    ), named AS (
        SELECT page_id, payload_bytes,
               list_aggregate(flatten(list_transform(numbers, lambda v: list_transform([32768, 1024, 32, 1],
                   lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // d) % 32 AS BIGINT) + 1, 1)))),
                   'string_agg', '') AS payload_digest
        FROM fives
    ), lasts AS (
        SELECT payload_digest, payload_bytes, max(page_id) AS response
        FROM named GROUP BY ALL
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> response THEN response END AS refers_to
    FROM named JOIN lasts USING (payload_digest, payload_bytes)
""", "op7_backoff": r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS list
        FROM documents
    ), pairs AS (
        SELECT doc_id, unnest(['<s>'] || list[:-2]) AS before, unnest(list) AS word
        FROM words WHERE len(list) > 0
    ), word_counts AS (
        SELECT word, count(*) AS n FROM pairs GROUP BY word
        UNION ALL SELECT '<s>', count(*) FROM words WHERE len(list) > 0
    ), pair_counts AS (
        SELECT before, word, count(*) AS n FROM pairs GROUP BY before, word
    ), total AS (
        SELECT count(*) AS n FROM pairs
    ), scored AS (
        SELECT p.doc_id, CASE WHEN pc.n >= 2 THEN ln(pc.n) - ln(wb.n)
                              ELSE ln(0.4) + ln(ww.n) - ln(total.n) END AS value
        FROM pairs p JOIN pair_counts pc USING (before, word)
        JOIN word_counts wb ON wb.word = p.before JOIN word_counts ww ON ww.word = p.word, total
    ), sums AS (
        SELECT doc_id, sum(value) AS log_score FROM scored GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(list) AS BIGINT) AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score,
           round(log_score / len(list), 4) AS score
    FROM words LEFT JOIN sums USING (doc_id)
"""}


def _kmeans_sql(rounds: int) -> str:
    """K-means round by round, each a relation of its own."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
        SELECT r, v, vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
            SELECT r, v, vec_id, j, CAST(list_sum(list_transform(list_zip(v, c),
                   lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM vectors, c{t})
        GROUP BY ALL)""")
        if t < rounds:
            steps.append(f"""s{t} AS (
        SELECT j, i, sum(x) AS s, count(*) AS n
        FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY j, i
    ), n{t} AS (
        SELECT j, list(CAST(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY i) AS c
        FROM s{t} GROUP BY j
    ), c{t + 1} AS MATERIALIZED (
        SELECT j, coalesce(n{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN n{t} USING (j))""")
    return f"""
    WITH vectors AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id,
               list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), c0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS j, v AS c
        FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM vectors ORDER BY h NULLS LAST, v LIMIT 8)
    ), {', '.join(steps)}
    SELECT vec_id, a.j AS cluster, d AS distance,
           CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} USING (j)
"""


ORACLE_SQL["op11_nsbounds"] = _kmeans_sql(10)


def phrases_sql(least: int, top: int) -> str:
    return rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), lists AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
    ), totals AS (
        SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM lists GROUP BY lang
    ), grams AS (
        SELECT lang, k, unnest(list_transform(range(1, CAST(len(words) - k + 2 AS BIGINT)),
                                              lambda i: words[i:i + k - 1])) AS words
        FROM lists, range(1, 6) AS t(k) WHERE len(words) >= k
    ), frequent AS (
        SELECT lang, k, words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}
    ), longer AS (
        SELECT DISTINCT lang, a, words[b:b + w - 1] AS words
        FROM frequent, range(2, 5) AS t(w), range(1, 5) AS u(b) WHERE k > w AND b + w - 1 <= k
    ), cuts AS (
        SELECT f.lang, f.words, f.a, f.k, c, l.a AS l, r.a AS r, n,
               CAST((CAST(1000 AS HUGEINT) * f.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
        FROM (SELECT * FROM frequent ANTI JOIN longer USING (lang, a, words)) f JOIN range(1, 5) AS t(c) ON c < k
        JOIN frequent l ON l.lang = f.lang AND l.words = f.words[:c]
        JOIN frequent r ON r.lang = f.lang AND r.words = f.words[c + 1:]
        JOIN totals ON totals.lang = f.lang
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, c) = 1
    )
    SELECT lang, row_number() OVER (PARTITION BY lang
                                    ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
           array_to_string(words, ' ') AS phrase, a, l, r, n, score
    FROM lowest QUALIFY rank <= {top}
"""


ORACLE_SQL["op12_phrases"] = phrases_sql(100, 2000)
