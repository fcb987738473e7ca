"""The registered queries of the numbered operators, each over its whole table, with checking SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm import (
    cross_polytope,
    hidden_markov,
    minhash_join,
    mixing,
    nn_descent,
    pairwise_quality,
    perspectives,
    phrases,
    piece_suffixes,
    secret_links,
    syncmers,
    wavelet_infill,
    zstd_language,
)
from corpus_spark.llm.batches import short_batches
from corpus_spark.llm.held_out import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = zstd_language.learn(docs.filter(~out))
    return zstd_language.identify(docs.select("doc_id", "text", out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


@query
def op3_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op6_source_mix"] = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS hash
    FROM documents
), ranked AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source
), filled AS (
    SELECT *, CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS held,
        CAST(sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest,
        CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
    FROM ranked
), level AS (
    SELECT (budget - held) / rest AS level FROM filled WHERE (budget - held) / rest * weight < 2 * source_size
    ORDER BY 2.0 * source_size / weight, source LIMIT 1
), targets AS (
    SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM filled, level
), planned AS (
    SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS passes FROM targets
), running AS (
    SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, d.hash, p.target - p.passes * p.source_size AS wanted,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS through,
        sum(d.size) OVER (PARTITION BY d.source, d.hash) AS held, d.source
    FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
), cut AS (
    SELECT source, arg_min(hash + CASE WHEN held < 2 * (wanted - through + held) THEN 1 ELSE 0 END, hash) AS below
    FROM running WHERE through > wanted GROUP BY source
)
SELECT r.doc_id, r.size, r.source_size, r.target,
    CAST(r.size * (r.passes + CASE WHEN r.passes < 2 AND (c.below IS NULL OR r.hash < c.below) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
"""


@query
def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digest(secret_links.scan(table(spark, sf_dir, "documents")))


@query
def op8_piece_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_suffixes.encode(table(spark, sf_dir, "documents"), piece_suffixes.Pieces.load())


@query
def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    ranking = pairwise_quality.learn(docs, table(spark, sf_dir, "labels").filter(~out))
    return pairwise_quality.score(docs.select("doc_id", "text", out.alias("held_out")), ranking).select(
        "doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted")
    )


@query
def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


ORACLES["op10_perspective_rotation"] = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
        replace(coalesce(text, ''), '<|', '< |') AS said
    FROM conversations
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, said) AS place FROM turns
), participants AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), rendered AS (
    SELECT t.conv_id, p.perspective, t.place, CAST((t.place - 1) // 256 AS BIGINT) AS part, t.speaker = p.perspective AS own,
        CASE WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
            WHEN t.speaker = p.perspective THEN '<|assistant|>' || chr(10)
            ELSE '<|user name=' || replace(t.speaker, '<|', '< |') || '|>' || chr(10) END AS head,
        t.said || '<|end|>' || chr(10) AS body
    FROM placed t JOIN participants p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), measured AS (
    SELECT *, CAST(sum(length(head) + length(body)) OVER (
        PARTITION BY conv_id, perspective, part ORDER BY place) AS BIGINT) AS finish FROM rendered
)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
    coalesce(string_agg(CASE WHEN own THEN (finish - length(body)) || ':' || finish END, ',' ORDER BY place), '') AS mask
FROM measured GROUP BY conv_id, perspective, part
"""


@query
def op12_wavelet_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    restored = wavelet_infill.restored(F.col("fim_form"), F.col("fim_text"))
    return wavelet_infill.fill_in_middle(docs).select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


ORACLES["op12_wavelet_infill"] = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM units
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
            THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, coalesce(array_to_string(u[1:i], ''), '') AS a, coalesce(array_to_string(u[i + 1:j], ''), '') AS b,
        coalesce(array_to_string(u[j + 1:n], ''), '') AS c
    FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrases"] = """
WITH pieces AS (
    SELECT row_number() OVER () AS piece_id, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), words AS (
    SELECT piece_id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
        SELECT piece_id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces)
), following AS (
    SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words
    WINDOW p AS (PARTITION BY piece_id ORDER BY i)
), counts AS (
    SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM following GROUP BY ALL
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM following WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM following WHERE w3 IS NOT NULL GROUP BY ALL
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
), parted AS (
    SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cut AS (
    SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r,
        CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM parted c JOIN counts l ON l.lang = c.lang AND l.phrase = head JOIN counts r ON r.lang = c.lang AND r.phrase = tail
), worst AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
    SELECT lang, phrase, max(f) AS longer FROM (
        SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM candidates WHERE size = 3)
    GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), ranked AS (
    SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
    FROM worst w LEFT JOIN inner_phrases i ON w.lang = i.lang AND w.phrase = i.phrase
    WHERE NOT coalesce(100 * longer >= 50 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
