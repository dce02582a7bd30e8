"""Registered queries of the training-data operators and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    brown,
    chat,
    credentials,
    curriculum,
    importance,
    order_minhash,
    pieces,
    pivots,
    private,
    quality,
    spotsigs,
    trie_counts,
    variants,
)
from granary.sources.tables import Tables

PIECE_MODEL = "piece_bpe_32k.model"


def op1_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses."""
    return spotsigs.edited_fingerprints(Tables(spark, folder).documents)


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents from trees fitted to ``labels.quality``."""
    t = Tables(spark, folder)
    return quality.quality_scores(t.documents, quality.train(t.documents, t.labels))


def op3_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents by backtracking, and their decoded texts, as digests."""
    return pieces.encode_documents(Tables(spark, folder).documents, public_tokenizers.path(PIECE_MODEL))


def op4_class_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Class n-gram scores of all documents."""
    return brown.class_scores(Tables(spark, folder).documents)


def op5_linked_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of all documents, with weak parts of credentials that complete each other."""
    return credentials.secret_report(credentials.secret_spans(Tables(spark, folder).documents))


def op6_pivot_top_products(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest integer products of every 50th vector with all others."""
    rows = Tables(spark, folder).embeddings.where(pivots.usable(F.col("embedding")))
    rows = rows.select("vec_id", pivots.scaled(F.col("embedding")).alias("v"))
    return pivots.top_products(rows, rows.where("vec_id % 50 = 0"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
        vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_bootstrapped_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data spans of all documents, with identifiers found through learned contexts."""
    return private.private_report(private.private_spans(Tables(spark, folder).documents))


def op8_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of all documents."""
    scores = trie_counts.unigram_pieces(public_tokenizers.path(PIECE_MODEL))
    return trie_counts.token_counts(Tables(spark, folder).documents, scores)


def op9_order_minhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.near_duplicate_classes(Tables(spark, folder).documents)


def op10_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document by the default weights and schedules, in order of first position."""
    plan = curriculum.training_plan(Tables(spark, folder).documents)
    return plan.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.get("positions", F.lit(0)).alias("first_position"),
    ).orderBy("first_position", "doc_id")


def op11_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weights, scores and ranks of all documents, resampled towards the benchmark texts."""
    t = Tables(spark, folder)
    return importance.resampled(t.documents, t.benchmark)


#: CRC-32 of a blob column ``b``, byte by byte, by a table made from its polynomial
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    bytes_ = f"list_transform(range(CAST(length(hex(encode({text}))) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, x: xor(k[xor(c, x) % 256 + 1], c // 256)))"


def _small(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP11_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all({_small("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT rid, unnest(w) AS w FROM d),
g AS (SELECT unnest(regexp_extract_all({_small("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, {_crc("w")} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM g) x, crc_table),
s AS (SELECT b, count(*) AS n FROM f JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN v USING (w) GROUP BY b),
gains AS (SELECT CAST(r.b AS BIGINT) AS b, CAST(floor(1000 * ln(
        CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM f) + 10000) AS DOUBLE)
        / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM g) + 10000) AS DOUBLE))) AS BIGINT) AS gain
    FROM range(10000) r(b) LEFT JOIN s ON r.b = s.b LEFT JOIN t ON r.b = t.b),
w AS (SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN v USING (w) JOIN gains USING (b) GROUP BY rid),
scored AS (SELECT d.rid, doc_id, CAST(len(d.w) AS BIGINT) AS n_features,
    CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    (CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296 AS u
    FROM d LEFT JOIN w USING (rid)),
final AS (SELECT *, CAST(weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS BIGINT) AS score FROM scored),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS r FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score,
    CASE WHEN r <= (SELECT count(*) * 10 // 100 FROM ranked) THEN r END AS rank
FROM final LEFT JOIN ranked USING (rid)
"""


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Forms and roots of all frequent words of the documents, by words one edit apart."""
    return variants.variant_groups(Tables(spark, folder).documents)


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, {_small("w")} AS w, count(*) AS n FROM
    (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) x GROUP BY ALL),
hashed AS (SELECT w, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, crc_table WHERE length(w) >= 6),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, CAST(p AS BIGINT) AS p, substr(word, 1, p - 1) || substr(word, p + 1) AS part FROM words, range(1, 1 + length(word)) r(p)),
near AS (
    SELECT a.word, b.word AS form, b.n AS form_n FROM less a JOIN less b ON a.part = b.part AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word),
best AS (SELECT word, count(*) AS n_near, first(form ORDER BY form_n DESC, form) AS form, max(form_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
    CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON way.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT way.word, way.at AS root FROM way JOIN forms ON way.at = forms.word WHERE forms.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
"""


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations and of one that holds control strings, read back from their formatted texts."""
    turns = Tables(spark, folder).conversations.select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(extra)))


_CONTROL = r"(<\\*(/?s>|</?SYS>>)|\[\\*(/?INST|/?ROLE|TEXT)\])"
OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
        + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE length(role) + 23 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_spot_signatures,
        op2_quality_classifier,
        op3_piece_encoding,
        op4_class_ngrams,
        op5_linked_secrets,
        op6_pivot_top_products,
        op7_bootstrapped_private_data,
        op8_trie_token_counts,
        op9_order_minhash_classes,
        op10_curriculum_mix,
        op11_target_resampling,
        op12_spelling_variants,
        op13_chat_format,
    )
}
ORACLES: dict[str, str] = {
    "op6_pivot_top_products": OP6_SQL,
    "op11_target_resampling": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
