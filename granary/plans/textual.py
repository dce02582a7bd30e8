"""Text queries."""

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import evaluate as E
from granary.operators import textprep as T
from granary.operators.split import kfold
from granary.plans.registry import query
from granary.session import fill_cores, materialize

WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
STRIP = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<head.*?>.*?</head>', '', 'gis'), '<a\\s.*?>', ' HYPERLINK ', 'gis'), '<.*?>', '', 'gs'), '{WS}*\\n', chr(10), 'g')"""
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(?:https?://|ftp://|www\.)[^\s<>"'']+', ' URL ', 'gi'), '\p{Nd}+(?:\.\p{Nd}*)?(?:[eE][+-]?\p{Nd}+)?', 'NUMBER', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')"""
COUNTS = f"(SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split(trim({CLEAN}), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)"


def make_mails(t):
    """Raw mails from documents: plain, page only, both, or nested."""

    # row by row: a task holds a few mails, not a batch of thousands
    @F.udf("binary", useArrow=False)
    def build(key, text):
        import html
        from email.message import EmailMessage

        page = f"<html><head><title>t</title></head><body><p>{html.escape(text)}</p><a href='u'>x</a></body></html>"
        m = EmailMessage()
        m["Subject"] = f"mail {key}"
        kind = 0 if key is None else key % 4
        if kind == 1:
            m.set_content(page, subtype="html")
        else:
            m.set_content(text)
        if kind >= 2:
            m.add_alternative(page, subtype="html")
        if kind == 3:
            m.add_attachment(b"abc", maintype="application", subtype="pdf", filename="a.pdf")
        return m.as_bytes()

    clean = F.regexp_replace("text", r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", " ")
    docs = fill_cores(t.documents.select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), build("doc_id", clean).alias("content"))


@query(
    "r1_mail_structures",
    """SELECT CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' WHEN 2 THEN 'multipart(text/plain, text/html)'
        ELSE 'multipart(multipart(text/plain, text/html), application/pdf)' END AS structure, count(*) AS n FROM documents GROUP BY 1""",
)
def _(t):
    return T.parse_mails(make_mails(t), "doc_id", "content").groupBy("structure").agg(F.count("*").alias("n"))


@query("r2_html_to_text", f"SELECT page_id, md5({STRIP}) AS digest, length({STRIP}) AS n_chars FROM pages")
@query("i13_regex_replace", f"SELECT page_id, md5({STRIP}) AS digest, length({STRIP}) AS n_chars FROM pages")
def _(t):
    plain = X.strip_markup("html")
    return fill_cores(t.pages, "page_id").select("page_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n_chars"))


@query("i14_html_unescape")
def _(t):
    """Decoded pages and how many entities were decoded."""
    stripped, full = X.strip_markup("html"), X.html_to_text("html")
    return fill_cores(t.pages, "page_id").select("page_id", F.length(full).alias("n_chars"), (F.length(stripped) - F.length(full)).alias("shorter_by"))


@query(
    "r3_mail_text",
    """SELECT doc_id, md5(regexp_replace(text || CASE WHEN doc_id % 4 = 1 THEN 'HYPERLINKx' ELSE '' END, '[^a-zA-Z]', '', 'g')) AS letters FROM documents""",
)
def _(t):
    """Digest of the letters in the extracted text of every mail."""
    text = T.mail_text(T.parse_mails(make_mails(t), "doc_id", "content"))
    return text.select("doc_id", F.md5(F.regexp_replace("text", "[^a-zA-Z]", "")).alias("letters"))


@query(
    "r4_url_replacement",
    r"""SELECT page_id, regexp_replace('see ' || url || ' or WWW.EXAMPLE.org/x, end', '\b(?:https?://|ftp://|www\.)[^\s<>"'']+', ' URL ', 'gi') AS text FROM pages""",
)
def _(t):
    src = F.concat(F.lit("see "), F.col("url"), F.lit(" or WWW.EXAMPLE.org/x, end"))
    return t.pages.select("page_id", F.regexp_replace(src, X.URL, " URL ").alias("text"))


@query("r5_clean_words", f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents")
def _(t):
    docs = fill_cores(t.documents.select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.md5(X.clean_words("text")).alias("digest"))


@query("r6_word_counts", f"SELECT doc_id, term, n FROM {COUNTS}")
def _(t):
    return T.word_counts(t.documents, "doc_id", "text")


@query("r7_stemmed_counts")
def _(t):
    counts = T.merge_stems(T.word_counts(t.documents, "doc_id", "text"), "doc_id")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


VOCAB = f"(SELECT term, weight, row_number() OVER (ORDER BY weight DESC, term) AS index FROM (SELECT term, CAST(sum(least(n, 10)) AS BIGINT) AS weight FROM {COUNTS} GROUP BY 1 ORDER BY weight DESC, term LIMIT 1000))"


@query("r8_vocabulary", f"SELECT * FROM {VOCAB}")
def _(t):
    return T.vocabulary(T.word_counts(t.documents, "doc_id", "text"), 1000)


@query("u7_one_row_to_many", f"SELECT doc_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS words FROM {COUNTS} GROUP BY 1")
def _(t):
    per_term = T.terms(t.documents, "doc_id", "text").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return per_term.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("n").alias("words"))


@query("g7_top_terms", f"SELECT term, CAST(sum(n) AS BIGINT) AS n FROM {COUNTS} GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def _(t):
    return T.terms(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query(
    "r9_indexed_counts",
    f"SELECT doc_id, coalesce(v.index, 0) AS index, CAST(sum(n) AS BIGINT) AS n FROM {COUNTS} c LEFT JOIN {VOCAB} v ON c.term = v.term GROUP BY 1, 2",
)
def _(t):
    counts = materialize(T.word_counts(t.documents, "doc_id", "text"), "counts")
    return T.index_counts(counts, T.vocabulary(counts, 1000), "doc_id")


@query(
    "r9_sparse_vectors",
    f"""WITH x AS (SELECT doc_id, coalesce(v.index, 0) AS index, CAST(sum(n) AS BIGINT) AS n FROM {COUNTS} c LEFT JOIN {VOCAB} v ON c.term = v.term GROUP BY 1, 2)
       SELECT doc_id, '(1001,[' || string_agg(index, ',' ORDER BY index) || '],[' || string_agg(n || '.0', ',' ORDER BY index) || '])' AS features FROM x GROUP BY 1""",
)
def _(t):
    counts = materialize(T.word_counts(t.documents, "doc_id", "text"), "counts")
    indexed = T.index_counts(counts, T.vocabulary(counts, 1000), "doc_id")
    return T.sparse_vectors(indexed, "doc_id", 1000).select("doc_id", F.col("features").cast("string").alias("features"))


@query("r10_text_classifier")
@query("m21_logistic_regression")
def _(t):
    """Word-count vectors to a classifier; held-out precision and recall per fold."""
    from granary.models.spark_ml import logistic

    docs = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    folded = kfold(docs, ["doc_id"], 3, 42, ["quality"])
    vectors = materialize(T.text_vectors(folded, "doc_id", "text", 1000).select("doc_id", "quality", "fold", "features"), "vectors")
    out = None
    for k in range(3):
        model = logistic("quality", 0.01).fit(vectors.where(F.col("fold") != k))
        scored = model.transform(vectors.where(F.col("fold") == k))
        rows = E.binary_report(scored, "quality", "prediction", ["fold"])
        out = rows if out is None else out.unionByName(rows)
    return out
