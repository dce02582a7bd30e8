"""Mail and document text to word counts and sparse vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.functions.stem import stem
from granary.functions.text import clean_words, html_to_text, words
from granary.session import fill_cores, materialize, sized

# ------------------------------------------------------------ mails

PLAIN, PAGE = "text/plain", "text/html"


def _mail_parts(message, depth: int = 0) -> Iterator[tuple[int, str, str | None]]:
    """(depth, kind, text) of a mail's parts, containers before their parts; only texts and pages have text."""
    nested = message.is_multipart()
    kind = message.get_content_type()
    text = None
    if not nested and kind in (PLAIN, PAGE):
        try:
            text = message.get_content()
        except (LookupError, UnicodeError):  # unknown or wrong character set: as it stands
            text = str(message.get_payload())
    yield depth, "multipart" if nested else kind, text
    for part in message.iter_parts() if nested else ():
        yield from _mail_parts(part, depth + 1)


def mail_parts(mails: DataFrame, key: str, content: str) -> DataFrame:
    """(key, parts) per raw mail; parts: array of (number, depth, kind, text).

    Mails are parsed row by row: a task holds a few of them, not a batch of thousands.
    """

    @F.udf("array<struct<number:int,depth:int,kind:string,text:string>>", useArrow=False)
    def split(raw):
        import email
        import email.policy

        message = email.message_from_bytes(bytes(raw), policy=email.policy.default)
        return [(i, d, k, t) for i, (d, k, t) in enumerate(_mail_parts(message))]

    rows = fill_cores(mails.select(key, F.col(content).alias("content")), key)
    return rows.select(key, split("content").alias("parts"))


def parse_mails(mails: DataFrame, key: str, content: str) -> DataFrame:
    """(key, structure, plain, page) per raw mail.

    ``structure`` nests the kinds of its parts; ``plain`` is the first plain
    text and ``page`` the last page before it (the last of all without one).
    """
    parts = F.col("parts")

    def shown(p: Column, i: Column) -> Column:
        following = F.get(parts, i + 1)
        box = p["kind"] == "multipart"
        closed = p["depth"] - F.coalesce(following["depth"], F.lit(0)) + F.when(box, 1).otherwise(0)
        name = F.when(box, F.lit("multipart(")).otherwise(p["kind"])
        comma = F.when(following.isNotNull() & (closed >= F.when(box, 1).otherwise(0)), ", ").otherwise("")
        return F.concat(name, F.repeat(F.lit(")"), closed.cast("int")), comma)

    first = F.get(F.filter(parts, lambda p: p["kind"] == PLAIN), F.lit(0))
    rows = mail_parts(mails, key, content).withColumn("_first", first)
    pages = F.filter(
        parts, lambda p: (p["kind"] == PAGE) & (F.col("_first").isNull() | (p["number"] < F.col("_first.number")))
    )
    return rows.select(
        key,
        F.array_join(F.transform(parts, shown), "").alias("structure"),
        F.col("_first.text").alias("plain"),
        F.try_element_at(pages, F.lit(-1))["text"].alias("page"),
    )


def mail_text(parsed: DataFrame) -> DataFrame:
    """Adds text: the plain part, else the page as text, else ''."""
    return parsed.withColumn("text", F.coalesce("plain", html_to_text("page"), F.lit("")))


# ------------------------------------------------------------ word counts


def terms(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key, term), one row per word."""
    rows = fill_cores(df.select(key, text), key)
    return rows.select(key, F.explode(words(clean_words(text, **options))).alias("term"))


def word_counts(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key, term, n) in long form."""
    return terms(df, key, text, **options).groupBy(key, "term").agg(F.count("*").alias("n"))


def merge_stems(counts: DataFrame, key: str) -> DataFrame:
    """Counts by stem; each distinct term is stemmed once."""

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem)

    counts = materialize(counts, "counts")
    # one row per distinct term, written: joined by broadcast only while it is small
    table = sized(counts.select("term").distinct().select("term", stems("term").alias("stem")), "stems")
    return counts.join(table, "term").groupBy(key, F.col("stem").alias("term")).agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int, cap: int = 10) -> DataFrame:
    """(term, weight, index): the terms with the largest capped counts, index from 1."""
    totals = counts.groupBy("term").agg(F.sum(F.least("n", F.lit(cap))).alias("weight"))
    top = totals.orderBy(F.desc("weight"), "term").limit(size)
    # ``size`` rows
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), "term"))
    return top.withColumn("index", rank)


def index_counts(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, index, n); terms outside the vocabulary add up at index 0."""
    v = F.broadcast(vocab.select("term", "index"))  # as many rows as the chosen vocabulary size
    joined = counts.join(v, "term", "left")
    return joined.groupBy(key, F.coalesce("index", F.lit(0)).alias("index")).agg(F.sum("n").alias("n"))


def _repeated(indexed: DataFrame, key: str) -> DataFrame:
    """(key, tokens): every index as text, as often as it was counted."""
    entries = F.sort_array(F.collect_list(F.struct("index", "n")))
    rows = indexed.groupBy(key).agg(entries.alias("e"))
    tokens = F.flatten(F.transform("e", lambda e: F.array_repeat(e["index"].cast("string"), e["n"].cast("int"))))
    return rows.select(key, tokens.alias("tokens"))


def _counted(rows: DataFrame, size: int) -> DataFrame:
    """Adds features, the counts of the tokens "0" to ``size``."""
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(size + 1)], inputCol="tokens", outputCol="features")
    return model.transform(rows).drop("tokens")


def sparse_vectors(indexed: DataFrame, key: str, size: int) -> DataFrame:
    """(key, features): vectors of width size + 1; a row holds at most that many entries."""
    return _counted(_repeated(indexed, key), size)


def text_vectors(df: DataFrame, key: str, text: str, size: int, train: Sequence | None = None) -> DataFrame:
    """Whole chain; the vocabulary comes from the rows where ``train`` holds.

    Texts are cleaned and split once, into a written table of counts.
    """
    counts = materialize(merge_stems(word_counts(df, key, text), key), "stemmed")
    basis = counts if train is None else counts.join(df.where(train).select(key), key, "left_semi")
    tokens = _repeated(index_counts(counts, sized(vocabulary(basis, size), "vocabulary"), key), key)
    none = F.array().cast("array<string>")
    return _counted(df.join(tokens, key, "left").withColumn("tokens", F.coalesce("tokens", none)), size)
