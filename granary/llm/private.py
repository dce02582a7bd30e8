"""Personal data: base patterns, and unseen identifiers found through bootstrapped contexts.

Base patterns give the seed entities. The words around them induce lexical
patterns; every identifier-like token in the corpus is linked to the patterns
of its own surroundings. On this graph Spark scores patterns by the scores of
their instances and instances by their patterns, a few rounds in turn, and the
instances of high-confidence patterns are reported as further identifiers.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import located, materialize, overlapped, span_digest, text_or_empty

# The base patterns, written so that no text makes them backtrack.
# A local part can begin only after a character it cannot contain, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
EXTRA = "identifier"
ORDER = {k: i for i, k in enumerate((*KINDS, EXTRA))}
#: candidates: letters, a mark, then a digit and 3 or more further letters, digits and hyphens; or groups of hex digits as in a UUID
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])(?:[A-Za-z]*+[-_#:]?+[0-9][0-9A-Za-z-]{3,}+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})"
    r"(?![^\x20\x09-\x0D.,;:!?])"
)
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 3.0  # sum of the scores that a pattern's instances need
_NEAR = 48  # code points before a match that mostly hold its context
_PIECE = 4096
PRIOR = 1.0  # added to a pattern's number of instances

_SPAN = "array<struct<rank:int,start:bigint,kind:string,end:bigint,value:string,two:string,one:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn check of a digit string; every second digit from the right counts double."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)),
    )
    return total % 10 == 0


def _octets(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(
        F.split(found, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255
    )


def _spans(kind: str, text: Column, pattern: str, when: Column, keep=None) -> Column:
    rows = F.when(when, located(text, pattern))
    if keep is not None:
        rows = F.filter(rows, lambda s: keep(s["found"]))
    # the two words and the one word before, as far as they stand after the match before this one
    def context(s: Column, words: str) -> Column:
        tail = F.right(s["before"], F.lit(_NEAR))
        whole = tail.rlike(r"[\x20\x09-\x0D][^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$")
        return F.lower(F.regexp_extract(F.when(whole, tail).otherwise(s["before"]), words + r"[\x20\x09-\x0D]*+$", 1))

    out = F.transform(
        rows,
        lambda s: F.struct(
            F.lit(ORDER[kind]).alias("rank"),
            s["start"].alias("start"),
            F.lit(kind).alias("kind"),
            s["end"].alias("end"),
            s["found"].alias("value"),
            context(s, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)").alias("two"),
            context(s, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)").alias("one"),
        ),
    )
    return F.coalesce(out, F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Leftmost, non-overlapping matches of each kind; matches that fail are dropped, not tried again."""
    digit = text.rlike("[0-9]")
    return {
        "email": _spans("email", text, EMAIL, text.contains("@")),
        "ip": _spans("ip", text, IP, text.rlike(r"[0-9]\.[0-9]"), _octets),
        "card": _spans(
            "card",
            text,
            CARD,
            digit,
            lambda f: F.length(_digits(f)).between(16, 19) & _luhn(_digits(f)),
        ),
        "phone": _spans("phone", text, PHONE, text.contains("+"), lambda f: F.length(_digits(f)).between(8, 15)),
    }


def private_spans(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS) -> DataFrame:
    """Every document with its base spans and discovered identifiers (arrays of span structs).

    Columns: the keys, email, ip, card, phone, identifier. Texts are scanned
    once; the spans go to a written table with numbered rows, so repeated
    doc_ids stay apart. The graph has one edge per candidate and context; a
    common context or value is summed before it is shuffled.

    A null text is an empty one, null keys stay null, other columns are
    ignored, and an empty table gives no rows.
    """
    body = F.col("_text")
    base = base_spans(body)
    weak = _spans(EXTRA, body, CANDIDATE, body.rlike("[0-9][0-9A-Za-z-]{3}"))
    own = F.concat(*KINDS)
    scanned = docs.select(*keys, text_or_empty(text).alias("_text")).select(
        *keys, *[c.alias(k) for k, c in base.items()], weak.alias("_weak"), F.monotonically_increasing_id().alias("_row")
    )
    scanned = materialize(scanned, "private")
    found = scanned.where(F.size(own) + F.size("_weak") > 0).select(
        "_row", F.explode(F.concat(own, F.col("_weak"))).alias("s")
    )
    # a candidate that shares a place with a base span is none
    extra = F.col("s.kind") == EXTRA
    found = materialize(found.withColumn("_covered", extra & overlapped("_row", ~extra)).where("not _covered"), "spans")
    contexts = F.array(
        F.when(F.col("s.two") != "", F.concat(F.lit("2 "), F.col("s.two"))),
        F.when(F.col("s.one") != "", F.concat(F.lit("1 "), F.col("s.one"))),
    )
    placed = found.select("_row", "s", F.explode(F.array_compact(contexts)).alias("pattern"))
    value = F.lower("s.value")
    edges = materialize(
        placed.select("pattern", value.alias("value"), (F.col("s.kind") != EXTRA).alias("seed"))
        .groupBy("pattern", "value")
        .agg(F.max(F.col("seed").cast("double")).alias("seed")),
        "graph",
    )
    # scores are at most 1: a pattern of too few instances can never have the support
    enough = edges.groupBy("pattern").agg(F.count("*").alias("_n")).where(F.col("_n") >= SUPPORT)
    edges = materialize(edges.join(enough.select("pattern"), "pattern"), "graph")
    scores = edges.select("value", "seed").groupBy("value").agg(F.max("seed").alias("score"))
    mean = F.sum("score") / (F.count("*") + PRIOR)
    trust = F.when(F.sum("score") >= SUPPORT, mean).otherwise(0.0).alias("trust")
    for _ in range(rounds):
        patterns = edges.join(scores, "value").groupBy("pattern").agg(trust)
        scores = materialize(
            edges.join(patterns, "pattern")
            .groupBy("value")
            .agg(F.greatest(F.max("seed"), F.max("trust")).alias("score")),
            "scores",
        )
    trusted = edges.join(scores, "value").groupBy("pattern").agg(trust).where(F.col("trust") >= CONFIDENT).select("pattern")
    more = placed.where(F.col("s.kind") == EXTRA).join(trusted, "pattern", "left_semi")
    more = more.groupBy("_row").agg(F.collect_set("s").alias("_more"))
    return scanned.join(more, "_row", "left").select(
        *keys, *KINDS, F.coalesce("_more", F.array().cast(_SPAN)).alias(EXTRA)
    )


def private_report(spans: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    base = F.concat(*KINDS)
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.concat(base, EXTRA)).alias("spans"),
    )


def _pieces(body: Column) -> Column:
    """The text in pieces of ``_PIECE`` code points, so that none is sought from the start of a long text."""
    return F.regexp_extract_all(body, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from one code point to another, out of its pieces."""
    a, b = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    at = (start % _PIECE + 1).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inside = F.substring(piece(a), at, (end - start).cast("int"))
    across = F.concat(
        F.substring(piece(a), at, F.lit(_PIECE)),
        F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
        F.substring(piece(b), F.lit(1), (end % _PIECE).cast("int")),
    )
    return F.when(a == b, inside).otherwise(across)


def _marked_up(box: Column) -> Column:
    """The text with its sorted spans replaced by their kinds; a span that begins inside an earlier one only prolongs it.

    How far the spans before a span reach is a running maximum over chunks.
    """
    chunk, spans, pieces = 256, box["s"], box["t"]
    furthest = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, s: F.greatest(a, s["end"]))
    sums = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / chunk).cast("int")), lambda c: furthest(F.slice(spans, c * chunk + 1, F.lit(chunk)))),
        F.array(F.lit(0).cast("long")),
        lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x))),
    )

    def place(reach: Column) -> Column:
        def reached(i: Column) -> Column:
            c = F.floor(i / chunk).cast("int")
            return F.greatest(F.get(reach, c), furthest(F.slice(spans, c * chunk + 1, (i % chunk).cast("int"))))

        placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), reached(i).alias("from"), s["kind"].alias("kind")))
        shown = F.transform(
            F.filter(placed, lambda s: s["start"] >= s["from"]),
            lambda s: F.concat(_between(pieces, s["from"], s["start"]), F.lit("<"), s["kind"], F.lit(">")),
        )
        last = F.element_at(reach, -1)
        whole = (F.size(pieces) * F.lit(_PIECE)).cast("long")
        return F.concat(F.array_join(shown, ""), _between(pieces, last, whole))

    return F.get(F.transform(F.array(sums), place), F.lit(0))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every found span replaced by its kind in angle brackets; n_chars follows.

    Overlapping spans are merged first; the earliest names the kind. Columns
    and rows are as in ``docs``; a null text stays null. All columns travel as
    one struct, so their names cannot clash.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text"))
    spans = private_spans(whole, "text", ("_doc",))
    body = F.col("_doc")[text]
    every = F.array_sort(
        F.transform(
            F.concat(*KINDS, EXTRA),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    built = F.get(F.transform(F.array(F.struct(_pieces(body).alias("t"), every.alias("s"))), _marked_up), F.lit(0))
    spans = spans.withColumn("_clean", F.when(F.size(every) > 0, built).otherwise(body))
    out = {c: F.col("_doc")[c].alias(c) for c in docs.columns}
    out[text] = F.col("_clean").alias(text)
    if "n_chars" in out:
        length = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.coalesce(length, F.col("_doc")["n_chars"]).alias("n_chars")
    return spans.select(*out.values())
