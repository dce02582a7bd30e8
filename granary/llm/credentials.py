"""Secret scan with multipart credential linking, in DataFrame functions only.

Plain secrets are found by fixed patterns. Beyond them, weak parts of a
credential (an access identifier, a secret-looking value, an endpoint) are
reported only where complementary parts stand in one scope: an interval join
on positions links identifiers and endpoints to secrets near them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import located, materialize, overlapped, span_digest, text_or_empty

# The base patterns, written so that no text makes them backtrack.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
SHORTEST_VALUE = 6

# Weak parts: each alone is too common to report.
# Names, values and addresses of any length; possessive, so that no text makes them backtrack.
IDENTIFIER = (
    r"(?i:\b(?:user(?:name)?|login|account|client_?id|access_?id|key_?id|tenant)\b)[\"']?\x20*+[:=]\x20*+[\"']?"
    r"([A-Za-z0-9][A-Za-z0-9_.@-]{3,}+)"
)
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"  # with a digit, a capital and a small letter
ENDPOINT = (
    r"(?i:\b(?:https?|ftp|ssh|jdbc|postgres|mysql|mongodb|redis|amqp|s3)://)[^\x00-\x20\"'<>]{3,}+"
    r"|(?i:\b(?:host|server|endpoint|url)\b)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9.-]{4,}+"
)
SCOPE = 240  # code points that parts of one credential may lie apart
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identifier", "secret", "endpoint")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + WEAK_KINDS)}


def _spans(kind: str, text: Column, pattern: str, when: Column, keep=None, group: int = 0) -> Column:
    """array<struct<start, rank, kind, end>>; empty where there is none."""
    rows = F.when(when, located(text, pattern, group))
    if keep is not None:
        rows = F.filter(rows, keep)
    out = F.transform(
        rows,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )
    return F.coalesce(out, F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))


def _mixed(s: Column) -> Column:
    return s["found"].rlike("[0-9]") & s["found"].rlike("[A-Z]") & s["found"].rlike("[a-z]")


def base_spans(text: Column) -> dict[str, Column]:
    """Leftmost, non-overlapping matches of each base kind; matches that fail are dropped, not tried again."""
    return {
        "assign": _spans(
            "assign",
            text,
            ASSIGN,
            text.rlike(r"(?i)password|passwd|secret|token|api_?key"),
            lambda s: F.length(s["part"]) >= SHORTEST_VALUE,
            1,
        ),
        "access": _spans("access", text, ACCESS, text.contains("AKIA")),
        "hex": _spans("hex", text, HEX, text.rlike(r"[0-9a-f]{24}")),
    }


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Every document with its base spans and the weak spans that a complementary part completes.

    Columns: doc_id, assign, access, hex, weak (arrays of span structs). The
    text is scanned once; spans go to a written table, whose rows are numbered
    (repeated doc_ids stay apart). The interval join goes by (row, side,
    position bucket of one scope) from both ends of a weak span: parts after it
    begin in the bucket of its end or the next, parts before it end in the
    bucket of its start or the one before. Spans may have any length, and a
    bucket holds no more spans than it has room for.

    A null text is an empty one, a null doc_id stays null, other columns are
    ignored, and an empty table gives no rows.
    """
    text = F.col("_text")
    base = base_spans(text)
    weak = F.concat(
        _spans("identifier", text, IDENTIFIER, text.rlike(r"(?i)user|login|account|client|access|key|tenant")),
        _spans("secret", text, SECRET, text.rlike(r"[A-Za-z0-9+/_=-]{16}"), _mixed),
        _spans("endpoint", text, ENDPOINT, text.rlike(r"://|(?i)host|server|endpoint|url")),
    )
    scanned = materialize(
        docs.select("doc_id", text_or_empty("text").alias("_text")).select(
            "doc_id",
            *[c.alias(k) for k, c in base.items()],
            weak.alias("_weak"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "secrets",
    )
    parts = scanned.where(F.size("_weak") > 0).select(
        "_row", F.explode(F.concat("assign", "access", "hex", "_weak")).alias("s")
    )
    # what completes a part: values complete identifiers and endpoints, and the other way round
    holds = F.when(F.col("s.kind").isin("assign", "hex", "secret"), "value").otherwise("name")
    weak_kind = F.col("s.kind").isin(*WEAK_KINDS)
    parts = parts.withColumns({"_holds": holds, "_covered": weak_kind & overlapped("_row", ~weak_kind)})
    parts = materialize(parts, "parts")
    bucket = lambda c: F.floor(F.col(c) / scope)
    place = lambda after, b: F.struct(F.lit(after).alias("after"), b.alias("b"))
    ends = F.array(place(True, bucket("s.end")), place(False, bucket("s.start")))
    # a base span of the same place makes a weak part superfluous
    weak_part = parts.where(weak_kind & ~F.col("_covered")).select("_row", "s", "_holds", F.explode(ends).alias("_b"))
    reach = F.array(
        place(True, bucket("s.start")),
        place(True, bucket("s.start") - 1),
        place(False, bucket("s.end")),
        place(False, bucket("s.end") + 1),
    )
    near = parts.select("_row", F.col("s").alias("o"), F.col("_holds").alias("_other"), F.explode(reach).alias("_b"))
    gap = F.greatest(F.col("s.start"), F.col("o.start")) - F.least(F.col("s.end"), F.col("o.end"))
    linked = weak_part.join(near, ["_row", "_b"]).where(
        (F.col("_holds") != F.col("_other"))
        & (gap <= scope)
        # spans of one place are one part, not two
        & (gap >= 0)
    )
    # which weak parts are completed
    linked = linked.groupBy("_row", "s").agg(F.count("*").alias("n")).groupBy("_row").agg(F.collect_list("s").alias("_found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    joined = scanned.join(linked, "_row", "left")
    return joined.select("doc_id", *BASE_KINDS, F.coalesce("_found", none).alias("weak"))


def secret_report(spans: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    base = F.concat(*BASE_KINDS)
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.concat(base, "weak")).alias("spans"),
    )
