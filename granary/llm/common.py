"""Expressions and table helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize, sized

__all__ = ["WORD", "connected_classes", "crc_mod", "located", "materialize", "overlapped", "sized", "span_digest", "text_or_empty", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 256


def text_or_empty(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit(""))


def word_count(text: str | Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def crc_mod(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found, part, before>> of a pattern's matches, leftmost and non-overlapping.

    Positions are code points, end exclusive. ``part`` is the given group and
    ``before`` the text between the previous match and this one. Match lengths
    and the gaps between matches come from the same regular expression; running
    sums over chunks of 256 keep a text with very many matches near linear.
    """
    def zipped(found: Column) -> Column:
        part = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(
            F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"), part.alias("p")),
            # the text after the last match comes without a match
            lambda x: F.struct(
                x["m"].alias("found"),
                x["p"].alias("part"),
                x["g"].alias("before"),
                F.length(x["g"]).cast("long").alias("gap"),
                (F.length(x["g"]) + F.length(x["m"])).cast("long").alias("step"),
            ),
        )

    # arrays of one element stand for names: every inner expression is computed once
    matched = F.filter(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.size(m) > 0)
    pieces = F.transform(matched, lambda m: F.filter(zipped(m), lambda x: x["found"].isNotNull()))
    zero = F.lit(0).cast("long")

    def place(box: Column) -> Column:
        rows = box["rows"]
        return F.transform(
            rows,
            lambda x, i: _span(
                x,
                F.element_at(box["sums"], (F.floor(i / _CHUNK) + 1).cast("int"))
                + F.aggregate(
                    F.slice(rows, (F.floor(i / _CHUNK) * _CHUNK + 1).cast("int"), (i % _CHUNK).cast("int")),
                    zero,
                    lambda a, y: a + y["step"],
                ),
            ),
        )

    boxed = F.transform(
        pieces,
        lambda rows: F.struct(
            rows.alias("rows"),
            F.aggregate(
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _CHUNK).cast("int")),
                    lambda c: F.aggregate(
                        F.slice(rows, c * _CHUNK + 1, F.lit(_CHUNK)), zero, lambda a, y: a + y["step"]
                    ),
                ),
                F.array(zero),
                lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
            ).alias("sums"),
        ),
    )
    return F.flatten(F.transform(boxed, place))


def _span(x: Column, before: Column) -> Column:
    start = before + x["gap"]
    return F.struct(
        start.alias("start"),
        (before + x["step"]).alias("end"),
        x["found"].alias("found"),
        x["part"].alias("part"),
        x["before"].alias("before"),
    )


def overlapped(row: str, by: Column) -> Column:
    """Whether the span ``s`` of a row shares a place with a span for which ``by`` holds.

    Spans of a row are passed twice in order of their starts: the furthest end
    of those that begin no later, and the nearest start of those that begin
    later, decide. Every frame grows by one span at a time.
    """
    earlier = Window.partitionBy(row).orderBy("s.start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(row).orderBy(F.col("s.start").desc()).rangeBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(by, F.col("s.end"))).over(earlier) > F.col("s.start")
    begins = F.min(F.when(by, F.col("s.start"))).over(later) < F.col("s.end")
    return F.coalesce(reached, F.lit(False)) | F.coalesce(begins, F.lit(False))


def span_digest(listed: Column) -> Column:
    """Comma-joined ``kind:start:end`` of an array of (order.., kind, start, end) structs, in sorted order."""
    return F.array_join(
        F.transform(
            F.array_sort(listed),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def connected_classes(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the least node of its component.

    Each round hooks every node to its least neighbour, if that is smaller, and
    follows the hooks to their roots; roots take the place of their nodes, in
    the links too, until no link is left. A root that took in no node is hooked
    in the next round, so two rounds at least halve what is left, whatever the
    shape of a component. Labels are written tables; only whether something is
    left reaches the driver.
    """
    edges = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = None
    while True:
        hooks = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        roots = _followed(materialize(hooks, "roots"))
        if labels is None:
            labels = roots
        else:
            further = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = labels.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            labels = materialize(labels, "roots")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            named = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
            edges = edges.join(named, end).select(other, F.col("_root").alias(end))
        edges = materialize(edges.where("a <> b").distinct(), "links")
        if edges.isEmpty():
            return labels


def _followed(hooks: DataFrame) -> DataFrame:
    """(node, root) with every root followed to its end; each step doubles what has been followed."""
    while True:
        hop = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
        hooks = materialize(
            hooks.join(hop, "root").select("node", F.col("root").alias("was"), F.col("further").alias("root")), "roots"
        )
        if hooks.where("root <> was").isEmpty():
            return hooks.select("node", "root")
        hooks = hooks.select("node", "root")
