"""SpotSigs document fingerprints, in DataFrame functions only.

A spot signature is a chain of content words that follows an anchor: a common
word, or any word whose own hash falls in a fixed share, so that texts poor in
common words have spots too and an edit changes only the spots near it. The set of signatures of a text is its fingerprint. Fingerprints are
compared by Jaccard similarity; a search partitions them by set length, so
that only lengths that can be similar enough meet, and prunes pairs before it
intersects their sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize, text_or_empty
from granary.operators.ranking import sorted_positions

# Frequent words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was be with as by at are this from or an not have but "
    "de la le et les des un une du que qui en au pour dans sur par est pas ce "
    "der die und das den von zu mit ist ein eine dem im nicht auf für als auch es "
    "el los las y del se por con para su al lo como más pero"
).split()
SHARE = 8  # one word in so many is an anchor by its hash
CHAIN = 2  # content words in a chain
REACH = 12  # words after an anchor in which its chain must lie
PUNCTUATION = ".,;:!?\"'()[]{}<>|*%&#$@+=/\\_~`^-"
MIN_LONG = -(2**63)


def words(text: Column) -> Column:
    """Lower-case words without punctuation."""
    plain = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _common(w: Column) -> Column:
    return w.isin(*ANCHORS)


def _anchor(w: Column) -> Column:
    return _common(w) | (F.pmod(F.xxhash64(w), F.lit(SHARE)) == 0)


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit signatures of a text.

    A text without any spot is cut into chains at every word; a text without
    words has none.
    """

    def spots(ws: Column) -> Column:
        placed = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: _anchor(x["w"]))
        chains = F.transform(
            placed,
            lambda x: F.struct(
                x["w"].alias("w"),
                F.slice(
                    F.filter(F.slice(ws, x["i"] + 2, F.lit(REACH)), lambda w: ~_common(w)), F.lit(1), F.lit(CHAIN)
                ).alias("c"),
            ),
        )
        return F.transform(F.filter(chains, lambda x: F.size(x["c"]) > 0), lambda x: F.hash(x["w"], x["c"]))

    def every(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.hash(w, F.slice(ws, i + 2, F.lit(CHAIN))))

    def chosen(ws: Column) -> Column:
        return F.transform(
            F.array(spots(ws)), lambda s: F.when((F.size(s) == 0) & (F.size(ws) > 0), every(ws)).otherwise(s)
        )

    # one-element arrays stand for names: the words are split once
    found = F.flatten(F.flatten(F.transform(F.array(words(text)), chosen)))
    return F.array_sort(F.array_distinct(found))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(common / either)
    )


def shown(sigs: Column) -> Column:
    """A fingerprint as text: its signatures in hexadecimal."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(F.shiftrightunsigned(s.cast("long") * 2**32, 32)))), " ")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses.

    The edited text has the last third (floor) of the code points replaced by
    as many first ones (or all) of the next document: the next lower doc_id,
    after the last the first.

    The order is found on ids, lengths and text hashes alone. Texts are
    shuffled once by (id, hash); each row then sends the needed prefix and its
    signatures to the row before it.

    A null text is an empty one. Null doc_ids come last. Rows with equal doc_id
    are ordered by text hash, and repeated rows share one place, so their next
    document is the next different row. One row alone is its own next. Other
    columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", text_or_empty("text").alias("text")).select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias("k"),
        F.xxhash64("text").alias("h"),
        "text",
        F.length("text").cast("long").alias("n"),
    )
    ids = keyed.select(F.bitwise_not("k").alias("o"), "h", "n").distinct()
    placed = sorted_positions(ids, ["o", "h"])
    places = placed.count()
    place = placed.select(F.bitwise_not("o").alias("k"), "h", "n", "position")
    before = place.select(
        ((F.col("position") + 1) % max(places, 1)).alias("position"),
        F.col("k").alias("k_before"),
        F.col("h").alias("h_before"),
        F.floor(F.col("n") / 3).alias("wanted"),
    )
    place = materialize(place.join(before, "position").select("k", "h", "k_before", "h_before", "wanted"), "order")
    signed = keyed.withColumn("sigs", signatures(F.col("text")))
    # both sides take the same columns from the one exchange of texts
    sent = signed.join(place, ["k", "h"]).select(
        F.col("k_before").alias("k"),
        F.col("h_before").alias("h"),
        F.col("doc_id").alias("next_doc_id"),
        F.col("n").alias("next_n_chars"),
        F.substring(F.col("text"), F.lit(1), F.col("wanted").cast("int")).alias("tail"),
        F.col("sigs").alias("next_sigs"),
    )
    once = Window.partitionBy("k", "h").orderBy(F.lit(0))
    sent = sent.withColumn("_i", F.row_number().over(once)).where("_i = 1").drop("_i")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int"))
    both = signed.join(sent, ["k", "h"]).select(
        "doc_id", "n", "sigs", "next_doc_id", "next_n_chars", "next_sigs", F.concat(kept, "tail").alias("edited")
    )
    both = both.withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("sigs")).alias("fingerprint"),
        shown(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        "next_doc_id",
        "next_n_chars",
    )


def similar_sets(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of different signature sets with Jaccard >= threshold.

    ``sets``: (id, sigs), where equal sets are collapsed to their least id
    first. Lengths are cut at powers of 1/threshold: sets that can be similar
    lie in one partition or in neighbours, so each set is indexed in its own and
    looked up in its own and the one below. Only the rarest signatures, of which
    a similar set must share one, are joined; a candidate's lengths are compared
    before its sets are. Empty sets are similar to none.
    """
    reps = sets.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("id").alias("id"))
    step = math.log(1 / threshold)
    reps = materialize(
        reps.select("id", "sigs", F.size("sigs").alias("n"), F.floor(F.log(F.size("sigs")) / step).alias("part")), "sets"
    )
    rare = reps.select("id", "n", "part", F.explode("sigs").alias("sig"))
    counts = rare.groupBy("sig").agg(F.count("*").alias("c"))
    order = Window.partitionBy("id").orderBy("c", "sig")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    rare = materialize(
        rare.join(counts, "sig").withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= prefix).drop("_i", "c"),
        "prefixes",
    )
    asked = rare.select(F.col("id").alias("x"), F.col("n").alias("nx"), "sig", F.col("part").alias("px"), F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = asked.join(rare.select(F.col("id").alias("y"), F.col("n").alias("ny"), "sig", "part"), ["part", "sig"])
    # within a partition a pair is met from the smaller id, across partitions from the longer set
    met = met.where(F.when(F.col("px") == F.col("part"), F.col("x") < F.col("y")).otherwise(True))
    met = met.where(F.least("nx", "ny") >= F.greatest("nx", "ny") * (threshold - 1e-9))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left = reps.select(F.col("id").alias("a"), F.col("sigs").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)
