"""Batch request payloads: JSON lists or CSV rows of transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# every value arrives as text so that a bad one yields a message, not a failed job
PAYLOAD_SCHEMA = "struct<transactions: array<map<string,string>>>"


def explode_json(df: DataFrame, body: str, keep=()) -> DataFrame:
    """One row per transaction of each ``{"transactions": [..]}`` body."""
    parsed = F.from_json(body, PAYLOAD_SCHEMA)
    return df.select(*keep, F.posexplode(parsed["transactions"]).alias("position", "fields"))


def first_error(fields, required: dict[str, bool]):
    """First validation message of a field map, null when valid.

    ``required``: field -> must not be negative.
    """
    checks = []
    for name, nonneg in required.items():
        text = F.element_at(fields, name)
        number = text.try_cast("double")
        checks += [
            F.when(text.isNull(), F.lit(f"Missing field: {name}")),
            F.when(number.isNull(), F.lit(f"Field {name} must be numeric")),
            F.when(
                F.isnan(number) | (F.abs(number) == float("inf")), F.lit(f"Field {name} must be finite")
            ),
        ]
        if nonneg:
            checks.append(F.when(number < 0, F.lit(f"Field {name} must be >= 0")))
    return F.coalesce(*checks)


def explode_csv(df: DataFrame, body: str, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., position, fields, error): one row per data line of each CSV body, in whose header the expected columns stand.

    Lines end with LF or CRLF, empty ones do not count, cells are trimmed and
    an empty cell is 0. A body without header and data, or whose header lacks a
    column, gives one row without position that says so. Lines with too few
    cells or a cell that is no finite number carry the first error; positions
    begin at 1.
    """
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", ""), r"\r?\n"), lambda x: x != "")
    cells = lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c))
    rows = df.select(*keep, lines.alias("_lines"))
    rows = rows.select(*keep, cells(F.coalesce(F.get("_lines", F.lit(0)), F.lit(""))).alias("_header"), F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))).alias("_data"))
    header, data = F.col("_header"), F.col("_data")
    missing = [F.when(~F.array_contains(header, c), F.lit(f"CSV header must include column: {c}")) for c in expected]
    whole = F.when(F.size(data) == 0, F.lit("CSV needs a header row and at least one data row")).otherwise(F.coalesce(*missing))
    rows = rows.withColumn("_whole", whole)
    line = rows.select(
        *keep, "_header", "_whole", F.posexplode_outer(F.when(F.col("_whole").isNull(), data)).alias("_at", "_line")
    ).select("*", cells(F.col("_line")).alias("_cells"))
    # of columns of one name the last counts
    place = lambda c: F.size("_header") - F.array_position(F.reverse("_header"), c)
    value = lambda c: F.get("_cells", place(c).cast("int"))
    number = lambda c: F.when(value(c) == "", 0.0).otherwise(value(c).try_cast("double"))
    position = F.col("_at") + 1
    say = lambda text: F.concat(F.lit("Row "), position.cast("string"), F.lit(text))
    finite = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) != float("inf"))
    errors = [F.when(F.size("_cells") < F.size("_header"), say(": not enough columns"))]
    errors += [F.when(~finite(c), say(f": {c} is not a number")) for c in expected]
    fields = F.create_map(*[x for c in expected for x in (F.lit(c), value(c))])
    error = F.coalesce("_whole", *errors)
    return line.select(*keep, position.cast("int").alias("position"), F.when(error.isNull(), fields).alias("fields"), error.alias("error"))
