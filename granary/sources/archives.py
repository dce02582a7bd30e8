"""Files packed in archives, ARFF tables and folders of documents."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "archive string, member string, content binary"
MEMBER_TYPES = (pa.string(), pa.string(), pa.binary())
MEMBER_BYTES = 4_000_000  # members that are handed on together


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data = io.BytesIO(content)
            if zipfile.is_zipfile(data):
                with zipfile.ZipFile(data) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame(
                                {"archive": [path], "member": [info.filename], "content": [z.read(info)]}
                            )
            else:
                data.seek(0)
                with tarfile.open(fileobj=data, mode="r:*") as tar:
                    for info in tar:
                        if info.isfile():
                            body = tar.extractfile(info).read()
                            yield pd.DataFrame(
                                {"archive": [path], "member": [info.name], "content": [body]}
                            )


def unpack(files: DataFrame) -> DataFrame:
    """Rows (path, content) of archives -> one row per member file."""
    return files.select("path", "content").mapInPandas(_members, MEMBER_SCHEMA)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _streamed(path: str) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the members, one at a time; tar files are read as a stream, zip files by their directory."""
    files, at = _file_system(path)
    with files.open_input_file(at) as f:
        magic = f.read(4)
    if magic[:2] == b"PK":
        with files.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
        return
    with files.open_input_stream(at, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
        for info in tar:
            if info.isfile():
                yield info.name, tar.extractfile(info).read()


def _stream_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "member", "content"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            held, size = [], 0
            for name, content in _streamed(path):
                held.append((path, name, content))
                size += len(content)
                if size > MEMBER_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), MEMBER_TYPES)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), MEMBER_TYPES)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per file inside zip / tar (gz, bz2, xz) archives; archives in parallel.

    Spark lists the archives; a task then streams one member after the other
    from the store, so no archive is held as a whole. In a store that only
    Spark can open, archives are read as binary rows instead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    try:
        _file_system(path)
    except (ValueError, OSError):
        return unpack(files)
    return files.select("path").mapInArrow(_stream_members, MEMBER_SCHEMA)


def write_files(df: DataFrame, root: str, path: str, content: str) -> int:
    """Writes the column ``content`` of every row (text or binary) to the file ``root``/``path``; returns their number.

    Each file gets its name when it is complete, so a reader never meets half a
    file, and a repeated task writes the same file again. ``root`` is shared
    storage that Arrow can open. A null content is an empty file.
    """

    def run(batches):
        files, at = _file_system(root)
        made: set[str] = set()
        n = 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{at}/{name}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with files.open_output_stream(part, compression=None) as f:
                    f.write(data or b"")
                files.move(part, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(F.col(path).cast("string"), F.col(content).cast("binary"))
    return int(rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0)


def pack(df: DataFrame, folder: str, name: str, text: str, per_archive: int = 64, kind: str = "gz") -> DataFrame:
    """Text rows -> rows (path, content) of compressed archives, a few files in each."""

    def blobs(batches):
        for batch in batches:
            for start in range(0, len(batch), per_archive):
                part = batch.iloc[start : start + per_archive]
                buf = io.BytesIO()
                if kind == "zip":
                    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                        for f, n, x in zip(part["folder"], part["name"], part["text"], strict=True):
                            z.writestr(f"{f}/{n}", x or "")
                else:
                    with tarfile.open(fileobj=buf, mode=f"w:{kind}") as tar:
                        for f, n, x in zip(part["folder"], part["name"], part["text"], strict=True):
                            data = (x or "").encode("utf-8")
                            info = tarfile.TarInfo(f"{f}/{n}")
                            info.size = len(data)
                            tar.addfile(info, io.BytesIO(data))
                # named by what is in it: a repeated task makes the same files
                held = "\n".join(f"{f}/{n}" for f, n in zip(part["folder"], part["name"], strict=True))
                name = hashlib.md5(held.encode("utf-8")).hexdigest()
                yield pd.DataFrame({"path": [f"{name}.{kind}"], "content": [buf.getvalue()]})

    rows = df.select(F.col(folder).alias("folder"), F.col(name).alias("name"), F.col(text).alias("text"))
    return rows.mapInPandas(blobs, "path string, content binary")


ATTRIBUTE = r"(?i)^@attribute\s+(?:'([^']+)'|\"([^\"]+)\"|(\S+))\s+(.+)$"


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF text scan: @attribute lines give the schema, the rest are CSV rows.

    Values may stand in single quotes. A question mark is a missing value, quoted or not.
    """
    lines = spark.read.text(path)
    header = (
        lines.where(F.col("value").rlike(r"(?i)^@attribute"))
        .select(F.monotonically_increasing_id().alias("i"), "value")
        .orderBy("i")
        .collect()
    )
    fields = []
    for row in header:
        m = re.match(ATTRIBUTE, row.value.strip())
        name = next(g for g in m.groups()[:3] if g)
        kind = m.group(4).strip().lower()
        fields.append((name, "double" if kind in ("numeric", "real", "integer") else "string"))
    # data rows may begin with @ too, so only the header's own words are header lines
    body = lines.where(~F.col("value").rlike(r"(?i)^\s*(@(relation|attribute|data)\b|%|$)"))
    cells = ", ".join(f"c{i} string" for i in range(len(fields)))
    options = {"quote": "'", "escape": "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": "?", "emptyValue": ""}
    row = body.select(F.from_csv("value", cells, options).alias("r"))
    out = []
    for i, (name, kind) in enumerate(fields):
        value = F.col(f"r.c{i}")
        out.append((value.try_cast("double") if kind == "double" else value).alias(name))
    return row.select(*out)


def read_documents(spark: SparkSession, path: str, min_name: int = 20) -> DataFrame:
    """One row per file whose name is longer than ``min_name`` characters; Spark does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.length(name) > min_name).select(
        "path", name.alias("name"), F.col("content").cast("string").alias("text")
    )


def member_documents(members: DataFrame, min_name: int = 20) -> DataFrame:
    """The same filter for files that stay inside their archives."""
    name = F.element_at(F.split("member", "/"), -1)
    folder = F.element_at(F.split("member", "/"), -2)
    return members.where(F.length(name) > min_name).select(
        folder.alias("folder"), name.alias("name"), F.col("content").cast("string").alias("text")
    )


def write_arff(df: DataFrame, path: str, relation: str) -> None:
    """Header file plus data files of one ARFF table."""
    spark = df.sparkSession
    kinds = {f.name: "numeric" if f.dataType.typeName() in ("double", "integer", "long", "float") else "string" for f in df.schema}
    header = [f"@relation {relation}", *[f"@attribute {n} {k}" for n, k in kinds.items()], "@data"]
    spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.text(path)

    def cell(n: str):
        value = F.col(n).cast("string")
        quoted = F.concat(F.lit("'"), F.regexp_replace(value, r"(['\\\\])", r"\\$1"), F.lit("'"))
        plain = value.rlike(r"^[A-Za-z0-9_.+-]+$")
        return F.when(value.isNull(), "?").when(plain, value).otherwise(quoted)

    cells = [cell(n) for n in kinds]
    df.select(F.concat_ws(",", *cells).alias("value")).write.mode("append").text(path)
