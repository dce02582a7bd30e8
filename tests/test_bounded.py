"""Operators whose tasks must stay bounded: hot groups, repeated hashes, many masks, stored statistics, streamed archives."""

import hashlib
import io
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.models import linear, retrain, search, sgd
from granary.operators import drift, ranking, similar, split
from granary.operators.gram import moments
from granary.session import fresh_path
from granary.sources import archives

# ---- grouped cuts


def plain_cuts(rows, ranks):
    """Hash at every rank (1-based) of each group; '' for rank 0."""
    by = {}
    for g, h in rows:
        by.setdefault(g, []).append(h)
    out = {}
    for g, hs in by.items():
        hs.sort()
        out[g] = (len(hs), *[hs[r(len(hs)) - 1] if r(len(hs)) > 0 else "" for r in ranks])
    return out


def test_hash_cuts_digit_by_digit(spark):
    # one key holds a third of a group, one group most rows, one group is null
    g = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise((F.col("id") % 20).cast("string"))
    df = spark.range(30_000).select(g.alias("g"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    df = df.withColumn("h", ranking.key_hash(["k"], 7))
    n = F.col("n")
    wanted = [F.floor(n * 0.2), F.lit(0), F.floor(n / 2), n]
    plain = [lambda n: int(n * 0.2), lambda n: 0, lambda n: n // 2, lambda n: n]
    rows = [(r.g, r.h) for r in df.collect()]
    got = {r.g: tuple(r)[1:] for r in ranking.hash_cuts(df, "h", wanted, ["g"], digits=1, most=20).collect()}
    assert got == plain_cuts(rows, plain)
    one = ranking.hash_cuts(df, "h", wanted, digits=1, most=5).first()
    assert tuple(one) == plain_cuts([(0, h) for _, h in rows], plain)[0]
    assert ranking.hash_cuts(df.limit(0), "h", wanted, ["g"]).collect() == []


def test_grouped_split_moves_only_touched_rows(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 3).alias("g"), F.lit(1.0).alias("wide"))
    out = split.train_test_split(df, ["id"], 0.25, 3, ["g"])
    sizes = {r.g: r.n for r in out.groupBy("g").agg(F.sum("is_test").alias("n")).collect()}
    assert sizes == {0: 16666, 1: 16666, 2: 16666}
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("wide" in line for line in exchanged)


# ---- rolling windows


@pytest.mark.parametrize("slice_rows", [40, 100_000])
def test_rolling_slices(spark, slice_rows):
    draw = np.random.default_rng(1)
    n = 6000
    user = np.where(draw.random(n) < 0.4, 0, draw.integers(1, 40, n))
    pdf = pd.DataFrame({"u": user, "ts": draw.integers(0, 500, n).astype(float), "id": np.arange(n), "v": draw.normal(size=n)})
    df = spark.createDataFrame(pdf).withColumn("u", F.when(F.col("u") != 39, F.col("u")))
    out = drift.rolling_per_entity(df, "u", "ts", "id", 4, {"s": F.sum("v"), "c": F.count("*")}, slice_rows=slice_rows)
    got = {r.id: (r.s, r.c) for r in out.collect()}
    pdf = pdf.sort_values(["u", "ts", "id"])
    want = pdf.groupby("u")["v"].rolling(5, min_periods=1).agg(["sum", "count"])
    assert len(got) == n
    for i, s, c in zip(pdf["id"], want["sum"], want["count"]):
        assert got[i] == (pytest.approx(s, abs=1e-9), c)


def test_few_rows_travel_twice(spark):
    df = spark.range(300_000).select((F.col("id") % 150).alias("u"), F.col("id").cast("double").alias("ts"), "id")
    rows = drift._sliced(df, "u", "ts", "id", 3, 300, 64)
    own = rows.agg(F.sum("_own").alias("own"), F.count("*").alias("n")).first()
    assert own.own == 300_000 and own.n - own.own < 0.02 * 300_000
    assert rows.groupBy("u", "_s").count().agg(F.max("count")).first()[0] <= 300 + 300_000 / 64


def test_ratios_to_a_zero_median(spark, tmp_path):
    import duckdb
    from compare import norm

    from granary.plans import catalog

    values = {1: [0.0, 0.0, 3.0, 0.0, 2.0, 5.0], 2: [-1e-9, 4.0], 3: [1e-9, None, -2.0], 4: [None, 1.0], 5: [-1e-9, -1e-9, 7.0]}
    rows = [(u * 10 + i, u, v, i) for u, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, i int")
    df.select("event_id", "user_id", "value", F.timestamp_seconds("i").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    name = "f8_rolling_median_ratio"
    got = {r.event_id: norm(r.ratio, 9) for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT event_id, ratio FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert got == {i: norm(v, 9) for i, v in want}
    assert got[10] == "nan" and float("inf") in got.values() and float("-inf") in got.values()


# ---- mails


def test_mails_go_row_by_row(spark, tmp_path):
    from granary.plans import catalog

    rows = [(i, f"text {i} <b> & ä\n" * (1 + 3000 * (i == 2))) for i in [*range(8), None]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    letters = catalog.queries()["r3_mail_text"](spark, str(tmp_path))
    for df in (letters, catalog.queries()["r1_mail_structures"](spark, str(tmp_path))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # no batch of thousands of mails or pages in a Python worker
        assert "BatchEvalPython" in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan
    got = {r.doc_id: r.letters for r in letters.collect()}
    for i, text in rows:
        plain = "".join(c for c in text + ("HYPERLINKx" if i in (1, 5) else "") if c.isascii() and c.isalpha())
        assert got[i] == hashlib.md5(plain.encode()).hexdigest()
    kinds = {r.structure: r.n for r in df.collect()}
    assert sorted(kinds.values()) == [2, 2, 2, 3] and kinds["text/plain"] == 3  # the one without a key too


# ---- one step per row


def plain_steps(x, y, part, order, parts, rate, epochs, decay):
    theta = np.zeros(x.shape[1] + 1)
    for t in range(epochs):
        r = rate / (1 + decay * t)
        sums, n = np.zeros_like(theta), 0
        for k in range(parts):
            w = theta.copy()
            mine = [i for i in order if part[i] == k]
            for i in mine:
                z = np.append(1.0, x[i])
                w -= r * (z @ w - y[i]) * z
            sums += w * len(mine)
            n += len(mine)
        theta = sums / n
    return theta


def test_ordered_steps_do_not_depend_on_partitions(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(500, 2))
    y = x @ [2.0, -1.0] + 0.5
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    fits = [sgd.averaged_sgd(df.repartition(k), ["a", "b"], "y", ["id"], 0.05, 3, 9, decay=0.1, parts=6) for k in (2, 8)]
    assert np.array_equal(fits[0].weights, fits[1].weights) and fits[0].intercept == fits[1].intercept
    hashes = {r.id: r.h for r in df.select("id", ranking.key_hash(["id"], 9).alias("h")).collect()}
    part = [int(hashes[i][:7], 16) % 6 for i in range(500)]
    want = plain_steps(x, y, part, sorted(range(500), key=lambda i: hashes[i]), 6, 0.05, 3, 0.1)
    assert np.allclose([fits[0].intercept, *fits[0].weights], want, atol=1e-10)
    assert sgd.averaged_sgd(df.limit(0), ["a"], "y", ["id"], 0.05, 3, 9).intercept == 0.0


# ---- scores from rows


def test_mean_absolute_error_of_all_candidates(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 3))
    y = x @ [1.0, 2.0, 0.0] + draw.normal(size=400)
    fold = np.arange(400) % 4
    cols = ["a", "b", "c"]
    rows = [(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)], "fold int, a double, b double, c double, y double")
    folds = moments(df.dropna(), cols, "y", "fold")
    grid = search.parameter_grid({"alpha": [0.1, 50.0, 5000.0]})
    results = search.search(folds, "ridge", grid, "mae", scale=True, data=df.dropna(subset=["fold"]))
    for r in results:
        test, train = [], []
        for k, m in sorted(search.fold_models(folds, "ridge", r["params"], True).items()):
            e = np.abs(y - x @ m.weights - m.intercept)
            test.append(e[fold == k].mean())
            train.append(e[fold != k].mean())
        assert r["mean_score"] == pytest.approx(np.mean(test)) and r["mean_train_score"] == pytest.approx(np.mean(train))
    assert min(results, key=lambda r: r["mean_score"])["rank"] == 1
    with pytest.raises(ValueError):
        search.cross_val_score(folds, "ridge", {"alpha": 1.0}, "mae")
    with pytest.raises(ValueError):
        search.cross_val_score(folds, "ridge", {"alpha": 1.0}, "other")


# ---- retraining


def test_retrain_from_stored_statistics(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(900, 2))
    y = 3 + x @ [0.5, -0.2] + 0.1 * draw.normal(size=900)
    y[:300] += 1.0  # outdated rows
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    part = lambda lo, hi: df.where(f"id >= {lo} and id < {hi}")
    root, valid = fresh_path(spark, "models"), part(750, 900)
    assert not retrain.retrain(root, part(0, 0), valid, ["a", "b"], "y")
    assert retrain.retrain(root, part(0, 400), valid, ["a", "b"], "y")
    assert retrain.retrain(root, part(400, 750), valid, ["a", "b"], "y", removed=part(0, 300))
    assert not retrain.retrain(root, part(0, 300), valid, ["a", "b"], "y")  # the outdated rows again: worse, not published
    rows = retrain.registry(spark, root).orderBy("version").collect()
    assert [(r.version, r.published, r.n_rows) for r in rows] == [(1, True, 400), (2, True, 450), (3, False, 750)]
    got = retrain.stored(rows[1])[1]
    want = linear.ols(moments(part(300, 750), ["a", "b"], "y")[None])
    assert np.allclose([*got.weights, got.intercept], [*want.weights, want.intercept], atol=1e-9)
    assert rows[1].rmse < rows[1].previous_rmse == rows[0].rmse and rows[2].previous_rmse == rows[1].rmse


# ---- archives and folders of files


def test_archives_are_streamed_from_files(spark):
    big = b"x" * 3_000_000
    files = {f"d/{i}.txt": f"text {i}".encode() for i in range(50)} | {"d/big.bin": big, "d/big2.bin": big, "empty": b""}
    blobs = {}
    for kind in ("gz", "bz2", "xz"):
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode=f"w:{kind}") as tar:
            tar.addfile(tarfile.TarInfo("folder/only/"))
            for name, data in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        blobs[f"a.{kind}"] = buf.getvalue()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", "")
        for name, data in files.items():
            z.writestr(name, data)
    blobs["sub/b.zip"] = buf.getvalue()
    root = fresh_path(spark, "archives")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "name string, data binary").repartition(3)
    assert archives.write_files(df, root, "name", "data") == 4
    assert archives.write_files(df, root, "name", "data") == 4  # once more: the same files
    got = archives.read_archives(spark, root).select(F.regexp_extract("archive", "[^/]+$", 0).alias("a"), "member", "content").collect()
    for name in ("a.gz", "a.bz2", "a.xz", "b.zip"):
        have = {r.member: bytes(r.content) for r in got if r.a == name}
        assert {k: v for k, v in have.items() if not k.startswith("folder")} == files


def test_documents_from_folders(spark):
    root = fresh_path(spark, "mails")
    rows = [("ham/a-rather-long-name.txt", "é"), ("spam/another-rather-long.txt", None), ("spam/short", "x")]
    archives.write_files(spark.createDataFrame(rows, "p string, t string"), root, "p", "t")
    got = {r.name: r.text for r in archives.read_documents(spark, root).collect()}
    assert got == {"a-rather-long-name.txt": "é"}  # neither short names nor empty files


# ---- similar rows over common features


@pytest.mark.parametrize("sizes", [(1024, 8192, 4096), (7, 10_000, 5)])
def test_similar_rows_equal_all_pairs(spark, sizes, monkeypatch):
    for name, value in zip(("CELL_ROWS", "CELLS", "QUERY_ROWS"), sizes):
        monkeypatch.setattr(similar, name, value)
    draw = np.random.default_rng(11)
    m = 600
    v = draw.integers(0, 12, (m, 3)).astype(float)
    v[: m // 3] = [1.0, 2.0, 3.0]  # a third are equal
    v[draw.random((m, 3)) < 0.3] = np.nan
    pdf = pd.DataFrame(v, columns=list("abc"))
    pdf.insert(0, "k", np.arange(m))
    df = spark.createDataFrame(pdf)
    df = df.withColumn("c", F.nanvl("c", F.lit(None).cast("double")))  # NaN and null both are missing
    given = {"a": 2.0, "b": 1.0, "c": 0.5}
    asked = df.where("k % 3 = 0")
    got = {}
    for r in similar.nearest_by_common(asked, df, "k", given, 6).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append(r.neighbor)
    dev = np.nanstd(v, axis=0, ddof=1)
    scaled = v * (np.array(list(given.values())) / dev)
    for i in range(0, m, 3):
        d = np.abs(scaled[i] - scaled)
        n = (~np.isnan(d)).sum(1)
        d = np.where(n > 0, np.round(np.nansum(d, 1) / np.maximum(n, 1), 9), np.inf)
        want = [j for j in sorted(range(m), key=lambda j: (d[j], j))[:6] if np.isfinite(d[j])]
        assert got.get(i, []) == want, i
    assert similar.nearest_by_common(asked, df.limit(0), "k", given, 6).collect() == []
    assert similar.nearest_by_common(asked.limit(0), df, "k", given, 6).collect() == []


# ---- named stages and CSV payloads


def test_named_stages(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from granary.models.spark_ml import Log1pTransformer
    from granary.models.stages import FittedStages, Stages

    df = spark.createDataFrame([(float(i), float(3.0 * np.log1p(i) + 1)) for i in range(30)], "x double, y double")
    stages = Stages(
        [("log", Log1pTransformer(["x"])), ("vector", VectorAssembler(inputCols=["x"], outputCol="f")), ("fit", LinearRegression(featuresCol="f", labelCol="y"))]
    )
    assert stages.names == ["log", "vector", "fit"] and len(stages[:2]) == 2 and stages[-1] is stages["fit"]
    assert stages["log":"vector"].names == stages[:-1].names == ["log", "vector"]
    other = stages.set_params(fit__regParam=5.0)
    assert other.get_params()["fit__regParam"] == 5.0 and stages.get_params()["fit__regParam"] == 0.0
    fitted = stages.fit(df)
    assert isinstance(fitted[:"vector"], FittedStages)
    assert fitted[:"log"].transform(df).agg(F.max("x")).first()[0] == pytest.approx(np.log1p(29))
    error = fitted.transform(df).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert error < 1e-6
    plain = stages.replace("log", Log1pTransformer([])).fit(df)
    assert plain.transform(df).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] > 0.5
    for bad in (lambda: Stages([]), lambda: Stages([("a", stages[0]), ("a", stages[0])]), lambda: stages.set_params(fit__none=1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        stages["none"]
    with pytest.raises(TypeError):
        Stages([("a", 1)])


def test_csv_payloads(spark):
    from granary.sources.payloads import explode_csv

    bodies = ["A,B\n1,2\r\n\n3, 4 \n", "A\n1", "A,B", "", None, "B,A,A\n1,2,3\n1,2", "A,B\nx,1\n1,inf\n,7"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, body string")
    got = [(r.id, r.position, r.fields, r.error) for r in explode_csv(df, "body", ["A", "B"], ["id"]).orderBy("id", "position").collect()]
    none = "CSV needs a header row and at least one data row"
    assert got == [
        (0, 1, {"A": "1", "B": "2"}, None),
        (0, 2, {"A": "3", "B": "4"}, None),
        (1, None, None, "CSV header must include column: B"),
        (2, None, None, none),
        (3, None, None, none),
        (4, None, None, none),
        (5, 1, {"A": "3", "B": "1"}, None),
        (5, 2, None, "Row 2: not enough columns"),
        (6, 1, None, "Row 1: A is not a number"),
        (6, 2, None, "Row 2: B is not a number"),
        (6, 3, {"A": "", "B": "7"}, None),
    ]


def test_one_hot_of_many_categories(spark):
    from granary.operators import encode

    df = spark.range(3000).select("id", F.when(F.col("id") < 2990, F.format_string("c%04d", F.col("id") % 1500)).alias("c"))
    codes = encode.label_codes(df, "c")
    with pytest.raises(ValueError):
        encode.categories_of(df, "c")
    for drop in (True, False):
        rows = encode.one_hot_vectors(df, "c", codes, "v", drop).collect()
        for r in rows:
            code = None if r.c is None else int(r.c[1:]) - drop
            assert r.v.size == 1500 - drop
            assert r.v.indices.tolist() == ([] if code is None or code < 0 else [code])
    new = spark.createDataFrame([("other",)], "c string")
    assert encode.one_hot_vectors(new, "c", codes, "v").first().v.numNonzeros() == 0
