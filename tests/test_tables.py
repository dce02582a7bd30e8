"""Cleaning, encoding, features, scaling, sources, monitoring, text and streams on small fixtures."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as X
from granary.functions.stem import stem
from granary.operators import clean, drift, encode, features, scoring, textprep
from granary.operators.filters import apply_rules, faceted_filter
from granary.operators.scale import MinMaxScaler, StandardScaler
from granary.session import fresh_path
from granary.sources import archives, artifacts, files
from granary.streaming import jobs


def test_imputer_rules(spark):
    df = spark.createDataFrame(
        [(1.0, "b", None), (None, "NaN", None), (4.0, "a", None), (2.0, None, None), (None, "none", None)],
        "x double, s string, e double",
    )
    m = clean.Imputer.fit(df, {"x": ("median", None), "s": ("most_frequent", None), "e": ("mean", 7.0)})
    assert m.values == {"x": 2.0, "s": "a", "e": 7.0}
    assert m.transform(df).where("x IS NULL OR s IS NULL OR e IS NULL").count() == 0
    with pytest.raises(ValueError):
        clean.Imputer.fit(df, {"x": ("guess", None)})


def test_cleaning_steps_fit_raw_or_sequential(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (100.0,)], "x double")

    def steps(mode):
        s = clean.CleaningSteps(mode)
        s.add("fill", lambda d: clean.Imputer.fit(d, {"x": ("constant", 0.0)}))
        s.add("limit", lambda d: clean.OutlierHandler.fit(d, ["x"], "percentile", (0.0, 0.5), "clip"))
        return s.fit(df)

    assert steps("raw").fitted[1][1].bounds["x"] == (1.0, 3.0)
    assert steps("sequential").fitted[1][1].bounds["x"] == (0.0, 2.0)


def test_encoders_like_the_documented_examples(spark):
    df = spark.createDataFrame([("cat",), ("dog",), ("cat",), ("bird",)], "a string")
    codes = encode.label_codes(df, "a")
    assert {r.category: r.code for r in codes.collect()} == {"bird": 0, "cat": 1, "dog": 2}
    other = spark.createDataFrame([("cow",)], "a string")
    with pytest.raises(Exception, match="unseen category"):
        encode.label_encode(other, "a", codes, "c").collect()
    assert encode.label_encode(other, "a", codes, "c", strict=False).first().c is None
    colors = spark.createDataFrame([("Red",), ("Blue",), ("Green",)], "c string")
    hot = colors.select(*encode.one_hot("c", encode.categories_of(colors, "c")))
    assert hot.columns == ["c_Green", "c_Red"]
    sums = colors.select(*encode.one_hot("c", ["Blue", "Green", "Red"], drop_first=False))
    assert {sum(r) for r in sums.collect()} == {1.0}


def test_scalers_restore(spark):
    rng = np.random.default_rng(42)
    rows = [(float(a), float(b), 3.0) for a, b in zip(rng.normal(5000, 1000, 100), rng.normal(0.5, 0.1, 100), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    s = StandardScaler.fit(df, ["a", "b", "c"])
    z = s.transform(df)
    row = z.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("c").alias("c")).first()
    assert row.m == pytest.approx(0, abs=1e-12) and row.s == pytest.approx(1) and row.c == 0
    mm = MinMaxScaler.fit(df, ["a", "c"], (-1, 1))
    for model in (s, mm):
        back = model.inverse(model.transform(df)).collect()
        np.testing.assert_allclose([list(r) for r in back], rows, rtol=1e-9)
    train = spark.createDataFrame([(float(v),) for v in range(100, 600, 100)], "x double")
    fitted = StandardScaler.fit(train, ["x"])
    assert fitted.mean["x"] == 300 and fitted.std["x"] == pytest.approx(141.4213562)
    with pytest.raises(ValueError):
        fitted.transform(df)


def test_polynomial_order(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "x double, y double")
    assert list(df.select(*features.polynomial(["x", "y"], 3)).first()) == [2, 3, 4, 6, 9, 8, 12, 18, 27]
    assert df.select(*features.polynomial(["x", "y"], 2, interaction_only=True)).columns == ["x", "y", "x*y"]
    assert len(features.polynomial(["x", "y"], 9)) == 54
    assert df.select(*features.polynomial(["x", "y"], 5)).columns[-1] == "y*y*y*y*y"
    assert len(features.polynomial(["a", "b", "c"], 3, interaction_only=True)) == 7


def test_house_features_skip_absent_inputs(spark):
    df = spark.createDataFrame([(2000, 2010, None, 2)], "`Year.Built` int, `Yr.Sold` int, `Garage.Area` double, `Garage.Cars` int")
    row = features.derive(df, features.house_features()).first().asDict()
    assert row["House_Age"] == 10 and row["Is_New"] == 0 and row["Garage_Area_Per_Car"] == 0
    assert "Total_SF" not in row


def test_faceted_filter_and_rules(spark):
    df = spark.createDataFrame([(1, "A.c", 5), (2, "abc", 0), (3, None, 9)], "id int, s string, n int")
    assert [r.id for r in faceted_filter(df, search="a.C", search_columns=["s", "zz"]).collect()] == [1]
    assert faceted_filter(df, equals={"n": 0}, ranges={"n": (0, None)}).count() == 3
    assert apply_rules(df, [("r", ["s"], F.col("s") != "abc"), ("q", ["gone"], F.lit(False))]).count() == 1


# ------------------------------------------------------------ sources


def test_archives_and_documents(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("d/y.txt", "defg")
    got = {r.member: bytes(r.content) for r in archives.read_archives(spark, str(tmp_path / "[ab].*")).collect()}
    assert got == {"d/x.txt": b"abc", "d/y.txt": b"defg"}
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "short.txt").write_text("no")
    (docs / "a-name-longer-than-twenty-characters.txt").write_text("yes")
    assert [r.text for r in archives.read_documents(spark, str(docs)).collect()] == ["yes"]


def test_arff_quotes_and_missing(spark, tmp_path):
    p = tmp_path / "t.arff"
    p.write_text("% c\n@RELATION r\n@ATTRIBUTE 'a b' NUMERIC\n@attribute c {x,y}\n@DATA\n1.5,'x'\n?,y\n")
    assert sorted(map(tuple, archives.read_arff(spark, str(p)).collect()), key=str) == [(1.5, "x"), (None, "y")]


def test_csv_na_tokens_and_missing_log(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b\n1,"x, y"\nNA,.\nbad,N/A\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    rows = [tuple(r) for r in files.read_csv(spark, str(p), schema).collect()]
    assert rows == [(1, "x, y"), (None, None), (None, None)]
    assert files.read_json_log(spark, str(tmp_path / "none"), schema).count() == 0


def test_artifact_record_is_checked(spark):
    from pyspark.ml import PipelineModel

    root = fresh_path(spark, "models")
    with pytest.raises(ValueError):
        artifacts.save_model(PipelineModel([]), root, "v1", {"features": []})
    artifacts.save_model(PipelineModel([]), root, "v1", {"features": ["a"], "target": "y", "metrics": {}})
    assert artifacts.load_model(spark, root)[1]["version"] == "v1"


# ------------------------------------------------------------ monitoring


def test_psi_of_same_and_shifted_scores(spark):
    rng = np.random.default_rng(0)
    ref = np.append(rng.normal(-2, 2, 5000), rng.normal(8, 2, 10))
    make = lambda v: spark.createDataFrame([(float(a),) for a in v], "s double")
    base = make(ref)
    assert drift.psi_table(base, base, ["s"]).first().psi == pytest.approx(0)
    assert drift.score_psi(base, make(rng.normal(-2, 2, 500)), "s").first().psi < 0.2
    assert drift.score_psi(base, make(rng.normal(3, 3, 500)), "s").first().psi > 0.25
    assert drift.score_psi(base, make(rng.normal(3, 3, 50)), "s").first().psi == 0.0
    edges, n = np.unique(np.percentile(ref, np.linspace(0, 100, 11))), 500
    cur = rng.normal(0, 2, n)
    r, c = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    rp, cp = (r + 1) / (r.sum() + len(r)), (c + 1) / (c.sum() + len(c))
    want = ((cp - rp) * np.log(cp / rp + 1e-10)).sum()
    assert drift.score_psi(base, make(cur), "s").first().psi == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n", [100, 101, 149, 150, 151, 350])
def test_rolling_windows_by_loop(spark, n):
    rng = np.random.default_rng(n)
    y, p = rng.standard_normal(n), rng.standard_normal(n)
    df = spark.createDataFrame([(i, float(y[i]), float(p[i])) for i in range(n)], "i long, y double, p double")
    got = {r.end_index: (r.n, r.r2) for r in drift.rolling_fit(df, "i", "i", "y", "p", 100).collect()}
    want = range(100, n, 50)
    assert sorted(got) == list(want)
    for e in want:
        a, b = y[e - 100 : e], p[e - 100 : e]
        assert got[e][0] == 100
        assert got[e][1] == pytest.approx(1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_prices_and_repair(spark):
    df = spark.createDataFrame([(12.0,), (16.0,), (14.9,), (-5.0,)], "x double")
    got = [r.p for r in df.select(scoring.price_from_log("x", 180000.0).alias("p")).collect()]
    assert got[1] == 180000 and got[2] == 2_000_000 and got[3] == 0
    with pytest.raises(ValueError):
        scoring.repair(df, ["x", "y"])


# ------------------------------------------------------------ text


def test_markup_and_entities(spark):
    page = "<HTML><head><title>x</title>\n</head><body><A href='q'>go</a> &lt;b&gt; \n \n\n end</body>"
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(X.html_to_text("h")).first()[0] == " HYPERLINK go <b>\n end"


def test_words(spark):
    df = spark.createDataFrame([(1, "Visit https://a.b/c?d=1 NOW: 3.5e10 Äpfel, x_y"), (2, ""), (3, None)], "k long, t string")
    got = {(r.k, r.term): r.n for r in textprep.word_counts(df, "k", "t").collect()}
    assert got == {(1, w): 1 for w in ("visit", "URL", "now", "NUMBER", "äpfel", "x_y")}


@pytest.mark.parametrize(
    "word,root",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
        ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"),
        ("digitizer", "digit"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("electrical", "electr"),
        ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"),
    ],
)
def test_stems_of_the_published_examples(word, root):
    assert stem(word) == root


def test_vectors_cover_documents_without_words(spark):
    df = spark.createDataFrame([(1, "a a b c"), (2, "a d"), (3, "")], "k long, t string")
    rows = {r.k: r.features for r in textprep.text_vectors(df, "k", "t", 2).collect()}
    assert rows[1].toArray().tolist() == [1.0, 2.0, 1.0] and rows[3].toArray().tolist() == [0.0, 0.0, 0.0]


def test_mail_prefers_plain_and_keeps_last_page(spark):
    raw = (
        b"MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>one</p>\n"
        b"--B\nContent-Type: text/html\n\n<p>two</p>\n--B--\n"
    )
    df = spark.createDataFrame([(1, raw), (2, b"Subject: s\n\nhello\n")], "k long, c binary")
    rows = {r.k: r for r in textprep.mail_text(textprep.parse_mails(df, "k", "c")).collect()}
    assert rows[1].structure == "multipart(text/html, text/html)" and rows[1].text.strip() == "two"
    assert rows[2].text.strip() == "hello"


# ------------------------------------------------------------ streams


def test_online_weights_find_the_line(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, 4000)
    rows = [(i, float(a), float(2 * a + 1 + 0.01 * b)) for i, (a, b) in enumerate(zip(x, rng.standard_normal(4000), strict=True))]
    path = jobs.spread_feed(spark.createDataFrame(rows, "id long, x double, y double"), "id", 6)
    feed = spark.readStream.schema("id long, x double, y double").option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.online_ridge(feed, ["x"], "y", rate=0.4, alpha=0.0).orderBy(F.desc("batch")).first()
    assert out.weights == pytest.approx([1.0, 2.0], abs=0.05) and out.n > 0


def test_null_groups_keep_their_rows(spark):
    from granary.operators import encode, split

    df = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), (F.col("id") % 7).alias("y"))
    parts = split.train_test_split(df, ["id"], 0.2, 1, by=["g"]).groupBy("g").agg(F.count("*").alias("n"), F.sum("is_test").alias("t"))
    assert {r.g: (r.n, r.t) for r in parts.collect()} == {k: (25, 5) for k in (None, 1, 2, 3)}
    folds = split.kfold(df, ["id"], 5, 1, by=["g"])
    assert folds.count() == 100 and folds.groupBy("g", "fold").count().where("count <> 5").count() == 0
    assert {r.weight for r in split.with_class_weights(df, "g").collect()} == {1.0}
    assert split.with_class_weights(df, "g").count() == 100
    coded = encode.out_of_fold_target(folds, "g", "y", "fold", out="e")
    assert coded.count() == 100 and coded.where("e IS NULL").count() == 0


def test_arff_quotes_and_marks(spark, tmp_path):
    from granary.sources import archives

    path = str(tmp_path / "t.arff")
    rows = [("a, b", 3.0), ("@home", 4.0), ("it's", None), (None, 5.0), ("% no comment", 2.0), ("", 6.0)]
    archives.write_arff(spark.createDataFrame(rows, "n string, v double"), path, "r")
    got = archives.read_arff(spark, path)
    assert got.dtypes == [("n", "string"), ("v", "double")]
    assert sorted(map(str, got.collect())) == sorted(f"Row(n={n!r}, v={v!r})" for n, v in rows)
