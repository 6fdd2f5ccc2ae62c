import json
import re
from pathlib import Path

import pyarrow as pa
import pytest
import zstandard
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hunkmill import schemas
from hunkmill.catalog import file_queries
from hunkmill.operators import evaluation, hunks, joins, models, rollups
from hunkmill.plans import calibration, contrast, messages, report, trends
from hunkmill.session import shared_folder
from hunkmill.sources import corpora, json_arrays, readers, writers


def test_csv_keeps_odd_rows(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('hash,author_date,insertions,msg\na,2020-01-01,[5],"two\nlines, ""q"""\n'
                    "b,2020-01-02\nc,bad,7,x,extra\n")
    rows = readers.csv_columns(spark, str(path), ["hash", "author_date", "insertions", "msg"],
                               ["hash", "author_date", "insertions"])
    assert [r.hash for r in rows.collect()] == ["a", "b", "c"]
    full = readers.csv_columns(spark, str(path), ["hash", "author_date", "insertions", "msg"],
                               ["msg"]).collect()
    assert full[0].msg == 'two\nlines, "q"'
    union = rollups.union_exports([(rows, {})])
    cleaned = rollups.clean_commit_rows(union).collect()
    assert [(r.hash, r.insertions, r.files_count) for r in cleaned] == [("a", 5.0, 0.0),
                                                                       ("b", 0.0, 0.0)]
    assert readers.existing(spark, [str(path), str(path) + "x"]) == [str(path)]


def test_numbered_lines_over_many_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[:4000]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8kb")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "a.txt")).orderBy("line").collect()
        both = readers.aligned_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
        assert both.where("left <> right").count() == 0 and both.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line for r in rows] == list(range(5000)) and [r.value for r in rows] == lines


def test_result_documents(spark, tmp_path):
    for name, text in (("a", json.dumps({"original": ["x"], "sampled": ["long text", " abc "]})),
                       ("b", json.dumps({"original": ["x"]})), ("c", "{broken")):
        folder = tmp_path / "model" / name
        folder.mkdir(parents=True)
        (folder / "raw.json").write_text(text)
    rows = readers.raw_pair_documents(spark, str(tmp_path / "*" / "*" / "raw.json"))
    assert [r.text for r in readers.generated_texts(rows).collect()] == ["long text"]


COMMIT = {
    "msg": "one\ntwo", "hash": "h1", "author_date": "2024-05-06T07:08:09+02:00",
    "author": {"name": "Ann", "email": "a@x"}, "committer": {"name": "Ann", "email": "a@x"},
    "co_authors": [{"name": "Bo", "email": None}], "insertions": 3, "deletions": 1, "lines": 4,
    "files": 2,
    "modified_files": [
        {"filename": "a.py", "old_path": "src/a.py", "new_path": None, "change_type": "MODIFY",
         "diff": "@@ -1 +1,2 @@\n+x = 1\n+y = 2\n z\n+w()\n", "added_lines": 3,
         "diff_parsed": {"added": [[1, "x = 1"], [2, "y = 2"]], "deleted": [[9, "q"]]},
         "methods": [{"name": "f", "long_name": "f()", "start_line": 1, "end_line": 2,
                      "complexity": 1, "nloc": 2, "params": []}],
         "changed_methods": [{"name": "f", "long_name": "f()", "start_line": 1, "end_line": 2}]},
        {"filename": "b.md", "new_path": "docs/b.md", "diff": "-gone", "methods": []},
    ],
}


def test_nested_commits(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([COMMIT, {**COMMIT, "hash": "h2"}], indent=4))
    rows = writers.land_commits(spark, str(tmp_path / "c.json"), str(tmp_path / "landed"))
    assert rows.count() == 2
    assert [r.author_name for r in hunks.flatten_files(rows).collect()] == ["Ann"] * 4
    assert [r.is_changed for r in hunks.flatten_methods(rows).collect()] == [True, True]
    changed = hunks.flatten_changed_lines(rows).where("hash = 'h1'").collect()
    assert [(r.side, r.line, r.text) for r in changed] == [
        ("added", 1, "x = 1"), ("added", 2, "y = 2"), ("deleted", 9, "q")]
    documents = rows.select(
        "*", F.lit("r").alias("repo"), F.array(F.lit("p")).alias("parents"),
        F.col("author_date").alias("committer_date"))
    mined = trends.mine(documents, "2024-01-01", "2024-12-31")
    commit = mined.commits.where("commit_hash = 'h1'").first()
    assert (commit.message, commit.hunk_count, commit.added_hunk_lines) == ("one\\ntwo", 2, 3)
    assert (commit.source_file_count, commit.docs_file_count) == (1, 0)
    mined.write(str(tmp_path / "mined"))
    read = readers.mined_commits(spark, str(tmp_path / "mined/commit_metrics"), ["r"])
    assert {r.calendar_month for r in read.collect()} == {"2024-05"}
    assert trends.mine(documents, "2025-01-01").commits.count() == 0


def test_corpora(spark, tmp_path):
    folder = tmp_path / "writingPrompts"
    folder.mkdir()
    (folder / "valid.wp_source").write_text("[ WP ] Go on\n[ WP ] Stop\n")
    (folder / "valid.wp_target").write_text("he said , i 'm `` here '' .\nnsfw text\n")
    got = corpora.load(spark, "writing", str(tmp_path)).collect()
    assert [(r.key, r.text) for r in got] == [(0, "Go on\nhe said, I'm \"here\".")]
    spark.createDataFrame([(1, "q?", "a.")], "key int, question string, long_answer string") \
        .write.parquet(str(tmp_path / "pubmed"))
    assert corpora.load(spark, "pubmed", str(tmp_path)).first().text == (
        "Question: q? Answer:<<<SEP>>>a.")
    (tmp_path / "commits_gpt2.json").write_text(json.dumps([COMMIT]))
    assert corpora.load(spark, "commits_gpt2", str(tmp_path)).first().text == "one\ntwo"
    with pytest.raises(ValueError, match="unknown corpus"):
        corpora.load(spark, "none", str(tmp_path))


@pytest.fixture(scope="module")
def vectors(spark):
    """Two classes that overlap, one of them rare."""
    rows = spark.range(1200).select(
        F.col("id").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 0, "Python").otherwise("Java").alias("language"),
        F.lit("source").alias("file_category"), F.lit("short").alias("length_bucket"))
    noise = lambda s: (F.pmod(F.xxhash64(F.lit(s), "key"), F.lit(1000)) / 1000).cast("float")
    return rows.withColumn("embedding", F.array(noise(1) + F.col("label") * 0.7, noise(2)))


def test_calibration(spark, vectors, tmp_path):
    found = calibration.calibrate(vectors, ["key"], max_rows=800)
    overall = found.overall.first()
    assert overall.train_rows + overall.test_rows == 3 * (800 // 3) and overall.roc_auc > 0.9
    assert overall.balanced_accuracy == found.sweep.first().balanced_accuracy
    found.write(str(tmp_path / "out"))
    stored = models.load(spark, str(tmp_path / "out/detector"))
    assert stored.threshold == found.threshold
    model = stored.model
    again = models.score(model, models.embedding_features(found.predictions.drop("prob_ai")))
    assert again.join(found.predictions.withColumnRenamed("prob_ai", "p"), "key").where(
        F.abs(F.col("p") - F.col("prob_ai")) > 1e-12).count() == 0
    config = readers.frozen_config(spark, str(tmp_path / "out/frozen_config/*.json")).first()
    assert config.threshold == found.threshold


def test_score_with_any_detector(vectors):
    import pandas as pd

    scored = models.score_with(
        vectors, lambda batch: pd.Series([float(v[1]) for v in batch]), "embedding", "p")
    assert scored.where(F.abs(F.col("p") - F.col("embedding")[1]) > 1e-6).count() == 0


def test_trend_and_report(spark, tmp_path):
    commits = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("repo"),
        F.col("id").cast("string").alias("commit_hash"),
        F.format_string("%d-%02d", 2020 + F.col("id") % 6, 1 + F.col("id") % 12)
        .alias("calendar_month"))
    rows = commits.select("repo", "commit_hash", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    hunk_rows = rows.select(
        "*", F.lit("Java").alias("language"), F.lit("test").alias("file_category"),
        (F.col("n") * 4).cast("int").alias("line_count"))
    score = lambda usable: usable.withColumn(
        "prob_ai", F.pmod(F.xxhash64("commit_hash", "n"), F.lit(100)) / 100)
    found = trends.analyse(commits, hunk_rows, score, 0.45, per_month=20)
    assert found.scored.where("line_count < 5").count() == 0
    assert found.monthly.agg(F.max("commits")).first()[0] == 20
    allowed = spark.createDataFrame([("Java", "test", "medium")],
                                    "language string, file_category string, length_bucket string")
    both = trends.usable_hunks(hunk_rows, ["Java"], allowed, "both")
    assert {r[0] for r in both.select("n").distinct().collect()} == {4}
    config = spark.createDataFrame(
        [(0.45, [("Java", "test", "short")], ["source"], ["Java"], ["docs"], ["very_short"], "")],
        schemas.FROZEN_CONFIG)
    overall = spark.createDataFrame([(0.45, 0.8, 0.9, 0.7, 0.6)],
                                    "threshold double, balanced_accuracy double, roc_auc double, "
                                    "precision double, recall double")
    repos = trends.repo_summaries(commits, hunk_rows)
    assert {(r.repo, r.commit_rows, r.hunk_rows) for r in repos.collect()} == {
        ("a", 1000, 4000), ("b", 2000, 8000)}
    made = report.build(found.monthly, found.pooled, config, repos, overall)
    made.write(str(tmp_path / "report"))
    text = made.text()
    assert "Repositories: a, b" in text and "2021-2022:" in text and "Threshold: 0.45" in text
    assert spark.read.option("header", True).csv(str(tmp_path / "report/threshold_robustness")).count() == 6


def test_usage_trend(spark):
    rows = spark.range(900).select(F.col("id").alias("key"), (2019 + F.col("id") % 6).alias("year"))
    trend = messages.usage_trend(
        rows, lambda r: r.withColumn("raw_ai_probability", F.lit(0.55)), per_year=50).collect()
    assert {r.year: r.percentage_ai for r in trend} == {
        2019: 0.0, 2020: 0.0, 2021: 0.0, 2022: 0.0, 2023: 100.0, 2024: 100.0}
    assert all(r.total_commits == 50 and r.percentage_ai_raw == 100.0 for r in trend)


def test_linear_svm_separates(spark, vectors):
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        vectors.select("key", "label", F.col("embedding")[0].alias("a"),
                       F.col("embedding")[1].alias("b")))
    model = models.fit_linear_svm(data, "key", folds=2)
    scored = models.score(model, data, "score")
    assert models.detector_areas(scored.select("label", "score")).first().roc_auc > 0.9


def test_contrast(spark):
    from hunkmill.operators import corpus

    pairs = spark.range(40).select(
        F.col("id").alias("pair_id"),
        F.concat_ws(" ", *[F.concat(F.lit(f"u{i}x"), F.col("id")) for i in range(30)])
        .alias("original"),
        F.lit("the cat sat on the mat and " * 5).alias("sampled"))
    reference = spark.createDataFrame([("the cat sat on the mat and the cat sat",)], "text string")
    model = corpus.fit(reference).landed(spark)
    got = {r.name: r for r in contrast.experiments(pairs, model, [1, 3]).collect()}
    assert set(got) == {"likelihood_threshold", "rank_threshold", "log_rank_threshold",
                        "entropy_threshold", "perturbation_1_d", "perturbation_1_z",
                        "perturbation_3_d", "perturbation_3_z"}
    assert got["likelihood_threshold"].roc_auc == 1.0 and got["perturbation_3_d"].roc_auc > 0.95


def test_lines_of_several_files_are_numbered_on(spark, tmp_path):
    for name, lines in (("a.txt", "x y z"), ("b.txt", "u v w")):
        (tmp_path / name).write_text("\n".join(lines.split()) + "\n")
    rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((r.line, r.value) for r in rows) == list(enumerate("x y z u v w".split()))


def test_scores_that_are_not_numbers_flag_nothing(spark):
    rows = spark.createDataFrame([("r", "c", float("nan"), 3, 1), ("r", "c", 0.1, 2, 0)], "repo string, commit_hash string, prob_ai double, line_count int, label int")
    found = rollups.commit_scores(rows, 0.5).first()
    assert (found.ai_hunk_count_low, found.ai_hunk_count_high, found.max_hunk_score, found.mean_hunk_score) == (0, 0, 0.1, 0.1)
    metrics = evaluation.confusion_metrics(rows, 0.5).first()
    assert (metrics.tp, metrics.fp, metrics.tn, metrics.fn) == (0, 0, 1, 1)
    assert all(r.tp == 0 for r in evaluation.threshold_sweep(rows).collect())


def test_a_frozen_configuration_drives_the_trend(spark):
    config = spark.createDataFrame([(0.4, ["Go"], ["source"], ["very_short"])], "threshold double, main_languages array<string>, main_file_categories array<string>, excluded_length_buckets array<string>")
    hunk_rows = spark.createDataFrame([("r", "c", "Go", "source", 8, 0.9), ("r", "c", "Go", "test", 8, 0.9), ("r", "c", "Java", "source", 8, 0.9)], "repo string, commit_hash string, language string, file_category string, line_count int, prob_ai double")
    commits = spark.createDataFrame([("r", "c", "2024-01")], "repo string, commit_hash string, calendar_month string")
    found = trends.analyse(commits, hunk_rows, lambda rows: rows, **trends.configured(config))
    assert found.scored.count() == 1


ODD_OBJECTS = [
    {"msg": "a } b { c ] d [ \\ \" \\\" end\\", "n": [{"x": "}"}, {"y": {"z": "]"}}], "hash": "1"},
    {"msg": "", "n": [], "hash": "2"}, {"hash": "3"}, {},
    {"msg": "ünï   {{{{ \"}\" , ]", "n": [[[{"k": "\\\\"}]]], "hash": "4"},
    {"msg": "line\nbreak\ttab, [", "hash": "5"},
]


@pytest.mark.parametrize("size, indent", [(7, None), (16, 2), (23, None), (5000, None)])
def test_objects_of_an_array_that_is_cut_anywhere(spark, tmp_path, size, indent):
    (tmp_path / "one.json").write_text(json.dumps(ODD_OBJECTS, indent=indent, ensure_ascii=False))
    (tmp_path / "two.json").write_text(" \n" + json.dumps(ODD_OBJECTS[:1], indent=indent) + "\n")
    (tmp_path / "none.json").write_text("[ ]\n")
    (tmp_path / "single.json").write_text(json.dumps(ODD_OBJECTS[4], indent=indent))
    bytes_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = json_arrays.objects(spark, str(tmp_path / "*.json")).collect()
        ranges = json_arrays._pieces(spark, str(tmp_path / "one.json")).select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_before)
        spark.conf.set("spark.sql.files.openCostInBytes", open_before)
    assert size > 1000 or ranges > 3
    by_file = {}
    for row in found:
        by_file.setdefault(row.file.rsplit("/", 1)[1], []).append(json.loads(row.text))
    key = lambda rows: sorted(map(json.dumps, rows))
    assert key(by_file.pop("one.json")) == key(ODD_OBJECTS)
    assert by_file == {"two.json": ODD_OBJECTS[:1], "single.json": [ODD_OBJECTS[4]]}


def test_pieces_of_an_array_carry_no_names(spark, tmp_path):
    folder = tmp_path / "a b%20"
    folder.mkdir()
    (folder / "x y.json").write_text(json.dumps(ODD_OBJECTS * 300))
    pieces = json_arrays._pieces(spark, str(folder))
    assert dict(pieces.dtypes)["file"] == "bigint"
    found = json_arrays.objects(spark, str(folder)).collect()
    assert [json.loads(r.text) for r in found] == ODD_OBJECTS * 300
    assert {r.file for r in found} == {r[0] for r in spark.read.text(str(folder)).select("_metadata.file_path").collect()}


def test_compressed_documents_are_landed(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("h}\n"), "id").alias("hash"), F.lit('"{').alias("msg"))
    writers.json_documents(rows.coalesce(1), str(tmp_path / "documents"), "gzip", file_rows=20)
    assert len(list((tmp_path / "documents").glob("*.json.gz"))) == 3
    read = writers.land_commits(spark, str(tmp_path / "documents"), str(tmp_path / "landed"), lines=True)
    assert sorted(r.hash for r in read.collect()) == sorted(f"h}}\n{i}" for i in range(50))


def test_arrays_are_written_and_read_back(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("h}"), "id").alias("hash"), F.lit('"{').alias("msg"))
    writers.json_arrays(rows.repartition(3), str(tmp_path / "arrays"))
    texts = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("part*") if p.stat().st_size]
    assert sum(map(len, texts)) == 100
    read = readers.messages_of(readers.commit_documents(spark, str(tmp_path / "arrays")))
    assert {(r.hash, r.text) for r in read.collect()} == {(f"h}}{i}", '"{') for i in range(100)}


@pytest.mark.parametrize("size, step", [(23, 60), (300, 5), (100_000, 40)])
def test_packed_arrays_that_are_cut_anywhere(spark, tmp_path, size, step):
    codec, folder = pa.Codec("zstd"), tmp_path / "packed"
    folder.mkdir()

    def pack(name, objects, **how):
        # No frame ends within an escape.
        signs = re.findall(rb"\\.|[^\\]", json.dumps(objects, **how).encode(), re.S)
        frames = [b"".join(signs[i:i + step]) for i in range(0, len(signs), step)]
        (folder / name).write_bytes(b"".join(codec.compress(f, asbytes=True) + json_arrays.MARKER.encode() for f in frames))

    pack("one.txt", ODD_OBJECTS)
    pack("two.txt", ODD_OBJECTS, indent=2)
    pack("single.txt", ODD_OBJECTS[4])
    (folder / "none.txt").write_bytes(b"")
    bytes_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = json_arrays.objects(spark, str(folder), packed=True).collect()
        messages = readers.messages_of(readers.commit_documents(spark, str(folder), columns=["hash", "msg"], packed=True)).collect()
        ranges = json_arrays._pieces(spark, str(folder / "one.txt"), True).select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_before)
        spark.conf.set("spark.sql.files.openCostInBytes", open_before)
    assert size > 1000 or ranges > 3
    by_file = {}
    for row in found:
        by_file.setdefault(row.file.rsplit("/", 1)[1], []).append(json.loads(row.text))
    key = lambda rows: sorted(map(json.dumps, rows))
    assert {name: key(rows) for name, rows in by_file.items()} == {
        "one.txt": key(ODD_OBJECTS), "two.txt": key(ODD_OBJECTS), "single.txt": key([ODD_OBJECTS[4]])}
    expected = [(x.get("hash"), x.get("msg")) for x in [*ODD_OBJECTS * 2, ODD_OBJECTS[4]]]
    assert sorted(map(str, map(tuple, messages))) == sorted(map(str, expected))


def test_packed_arrays_are_written_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FRAME_BYTES", 300)
    rows = spark.range(500).select(F.concat(F.lit("h}"), "id").alias("hash"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit('"{\\ü\n'), F.col("id") % 90)).alias("msg"))
    writers.json_arrays(rows.where("id > 450").repartition(3).unionByName(rows.where("id <= 450").coalesce(1)), str(tmp_path / "packed"), packed=True)
    files = [p.read_bytes() for p in (tmp_path / "packed").glob("part*") if p.stat().st_size]
    assert max(f.count(json_arrays.MARKER.encode()) for f in files) > 50
    # A plain reader of such files sees the array.
    texts = [zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() for f in files]
    assert sum(len(json.loads(t)) for t in texts) == 500
    bytes_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        read = readers.messages_of(readers.commit_documents(spark, str(tmp_path / "packed"), packed=True)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_before)
    assert sorted((r.hash, r.text or "") for r in read) == sorted((f"h}}{i}", '"{\\ü\n' * (i % 90) if i % 7 else "") for i in range(500))


def test_messages_of_commits_leave_little_on_the_disk(spark, tmp_path):
    orders = spark.range(3000).selectExpr("id AS o_orderkey", "id * 7919 % 1000 AS o_custkey", "TIMESTAMP'1996-01-02' AS o_orderdate")
    lines = spark.range(12_000).selectExpr(
        "id % 2900 AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "id * 104729 % 2000 AS l_partkey", "id % 100 AS l_suppkey",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "IF(id % 3 = 0, 'A', 'R') AS l_returnflag", "id * 1.5D AS l_extendedprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    text = file_queries._commit_documents(spark, str(tmp_path)).select(F.to_json(F.struct("*")).alias("text"))
    size = text.agg(F.sum(F.length("text"))).first()[0]
    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.rglob("*"))
    found = file_queries.commit_messages(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {(f"h{i}", f"order {i}\n\nbody") for i in range(3000)} and len(found) == 3000
    written = sum(p.stat().st_size for p in folder.rglob("*") if p not in before and p.is_file())
    assert written < size / 8


def test_tables_in_buckets_are_joined_without_a_shuffle(spark, tmp_path):
    keys, limit = ["repo", "commit_hash"], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    commits = spark.range(400).select(F.concat(F.lit("r"), F.col("id") % 4).alias("repo"), F.col("id").cast("string").alias("commit_hash"))
    rows = commits.crossJoin(spark.range(3).withColumnRenamed("id", "line_count")).where("commit_hash <> '7'")
    a = writers.co_located(commits, str(tmp_path / "commits"), "test_commits", keys, 8)
    b = writers.co_located(rows, str(tmp_path / "hunks"), "test_hunks", keys, 8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = joins.co_located_hunks(b, a.where("repo = 'r1'"), keys)
        joined = a.join(kept.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        assert joined.where("n = 3").count() == 100
        # Another session knows only the path.
        spark.sql("DROP TABLE test_hunks")
        again = readers.co_located(spark, str(tmp_path / "hunks"), "test_hunks_again", b.schema, keys, 8)
        plan = joins.co_located_hunks(again, a, keys)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and again.count() == 1197
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("test_commits", "test_hunks", "test_hunks_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_lines_that_do_not_fit_lose_nothing(spark, tmp_path):
    (tmp_path / "x.csv").write_text('h,m,n\n1,"a, ""b""\nc",2\n3,short\n4,a,b,too,"many ""x"""\n5,,\n')
    kept, apart = readers.csv_and_quarantine(spark, str(tmp_path / "x.csv"), ["h", "m", "n"])
    assert sorted(map(tuple, kept.collect()), key=str) == [("1", 'a, "b"\nc', "2"), ("5", None, None)]
    assert {r.line.strip(): r.fields for r in apart.collect()} == {"3,short": ["3", "short"], '4,a,b,too,"many ""x"""': ["4", "a", "b"]}
