"""Model folders, training gradient, clusters, streams with a model, growing profiles."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.operators import features, model as ml, profiling, ranking, routing
from replyforge.operators.incremental import ProfileState
from replyforge.schemas import RAW_MESSAGES
from replyforge.sources import readers, stages, taxonomy, writers
from replyforge.streaming.route_stream import route_stream_model

TEXTS = [
    ("my parcel never arrived today", "delivery_issue"), ("parcel never arrived at home", "delivery_issue"),
    ("refund my money now", "refund_return"), ("please refund my money", "refund_return"),
    ("hello there friend", "other_unknown"), ("hello friend again", "other_unknown"),
    ("hello there again", "other_unknown"), ("refund the parcel refund", "refund_return"),
    ("nothing in common", "other_unknown"), (None, "other_unknown"), ("no label", None),
]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TEXTS, "customer_text string, intent string")


@pytest.fixture(scope="module")
def given(spark):
    terms = [("refund", 2.0, [-1.0, 0.5, 3.0]), ("parcel", 1.5, [2.0, -1.0, 0.25]),
             ("hello", 1.2, [0.1, 2.0, -0.5]), ("my money", 1.1, [0.0, 0.3, 0.7]),
             ("absent term", 1.0, [4.0, -2.0, 1.0])]
    frame = spark.createDataFrame(terms, "term string, idf double, coefficients array<double>")
    return ml.IntentModel(frame, [0.1, 0.2, -0.3], ["delivery_issue", "other_unknown", "refund_return"])


# -- model folders -------------------------------------------------------------


def test_versions_of_a_model(spark, given, train, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(ValueError, match="no finished model"):
        ml.load_model(path, spark)
    assert [ml.save_model(given, path), ml.save_model(given, path)] == [1, 2]
    loaded = ml.load_model(path, spark, version=1)
    assert (loaded.labels, loaded.bias) == (given.labels, given.bias)
    texts = train.dropna()
    assert rows(ml.score(texts, loaded)) == rows(ml.score(texts, given))


def test_broken_models_are_refused(spark, given, tmp_path):
    path = str(tmp_path / "model")
    ml.save_model(given, path)
    # A writer that died after the terms leaves no manifest: the version does not count.
    given.terms.write.parquet(f"{path}/version=2/terms")
    assert ml.load_model(path, spark).labels == given.labels
    with pytest.raises(ValueError, match="no finished model 2"):
        ml.load_model(path, spark, version=2)
    given.terms.limit(1).write.mode("append").parquet(f"{path}/version=1/terms")
    with pytest.raises(ValueError, match="lost or changed terms"):
        ml.load_model(path, spark)


def test_equal_texts_are_scored_once_and_all_rows_come_back(spark, given):
    df = spark.createDataFrame(
        [(1, "refund refund"), (2, "refund refund"), (2, "refund refund"), (3, None), (4, "")],
        "i long, customer_text string",
    )
    got = sorted((r.i, r.model_intent) for r in ml.score(df, given).collect())
    assert got == [(1, "refund_return"), (2, "refund_return"), (2, "refund_return"),
                   (3, "other_unknown"), (4, "other_unknown")]


def test_stream_with_a_model_equals_batch_and_writes_no_stage(spark, given, tmp_path):
    texts = [(k, t) for k, (t, _) in enumerate(TEXTS)] + [(90, "  "), (91, "refund my money now")]
    for part in range(3):
        spark.createDataFrame(texts[part::3], "i long, customer_text string").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    model = str(tmp_path / "model")
    ml.save_model(given, model)
    stream = spark.readStream.schema("i long, customer_text string").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = set(os.listdir(stages.shared_folder(spark).removeprefix("file://")))
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    route_stream_model(stream, model, out, rejects, str(tmp_path / "state"), keep=("i",)).awaitTermination()
    assert set(os.listdir(stages.shared_folder(spark).removeprefix("file://"))) == before
    usable, blank = routing.split_blank(spark.createDataFrame(texts, "i long, customer_text string"))
    batch = routing.respond(ml.score(usable, given), keep=("i",))
    shown = F.to_json("response").alias("r")
    assert rows(spark.read.parquet(out).select("i", shown)) == rows(batch.select("i", shown))
    assert rows(spark.read.parquet(rejects), "i") == rows(blank, "i")
    assert len(os.listdir(out)) >= 3  # several micro-batches


def test_stream_goes_on_and_takes_new_models(spark, given, tmp_path):
    folder, model = tmp_path / "in", str(tmp_path / "model")

    def arrive(key):
        spark.createDataFrame([(key, "refund my money now")], "i long, customer_text string").coalesce(
            1).write.mode("append").parquet(str(folder))

    arrive(1)
    ml.save_model(given, model)
    stream = spark.readStream.schema("i long, customer_text string").parquet(str(folder))
    query = route_stream_model(
        stream, model, str(tmp_path / "out"), str(tmp_path / "rejects"), str(tmp_path / "state"),
        keep=("i",), every="1 second", refresh=True)
    try:
        query.processAllAvailable()
        other = ml.IntentModel(given.terms, [9.0, 0.0, 0.0], given.labels)
        ml.save_model(other, model)
        arrive(2)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("i", "response.predictions.confidence")
    by_id = {r.i: r.confidence for r in got.collect()}
    want = [ml.score(spark.createDataFrame([("refund my money now",)], "customer_text string"), m).first()
            for m in (given, other)]
    assert by_id == {1: pytest.approx(want[0].confidence), 2: pytest.approx(want[1].confidence)}
    assert want[0].model_intent != want[1].model_intent


# -- gradient --------------------------------------------------------------------


def brute_objective(model_terms, bias, labels, data):
    """(objective, x, y, w): class-balanced log loss plus penalty, by hand."""
    terms = sorted(model_terms)
    support = Counter(l for _, l in data)
    x = np.zeros((len(data), len(terms)))
    for row, (text, _) in enumerate(data):
        words = re.findall(r"\w\w+", text)
        counts = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
        for k, t in enumerate(terms):
            if counts[t]:
                x[row, k] = (1 + math.log(counts[t])) * model_terms[t][0]
        x[row] /= np.linalg.norm(x[row]) or 1.0
    y = np.array([labels.index(l) for _, l in data])
    w = np.array([len(data) / (len(support) * support[l]) for _, l in data])

    def objective(coefficients, bias):
        z = x @ coefficients + bias
        log_mass = np.log(np.exp(z).sum(axis=1))
        loss = (w * (log_mass - z[np.arange(len(y)), y])).sum() / len(data)
        return loss + (coefficients**2).sum() / 2 / len(data)

    return terms, objective


def test_gradient_is_the_slope_of_the_objective(train, given):
    data = [(t, l) for t, l in TEXTS if t is not None and l is not None]
    held = {r.term: (r.idf, r.coefficients) for r in given.terms.collect()}
    terms, objective = brute_objective(held, given.bias, given.labels, data)
    c, b = np.array([held[t][1] for t in terms]), np.array(given.bias)
    got = {(r.term, r.label): r.gradient for r in ml.training_gradient(train, given).collect()}
    assert len(got) == 3 * (len(terms) + 1)
    for j, label in enumerate(given.labels):
        for k, term in enumerate([*terms, ml.BIAS]):
            up_c, up_b, down_c, down_b = c.copy(), b.copy(), c.copy(), b.copy()
            if term == ml.BIAS:
                up_b[j] += 1e-5
                down_b[j] -= 1e-5
            else:
                up_c[k, j] += 1e-5
                down_c[k, j] -= 1e-5
            slope = (objective(up_c, up_b) - objective(down_c, down_b)) / 2e-5
            assert got[term, label] == pytest.approx(slope, abs=1e-8)


def test_gradient_vanishes_at_the_fitted_coefficients(train):
    fitted = ml.train_classifier(train, min_df=1, tol=1e-8)
    slopes = ml.training_gradient(train, fitted)
    assert slopes.agg(F.max(F.abs("gradient"))).first()[0] < 1e-3


def test_gradient_refuses_unknown_labels(spark, given):
    odd = spark.createDataFrame([("refund", "new label")], "customer_text string, intent string")
    with pytest.raises(ValueError, match="new label"):
        ml.training_gradient(odd, given)


# -- vocabulary cut ----------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_nth_text(spark, most):
    values = ["", "a", "ab", "abc", "abcd", "abce", "abcé", "b", "日本", "日本語", "z" * 40, "z" * 41]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "t string")
    want = sorted(values, key=lambda v: v.encode())
    assert [ranking.nth_text(df, "t", n, most) for n in range(1, len(want) + 1)] == want


def test_vocabulary_sorts_nothing_whole(spark):
    lists = spark.createDataFrame([(k, [f"t{k % 7}", f"only{k}"]) for k in range(60)], "k long, grams array<string>")
    best = features.vocabulary(lists, 1, 30)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    counts = Counter(t for k in range(60) for t in (f"t{k % 7}", f"only{k}"))
    assert {r.term for r in best.collect()} == set(sorted(counts, key=lambda t: (-counts[t], t))[:30])


# -- clusters ------------------------------------------------------------------------


def test_lloyd_steps_like_dense_k_means(spark):
    rng = np.random.default_rng(8)
    x = rng.random((40, 6)) * (rng.random((40, 6)) < 0.5)
    x[7] = 0
    start = np.arange(40) % 4
    weights = spark.createDataFrame(
        [(i, f"t{j}", float(x[i, j])) for i in range(40) for j in range(6) if x[i, j]],
        "i long, term string, weight double")
    assigned = spark.createDataFrame([(i, int(c)) for i, c in enumerate(start)], "i long, cluster int")
    got, centres = ml.lloyd_steps(weights, assigned, "i", steps=3)
    want = start
    for _ in range(3):
        means = np.array([x[want == c].mean(axis=0) if (want == c).any() else np.full(6, 1e9)
                          for c in range(4)])
        want = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.i: r.cluster for r in got.collect()} == dict(enumerate(want.tolist()))
    for r in centres.collect():
        assert r.weight == pytest.approx(x[want == r.cluster][:, int(r.term[1:])].mean())


# -- growing profiles ------------------------------------------------------------------


def _delivery(spark, path, data):
    spark.createDataFrame(data, "tweet_id long, author_id string, text string").coalesce(1).write.mode(
        "append").parquet(path)


def test_profile_grows_file_by_file(spark, tmp_path):
    folder, path = str(tmp_path / "state"), str(tmp_path / "in")
    state = ProfileState(spark, folder)
    parts = [[(1, "a", "x"), (2, None, "y"), (None, "b", None)], [(2, "a", None), (3, "c", "x")],
             [(3, None, "z"), (3, "d", "z")]]
    seen = []
    for data in parts:
        _delivery(spark, path, data)
        assert len(state.add(path)) == 1  # only the new file
        seen += data
        whole = spark.createDataFrame(seen, "tweet_id long, author_id string, text string")
        assert rows(state.null_profile(), "column", "n_rows", "n_null", "null_pct") == rows(
            profiling.null_profile(whole), "column", "n_rows", "n_null", "null_pct")
        assert rows(state.duplicate_ids()) == rows(profiling.duplicate_ids(whole))
    assert state.add(path) == []
    estimates = {r.column: r.estimate for r in state.distinct_estimates().collect()}
    assert estimates == {"tweet_id": 3, "author_id": 4, "text": 3}
    # Compacted, the state says the same, goes on growing, and an unfinished merge is no harm.
    for extra in ([], [(9, "e", "w"), (1, None, None)]):
        state.compact()
        state.compact()
        if extra:
            _delivery(spark, path, extra)
            assert len(state.add(path)) == 1
            seen += extra
        whole = spark.createDataFrame(seen, "tweet_id long, author_id string, text string")
        assert rows(state.null_profile(), "column", "n_rows", "n_null", "null_pct") == rows(
            profiling.null_profile(whole), "column", "n_rows", "n_null", "null_pct")
        assert rows(state.duplicate_ids()) == rows(profiling.duplicate_ids(whole))
        assert state.add(path) == []
    state._files().drop("batch").write.parquet(f"{folder}/files/batch=c-unfinished")
    assert rows(state.duplicate_ids()) == rows(profiling.duplicate_ids(whole))
    assert state.null_profile().first().n_rows == len(seen)
    # Ids of a batch that never finished do not count; neither does an empty state.
    spark.createDataFrame([(77, 5, 1)], "key long, n long, bucket int").write.partitionBy("bucket").parquet(
        f"{folder}/ids/batch=unfinished")
    assert rows(ProfileState(spark, folder).duplicate_ids()) == rows(profiling.duplicate_ids(whole))
    assert rows(ProfileState(spark, str(tmp_path / "none")).duplicate_ids()) == [(0, 0, 0)]


def test_sketches_merge_over_deliveries(spark, tmp_path):
    state = ProfileState(spark, str(tmp_path / "state"))
    for part in range(3):
        spark.range(part * 4000, part * 4000 + 8000).select(
            F.col("id").alias("tweet_id"), F.col("id").cast("string").alias("author_id"),
            F.lit("x").alias("text")).write.mode("append").parquet(str(tmp_path / "in"))
        state.add(str(tmp_path / "in"))
    estimates = {r.column: r.estimate for r in state.distinct_estimates().collect()}
    assert abs(estimates["tweet_id"] / 16000 - 1) < 0.05 and estimates["text"] == 1


def test_ledger_by_sketches(spark):
    pairs = spark.range(5000).select((F.col("id") % 700).alias("conversation_id"))
    extract = spark.createDataFrame([("b",), ("u",)], "author_id string")
    exact = profiling.extraction_ledger(extract, pairs, pairs.limit(100), "b").first()
    about = profiling.extraction_ledger(extract, pairs, pairs.limit(100), "b", approximate=True).first()
    assert exact.conversations_before == 700
    assert abs(about.conversations_before / 700 - 1) < 0.1
    assert (about.pairs_before, about.pairs_removed) == (exact.pairs_before, exact.pairs_removed)


# -- sources ------------------------------------------------------------------------------


def test_rejected_lines_say_why(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n'
                    '1,u,True,t,fine,,\n2,u,True,t,"a, ""b""\nc",,3,too,"many, x"\n3,u,True\n')
    kept, rejects = readers.read_messages(spark, str(path))
    assert rows(kept, "tweet_id") == [(1,), (3,)]
    assert rows(rejects, "file", "n_fields", "reason") == [
        ("m.csv", 9, "too many fields: 9 instead of 7")]
    assert rejects.first().line.startswith('2,u,True,t,"a, ""b""\nc"')


def test_rows_numbered_as_the_files_have_them(spark, tmp_path):
    df = spark.createDataFrame([(str(k * 37 % 101), f"line\n{k}") for k in range(101)], "tweet_id string, text string")
    schema = RAW_MESSAGES.__class__([f for f in RAW_MESSAGES.fields if f.name in ("tweet_id", "text")])
    path = str(tmp_path / "x")
    writers.export_csv(df.orderBy(F.col("tweet_id").cast("int")).repartitionByRange(
        5, F.col("tweet_id").cast("int")).sortWithinPartitions(F.col("tweet_id").cast("int")), path)
    got = readers.read_in_order(spark, path, schema)
    assert [(r.row_no, int(r.tweet_id)) for r in got.orderBy("row_no").collect()] == [
        (k + 1, k) for k in range(101)]


def test_taxonomy_folder(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("intents:\n  - name: one\n    priority: High\n  - {name: 2}\n")
    (tmp_path / "b.yml").write_text("- name: three\n")
    (tmp_path / "notes.md").write_text("no taxonomy")
    got = taxonomy.read(spark, str(tmp_path))
    assert rows(got, "file", "position", "name") == [("a.yaml", 0, "one"), ("a.yaml", 1, "2"), ("b.yml", 0, "three")]
    assert got.where("name = 'one'").first().attributes == {"priority": "High"}
    assert got.rdd.getNumPartitions() == 2
    assert rows(taxonomy.read(spark, (tmp_path / "b.yml").as_uri()), "name") == [("three",)]


def test_taxonomy_refuses_other_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("other: 1\n")
    with pytest.raises(Exception, match="no list of named intents"):
        taxonomy.read(spark, str(tmp_path / "a.yaml")).collect()
    with pytest.raises(Exception, match="does not exist"):
        taxonomy.read(spark, str(tmp_path / "none")).collect()


def test_taxonomy_round_trip(spark, tmp_path):
    names = ['plain', 'with: "colon"', "- dash", "été", "a\\b"]
    taxonomy.write(spark, spark.createDataFrame([(n,) for n in names], "name string"), str(tmp_path / "t"))
    assert rows(taxonomy.read(spark, str(tmp_path / "t")), "position", "name") == sorted(
        enumerate(sorted(names)), key=repr)


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    few = spark.read.parquet(str(tmp_path / "one"))
    assert readers.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = few.repartition(20)
    assert readers.spread(many) is many
    assert readers.spread(few).count() == 100


def test_spread_bounds_what_a_task_reads(spark, tmp_path):
    spark.range(5000).repartition(10).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert readers.spread(scan, task_bytes=1000).rdd.getNumPartitions() > 20
    assert readers.spread(scan, task_bytes=1000).count() == 5000
