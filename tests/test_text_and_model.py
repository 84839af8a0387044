import math
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.functions import text as tx
from replyforge.functions.packs import DISCOVERY_STOP_WORDS
from replyforge.operators import features, model as ml

SAMPLES = [
    "@Shop_Help my   order is late!! see http://t.co/x?y=1 NOW",
    "a b cd\x1cef g hi", "", "   ", "no-break  x @ab@cd", "été a été, Straße",
    "HTTPS://UPPER.case tail", "x@foo-y z9z", "line\none\r\ntwo", "ID_42 and 7 ok_ _",
]


def reference_clean(text):
    text = text.lower()
    for pattern, repl in ((r"@[a-z0-9_]+", ""), (r"http\S+", ""), (r"[^a-z\s]", " "), (r"\b[a-z]\b", "")):
        text = re.sub(pattern, repl, text)
    return " ".join(text.split())


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string")


def test_cleaner_and_strip(samples):
    got = samples.select("i", tx.clean_message(F.col("t")), tx.strip(F.col("t"))).collect()
    for i, cleaned, stripped in got:
        assert cleaned == reference_clean(SAMPLES[i])
        assert stripped == SAMPLES[i].strip()


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tx.clean_message(F.col("t")), tx.strip(F.col("t"))).first() == (None, None)


def test_tokens(samples):
    got = samples.select("i", tx.word_tokens(F.col("t")), tx.alpha_tokens(F.col("t"))).collect()
    for i, words, alphas in got:
        assert words == re.findall(r"(?u)\b\w\w+\b", SAMPLES[i].lower())
        assert alphas == re.findall(r"[a-z]+", SAMPLES[i].lower())


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [tuple(r) for r in df.select(*[tx.ngrams(F.col("w"), n) for n in (1, 2, 3)]).collect()]
    assert got == [(["a", "b", "c"], ["a b", "b c"], ["a b c"]), (["a"], [], []), ([], [], [])]


def test_ngrams_span_removed_words(spark):
    df = spark.createDataFrame([("I haven not received it yet",)], "t string")
    got = rows(features.ngram_topk(df, "t", 2, stop_words=DISCOVERY_STOP_WORDS))
    assert got == [("haven received", 1), ("received yet", 1)]


DOCS = ["the cat sat", "the cat ate the fish", "a dog sat", "fish fish fish dog", "zz"]


def brute_tfidf(docs, sizes, min_df, sublinear):
    counts = []
    for d in docs:
        w = re.findall(r"\b\w\w+\b", d.lower())
        counts.append(Counter(" ".join(w[i:i + n]) for n in sizes for i in range(len(w) - n + 1)))
    df = Counter(t for c in counts for t in c)
    out = {}
    for i, c in enumerate(counts):
        raw = {
            t: ((1 + math.log(x)) if sublinear else x) * (math.log((1 + len(docs)) / (1 + df[t])) + 1)
            for t, x in c.items() if df[t] >= min_df
        }
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / norm for t, v in raw.items()})
    return out


@pytest.mark.parametrize("limit", [None, 1000])
@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf(spark, limit, sublinear):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i long, t string")
    got = features.tfidf(
        df, "i", tx.word_tokens(F.col("t")), (1, 2), min_df=2, max_features=limit, sublinear=sublinear
    )
    want = brute_tfidf(DOCS, (1, 2), 2, sublinear)
    assert {(r.i, r.term): r.weight for r in got.collect()} == pytest.approx(want)


def test_tfidf_needs_one_exchange_by_document(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i long, t string")
    got = features.tfidf(df, "i", tx.word_tokens(F.col("t")), (1, 2), max_features=1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(i#") == 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100])
def test_vocabulary_limit(spark, n):
    cf = {"a": 9, "b": 8, "c": 8, "d": 2, "e": 2, "f": 1}
    lists = spark.createDataFrame([(1, [t] * x) for t, x in cf.items()], "k long, grams array<string>")
    got = {r.term for r in features.vocabulary(lists, 1, n).collect()}
    assert got == set(sorted(cf, key=lambda t: (-cf[t], t))[:n])


@pytest.fixture(scope="module")
def trained(spark):
    data = [
        ("my parcel never arrived today", "delivery_issue"),
        ("parcel never arrived at home", "delivery_issue"),
        ("refund my money now", "refund_return"),
        ("please refund my money", "refund_return"),
        ("hello there friend", "other_unknown"), ("hello friend again", "other_unknown"),
        ("hello there again", "other_unknown"), (None, "other_unknown"),
    ]
    df = spark.createDataFrame(data, "customer_text string, intent string")
    return df, ml.train_classifier(df)


def test_features_match_relational_form(spark, trained):
    """The vectors hold the same weights as the relational TF-IDF, up to their length."""
    df, model = trained
    docs = df.dropna().coalesce(1).withColumn("i", F.monotonically_increasing_id())
    lists = features.gram_lists(docs, "i", features.training_words(F.col("customer_text")), (1, 2))
    terms = sorted(r.term for r in model.terms.collect())
    at = spark.createDataFrame(list(enumerate(terms)), "at int, term string")
    vocab = model.terms.select("term", "idf").join(at, "term")
    got = {}
    for r in ml._vectors(lists, "i", vocab, len(terms), sublinear=True).collect():
        length = math.sqrt(sum(v * v for v in r.features.values)) or 1.0
        got |= {(r.i, terms[j]): v / length for j, v in zip(r.features.indices, r.features.values)}
    texts = [r.customer_text for r in docs.orderBy("i").collect()]
    assert got == pytest.approx(brute_tfidf(texts, (1, 2), 2, True))


def test_no_python_in_the_model_path(spark, trained):
    df, model = trained
    plan = ml.score(df, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scores_and_save_load(spark, trained):
    df, model = trained
    rows_in = df.dropna()
    scored = ml.score(rows_in, model)
    assert all(r.model_intent == r.intent and 0 < r.confidence <= 1 for r in scored.collect())
    path = tempfile.mkdtemp() + "/model"
    ml.save_model(model, path)
    again = ml.score(rows_in, ml.load_model(path))
    assert rows(again) == rows(scored)


def test_evaluate_golden(spark, trained):
    df, model = trained
    golden = df.dropna().withColumnRenamed("intent", "true_intent").withColumn(
        "example_id", F.concat(F.lit("GS-"), F.col("customer_text"))
    )
    preds = ml.evaluate_golden(golden, model)
    assert preds.count() == 7 and preds.where("correct").count() == 7


def test_clusters(spark):
    data = [(i, "red apple pie" if i % 2 else "blue car wheel") for i in range(20)]
    docs = spark.createDataFrame(data, "i long, t string")
    clustered, centres = ml.topic_clusters(docs, "i", "t", k=2)
    profile = ml.cluster_profile(clustered, centres, "i", "t").collect()
    assert sorted(r.size for r in profile) == [10, 10]
    assert {frozenset(r.words.split(", ")) for r in profile} == {
        frozenset({"red", "apple", "pie"}), frozenset({"blue", "car", "wheel"})
    }


def test_limited_vocabularies_move_nothing_by_term(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i long, t string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = features.tfidf(df, "i", tx.word_tokens(F.col("t")), (1, 2), max_features=1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(term#" not in plan


def test_top_grams_work_each_text_out_once(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i long, t string")
    plan = features.ngram_topk(df, "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_cleaned_tokens_with_and_without_rewriting(spark):
    texts = ["plain Words here", "ask @bob_1now ok", "see HTTP://x.y/z done", "ht@xtp://a b",
             "@a http://@b c", "", None, "ht@x tp is"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import re

    want = [t and re.findall("[a-z]{2,}", re.sub(r"http\S+", "", re.sub("@[a-z0-9_]+", "", t.lower())))
            for t in texts]
    got = [r[0] for r in df.select(tx.cleaned_tokens(F.col("t"))).collect()]
    assert [g or None for g in got] == [w or None for w in want]
