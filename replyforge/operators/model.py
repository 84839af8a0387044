"""Spark ML: intent classifier, topic clusters, scoring, evaluation.

Features are built relationally (see ``features``) and only packed into vectors
for the fit, so no Python runs on the executors.  A fitted classifier is a table
of terms with their idf and one coefficient per class; scoring joins it to the
terms of the texts and adds up.  Coefficients and cluster centres are all that
reaches the driver; their size is set by ``max_features`` and ``k``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from replyforge.functions.packs import DISCOVERY_STOP_WORDS
from replyforge.functions.text import cleaned_tokens, drop_words, flatten_lines
from replyforge.operators import features
from replyforge.operators.metrics import predictions_table
from replyforge.operators.routing import decide
from replyforge.operators.rules import expected_escalation
from replyforge.operators.sampling import class_weights, uniform_sample
from replyforge.sources.stages import cut, stage_path

SIZES = (1, 2)  # the classifier reads single words and pairs


@dataclass
class IntentModel:
    """terms: (term, idf, coefficients), one coefficient per label."""

    terms: DataFrame
    bias: list[float]
    labels: list[str]


def _numbered(vocab: DataFrame) -> DataFrame:
    """Adds ``at``, the place of each term; the vocabulary's limit bounds the sort."""
    return vocab.withColumn("at", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def _vectors(
    lists: DataFrame, key: str, vocab: DataFrame, size: int, sublinear: bool,
    rest: DataFrame | None = None, sent: bool = True,
) -> DataFrame:
    """``rest`` (or ``lists`` without its grams), with ``features``: tf-idf as sparse vectors.

    The struct that a vector is made of is built with plain functions, written,
    and read back as vectors.  Vectors have unit length; a document without any
    known term gets zeros.
    """
    packed = features.raw_weights(lists, key, vocab, sublinear, sent).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("w"),
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_length"),
    )
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.coalesce(F.transform("w", lambda w: w["at"]), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(
            F.transform("w", lambda w: w["raw"] / F.col("_length")), F.array().cast("array<double>")
        ).alias("values"),
    )
    rest = lists.drop("grams") if rest is None else rest
    whole = rest.join(packed, key, "left").select(*rest.columns, sparse.alias("features"))
    path = stage_path(lists.sparkSession, "vectors")
    whole.write.parquet(path)
    schema = T.StructType([*rest.schema.fields, T.StructField("features", VectorUDT())])
    return lists.sparkSession.read.schema(schema).parquet(path)


def _training_rows(train: DataFrame, text: str, label: str) -> DataFrame:
    """(_row, _label, _words) of the usable rows, as a stage table."""
    rows = train.dropna(subset=[text, label]).select(
        F.monotonically_increasing_id().alias("_row"), F.col(label).alias("_label"),
        features.training_words(F.col(text)).alias("_words"),
    )
    return cut(rows, "training-words")


def train_classifier(
    train: DataFrame,
    text: str = "customer_text",
    label: str = "intent",
    min_df: int = 2,
    max_features: int = 50_000,
    max_iter: int = 1000,
    tol: float = 1e-6,
) -> IntentModel:
    """Class-balanced multinomial logistic regression on sublinear TF-IDF.

    Balanced weights sum to the row count n, so ``regParam = 1/n`` is the
    objective with C = 1.  ``tol`` is the relative gain at which the fit stops;
    with 1e-6 the steepest slope left is about 1e-4 (``training_gradient``).  Vocabulary ties are broken by term.
    """
    rows = _training_rows(train, text, label)
    grams = features.gram_lists(rows, "_row", F.col("_words"), SIZES)
    chosen = features.with_idf(features.vocabulary(grams, min_df, max_features), rows)
    vocab = cut(_numbered(chosen), "vocabulary")
    size = vocab.count()
    labels = sorted(r["_label"] for r in rows.select("_label").distinct().collect())  # classes
    weights = class_weights(rows.select("_label"), "_label").select("_label", "weight")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("_label")) - 1
    lists = features.by_document(rows, "_row", "_words", SIZES)
    ready = _vectors(
        lists, "_row", vocab, size, sublinear=True, rest=rows.select("_row", "_label")
    ).join(F.broadcast(weights), "_label").select(
        F.col("features").alias("unit"), place.cast("double").alias("_y"), "weight"
    ).persist()
    try:
        n = ready.count()
        fitted = LogisticRegression(
            featuresCol="unit", labelCol="_y", weightCol="weight", family="multinomial",
            maxIter=max_iter, tol=tol, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
            standardization=False, aggregationDepth=2,
        ).fit(ready)
    finally:
        ready.unpersist()
    by_term = fitted.coefficientMatrix.toArray().T.tolist()
    coefficients = train.sparkSession.createDataFrame(
        list(enumerate(by_term)), "at int, coefficients array<double>"
    )
    terms = cut(vocab.join(coefficients, "at").select("term", "idf", "coefficients"), "model-terms")
    return IntentModel(terms, [float(b) for b in fitted.interceptVector.toArray()], labels)


def score(
    df: DataFrame, model: IntentModel, text: str = "customer_text", digits: int | None = None
) -> DataFrame:
    """Add ``model_intent`` and ``confidence`` (the largest class probability, rounded
    to ``digits`` if given).

    A text is scored by the sum over its terms of weight times coefficient; one
    without any known term (or NULL) gets the biases.  A score depends on the
    text alone, so each different text is scored once and joined back by its
    digest: nothing is written, rows need no key, and a text that many rows
    share is one row of the work.
    """
    keyed = df.withColumn("_text", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    texts = keyed.select("_text", F.col(text).alias("_given")).dropDuplicates(["_text"])
    lists = features.gram_lists(texts, "_text", features.training_words(F.col("_given")), SIZES)
    raw = features.raw_weights(lists, "_text", model.terms, sublinear=True)
    sums = raw.groupBy("_text").agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"),
        *_class_sums(F.col("raw"), len(model.labels)),
    )
    margins = _margins(model.bias, F.col("_norm"))
    best = F.array_max("_margins")
    mass = F.aggregate("_margins", F.lit(0.0), lambda s, m: s + F.exp(m - F.array_max("_margins")))
    names = F.array(*[F.lit(x) for x in model.labels])
    return keyed.join(sums, "_text", "left").withColumn("_margins", margins).select(
        *df.columns,
        F.element_at(names, F.array_position("_margins", best).cast("int")).alias("model_intent"),
        (1.0 / mass if digits is None else F.round(1.0 / mass, digits)).alias("confidence"),
    )


def _class_sums(weight: Column, classes: int) -> list[Column]:
    """One sum per class, ``_c0`` and so on, of weight times coefficient."""
    return [F.sum(weight * F.col("coefficients")[c]).alias(f"_c{c}") for c in range(classes)]


def _margins(bias: list[float], length: Column) -> Column:
    """Array of the classes' margins, from ``_class_sums`` of a text or their absence."""
    return F.array(*[
        F.lit(b) + F.coalesce(F.col(f"_c{c}") / length, F.lit(0.0)) for c, b in enumerate(bias)
    ])


BIAS = "(bias)"  # the row of ``training_gradient`` that belongs to the intercepts


def training_gradient(
    train: DataFrame, model: IntentModel, text: str = "customer_text", label: str = "intent"
) -> DataFrame:
    """(term, label, gradient): slope of the training objective at the model's coefficients.

    The objective is what ``train_classifier`` minimises: the class-balanced mean
    log loss plus half the squared coefficients over the row count n.  For every
    (term, class): the sum over rows of row weight * (probability - truth) * term
    weight, over n, plus the coefficient over n; intercepts carry no penalty.
    Rows without text or label are left out; a label the model does not know is
    an error.
    """
    classes = range(len(model.labels))
    rows = _training_rows(train, text, label)
    balance = class_weights(rows.select("_label"), "_label").select("_label", "weight")
    unknown = balance.where(~F.col("_label").isin(model.labels)).select("_label").collect()
    if unknown:  # distinct labels, a handful
        raise ValueError(f"labels without coefficients: {sorted(r['_label'] for r in unknown)}")
    n = F.lit(float(max(rows.count(), 1)))
    lists = features.by_document(rows, "_row", "_words", SIZES)
    raw = features.raw_weights(lists, "_row", model.terms, sublinear=True)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("_row")))
    weights = raw.withColumn("x", F.col("raw") / length)
    sums = weights.groupBy("_row").agg(*_class_sums(F.col("x"), len(model.labels)))
    margins = rows.select("_row", "_label").join(sums, "_row", "left").withColumn(
        "_margins", _margins(model.bias, F.lit(1.0))
    )
    powers = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
    mass = F.aggregate("_powers", F.lit(0.0), lambda s, p: s + p)
    residuals = cut(
        margins.withColumn("_powers", powers).withColumn("_mass", mass)
        .join(F.broadcast(balance), "_label").select("_row", *[
            (F.col("weight") / n * (
                F.col("_powers")[c] / F.col("_mass")
                - F.when(F.col("_label") == model.labels[c], 1.0).otherwise(0.0)
            )).alias(f"_r{c}") for c in classes
        ]), "residuals",
    )
    slopes = weights.select("_row", "term", "x").join(residuals, "_row").groupBy("term").agg(
        *[F.sum(F.col("x") * F.col(f"_r{c}")).alias(f"_g{c}") for c in classes]
    )
    # A term of the model that no row has keeps its penalty.
    by_term = model.terms.join(slopes, "term", "left").select("term", *[
        (F.coalesce(f"_g{c}", F.lit(0.0)) + F.col("coefficients")[c] / n).alias(f"_g{c}")
        for c in classes
    ])
    bias = residuals.agg(*[F.coalesce(F.sum(f"_r{c}"), F.lit(0.0)).alias(f"_g{c}") for c in classes])
    every = by_term.unionByName(bias.withColumn("term", F.lit(BIAS)))
    return every.select("term", F.inline(F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(f"_g{c}").alias("gradient"))
        for c, name in enumerate(model.labels)
    ])))


# -- model folders ---------------------------------------------------------------

FORMAT = 1
_MANIFEST = (
    "format int, version int, labels array<string>, bias array<double>, sizes array<int>, "
    "n_terms long, checksum string"
)
_TERMS = "term string, idf double, coefficients array<double>"


def _term_figures(terms: DataFrame):
    """(n_terms, checksum): the count and an order-free sum over all terms."""
    row = F.xxhash64("term", "idf", "coefficients").cast("decimal(38,0)")
    return terms.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"),
    ).first()


def _manifests(spark: SparkSession, path: str) -> dict[int, object]:
    try:
        found = spark.read.schema(_MANIFEST).json(f"{path}/version=*/manifest").collect()
    except AnalysisException:  # no version yet
        return {}
    return {m["version"]: m for m in found}


def save_model(model: IntentModel, path: str) -> int:
    """Write the model as the next version below ``path``; returns its number.

    The terms go first and the manifest (labels in coefficient order, biases,
    n-gram sizes, count and checksum of the terms) last, so a version without a
    manifest is one whose writer did not finish.
    """
    spark = model.terms.sparkSession
    version = max(_manifests(spark, path), default=0) + 1
    terms = model.terms.select(
        "term", F.col("idf").cast("double"), F.col("coefficients").cast("array<double>")
    )
    folder = f"{path}/version={version}"
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    figures = _term_figures(spark.read.schema(_TERMS).parquet(f"{folder}/terms"))
    manifest = [(
        FORMAT, version, list(model.labels), [float(b) for b in model.bias], list(SIZES),
        figures["n_terms"], figures["checksum"],
    )]
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").json(
        f"{folder}/manifest"
    )
    return version


def load_model(
    path: str, spark: SparkSession | None = None, version: int | None = None
) -> IntentModel:
    """The latest finished version below ``path``, or the one asked for.

    Batch and stream load alike.  A version that is missing, unfinished, of
    another format, or whose terms are not those that were saved is refused.
    """
    spark = spark or SparkSession.getActiveSession()
    known = _manifests(spark, path)
    if version is None:
        version = max(known, default=None)
    if version not in known:
        raise ValueError(f"{path} has no finished model{'' if version is None else f' {version}'}")
    head = known[version]
    if head["format"] != FORMAT or tuple(head["sizes"]) != SIZES:
        raise ValueError(f"model {version} of {path} is of another format")
    terms = spark.read.schema(_TERMS).parquet(f"{path}/version={version}/terms")
    figures = _term_figures(terms)
    if (figures["n_terms"], figures["checksum"]) != (head["n_terms"], head["checksum"]):
        raise ValueError(f"model {version} of {path} has lost or changed terms")
    if len(head["bias"]) != len(head["labels"]):
        raise ValueError(f"model {version} of {path} has labels without a bias")
    return IntentModel(terms, list(head["bias"]), list(head["labels"]))


def evaluate_golden(golden: DataFrame, model: IntentModel, key: str = "example_id") -> DataFrame:
    """Prediction table of a golden set (``true_intent`` given) on the routed path."""
    routed = decide(score(golden, model))
    flagged = routed.withColumn(
        "expected_escalation",
        expected_escalation(F.col("true_intent"), F.col("customer_text")),
    )
    return predictions_table(flagged, key)


def topic_clusters(
    docs: DataFrame,
    key: str,
    text: str,
    sample: int | None = None,
    k: int = 10,
    max_features: int = 2000,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(clustered documents, (cluster, term, weight) of every centre)."""
    corpus = docs if sample is None else uniform_sample(docs, key, sample, seed)
    # Several passes follow; the texts are cleaned in one.
    words = corpus.select(key, text, cleaned_tokens(F.col(text)).alias("_all"))
    lists = cut(
        words.where(F.size("_all") > 0).select(
            key, text,
            F.array_join("_all", " ").alias("_clean"),
            drop_words(F.col("_all"), DISCOVERY_STOP_WORDS).alias("grams"),
        ),
        "topic-words",
    )
    chosen = features.with_idf(features.vocabulary(lists, 1, max_features), lists)
    vocab = cut(_numbered(chosen), "vocabulary")
    names = [r["term"] for r in vocab.orderBy("at").collect()]  # max_features terms
    ready = _vectors(
        features.by_document(lists, key, "grams", (1,)), key, vocab, len(names), sublinear=False,
        rest=lists.drop("grams"), sent=False,  # the order of sums, down to the last bit, sets the clusters
    )
    # The vectors are a written table; what the fit keeps of them in memory is its own.
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready)
    clustered = model.transform(ready).select(key, text, "_clean", "cluster")
    terms = [
        (i, names[j], float(w))
        for i, centre in enumerate(model.clusterCenters())
        for j, w in enumerate(centre)
        if w > 0
    ]
    centres = docs.sparkSession.createDataFrame(terms, "cluster int, term string, weight double")
    return clustered, centres


def cluster_centres(weights: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """(cluster, term, weight): the mean vector of each cluster's documents.

    ``weights``: (key, term, weight); ``assigned``: (key, cluster), a document
    without terms counts as a zero vector.
    """
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    sums = weights.join(assigned, key).groupBy("cluster", "term").agg(F.sum("weight").alias("_sum"))
    return sums.join(F.broadcast(sizes), "cluster").select(
        "cluster", "term", (F.col("_sum") / F.col("_size")).alias("weight")
    )


def assign_clusters(weights: DataFrame, keys: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(key, cluster) of every row of ``keys``: the nearest centre, the lowest of equals.

    |x - c|^2 = |x|^2 + |c|^2 - 2 x.c, and |x| is the same for all centres: terms
    are joined to a table with one number per centre, and k sums per document
    decide.  The k squared lengths are all that the driver sees.
    """
    lengths = {
        r["cluster"]: r["n"] for r in centres.groupBy("cluster").agg(
            F.sum(F.col("weight") * F.col("weight")).alias("n")
        ).collect()
    }
    ids = sorted(lengths)
    table = centres.groupBy("term").agg(*[
        F.sum(F.when(F.col("cluster") == c, F.col("weight")).otherwise(0.0)).alias(f"_w{i}")
        for i, c in enumerate(ids)
    ])
    # At most max_features terms with k numbers each.
    sums = weights.join(F.broadcast(table), "term").groupBy(key).agg(*[
        F.sum(F.col("weight") * F.col(f"_w{i}")).alias(f"_d{i}") for i in range(len(ids))
    ])
    far = F.array(*[
        F.lit(lengths[c]) - 2 * F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) for i, c in enumerate(ids)
    ])
    nearest = F.array_position("_far", F.array_min("_far")).cast("int")
    return keys.select(key).join(sums, key, "left").withColumn("_far", far).select(
        key, F.element_at(F.array(*[F.lit(c) for c in ids]), nearest).alias("cluster")
    )


def lloyd_steps(weights: DataFrame, assigned: DataFrame, key: str, steps: int = 1):
    """(assignment, its centres) after ``steps`` rounds of k-means on sparse rows."""
    centres = cut(cluster_centres(weights, assigned, key), "centres")
    for _ in range(steps):
        assigned = cut(assign_clusters(weights, assigned.select(key), centres, key), "assigned")
        centres = cut(cluster_centres(weights, assigned, key), "centres")
    return assigned, centres


def cluster_profile(
    clustered: DataFrame, centres: DataFrame, key: str, text: str, top: int = 5
) -> DataFrame:
    """(cluster, size, words, example): sizes, heaviest terms, one typical text.

    The example is the first text (by key) of 31..149 cleaned characters, or
    the first of any length.
    """
    fits = F.length("_clean").between(31, 149)
    sizes = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by(text, F.struct(~fits, F.col(key))).alias("example"),
    )
    # At most max_features terms per cluster.
    words = centres.groupBy("cluster").agg(
        F.slice(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))),
                lambda x: x["term"],
            ),
            1,
            top,
        ).alias("words")
    )
    return sizes.join(F.broadcast(words), "cluster", "left").select(
        "cluster", "size", F.array_join("words", ", ").alias("words"),
        flatten_lines(F.col("example"), 200).alias("example"),
    )

