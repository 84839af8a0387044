"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

The matching SQL for the correctness check is in ``oracle``.  Queries read the
whole tables through the views; limits appear only where a top-k or a sample is
the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from replyforge.functions import packs
from replyforge.functions.numbers import parse_id
from replyforge.functions.text import (
    clean_message, cleaned_tokens, drop_words, flatten_lines, is_blank, strip,
)
from replyforge.operators import (
    cleaning, features, golden as golden_ops, judging, metrics, model as ml, profiling,
    routing, rules, sampling, threads,
)
from replyforge.operators.incremental import ProfileState
from replyforge.plans import jobs, views
from replyforge.schemas import RAW_MESSAGES
from replyforge.sources import readers, taxonomy as taxonomies, writers
from replyforge.sources.stages import cut, stage_path
from replyforge.streaming.route_stream import (
    message_stream, route_stream as run_stream, route_stream_model as run_model_stream,
)

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- threads ---------------------------------------------------------------


@query
def extract_brand(spark: SparkSession, sf: str) -> DataFrame:
    return threads.extract_brand(views.messages(spark, sf), views.BRAND).select(
        "tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id"
    )


@query
def pair_replies(spark, sf):
    return threads.pair_replies(views.messages(spark, sf))


@query
def conversation_roots(spark, sf):
    return threads.find_roots(views.messages(spark, sf), threads.MAX_DEPTH)


@query
def roots_with_copies(spark, sf):
    """Roots over a table with repeated messages, to any depth."""
    return threads.find_roots(views.dirty(spark, sf))


def _turns(spark, sf):
    extracted = jobs.extract(views.messages(spark, sf), views.BRAND)
    return jobs.reconstruct(extracted, views.BRAND)


@query
def turn_index(spark, sf):
    return _turns(spark, sf)


@query
def turn_histogram(spark, sf):
    return profiling.turn_histogram(_turns(spark, sf))


@query
def skip_accounting(spark, sf):
    return threads.skip_accounting(views.messages(spark, sf))


@query
def orphan_replies(spark, sf):
    return threads.orphan_replies(views.messages(spark, sf)).select(
        "tweet_id", "author_id", "in_response_to_tweet_id"
    )


@query
def root_depth_cap(spark, sf):
    return threads.find_roots(views.event_chain(spark, sf), threads.MAX_DEPTH)


@query
def root_cycles(spark, sf):
    return threads.find_roots(views.event_chain(spark, sf, cycles=True), threads.MAX_DEPTH)


# -- cleaning --------------------------------------------------------------


@query
def clean_pairs(spark, sf):
    return cleaning.clean_pairs(views.dirty_pairs(spark, sf))


@query
def clean_ledger(spark, sf):
    return cleaning.clean_ledger(views.dirty_pairs(spark, sf))


@query
def short_reply_topk(spark, sf):
    return cleaning.short_reply_topk(views.dirty_pairs(spark, sf))


@query
def dedup_pairs(spark, sf):
    return cleaning.deduplicated(views.dirty_pairs(spark, sf)).select(
        "customer_tweet_id", "support_tweet_id", "customer_text", "support_text"
    )


@query
def long_flag(spark, sf):
    flagged = cleaning.flag_long(views.dirty_pairs(spark, sf))
    return flagged.groupBy("is_long_response").agg(F.count(F.lit(1)).alias("n"))


@query
def blank_split(spark, sf):
    """Messages by what the scoring path would do with them."""
    text = F.col("text")
    fate = (
        F.when(text.isNull(), "null").when(is_blank(text), "blank").otherwise("scored")
    )
    return views.dirty(spark, sf).groupBy(fate.alias("fate")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(strip(text))).alias("stripped_chars")
    )


# -- profile ---------------------------------------------------------------


@query
def null_profile(spark, sf):
    return profiling.null_profile(views.messages_with_response(spark, sf)).drop("type")


@query
def missing_values(spark, sf):
    return profiling.missing_values(views.messages_with_response(spark, sf))


@query
def direction_counts(spark, sf):
    return profiling.direction_counts(views.messages(spark, sf))


@query
def duplicate_ids(spark, sf):
    return profiling.duplicate_ids(views.dirty(spark, sf))


@query
def author_counts(spark, sf):
    return profiling.author_counts(views.messages(spark, sf))


@query
def top_brands(spark, sf):
    return profiling.top_brands(views.messages(spark, sf))


@query
def brand_recommendation(spark, sf):
    return profiling.brand_recommendation(views.messages(spark, sf))


@query
def reply_fill_counts(spark, sf):
    return profiling.reply_fill_counts(views.messages_with_response(spark, sf))


@query
def quality_flags(spark, sf):
    return profiling.quality_flags(views.dirty(spark, sf).drop("copy", "conv_id", "turn", "role"))


@query
def extraction_ledger(spark, sf):
    pairs = views.dirty_pairs(spark, sf)
    return profiling.extraction_ledger(
        views.messages(spark, sf), pairs, cleaning.clean_pairs(pairs), views.BRAND
    )


def _clean(spark, sf):
    return cleaning.clean_pairs(views.dirty_pairs(spark, sf))


@query
def turn_stats(spark, sf):
    return profiling.turn_stats(_clean(spark, sf))


@query
def length_stats(spark, sf):
    return profiling.length_stats(_clean(spark, sf))


@query
def date_range(spark, sf):
    span = profiling.date_range(views.messages(spark, sf), "created_at")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return span.select(shown("earliest"), shown("latest"), "unparsed")


@query
def date_range_mixed(spark, sf):
    """The same times, written with offsets and weekdays here and there."""
    rows = views.messages(spark, sf)
    time = F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    mixed = (
        F.when(F.col("turn") % 3 == 1, F.date_format(time, "EEE MMM dd HH:mm:ss Z yyyy"))
        .when(F.col("turn") % 3 == 2, F.concat("created_at", F.lit("+00:00")))
        .otherwise(F.col("created_at"))
    )
    span = profiling.date_range(rows.withColumn("created_at", mixed), "created_at")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return span.select(shown("earliest"), shown("latest"), "unparsed")


@query
def conversation_stats(spark, sf):
    return profiling.conversation_stats(_clean(spark, sf))


@query
def dq_counts(spark, sf):
    return profiling.dq_counts(_clean(spark, sf), long_turns=3)


@query
def longest_conversations(spark, sf):
    return profiling.longest_conversations(_clean(spark, sf), at_least=2)


@query
def sample_conversations(spark, sf):
    return profiling.sample_conversations(_clean(spark, sf))


@query
def parse_ids(spark, sf):
    """Ids as a CSV would carry them: '12.0', '12' or junk."""
    parent, turn = F.col("in_response_to_tweet_id"), F.col("turn")
    raw = (
        F.when(turn % 3 == 0, F.concat(parent.cast("string"), F.lit(".0")))
        .when(turn % 3 == 1, parent.cast("string"))
        .otherwise("n/a")
    )
    return views.messages(spark, sf).select("tweet_id", parse_id(raw).alias("parent_id"))


@query
def csv_scan(spark, sf):
    """All messages through a CSV export and the typed, fault-tolerant CSV scan."""
    path = stage_path(spark, "messages-csv")
    writers.export_csv(views.messages_with_response(spark, sf), path)
    rows, _ = readers.read_messages(spark, path)
    return rows


@query
def schema_peek(spark, sf):
    """Column types that the message CSV suggests, from all its rows."""
    path = stage_path(spark, "messages-csv")
    writers.export_csv(views.messages_with_response(spark, sf), path)
    found = readers.peek_schema(spark, path)
    return profiling.schema_rows(spark.createDataFrame([], found))


@query
def csv_rejects(spark, sf):
    """The lines of a CSV of all messages that have too many fields, and why."""
    path = stage_path(spark, "messages-csv")
    rows = views.messages_with_response(spark, sf)
    odd = F.col("tweet_id") % 5 == 3
    writers.export_csv(rows.where(~odd), path)
    writers.append_csv(
        rows.where(odd).withColumn("surplus", F.lit('x, "y"\nz')).withColumn("more", F.lit(1)), path
    )
    _, rejects = readers.read_messages(spark, path)
    return rejects.select(
        F.substring_index("line", ",", 1).cast("long").alias("tweet_id"), "n_fields", "reason",
        F.col("file").isNotNull().alias("has_file"),
    )


@query
def missing_columns(spark, sf):
    """Expected columns that a CSV of all messages lacks."""
    path = stage_path(spark, "messages-csv")
    writers.export_csv(views.messages(spark, sf).drop("conv_id", "turn", "role"), path)
    return profiling.missing_columns(spark.read.options(**readers.CSV_OPTIONS).csv(path))


@query
def ordered_export(spark, sf):
    """All messages exported in the order of their ids, numbered as the files have them."""
    path = stage_path(spark, "ordered-csv")
    rows = views.messages_with_response(spark, sf)
    writers.export_csv(rows, path, order_by=("tweet_id",))
    numbered = readers.read_in_order(spark, path, RAW_MESSAGES)
    return numbered.select("row_no", parse_id(F.col("tweet_id")).alias("tweet_id"))


def _profiled(spark, sf) -> tuple[DataFrame, ProfileState]:
    """(dirty messages, their profile), gathered from three deliveries of files."""
    rows = views.dirty(spark, sf)
    columns = ["tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id"]
    state = ProfileState(spark, stage_path(spark, "profile"))
    for delivery in range(3):
        path = stage_path(spark, "delivery")
        # Copies of a message come with different deliveries.
        rows.where((F.col("conv_id") + F.col("copy")) % 3 == delivery).select(*columns).write.parquet(path)
        state.add(path)
    return rows.select(*columns), state


@query
def profile_incremental(spark, sf):
    """NULLs and repeated ids, merged from three deliveries profiled one by one."""
    _, state = _profiled(spark, sf)
    nulls = state.null_profile().select(
        "column", F.inline(F.array(
            F.struct(F.lit("n_rows").alias("measure"), F.col("n_rows").alias("value")),
            F.struct(F.lit("n_null").alias("measure"), F.col("n_null").alias("value")),
        ))
    )
    measures = ("unique_ids", "duplicated_ids", "extra_rows")
    ids = state.duplicate_ids().select(F.lit("tweet_id").alias("column"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures
    ])))
    return nulls.unionByName(ids)


@query
def distinct_estimates(spark, sf):
    """Exact distinct counts, and whether the merged sketches are within five percent."""
    rows, state = _profiled(spark, sf)
    exact = rows.agg(*[F.countDistinct(c).alias(c) for c in rows.columns]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in rows.columns
    ])))
    apart = F.abs(F.col("estimate") - F.col("exact")) * 20 <= F.col("exact")
    return exact.join(state.distinct_estimates(), "column").select(
        "column", "exact", apart.alias("within_5_pct")
    )


# -- text ------------------------------------------------------------------


@query
def clean_text(spark, sf):
    docs = views.documents(spark, sf)
    return docs.select("doc_id", clean_message(F.col("text")).alias("clean_text"))


@query
def display_text(spark, sf):
    text = F.col("text")
    return views.messages(spark, sf).select(
        "tweet_id",
        flatten_lines(text, 300, stripped=True).alias("report_line"),
        flatten_lines(text, 150).alias("console_line"),
    )


@query
def word_topk(spark, sf):
    return profiling.word_topk(views.documents(spark, sf), "text", "doc_id", sample=None)


@query
def bigram_topk(spark, sf):
    return features.ngram_topk(views.documents(spark, sf), "text", 2)


@query
def trigram_topk(spark, sf):
    return features.ngram_topk(views.documents(spark, sf), "text", 3)


@query
def doc_freq(spark, sf):
    docs = views.documents(spark, sf)
    lists = features.gram_lists(docs, "doc_id", features.training_words(F.col("text")), (1, 2))
    return features.vocabulary(lists, min_df=2, max_features=2000)


@query
def tfidf(spark, sf):
    weights = features.tfidf(
        views.documents(spark, sf), "doc_id", features.discovery_tokens(F.col("text")),
        max_features=2000,
    )
    return weights.withColumn("weight", F.round("weight", 6))


@query
def tfidf_sublinear(spark, sf):
    weights = features.tfidf(
        views.documents(spark, sf), "doc_id", features.training_words(F.col("text")), (1, 2),
        min_df=2, max_features=50_000, sublinear=True,
    )
    return weights.withColumn("weight", F.round("weight", 6))


# -- rules -----------------------------------------------------------------


@query
def weak_label(spark, sf):
    return views.weak_labels(spark, sf).select(
        "customer_tweet_id", "customer_text", "intent", "confidence", "labeling_method"
    )


@query
def auto_label(spark, sf):
    return views.golden(spark, sf).select(
        "customer_tweet_id", "intent", "difficulty", "labeling_notes"
    )


@query
def keyword_baseline(spark, sf):
    return views.spiked(spark, sf).select(
        "customer_tweet_id", rules.keyword_label(F.col("customer_text")).alias("intent")
    )


@query
def majority_baseline(spark, sf):
    return rules.majority_class(views.weak_labels(spark, sf))


@query
def expected_escalation(spark, sf):
    return views.predictions(spark, sf).select(
        "customer_tweet_id", "true_intent",
        F.col("expected_escalation").cast("long").alias("expected_escalation"),
    )


@query
def override_route(spark, sf):
    return views.routed(spark, sf).select(
        "customer_tweet_id", "model_intent", "intent", "override_reason"
    )


@query
def escalation_reason(spark, sf):
    return views.routed(spark, sf).select(
        "customer_tweet_id", "intent", "confidence", "needs_escalation", "escalation_reason"
    )


@query
def confidence_flags(spark, sf):
    flagged = routing.confidence_flags(views.routed(spark, sf))
    return flagged.groupBy("confidence_flag").agg(F.count(F.lit(1)).alias("n"))


# -- sampling --------------------------------------------------------------


@query
def uniform_sample(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return sampling.uniform_sample(docs, "doc_id", 100)


@query
def quota_sample(spark, sf):
    """Half of all events: the histogram path of exact sampling."""
    events = views.table(spark, sf, "events").select("event_id", "user_id", "value")
    half = events.agg(F.floor(F.count(F.lit(1)) / 2).alias("quota"))
    return sampling.take_quota(events, "event_id", half)


@query
def length_bins(spark, sf):
    docs = views.document_messages(spark, sf).select(
        "customer_tweet_id", F.length("customer_text").cast("long").alias("text_len")
    )
    return sampling.length_bins(docs, "text_len")


@query
def golden_sample(spark, sf):
    return golden_ops.golden_sample(views.document_messages(spark, sf))


@query
def golden_bin_counts(spark, sf):
    sample = golden_ops.golden_sample(views.document_messages(spark, sf))
    return sample.groupBy("len_bin").agg(F.count(F.lit(1)).alias("n"))


@query
def row_count_gate(spark, sf):
    return golden_ops.row_count_gate(golden_ops.golden_sample(views.document_messages(spark, sf)))


@query
def undersample(spark, sf):
    labels = _weak_table(spark, sf).select("customer_tweet_id", "intent")
    return sampling.undersample(labels, "customer_tweet_id", "intent", packs.OTHER)


@query
def train_val_split(spark, sf):
    labels = _weak_table(spark, sf).select("customer_tweet_id", "intent")
    return sampling.train_val_split(labels, "customer_tweet_id", "intent")


@query
def prepare_training(spark, sf):
    """Weak labels to a balanced, split training table without golden rows."""
    held_out = sampling.uniform_sample(
        views.spiked(spark, sf).select("customer_tweet_id"), "customer_tweet_id", 250
    )
    rows, _ = jobs.prepare_training(
        _weak_table(spark, sf), held_out, key="customer_tweet_id"
    )
    return rows.select("customer_tweet_id", "intent", "confidence", "split")


@query
def class_weights(spark, sf):
    weights = sampling.class_weights(views.weak_labels(spark, sf), "intent")
    return weights.withColumn("weight", F.round("weight", 6))


@query
def leakage_check(spark, sf):
    """Training rows that repeat one of the 250 golden rows, by id or text."""
    train = views.weak_labels(spark, sf).select("customer_tweet_id", "customer_text", "intent")
    gold = sampling.uniform_sample(
        views.spiked(spark, sf).select("customer_tweet_id", "customer_text"),
        "customer_tweet_id", 250,
    )
    return jobs.leakage(train, gold).select("customer_tweet_id", "intent")


def _weak_table(spark, sf):
    """Weak labels as the written table later jobs read.  A filter on a label
    column would otherwise be pushed below the rules and run them twice."""
    labels = views.weak_labels(spark, sf)
    return cut(labels.select("customer_tweet_id", "customer_text", "intent", "confidence"), "weak")


def _golden_table(spark, sf):
    return cut(views.golden(spark, sf).drop("conv_id", "turn"), "golden")


def _prediction_table(spark, sf):
    return cut(views.predictions(spark, sf), "predictions")


# -- golden set ------------------------------------------------------------


def _taxonomy(spark, sf):
    """The intents of all weak labels, through a taxonomy file."""
    path = stage_path(spark, "taxonomy")
    names = views.weak_labels(spark, sf).select(F.col("intent").alias("name")).distinct()
    taxonomies.write(spark, names, path)
    return taxonomies.read(spark, path)


@query
def taxonomy(spark, sf):
    return _taxonomy(spark, sf).select("position", "name")


@query
def validate_golden(spark, sf):
    return golden_ops.validate_golden(_golden_table(spark, sf), _taxonomy(spark, sf))


@query
def intent_distribution(spark, sf):
    return golden_ops.intent_distribution(_golden_table(spark, sf))


@query
def difficulty_distribution(spark, sf):
    return golden_ops.difficulty_distribution(_golden_table(spark, sf))


@query
def review_queue(spark, sf):
    flagged = views.review_flags(spark, sf).drop("human_decision", "final_intent")
    return golden_ops.review_queue(views.golden(spark, sf), flagged)


@query
def review_gate(spark, sf):
    return golden_ops.review_gate(views.review_flags(spark, sf))


@query
def apply_review(spark, sf):
    merged = golden_ops.apply_review(views.golden(spark, sf), views.review_flags(spark, sf))
    return merged.select("example_id", "intent", "difficulty", "labeling_notes", "corrected")


# -- metrics ---------------------------------------------------------------


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


@query
def accuracy(spark, sf):
    return _rounded(metrics.accuracy(views.predictions(spark, sf)), "accuracy")


@query
def class_report(spark, sf):
    report = metrics.class_report(views.predictions(spark, sf))
    return _rounded(report, "precision", "recall", "f1")


@query
def macro_weighted(spark, sf):
    averages = metrics.averages(metrics.class_report(views.predictions(spark, sf)))
    return _rounded(averages, "precision", "recall", "f1")


@query
def binary_escalation(spark, sf):
    scores = metrics.binary_metrics(views.predictions(spark, sf))
    return _rounded(scores, "accuracy", "precision", "recall", "f1")


@query
def quality_labels(spark, sf):
    """Binary metrics of the documents' toxic flag against their quality flag."""
    labels = views.table(spark, sf, "labels")
    return _rounded(
        metrics.binary_metrics(labels, "quality", "toxic"),
        "accuracy", "precision", "recall", "f1",
    )


@query
def escalation_totals(spark, sf):
    totals = metrics.escalation_totals(views.predictions(spark, sf))
    return totals.withColumn("expected_escalation", F.col("expected_escalation").cast("long"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(views.predictions(spark, sf))


@query
def confusion_wide(spark, sf):
    return metrics.wide_confusion_matrix(views.predictions(spark, sf))


@query
def confusion_pairs(spark, sf):
    return metrics.confusion_pairs(_prediction_table(spark, sf))


@query
def error_marginals(spark, sf):
    return metrics.error_marginals(_prediction_table(spark, sf))


@query
def failure_rows(spark, sf):
    return metrics.failure_rows(_prediction_table(spark, sf))


@query
def error_samples(spark, sf):
    return metrics.error_samples(_prediction_table(spark, sf))


@query
def accuracy_gaps(spark, sf):
    """Accuracy where predictions and truths are missing: a gap is never right."""
    return _rounded(metrics.accuracy(views.patchy_predictions(spark, sf)), "accuracy")


@query
def binary_gaps(spark, sf):
    """Escalation scores where predictions are missing: a gap is not positive."""
    scores = metrics.binary_metrics(views.patchy_predictions(spark, sf))
    return _rounded(scores, "accuracy", "precision", "recall", "f1")


def _patchy_table(spark, sf):
    return cut(views.patchy_predictions(spark, sf), "predictions")


@query
def confusion_pairs_gaps(spark, sf):
    return metrics.confusion_pairs(_patchy_table(spark, sf))


@query
def error_marginals_gaps(spark, sf):
    return metrics.error_marginals(_patchy_table(spark, sf))


@query
def failure_rows_gaps(spark, sf):
    return metrics.failure_rows(_patchy_table(spark, sf))


@query
def report_table(spark, sf):
    return metrics.report_table(metrics.class_report(views.predictions(spark, sf)))


@query
def model_comparison(spark, sf):
    table = jobs.baselines(views.weak_labels(spark, sf), _prediction_table(spark, sf))
    return _rounded(table, "accuracy", "macro_f1", "weighted_f1")


@query
def metrics_json(spark, sf):
    """Metrics written as a JSON report and three figures read back from it."""
    path = stage_path(spark, "metrics-json")
    writers.write_metrics(metrics.metrics_record(views.predictions(spark, sf)), path)
    return readers.read_metrics(spark, path)


# -- routing and judging -----------------------------------------------------


@query
def route_batch(spark, sf):
    usable, _ = routing.split_blank(views.spiked(spark, sf))
    routed = routing.respond(views.with_model_stand_in(usable), keep=("example_id",))
    return routed.select("example_id", F.to_json("response").alias("response"))


@query
def route_stream(spark, sf):
    """The routing job over the same messages as a stream; equals ``route_batch``."""
    source = views.table(spark, sf, "conversations")
    stream = message_stream(spark, sf, source.schema, "conversations.parquet")
    out = stage_path(spark, "routed")
    run_stream(
        views.spike(stream), views.with_model_stand_in, out,
        stage_path(spark, "rejects"), stage_path(spark, "stream-state"),
        keep=("example_id",),
    ).awaitTermination()
    return spark.read.parquet(out).select("example_id", F.to_json("response").alias("response"))


@query
def reply_template(spark, sf):
    replied = routing.with_dimension(views.routed(spark, sf))
    return replied.select(
        "customer_tweet_id", "intent", "label", "priority", "department", "action", "evidence",
        "reply", F.lit(packs.REPLY_MODE).alias("reply_mode"),
    )


@query
def prompt_text(spark, sf):
    replied = routing.with_dimension(views.routed(spark, sf))
    return replied.select(
        "customer_tweet_id",
        routing.reply_prompt(F.col("customer_text"), F.col("evidence")).alias("prompt"),
    )


@query
def judge_prompt(spark, sf):
    replied = routing.with_dimension(views.predictions(spark, sf), "predicted_intent")
    return replied.select(
        "customer_tweet_id",
        judging.judge_prompt(
            F.col("customer_text"), F.col("predicted_intent"), F.col("true_intent"),
            F.col("evidence"), F.col("reply"),
        ).alias("prompt"),
    )


@query
def judge_scores(spark, sf):
    return judging.judge_sample(views.predictions(spark, sf))


@query
def judge_summary(spark, sf):
    return judging.judge_summary(judging.judge_sample(views.predictions(spark, sf)))


@query
def human_template(spark, sf):
    return judging.human_template(judging.judge_sample(views.predictions(spark, sf)))


def _judged_replies(spark, sf):
    """Every message judged with its own text as the reply."""
    preds = views.predictions(spark, sf)
    reply = views.dirty(spark, sf).where("copy = 0").select(
        F.col("tweet_id").alias("customer_tweet_id"),
        F.coalesce("text", F.lit("")).alias("reply"),
    )
    return judging.judge_scores(
        preds.join(reply, "customer_tweet_id"), "reply", "predicted_intent", "true_intent"
    )


@query
def judge_all(spark, sf):
    return _judged_replies(spark, sf).select("example_id", *judging.SCORES)


@query
def ratings_pending(spark, sf):
    return judging.ratings_pending(views.human_ratings(spark, sf))


@query
def rater_agreement(spark, sf):
    return judging.rater_agreement(_judged_replies(spark, sf), views.human_ratings(spark, sf))


@query
def judge_reply_parse(spark, sf):
    """Scores parsed from JSON answers; every third answer lacks most scores."""
    conv, turn = F.col("conv_id"), F.col("turn")
    whole = F.to_json(
        F.struct(
            F.struct(
                (conv % 5 + 1).alias("intent_correctness"),
                (turn % 5 + 1).alias("relevance"),
                F.lit(4).alias("grounding"),
                F.lit(3).alias("helpfulness"),
                F.lit(5).alias("safety"),
                ((conv + turn) % 5 + 1).alias("overall_quality"),
            ).alias("scores"),
            F.col("text").alias("reason"),
        )
    )
    partial = F.to_json(F.struct(F.struct(F.lit(5).alias("safety")).alias("scores")))
    answer = F.when(conv % 3 == 0, partial).otherwise(whole)
    parsed = views.messages(spark, sf).select(
        "tweet_id", judging.parse_judge_reply(answer).alias("s")
    )
    return parsed.select(
        "tweet_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in judging.SCORES],
        "s.judge_reason",
    )


# -- models (no SQL twin) ------------------------------------------------------


def _trained(spark, sf, held_out=None):
    rows, _ = jobs.prepare_training(_weak_table(spark, sf), held_out, key="customer_tweet_id")
    rows = cut(rows.select("customer_text", "intent", "split"), "split")
    return jobs.train(rows.where("split = 'train'").drop("split"))


GIVEN_LABELS = ["delivery_issue", "other_unknown", "refund_return"]
GIVEN_BIAS = [0.1, 0.4, -0.2]
# (term, idf, coefficient of each label)
GIVEN_TERMS = [
    ("refund", 2.0, [-1.0, -0.5, 3.0]), ("package", 1.7, [2.5, -0.5, 0.2]),
    ("my", 1.1, [0.3, 0.1, 0.4]), ("delivery", 1.9, [2.0, -1.0, -0.3]),
    ("my refund", 2.4, [-0.5, -0.2, 1.5]), ("thank you", 2.2, [-1.0, 2.0, -1.0]),
    ("late delivery", 2.6, [1.8, -0.7, -0.4]), ("is", 1.2, [0.2, 0.3, 0.0]),
]


@query
def score_given_model(spark, sf):
    """Every message scored by a model with given coefficients."""
    terms = spark.createDataFrame(GIVEN_TERMS, "term string, idf double, coefficients array<double>")
    model = ml.IntentModel(terms, GIVEN_BIAS, GIVEN_LABELS)
    return ml.score(views.spiked(spark, sf), model).select(
        "customer_tweet_id", "model_intent", F.round("confidence", 6).alias("confidence")
    )


@query
def route_model(spark, sf):
    """All messages routed by a saved and loaded model."""
    routed, _ = jobs.route(
        views.spiked(spark, sf), _saved_model(spark, sf), keep=("example_id",), digits=4
    )
    return routed.select("example_id", F.to_json("response").alias("response"))


def _saved_model(spark, sf):
    """The given model through its folder: saved, then loaded."""
    path = stage_path(spark, "model")
    ml.save_model(views.given_model(spark, sf), path)
    return ml.load_model(path, spark)


@query
def route_stream_model(spark, sf):
    """The same routing with the same model over a stream of the messages."""
    path = stage_path(spark, "model")
    ml.save_model(views.given_model(spark, sf), path)
    source = views.table(spark, sf, "conversations")
    stream = message_stream(spark, sf, source.schema, "conversations.parquet")
    out = stage_path(spark, "routed")
    run_model_stream(
        views.spike(stream), path, out, stage_path(spark, "rejects"),
        stage_path(spark, "stream-state"), keep=("example_id",), digits=4,
    ).awaitTermination()
    return spark.read.parquet(out).select("example_id", F.to_json("response").alias("response"))


@query
def model_round_trip(spark, sf):
    """Every message scored by the model that was saved and loaded again."""
    return ml.score(views.spiked(spark, sf), _saved_model(spark, sf)).select(
        "customer_tweet_id", "model_intent", F.round("confidence", 6).alias("confidence")
    )


@query
def training_gradient(spark, sf):
    """Slope of the training objective on all weak labels, at given coefficients."""
    train = views.weak_labels(spark, sf).select("customer_text", "intent")
    slopes = ml.training_gradient(train, views.given_model(spark, sf))
    return slopes.withColumn("gradient", F.round("gradient", 9))


@query
def training_optimum(spark, sf):
    """The classifier trained on all weak labels: its size, and whether the slope of the
    objective has vanished at its coefficients."""
    train = cut(views.weak_labels(spark, sf).select("customer_text", "intent"), "weak")
    model = ml.train_classifier(train)
    size = train.dropna().agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("intent").alias("n_labels")
    )
    steepest = ml.training_gradient(train, model).agg(F.max(F.abs("gradient"))).scalar()
    return size.withColumn("n_terms", model.terms.agg(F.count(F.lit(1))).scalar()).withColumn(
        "at_optimum", steepest < 1e-3
    )


@query
def golden_evaluation_given(spark, sf):
    """Class report of the given model, routed, on the 250 held-out messages."""
    held_out = sampling.uniform_sample(views.golden(spark, sf), "customer_tweet_id", 250)
    preds = ml.evaluate_golden(
        held_out.withColumnRenamed("intent", "true_intent"), views.given_model(spark, sf)
    )
    return _rounded(metrics.class_report(preds), "precision", "recall", "f1")


def _assigned_once(spark, sf):
    """(weights, clusters by one round from given ones, their centres) of all documents."""
    # Cleaned once, for the weights and for which documents have any words.
    cleaned = cut(
        views.documents(spark, sf).select("doc_id", cleaned_tokens(F.col("text")).alias("words")),
        "cleaned-words",
    )
    kept = drop_words(F.col("words"), packs.DISCOVERY_STOP_WORDS)
    weights = cut(features.tfidf(cleaned, "doc_id", kept, max_features=2000), "topic-weights")
    start = cleaned.where(F.size("words") > 0).select(
        "doc_id", (F.col("doc_id") % 10).cast("int").alias("cluster")
    )
    return ml.lloyd_steps(weights, cut(start, "start"), "doc_id")


@query
def cluster_assign_given(spark, sf):
    """One k-means round over all documents from given clusters."""
    return _assigned_once(spark, sf)[0]


@query
def cluster_profile_given(spark, sf):
    """Sizes, heaviest terms and an example of the clusters after that round."""
    assigned, centres = _assigned_once(spark, sf)
    clean = clean_message(F.col("text")).alias("_clean")
    texts = views.documents(spark, sf).select("doc_id", "text", clean)
    rounded = centres.withColumn("weight", F.round("weight", 9))  # ties go by term
    return ml.cluster_profile(texts.join(assigned, "doc_id"), rounded, "doc_id", "text")


@query
def train_score(spark, sf):
    """Classifier trained on the weak labels, every message scored and routed."""
    model = _trained(spark, sf)
    scored = ml.score(views.spiked(spark, sf), model)
    return routing.decide(scored).select(
        "example_id", "model_intent", "intent", F.round("confidence", 4).alias("confidence"),
        "needs_escalation", "escalation_reason",
    )


@query
def golden_evaluation(spark, sf):
    """Class report of the trained, routed model on 250 messages kept out of training."""
    held_out = cut(
        sampling.uniform_sample(views.golden(spark, sf), "customer_tweet_id", 250), "held-out"
    )
    model = _trained(spark, sf, held_out)
    preds = ml.evaluate_golden(held_out.withColumnRenamed("intent", "true_intent"), model)
    return _rounded(metrics.class_report(preds), "precision", "recall", "f1")


@query
def topic_clusters(spark, sf):
    docs = views.documents(spark, sf)
    clustered, _ = ml.topic_clusters(docs, "doc_id", "text")
    return clustered.select("doc_id", "cluster")


@query
def cluster_profile(spark, sf):
    docs = views.documents(spark, sf)
    clustered, centres = ml.topic_clusters(docs, "doc_id", "text")
    return ml.cluster_profile(clustered, centres, "doc_id", "text")
