"""n-grams, vocabularies and TF-IDF in relational form.

One document is one row.  Word lists are what is written and moved; n-grams
exist only where they are counted.  Document and corpus frequencies come from
one aggregation by term, combined inside each task before the shuffle; weights
need one exchange by document, which the counts and the norm share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from replyforge.functions import packs
from replyforge.functions.text import cleaned_tokens, drop_words, ngrams, word_tokens
from replyforge.operators.ranking import nth_text, top_n
from replyforge.sources.readers import tasks_for
from replyforge.sources.stages import cut

# Most terms of a vocabulary that is sent whole to every task: a few MB.
SENT_TERMS = 100_000
# Most bytes of a word table, as written, whose terms one task holds.
LIST_BYTES = 4 << 20


def discovery_tokens(text: Column, stop_words=packs.DISCOVERY_STOP_WORDS) -> Column:
    """Cleaned words without stop words, in order."""
    return drop_words(cleaned_tokens(text), stop_words)


def training_words(text: Column) -> Column:
    """Words of the raw text; the classifier uses them singly and in pairs."""
    return word_tokens(text)


def ngram_topk(df: DataFrame, text: str, n: int, k: int = 20, stop_words=packs.DISCOVERY_STOP_WORDS):
    """Most frequent n-grams after stop-word removal (they may span removed words)."""
    counts = (
        df.select(discovery_tokens(F.col(text), stop_words).alias("words"))
        .select(ngrams(F.col("words"), n).alias("grams"))
        .select(*_places("grams", "ngram")).where("at is not null")
        .groupBy("ngram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_n(counts, [F.desc("n"), "ngram"], k)


def _places(grams: str, term: str = "term") -> list:
    """``at`` and ``term`` of every gram; a list without any gives a row without ``at``.

    Outer, because an inner explode makes Spark filter by the list before it,
    which works the words and grams of every text out a second time.
    """
    return [F.posexplode_outer(grams).alias("at", term)]


def gram_lists(df: DataFrame, key: str, words: Column, sizes=(1,)) -> DataFrame:
    """(key, grams): the n-grams of the given sizes, one row per document.

    The word list is projected first, so that it is computed once per row.
    """
    grams = [ngrams(F.col("_words"), n) for n in sizes]
    return df.select(key, words.alias("_words")).select(
        key, (F.concat(*grams) if len(grams) > 1 else grams[0]).alias("grams")
    )


def by_document(held: DataFrame, key: str, words: str, sizes=(1,)) -> DataFrame:
    """``gram_lists`` after the one exchange by document, which moves words only.

    ``held`` is a stage table; where its size asks for more tasks than a shuffle
    has, it gets them, since each holds the terms of its documents.
    """
    tasks = tasks_for(held, LIST_BYTES)
    usual = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select(key, words)
    dealt = dealt.repartition(tasks, key) if tasks > usual else dealt.repartition(key)
    return gram_lists(dealt, key, F.col(words), sizes)


def term_counts(lists: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, term, tf), of the terms of ``known`` if given (sent to all tasks); no
    further exchange if ``lists`` come from ``by_document``."""
    terms = lists.select(key, *_places("grams")).where("at is not null").select(key, "term")
    if known is not None:
        terms = terms.join(F.broadcast(known.select("term")), "term", "left_semi")
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(
    lists: DataFrame, min_df: int = 1, max_features: int | None = None
) -> DataFrame:
    """(term, df, cf): terms in at least ``min_df`` documents, the
    ``max_features`` most frequent ones if a limit is given (ties by term).

    Nothing is sorted as a whole: histograms find the count and, among the terms
    with that count, the last term that makes the limit; the rest is a filter.
    """
    # Sorted, so that a document's first row of a term is known by the one before.
    rows = lists.select(F.sort_array("grams").alias("grams")).select(
        "grams", *_places("grams")
    ).where("at is not null")
    before = F.when(F.col("at") > 0, F.get("grams", F.col("at") - 1))
    first = (F.col("at") == 0) | ~before.eqNullSafe(F.col("term"))
    terms = (
        rows.groupBy("term")
        .agg(F.count_if(first).alias("df"), F.count(F.lit(1)).alias("cf"))
        .where(F.col("df") >= min_df)
    )
    if max_features is None:
        return terms
    terms = cut(terms, "terms")
    power = F.floor(F.log2("cf"))
    found = _where_reached(terms, power, max_features)
    if found is None:
        return terms
    # Distinct counts of one power: at most the root of all occurrences.
    edge = terms.where(power == found["value"])
    found = _where_reached(edge, F.col("cf"), found["wanted"])
    last = nth_text(terms.where(F.col("cf") == found["value"]), "term", found["wanted"])
    more = F.col("cf") > found["value"]
    return terms.where(more | ((F.col("cf") == found["value"]) & (F.col("term") <= last)))


def _where_reached(df: DataFrame, value: Column, n: int):
    """(value, wanted): the value, going down, at which ``n`` rows are reached, and
    how many of its rows are wanted; None where there are fewer rows."""
    downward = Window.orderBy(F.desc("value")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(downward))
        .where(F.col("upto") >= n)
        .agg(F.max_by(F.struct("value", (n - F.col("upto") + F.col("n")).alias("wanted")), "value").alias("f"))
        .first()["f"]
    )


def tfidf(
    docs: DataFrame,
    key: str,
    words: Column,
    sizes=(1,),
    min_df: int = 1,
    max_features: int | None = None,
    sublinear: bool = False,
) -> DataFrame:
    """(key, term, weight) with smoothed idf and unit-length document vectors.

    idf = ln((1 + documents) / (1 + df)) + 1; tf is the count, or 1 + ln(count).
    A vocabulary of up to ``SENT_TERMS`` is sent to all tasks; beyond, or without
    a limit, the join is a shuffle join in which AQE splits very common terms.
    """
    # Texts are tokenised once: vocabulary and weights both read these words.
    held = cut(docs.select(key, words.alias("words")), "words")
    chosen = vocabulary(gram_lists(held, key, F.col("words"), sizes), min_df, max_features)
    vocab = cut(with_idf(chosen, held), "vocabulary")
    lists = by_document(held, key, "words", sizes)
    sent = max_features is not None and max_features <= SENT_TERMS
    raw = raw_weights(lists, key, vocab, sublinear, sent).select(key, "term", "raw")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


def with_idf(vocab: DataFrame, lists: DataFrame) -> DataFrame:
    """(term, idf): ln((1 + documents) / (1 + df)) + 1."""
    n_docs = lists.agg(F.count(F.lit(1))).scalar()
    return vocab.select("term", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def raw_weights(
    lists: DataFrame, key: str, terms: DataFrame, sublinear: bool, sent: bool = True
) -> DataFrame:
    """(key, raw, columns of ``terms``): tf times idf before the unit length.

    With ``sent`` every task gets all ``terms`` and drops the others before it
    counts, so nothing is moved by term; without, it is a shuffle join.
    """
    tf = F.log(F.col("tf").cast("double")) + 1 if sublinear else F.col("tf").cast("double")
    if sent:
        counts, terms = term_counts(lists, key, terms), F.broadcast(terms)
    else:
        counts = term_counts(lists, key)
    return counts.join(terms, "term").withColumn("raw", tf * F.col("idf"))
