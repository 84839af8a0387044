"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one over target texts
(labelled good), one over all raw texts.  A text's log weight is the sum of
log(target / raw) over its n-grams, so it measures how much likelier the target
model makes the text.  The target model leans on the raw one: each bucket has
PRIOR more occurrences than counted, observed and expected alike, so an n-gram
too rare for the target texts to have is no evidence, however long the text or
few the labels.  Target texts are in two folds; a labelled text is weighed by
the other fold's model, all others by the mean of both.  A sample of k raw texts without replacement, in
proportion to the weights, is the k largest sums of log weight and Gumbel noise
(drawn from the text's id, so a rerun draws the same).

N-grams are words and word pairs, and pairs and triples of word shapes (case,
symbols, length, repetition): shapes let unseen words count.  Both models have
``BUCKETS`` buckets whatever the corpus, which bounds what is sent around; the
k-th largest key is found by histograms of bounded size, never by one sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from replyforge.llm.words import (
    LOWER, NOT_BLANK, Chunk, chunks, find_words, mix, salt, text_hashes,
)
from replyforge.sources.stages import cut

BUCKETS = 1 << 16
PRIOR = 10.0
TEMPERATURE = 1.0
BINS = 4096

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True


def ngrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of the n-grams of each text; none for a text without words."""
    words = find_words(chunk, NOT_BLANK, LOWER)
    a, b = words.starts, words.ends
    n = len(a)

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[chunk.data])])
        return sums[b] - sums[a]

    size = b - a
    upper, digit, symbol = inside(_UPPER), inside(_DIGIT), inside(_SYMBOL)
    rows = words.rows()
    first = np.zeros(n, dtype=bool)
    first[words.bounds[:-1][words.counts() > 0]] = True
    same = np.zeros(n, dtype=np.int64)
    if n > 1:
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & ~first[1:]
    last = chunk.data[b - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    ending = np.where(_SYMBOL[last], last, 0)
    shape = (
        np.minimum(upper, 3) + 4 * np.minimum(symbol, 4) + 20 * np.minimum(digit, 2)
        + 60 * same + 120 * np.minimum(np.log2(size + 1).astype(np.int64), 6)
        + 1000 * ending + 1_000_000 * (size == symbol)
    ).astype(np.uint64)
    shape = mix(shape + salt(21))

    parts = [words.hashes, shape * salt(22)]
    owners = [rows, rows]
    for values, order, seed in ((words.hashes, 2, 23), (shape, 2, 24), (shape, 3, 25)):
        if n < order:
            continue
        gram = values[: n - order + 1] * salt(seed)
        for k in range(1, order):
            gram = mix(gram) + values[k: n - order + 1 + k]
        whole = rows[: n - order + 1] == rows[order - 1:]
        parts.append(gram[whole])
        owners.append(rows[: n - order + 1][whole])
    flat = mix(np.concatenate(parts) + salt(26)) & np.uint64(BUCKETS - 1)
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return flat[by].astype(np.int64), np.searchsorted(owner[by], np.arange(chunk.n + 1))


LABELLED_ROWS = 40_000  # labelled rows used at most: the target texts and the cut
# The cut is looked for on the scale sign(w) log(1 + |w|), in bins of this width.
CUT_RANGE, CUT_STEP = 20.0, 0.05


def labelled_sample(labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """(id, quality, fold): at most ``limit`` rows, the first in hash order of the id.

    Ids labelled more than once count as good only if always good; rows with a
    NULL id or label are left out.
    """
    clean = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("_label_id")
    ).agg(F.min("quality").cast("int").alias("_quality"))
    return clean.orderBy(F.xxhash64("_label_id"), "_label_id").limit(limit).withColumn(
        "_fold", F.pmod(F.xxhash64("_label_id", F.lit(1)), F.lit(2)).cast("int")
    )


def _with_labels(docs: DataFrame, sample: DataFrame, *more) -> DataFrame:
    """(doc_id, text, fold, quality, more): fold is -1 and quality NULL without a label."""
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more
    )
    named = sample.withColumnRenamed("_label_id", "doc_id")
    return given.join(F.broadcast(named), "doc_id", "left").select(  # LABELLED_ROWS rows
        "doc_id", "text", F.coalesce("_fold", F.lit(-1)).alias("fold"),
        F.col("_quality").alias("quality"), *given.columns[2:],
    )


def count_models(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """(2, BUCKETS): log(target / raw) of every bucket for either fold's target texts."""

    def count(batches):
        raw = np.zeros(BUCKETS, dtype=np.int64)
        target = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            fold = batch.column(2).to_numpy()
            good = pc.equal(batch.column(3), 1).fill_null(False).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                grams, bounds = ngrams(chunk)
                raw += np.bincount(grams, minlength=BUCKETS)
                of = slice(chunk.first, chunk.first + chunk.n)
                for f in (0, 1):
                    mine = np.repeat(good[of] & (fold[of] == f), np.diff(bounds))
                    target[f] += np.bincount(grams[mine], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(seen, pa.int64()), "raw": pa.array(raw[seen], pa.int64()),
            "t0": pa.array(target[0][seen], pa.int64()), "t1": pa.array(target[1][seen], pa.int64()),
        })

    parts = _with_labels(docs, sample).mapInArrow(count, "bucket long, raw long, t0 long, t1 long")
    sums = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "t0", "t1")])
    raw, target = np.zeros(BUCKETS), np.zeros((2, BUCKETS))
    for r in sums.collect():  # BUCKETS rows at most
        raw[r["bucket"]] = r["raw"]
        target[:, r["bucket"]] = r["t0"], r["t1"]
    return np.stack([log_ratio(target[f] if target[f].any() else target.sum(axis=0), raw) for f in (0, 1)])


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of every bucket, from occurrences; 0 where a model is empty."""
    if not target.any():
        return np.zeros(len(raw))  # nothing is known to be good: all texts weigh the same
    share = raw / raw.sum()
    leaning = (target + PRIOR) / (target.sum() * share + PRIOR)
    return np.log(leaning / (leaning * share).sum())


def log_weights(texts: pa.Array, fold: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Log weights: by the other fold's model, or by both where the fold is -1."""
    tables = {-1: ratios.mean(axis=0), 0: ratios[1], 1: ratios[0]}
    out = np.zeros(len(texts))
    for chunk in chunks(texts):
        grams, bounds = ngrams(chunk)
        own = fold[chunk.first:chunk.first + chunk.n]
        for f in np.unique(own).tolist():
            sums = np.concatenate([[0.0], np.cumsum(tables[f][grams])])
            weights = sums[bounds[1:]] - sums[bounds[:-1]]
            out[chunk.first:chunk.first + chunk.n][own == f] = weights[own == f]
    return out


def gumbel(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """Standard Gumbel noise, a function of id and seed."""
    drawn = mix(ids.astype(np.int64).view(np.uint64) * salt(31) + salt(32 + seed))
    uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(uniform))


def _keys(batch: pa.RecordBatch, ratios: np.ndarray, temperature: float):
    """(log weights, keys) of (doc_id, text, fold, ...)."""
    weights = log_weights(batch.column(1), batch.column(2).to_numpy(), ratios)
    known = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
    return weights, weights / temperature + gumbel(known)


def score(docs: DataFrame, sample: DataFrame, ratio, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, quality, log_weight, key) of every row; ``ratio`` is a broadcast."""

    def run(batches):
        for batch in batches:
            weights, keys = _keys(batch, ratio.value, temperature)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "quality": batch.column(3),
                "log_weight": weights, "key": keys,
            })

    return _with_labels(docs, sample).mapInArrow(
        run, "doc_id long, quality int, log_weight double, key double"
    )


def sample_size(scored: DataFrame) -> int:
    """How many raw texts are as likely as the good ones: the k of the sample.

    The cut on the log weight with the smallest sum of the shares of good texts
    lost and of bad ones kept in the labelled sample (the middle of the widest
    such gap), counted over all raw rows.  All rows, if either label is missing.
    """
    scaled = F.signum("log_weight") * F.log1p(F.abs("log_weight"))
    place = F.floor(F.least(F.greatest(scaled, F.lit(-CUT_RANGE)), F.lit(CUT_RANGE)) / CUT_STEP).cast("long")
    bins = scored.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("bad"),
    )
    rows = sorted(tuple(r) for r in bins.collect())  # 2 * CUT_RANGE / CUT_STEP rows at most
    all_good, all_bad = (sum(r[c] for r in rows) for c in (2, 3))
    if not all_good or not all_bad:
        return sum(n for _, n, _, _ in rows)
    low, high = int(-CUT_RANGE / CUT_STEP), int(CUT_RANGE / CUT_STEP) + 1
    by_bin = {b: (n, good, bad) for b, n, good, bad in rows}
    errors, now = [], all_bad * all_good
    for b in range(low, high + 1):  # keeping bins b and above
        errors.append(now)
        _, good, bad = by_bin.get(b, (0, 0, 0))
        now += good * all_bad - bad * all_good
    least = min(errors)
    runs, start = [], None
    for k, e in enumerate([*errors, -1]):
        if e == least and start is None:
            start = k
        elif e != least and start is not None:
            runs.append((k - start, start))
            start = None
    length, start = max(runs)
    first_kept = low + start + length // 2
    return sum(n for b, (n, _, _) in by_bin.items() if b >= first_kept)


def largest_keys(scored: DataFrame, k: int) -> float:
    """The k-th largest key; -inf if there are no more than k rows, +inf if k is 0."""
    low, high, n = scored.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if n <= k:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        inside = scored.where(F.col("key").between(low, high))
        width = (high - low) / BINS
        if width == 0.0 or low + width == low:
            return low
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("bin")
        bins = inside.groupBy(place).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        for _, n, bin_low, bin_high in sorted(map(tuple, bins.collect()), reverse=True):
            if above + n >= k:
                break
            above += n
        low, high = bin_low, bin_high
        if n <= BINS:
            keys = scored.where(F.col("key").between(low, high)).select("key").collect()
            return sorted((r["key"] for r in keys), reverse=True)[k - above - 1]


class Resampler:
    """Fitted importance resampling of one raw corpus."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None,
                 temperature: float = TEMPERATURE, labelled_rows: int = LABELLED_ROWS):
        self.sample = cut(labelled_sample(labels, labelled_rows), "labelled")
        self.temperature = temperature
        self.ratio = docs.sparkSession.sparkContext.broadcast(count_models(docs, self.sample))
        self.scored = cut(score(docs, self.sample, self.ratio, temperature), "log-weights")
        self.k = sample_size(self.scored) if k is None else k
        self.threshold = largest_keys(self.scored, self.k)

    def decisions(self) -> DataFrame:
        """(doc_id, log_weight, key, kept), one row per row of the corpus."""
        return self.scored.select(
            "doc_id", "log_weight", "key", (F.col("key") >= self.threshold).alias("kept")
        )

    def keep(self, docs: DataFrame) -> DataFrame:
        """The sampled rows of the corpus, all columns as they are."""
        ratio, temperature, threshold = self.ratio, self.temperature, self.threshold
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
        rows = _with_labels(docs, self.sample, whole)

        def run(batches):
            for batch in batches:
                _, keys = _keys(batch, ratio.value, temperature)
                yield batch.select(["_row"]).filter(pa.array(keys >= threshold))

        return rows.mapInArrow(run, rows.select("_row").schema).select("_row.*")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """Rows of ``docs`` drawn by Gumbel top-k in proportion to their importance.

    Without ``k`` the sample is as large as the part of the corpus that looks
    like the labelled good texts.  Rows that tie at the last place stay
    together.  NULL and empty texts have log weight 0; NULL ids share one
    noise; repeated rows share weight and noise.  Without labels, or with one
    kind of them only, every row stays.  Only doc_id and text of ``docs`` are read.
    """
    return Resampler(docs, labels, k).keep(docs)
