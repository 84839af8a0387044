"""Toxicity: a linear-chain CRF tags toxic words; its marginals score documents.

1. Words and word beginnings are counted in labelled documents: in how many,
   and in how many toxic ones.  What occurs mostly in toxic ones is the lexicon.
2. Words of toxic documents that the lexicon names are labelled toxic, all
   words of clean documents are labelled clean; the CRF is fitted to these
   labelled words.  A document's own counts are taken out before its words are
   looked up, so that it cannot vouch for itself.  The documents whose words are
   used are drawn by label, so rare toxic ones are all in; weights give both
   labels back the shares they have among the labelled documents.
3. Forward-backward marginals of every word give the document's features, a
   logistic curve over them the score, and runs of words above one half the
   offending offsets.

Only text is an input.  Fitting uses a bounded, documented sample of labelled
rows; scoring streams whole texts and never shuffles them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from replyforge.llm.crf import Chain, fit
from replyforge.llm.words import Chunk, Words, chunks, find_words, mix, salt, span_hash
from replyforge.sources.stages import cut

LABELLED_ROWS = 30_000  # labelled documents used at most
CHAIN_ROWS = 1_500  # of these, documents whose words the CRF and the score are fitted to
LEXICON = 100_000  # entries kept at most, the most toxic first
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes of a word's beginning that are looked up
PRIOR_ROWS = 3.0
LEAST_ROWS = 3  # toxic documents that a lexicon entry occurs in
LEVELS = np.array([0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85])
THRESHOLD = 0.3

_N = len(LEVELS) + 1
N_FEATURES = 1 + 4 * _N


def word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(keys, word numbers): each whole word, and its beginnings if it is longer."""
    every = np.arange(len(words.hashes))
    keys, owners = [mix(words.hashes ^ salt(51))], [every]
    size = words.ends - words.starts
    for n in BEGINNINGS:
        long = every[size > n]
        start = words.starts[long]
        keys.append(mix(span_hash(words.prefix_sums, start, start + n) ^ salt(52 + n)))
        owners.append(long)
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class Lexicon:
    keys: np.ndarray  # sorted
    documents: np.ndarray
    toxic: np.ndarray
    base: float  # share of toxic documents

    def levels(self, words: Words, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(level of the word itself, of its most toxic beginning); 0: not in the lexicon.

        ``own`` holds each word's document label where the document was counted.
        """
        n = len(words.hashes)
        out = [np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
        if not n or not len(self.keys):
            return out[0], out[1]
        keys, owner = word_keys(words)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        at, owner = at[hit], owner[hit]
        documents = self.documents[at].astype(np.float64)
        toxic = self.toxic[at].astype(np.float64)
        if own is not None:
            documents -= 1
            toxic -= own[owner]
        share = (toxic + PRIOR_ROWS * self.base) / (documents + PRIOR_ROWS)
        level = np.searchsorted(LEVELS, share, "right")
        whole = hit < n
        np.maximum.at(out[0], owner[whole], level[whole])
        np.maximum.at(out[1], owner[~whole], level[~whole])
        return out[0], out[1]


def observations(words: Words, level: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first-word flags): bias, own levels, levels of both neighbours."""
    n = len(level)
    first = np.zeros(n, dtype=bool)
    first[words.bounds[:-1][words.counts() > 0]] = True
    either = np.maximum(level, begin)
    before = np.zeros(n, dtype=np.int64)
    after = np.zeros(n, dtype=np.int64)
    if n > 1:
        before[1:] = np.where(first[1:], 0, either[:-1])
        after[:-1] = np.where(first[1:], 0, either[1:])
    return np.stack([
        np.zeros(n, np.int64), 1 + level, 1 + _N + begin, 1 + 2 * _N + before, 1 + 3 * _N + after
    ], axis=1), first


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: log odds that any word is toxic, expected toxic words, their share."""
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    total = np.concatenate([[0.0], np.cumsum(p)])
    silent = none[bounds[1:]] - none[bounds[:-1]]
    expected = total[bounds[1:]] - total[bounds[:-1]]
    some = np.clip(-np.expm1(silent), 1e-6, 1 - 1e-6)
    count = np.maximum(np.diff(bounds), 1)
    return np.stack([
        np.ones(len(silent)), np.log(some / (1 - some)), np.log1p(expected),
        10 * expected / count,
    ], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 40,
              ridge: float = 0.1) -> np.ndarray:
    """Newton steps for a ridge logistic curve over weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (y - p)) - ridge * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w


@dataclass
class Tagger:
    lexicon: Lexicon
    chain: Chain
    curve: np.ndarray

    def tag(self, chunk: Chunk) -> tuple[Words, np.ndarray, np.ndarray]:
        """(words, P(toxic) per word, score per document)."""
        words = find_words(chunk)
        observed, first = observations(words, *self.lexicon.levels(words))
        p = self.chain.marginals(observed, first)
        x = document_features(p, words.bounds) @ self.curve
        return words, p, 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, toxic) to learn from, at most ``limit``, in hash order of the id.

    NULL ids or labels are left out; an id labelled twice is toxic if once so.
    """
    clean = labels.where("doc_id is not null and toxic is not null").where(
        ~held_out(F.col("doc_id"))
    )
    return clean.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(
        F.max("toxic").cast("int").alias("_toxic")
    ).orderBy(F.xxhash64("_label_id"), "_label_id").limit(limit)


def _labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return given.join(
        F.broadcast(sample), given["doc_id"] == sample["_label_id"]  # LABELLED_ROWS rows
    ).select("doc_id", "text", "_toxic")


def build_lexicon(texts: DataFrame) -> Lexicon:
    """From (doc_id, text, toxic): keys that toxic documents hold more often than others."""

    def count(batches):
        for batch in batches:
            toxic = batch.column(2).to_numpy()
            for chunk in chunks(batch.column(1)):
                words = find_words(chunk)
                keys, owner = word_keys(words)
                row = words.rows()[owner]
                # Once per document and key.
                order = np.lexsort((row, keys))
                keys, row = keys[order], row[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                keys, label = keys[new], toxic[chunk.first + row[new]]
                found, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(found.view(np.int64)),
                    "documents": pa.array(np.bincount(at, minlength=len(found))),
                    "toxic": pa.array(
                        np.bincount(at, weights=label, minlength=len(found)).astype(np.int64)),
                })

    totals = texts.agg(F.count("*"), F.sum("_toxic")).first()
    base = (totals[1] or 0) / max(totals[0], 1)
    counted = texts.mapInArrow(count, "key long, documents long, toxic long").groupBy("key").agg(
        F.sum("documents").alias("documents"), F.sum("toxic").alias("toxic")
    )
    share = (F.col("toxic") + PRIOR_ROWS * base) / (F.col("documents") + PRIOR_ROWS)
    best = counted.where((F.col("toxic") >= LEAST_ROWS) & (share >= LEVELS[0])).orderBy(
        share.desc(), F.desc("documents"), "key"
    ).limit(LEXICON).collect()  # LEXICON rows at most
    keys = np.array([r["key"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(
        keys[order], np.array([r["documents"] for r in best], dtype=np.int64)[order],
        np.array([r["toxic"] for r in best], dtype=np.int64)[order], base,
    )


def _fill_unseen(chain: Chain, observed: np.ndarray) -> None:
    """Levels that no fitted word has weigh what the level below does.

    Own counts are taken out for fitting only, so words of few documents reach
    higher levels when they are scored.
    """
    seen = np.bincount(observed.ravel(), minlength=N_FEATURES) > 0
    for at in range(1, N_FEATURES):
        if (at - 1) % _N and not seen[at]:
            chain.weights[at] = chain.weights[at - 1]


def drawn_by_label(toxic: int, clean: int, limit: int) -> tuple[int, int, float, float]:
    """How many toxic and clean documents of so many are drawn, and what each one weighs.

    Toxic ones take up to half of ``limit``, and what clean ones leave.  Weights
    undo the draw; a document of the label drawn more fully weighs 1.
    """
    some = min(toxic, max(limit // 2, limit - clean))
    others = min(clean, limit - some)
    stands = [n / k if k else np.inf for n, k in ((toxic, some), (clean, others))]
    least = min(stands)
    return some, others, *(w / least if np.isfinite(w) else 1.0 for w in stands)


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS,
          chain_rows: int = CHAIN_ROWS) -> Tagger:
    """A tagger; with no labelled toxic document it scores everything near 0."""
    sample = cut(training_rows(labels, labelled_rows), "toxic-labels")
    texts = cut(_labelled_texts(docs, sample), "labelled-texts")
    lexicon = build_lexicon(texts)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def encode(batches):
        for batch in batches:
            toxic = batch.column(2).to_numpy()
            for chunk in chunks(batch.column(1)):
                words = find_words(chunk)
                own = toxic[chunk.first:chunk.first + chunk.n]
                level, begin = shared.value.levels(words, own[words.rows()])
                both = (level * _N + begin).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array(own, pa.int32()),
                    "levels": [both[a:b].tobytes()
                               for a, b in zip(words.bounds[:-1], words.bounds[1:])],
                })

    # Ids are chosen first, of those with a text: only chosen texts move.
    known = texts.select(F.col("doc_id").alias("_label_id"), "_toxic").distinct()
    have = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean, *weighs = drawn_by_label(have.get(1, 0), have.get(0, 0), chain_rows)
    by_hash = lambda label: known.where(F.col("_toxic") == label).select("_label_id").orderBy(
        F.xxhash64("_label_id", F.lit(1)), "_label_id"
    )
    some = by_hash(1).limit(n_toxic).unionByName(by_hash(0).limit(n_clean))
    chosen = texts.join(F.broadcast(some), texts["doc_id"] == some["_label_id"]).select(
        "doc_id", "text", "_toxic"
    )
    rows = chosen.mapInArrow(encode, "toxic int, levels binary").collect()  # chain_rows texts
    rows.sort(key=lambda r: (r["toxic"], bytes(r["levels"])))  # the same sums in any run
    toxic = np.array([r["toxic"] for r in rows], dtype=np.int64)
    sizes = np.array([len(r["levels"]) for r in rows], dtype=np.int64)
    both = np.frombuffer(b"".join(bytes(r["levels"]) for r in rows), np.uint8).astype(np.int64)
    level, begin = both // _N, both % _N
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = Words(np.zeros(0), np.zeros(0), np.zeros(len(both)), bounds, np.zeros(0))
    observed, first = observations(words, level, begin)
    named = np.maximum(level, begin) >= np.searchsorted(LEVELS, 0.5)
    word_labels = (named & (np.repeat(toxic, sizes) == 1)).astype(np.int64)
    weights = np.where(toxic == 1, *weighs)
    chain = fit(observed, first, word_labels, N_FEATURES, weights=np.repeat(weights, sizes))
    _fill_unseen(chain, observed)
    p = chain.marginals(observed, first)
    if lexicon.base > 0:  # of all labelled documents
        curve = _logistic(document_features(p, bounds), toxic, weights)
    else:
        curve = np.array([-4.0, 0.0, 0.0, 0.0])  # nothing is known to be toxic
    return Tagger(lexicon, chain, curve)


_SCORES = ("doc_id long, score double, "
           "spans array<struct<start:long,stop:long,probability:double>>")


def score_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, score, spans), one row per row of ``docs``.

    ``spans`` are runs of toxic words as [start, stop) in code points of the
    text, with the highest marginal in each.  NULL and empty texts have no
    words and get the score of a text without toxic words.  Other columns are
    not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                words, p, scores = model.value.tag(chunk)
                spans: list[list[dict]] = [[] for _ in range(chunk.n)]
                hot = np.flatnonzero(p > 0.5)
                if len(hot):
                    # Code points before each byte: all bytes but continuations count.
                    points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                    row = np.searchsorted(words.bounds, hot, "right") - 1
                    base = points[chunk.bounds[row]]
                    starts = points[words.starts[hot]] - base
                    stops = points[words.ends[hot]] - base
                    for k, (w, r) in enumerate(zip(hot.tolist(), row.tolist())):
                        mine = spans[r]
                        if mine and k and hot[k - 1] == w - 1:
                            mine[-1]["stop"] = int(stops[k])
                            mine[-1]["probability"] = max(mine[-1]["probability"], float(p[w]))
                        else:
                            mine.append({"start": int(starts[k]), "stop": int(stops[k]),
                                         "probability": float(p[w])})
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.n), pa.array(scores),
                    pa.array(spans, pa.list_(pa.struct([
                        ("start", pa.int64()), ("stop", pa.int64()),
                        ("probability", pa.float64())]))),
                ], names=["doc_id", "score", "spans"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, _SCORES)
