"""Quality, toxicity, near-dedup, fingerprints, decontamination: brute force and odd input."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import rows

from llm.prose import prose
from replyforge.llm import decontaminate, fingerprints, near_dedup, quality, toxicity
from replyforge.llm.crf import Chain
from replyforge.llm.words import chunks, find_words, shingles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter([text])


# -- words -------------------------------------------------------------------


def test_words_and_shingles_of_a_chunk():
    texts = ["One two, THREE", "", "éa-b", " - ", "a b c d e f g", "one two three"]
    (chunk,) = chunks(pa.array(texts))
    found = find_words(chunk)
    raw = chunk.data.tobytes()
    cut = [raw[a:b].decode().lower() for a, b in zip(found.starts, found.ends)]
    assert cut == [w for t in texts for w in words_of(t)]
    by_word = {}
    for w, h in zip(cut, found.hashes):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    hashes, bounds = shingles(chunk, found)
    assert list(np.diff(bounds)) == [1, 1, 1, 1, 3, 1]
    assert hashes[bounds[0]] == hashes[bounds[5]]
    assert len(set(hashes)) == len(hashes) - 1


# -- near-dedup --------------------------------------------------------------


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(5)
    left, right = [], []
    for _ in range(250):
        x = [f"w{i}" for i in rng.integers(0, 5, 60)] + [f"u{i}" for i in range(30)]
        y = list(x)
        for _ in range(int(rng.integers(0, 12))):
            y[rng.integers(0, len(y))] = f"z{rng.integers(0, 99)}"
        left.append(" ".join(x))
        right.append(" ".join(y))

    def sign(texts):
        (chunk,) = chunks(pa.array(texts))
        return near_dedup.bag_minhash(*near_dedup.multisets(chunk), chunk.n)

    same = (sign(left) == sign(right)).mean(axis=1)
    true = np.array([
        sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
        for a, b in zip(left, right)
    ])
    noise = np.sqrt((true * (1 - true) / near_dedup.SIZE).mean())
    assert abs((same - true).mean()) < 3 * noise / np.sqrt(250)
    assert np.sqrt(((same - true) ** 2).mean()) < 1.3 * noise


def brute_classes(docs):
    parent = {i: i for i, _ in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [(i, bag(t or "")) for i, t in docs]
    for (i, a), (j, b) in itertools.combinations(bags, 2):
        if 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
            a_top, b_top = sorted((top(i), top(j)))
            parent[b_top] = a_top
    return sorted((i, top(i)) for i, _ in docs)


def test_near_classes_like_brute_force(llm):
    rng = np.random.default_rng(1)
    docs = []
    for k in range(18):
        base = prose(k, 40 + 11 * k).split()
        for c in range(int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                copy[rng.integers(0, len(copy))] = f"edit{rng.integers(0, 9)}"
            docs.append((100 * k + c, " ".join(copy)))
    docs += [(5000, "one two"), (5001, "ONE, two"), (5002, "!!"), (5003, "??"), (5004, "!!"),
             (5005, "again " * 400), (5006, "again " * 450), (5007, "again " * 900)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_duplicates(df)
    assert rows(got, "doc_id", "class_id") == sorted(brute_classes(docs), key=repr)
    kept = near_dedup.keep_one(df)
    assert rows(kept, "doc_id") == sorted({(c,) for _, c in brute_classes(docs)}, key=repr)


def test_families_across_components(llm, monkeypatch):
    """Members of large buckets that are not like the leader, in several groups."""
    monkeypatch.setattr(near_dedup, "GROUP", 7)
    rng = np.random.default_rng(8)
    base = prose(77, 120).split()
    docs = []
    for k in range(70):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            copy[at] = f"edit{rng.integers(0, 4)}"
        docs.append((k, " ".join(copy)))
    df = llm.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_duplicates(df)
    assert rows(got, "doc_id", "class_id") == sorted(brute_classes(docs), key=repr)


def test_texts_without_an_id_and_with_a_repeated_id(llm):
    """Ids neither bring different texts together nor pass links on."""
    a, b, c, d, e, f = (prose(200 + k, 60) for k in range(6))
    near = lambda text: text + " more"
    docs = [(None, a), (None, b), (None, c), (None, c), (None, near(c)), (1, near(a)), (2, near(b)),
            (7, d), (7, e), (7, e), (8, near(d)), (9, near(e)), (None, f), (-(1 << 63), "smallest")]
    df = llm.createDataFrame(
        [(i, t, n, {"k": n}) for n, (i, t) in enumerate(docs)],
        "doc_id long, text string, n int, m map<string,int>",
    )
    got = near_dedup.near_duplicates(df)
    low = -(1 << 63)
    assert rows(got) == sorted([
        (None, 1, None), (1, 1, 1), (None, 2, None), (2, 2, 2),
        *[(None, None, None)] * 4,  # c three times, f
        (7, 7, 7), (8, 7, 8), (7, 7, 7), (7, 7, 7), (9, 7, 9), (low, low, low),
    ], key=repr)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    of_c = found.pop((None, c), 0) + found.pop((None, near(c)), 0)
    assert of_c == 1
    assert found == Counter(
        [(1, near(a)), (2, near(b)), (7, d), (7, e), (None, f), (low, "smallest")])
    dealt = near_dedup.keep_one(df.orderBy("n", ascending=False).repartition(3))
    assert rows(dealt, "doc_id", "n") == rows(kept, "doc_id", "n")


def test_components_of_chains_and_stars(llm):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 200)]
    df = llm.createDataFrame(links, "a long, b long")
    got = dict(rows(near_dedup.components(df)))
    assert {got.get(k, k) for k in [*range(41), 200]} == {0}
    assert {got.get(k, k) for k in range(100, 130)} == {100}
    assert near_dedup.components(df.where("false")).count() == 0


def test_near_odd(llm, odd, none):
    got = near_dedup.near_duplicates(odd)
    assert got.count() == odd.count()
    found = dict(rows(got, "doc_id", "class_id"))
    assert found[1] == 1 and found[2] == 1 and found[3] == 3 and found[5] == 5
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert rows(kept, "doc_id") == sorted([(None,), (1,), (3,), (4,), (5,), (6,), (7,)], key=repr)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0


# -- fingerprints ------------------------------------------------------------


def test_fingerprints_follow_jaccard(llm, odd, none):
    docs = [(k, prose(k % 25, 30 + 17 * (k % 30))) for k in range(60)] + [(60, None), (61, "a b")]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_next(df, n_ranges=5).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        tail = len(text) // 4
        edited = text[: len(text) - tail] + after[:tail]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = set(bag(text)), set(bag(other))
            assert abs(value - len(a & b) / len(a | b)) < 0.16
    strange = fingerprints.fingerprint_next(odd, n_ranges=3)
    assert strange.count() == odd.count()
    assert fingerprints.fingerprint_texts(odd).count() == odd.count()
    assert fingerprints.fingerprint_next(none).count() == 0
    one = fingerprints.fingerprint_next(df.where("doc_id = 3")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("n_ranges", [1, 4, 40, None])
def test_successors_where_a_third_has_no_id(llm, n_ranges, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 3000)
    docs = [(None if k % 3 == 0 else k // 2, prose(k % 31, 5 + k % 23)) for k in range(150)]
    docs += [(None, "the same text")] * 9 + [(-5, "negative"), (None, None), (9, "")]
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(5)
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    want = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        tail = len(text) // 4
        edited = text[: len(text) - tail] + following[:tail]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.fingerprint_next(df, n_ranges)
    assert rows(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)


def test_fingerprint_packing():
    values = fingerprints.low_bits(pa.array([prose(3, 50), "a"]))
    assert (fingerprints.unpacked(fingerprints.packed(values)[0]) == values[0]).all()


# -- decontamination ---------------------------------------------------------


def brute_windows(docs, items, size=10):
    out = []
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(0, len(w) - size + 1) if len(w) >= size else min(1, len(w))):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(item))
    for i, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for length in {len(k) for k in windows}:
            for k in range(len(w) - length + 1):
                if names := windows.get(tuple(w[k:k + length])):
                    hit |= set(range(k, k + length))
                    ids |= names
        out.append((i, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out)


def brute_longest(text, items, size=10):
    """Words of the longest run that text and an item share, if it holds a window."""
    w, best = words_of(text), 0
    for _, item in items:
        v = words_of(item)
        for a in range(len(w)):
            for b in range(len(v)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                if n >= min(size, len(v)):
                    best = max(best, n)
    return best


def test_windows_like_brute_force(llm):
    items = [(1, prose(1, 30)), (2, prose(2, 10)), (3, "Short item"), (4, None), (10, prose(1, 14)),
             (11, "again " * 15)]
    docs = [
        (0, prose(50, 200)), (1, "x " + prose(1, 30) + " y"), (2, prose(1, 12).upper()),
        (3, prose(2, 9)), (4, "a short, ITEM! of words"), (5, "short"), (6, None), (7, ""),
        (8, " ".join(prose(1, 30).split()[5:25]) + " z " + prose(2, 10)), (9, "again " * 60),
        (10, prose(2, 9) + "\n" + prose(2, 10).split()[-1]),
    ]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    bench = llm.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 60):  # one block, several blocks
        found = decontaminate.find_matches(df, bench, block_bytes=block_bytes)
        got = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n"), "items")
        assert sorted((a, b, c, tuple(d)) for a, b, c, d in got.collect()) == brute_windows(docs, items)
    for block_bytes in (1 << 20, 60):
        found = decontaminate.find_matches(df, bench, block_bytes=block_bytes)
        longest = dict(rows(found, "doc_id", "longest"))
        assert longest == {i: brute_longest(t, items) for i, t in docs}
    assert longest[1] == 30 and longest[2] == 12 and longest[9] == 15 and longest[0] == 0
    clean = decontaminate.remove_contaminated(df, bench)
    assert rows(clean, "doc_id") == sorted(
        [(i,) for i, _, n, _ in brute_windows(docs, items) if not n], key=repr
    )


def test_windows_odd(llm, odd, none):
    bench = llm.createDataFrame([(None, "the same row twice"), (2, None)], "item_id long, text string")
    got = decontaminate.find_matches(odd, bench)
    assert got.count() == odd.count()
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.remove_contaminated(odd, bench.where("false")).count() == odd.count()
    assert decontaminate.remove_contaminated(none, bench).count() == 0


# -- quality -----------------------------------------------------------------


def test_kth_largest_key(llm):
    rng = np.random.default_rng(2)
    keys = np.concatenate([rng.normal(size=9000) ** 3, np.full(50, 1.5)])
    df = llm.createDataFrame([(float(k),) for k in keys], "key double")
    for k in (1, 40, 3000, 9049):
        assert quality.largest_keys(df, k) == np.sort(keys)[-k]
    assert quality.largest_keys(df, 10_000) == float("-inf")
    assert quality.largest_keys(df, 0) == float("inf")


def test_gumbel_sampling_follows_the_weights():
    hits = sum(
        int(np.argmax(np.log([1.0, 2.0, 7.0]) + quality.gumbel(np.arange(3), seed)) == 2)
        for seed in range(3000)
    )
    assert abs(hits / 3000 - 0.7) < 0.03


def junk(k):
    return " ".join(w + "$$$" for w in prose(k, 30 + k % 9).split())


def test_quality_keeps_good_texts(llm, odd, none):
    docs = [(k, prose(k, 60 + k % 50) if k % 5 else junk(k)) for k in range(400)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    labels = llm.createDataFrame(
        [(k, int(k % 5 > 0)) for k in range(0, 400, 3)] + [(None, 1), (2, None)],
        "doc_id long, quality int",
    )
    kept = {r.doc_id for r in quality.resample(df, labels).collect()}
    assert kept == {k for k in range(400) if k % 5}
    assert quality.resample(df, labels, k=17).count() == 17
    assert quality.resample(df, labels.where("false")).count() == 400
    strange = quality.resample(odd, labels)
    assert strange.columns == odd.columns
    assert quality.resample(none, labels).count() == 0


def brute_decisions(docs, labels, prior=10.0):
    """Log weight of each id, models and all worked out by hand."""
    grams = {}
    for k, text in docs:
        (chunk,) = chunks(pa.array([text], pa.string())) if text else (None,)
        grams[k] = quality.ngrams(chunk)[0].tolist() if chunk else []
    fold = labels  # id -> (fold, quality)
    raw = Counter(g for gs in grams.values() for g in gs)
    total = sum(raw.values())
    target = [Counter(g for k, gs in grams.items() if fold.get(k) == (f, 1) for g in gs) for f in (0, 1)]

    def table(t):
        size = sum(t.values())
        lean = {b: (t[b] + prior) / (size * n / total + prior) for b, n in raw.items()}
        mass = sum(lean[b] * n / total for b, n in raw.items())
        return {b: math.log(x / mass) for b, x in lean.items()}

    tables = [table(t) for t in target]
    weights = {}
    for k, gs in grams.items():
        sums = [sum(t[g] for g in gs) for t in tables]
        weights[k] = sums[1 - fold[k][0]] if k in fold else sum(sums) / 2
    return weights


def test_models_and_sample_like_brute_force(llm):
    docs = [(k, prose(k, 20 + k % 30) if k % 5 else junk(k)) for k in range(120)]
    docs += [(200, None), (201, ""), (202, docs[6][1])]
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = llm.createDataFrame([(k, int(k % 5 > 0)) for k in range(0, 120, 2)], "doc_id long, quality int")
    fitted = quality.Resampler(df, labels)
    folds = {r["_label_id"]: (r["_fold"], r["_quality"]) for r in fitted.sample.collect()}
    assert {f for f, _ in folds.values()} == {0, 1}
    got = {r.doc_id: r for r in fitted.decisions().collect()}
    want = brute_decisions(docs, folds)
    assert {k: r.log_weight for k, r in got.items()} == pytest.approx(want, abs=1e-9)
    # The size: every cut of the scale is tried on the labelled texts.
    step = {k: math.floor(min(max(math.copysign(math.log1p(abs(w)), w), -20), 20) / 0.05)
            for k, w in want.items()}
    good = [step[k] for k, (_, q) in folds.items() if q == 1]
    bad = [step[k] for k, (_, q) in folds.items() if q == 0]
    errors = {c: sum(g < c for g in good) / len(good) + sum(b >= c for b in bad) / len(bad)
              for c in range(-400, 403)}
    sizes = {sum(s >= c for s in step.values()) for c, e in errors.items() if e == min(errors.values())}
    assert fitted.k in sizes
    noise = quality.gumbel(np.array(list(want)))
    keys = {k: want[k] + g for k, g in zip(want, noise)}
    assert {k for k, r in got.items() if r.kept} == set(sorted(keys, key=lambda k: -keys[k])[:fitted.k])
    assert {r.doc_id for r in fitted.keep(df).collect()} == {k for k, r in got.items() if r.kept}


def test_rows_that_tie_at_the_last_place_stay_together(llm):
    docs = [(5, "good words here")] * 3 + [(5, None), (6, None)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    labels = llm.createDataFrame([(5, 1)], "doc_id long, quality int")
    for k in (1, 2, 3, 4):
        fitted = quality.Resampler(df, labels, k=k)
        kept = rows(fitted.keep(df), "doc_id", "text")
        assert kept.count((5, "good words here")) in (0, 3)  # one key: all or none
        assert len(kept) >= k and fitted.decisions().where("kept").count() == len(kept)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_good_documents_stay_and_bad_ones_go(llm, sf):
    read = lambda t: llm.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    kept = {r.doc_id for r in quality.resample(read("documents"), read("labels")).collect()}
    good, bad = ([i for i, q in labels.items() if q == v] for v in (1, 0))
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.2 * len(bad)


# -- toxicity ----------------------------------------------------------------


def test_marginals_like_enumeration():
    rng = np.random.default_rng(4)
    chain = Chain(rng.normal(size=6), rng.normal(size=(2, 2)))
    observed = rng.integers(0, 6, (7, 2))
    first = np.array([1, 0, 0, 0, 1, 0, 0], dtype=bool)
    unary = chain.weights[observed].sum(axis=1)
    mass, hot = 0.0, np.zeros(7)
    for states in itertools.product((0, 1), repeat=7):
        s = sum(unary[i] for i in range(7) if states[i])
        s += sum(chain.transitions[states[i - 1], states[i]] for i in range(7) if not first[i])
        mass += np.exp(s)
        hot += np.exp(s) * np.array(states)
    assert np.allclose(chain.marginals(observed, first), hot / mass)


def test_long_chain_equals_short_ones():
    rng = np.random.default_rng(6)
    chain = Chain(rng.normal(size=5), rng.normal(size=(2, 2)))
    observed = rng.integers(0, 5, (900, 3))
    first = rng.random(900) < 0.02
    first[0] = True
    whole = chain.marginals(observed, first)
    edges = [*np.flatnonzero(first), 900]
    parts = [chain.marginals(observed[a:b], first[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    assert np.allclose(whole, np.concatenate(parts))


def toxic_corpus(llm):
    docs, labels = [], []
    for k in range(600):
        text = prose(k, 30 + k % 60)
        if k % 6 == 0:
            words = text.split()
            words[k % 20 + 2] = ("Blorg", "snarf", "zugzug%d" % k)[k // 6 % 3]
            text = " ".join(words)
        docs.append((k, text))
        labels.append((k, int(k % 6 == 0)))
    return (llm.createDataFrame(docs, "doc_id long, text string"),
            llm.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxic_words_are_found(llm, odd, none):
    docs, labels = toxic_corpus(llm)
    tagger = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, tagger)
    found = {r.doc_id: r for r in got.collect()}
    wrong = [k for k in range(600) if (found[k].score >= 0.3) != (k % 6 == 0)]
    assert len(wrong) <= 6
    texts = dict(docs.collect())
    spans = [texts[k][s.start:s.stop] for k in range(600) for s in found[k].spans]
    assert sum(bool(re.fullmatch("Blorg|snarf|zugzug[0-9]+", s)) for s in spans) >= 0.75 * len(spans) > 60
    # Held-out labels are never looked at.
    flipped = labels.select("doc_id", toxicity.F.when(
        toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")
    ).otherwise(toxicity.F.col("toxic")).alias("toxic"))
    again = toxicity.score_documents(docs, toxicity.train(docs, flipped))
    assert rows(again, "doc_id", "score") == rows(got, "doc_id", "score")
    strange = toxicity.score_documents(odd, tagger)
    assert strange.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in strange.collect())
    assert toxicity.score_documents(none, tagger).count() == 0


def brute_scores(docs, learnt, tagger):
    """{doc_id: score}: lexicon, levels, forward-backward and curve, word by word."""
    def entries(word):
        return [("word", word)] + [("begins", word[:n]) for n in toxicity.BEGINNINGS if len(word) > n]

    held, toxic = Counter(), Counter()
    for text, label in learnt:
        for e in {e for w in words_of(text) for e in entries(w)}:
            held[e] += 1
            toxic[e] += label
    base = sum(label for _, label in learnt) / len(learnt)
    prior = toxicity.PRIOR_ROWS
    share = {e: (toxic[e] + prior * base) / (held[e] + prior) for e in held if toxic[e] >= 3}

    def level(e):
        of = share.get(e, 0.0)
        return sum(of >= x for x in toxicity.LEVELS) if of >= toxicity.LEVELS[0] else 0

    n, (weights, moves) = len(toxicity.LEVELS) + 1, (tagger.chain.weights, tagger.chain.transitions)
    out = {}
    for i, text in docs:
        words = words_of(text)
        own = [level(("word", w)) for w in words]
        begin = [max([level(e) for e in entries(w)[1:]], default=0) for w in words]
        either = [0, *map(max, own, begin), 0]
        emit = [math.exp(min(max(
            weights[0] + weights[1 + a] + weights[1 + n + b] + weights[1 + 2 * n + either[k]]
            + weights[1 + 3 * n + either[k + 2]], -30), 30)) for k, (a, b) in enumerate(zip(own, begin))]
        forward, backward = [], [(0.5, 0.5)] if words else []
        for k, e in enumerate(emit):
            if k:
                f0, f1 = forward[-1]
                now = [f0 * math.exp(moves[0][s]) + f1 * math.exp(moves[1][s]) for s in (0, 1)]
            else:
                now = [1.0, 1.0]
            now = (now[0], now[1] * e)
            forward.append((now[0] / sum(now), now[1] / sum(now)))
        for e in reversed(emit[1:]):
            b0, b1 = backward[-1]
            now = [math.exp(moves[s][0]) * b0 + math.exp(moves[s][1]) * e * b1 for s in (0, 1)]
            backward.append((now[0] / sum(now), now[1] / sum(now)))
        p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, reversed(backward))]
        silent = math.prod(1 - min(x, 1 - 1e-9) for x in p)
        some = min(max(1 - silent, 1e-6), 1 - 1e-6)
        features = [1.0, math.log(some / (1 - some)), math.log1p(sum(p)), 10 * sum(p) / max(len(p), 1)]
        x = sum(f * c for f, c in zip(features, tagger.curve))
        out[i] = 1 / (1 + math.exp(-min(max(x, -30), 30)))
    return out


def test_scores_like_brute_force(llm):
    docs, labels = toxic_corpus(llm)
    tagger = toxicity.train(docs, labels)
    learnt_ids = {r["_label_id"]: r["_toxic"] for r in toxicity.training_rows(labels).collect()}
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert set(learnt_ids) == {k for k, _ in plain if zlib.crc32(str(k).encode()) % 4 != 2}
    plain += [(900, None), (901, ""), (902, "snarf"), (903, "blorg snarf zugzug1"), (904, "blorg snarf zugzug1")]
    learnt = [(t, learnt_ids[k]) for k, t in plain if k in learnt_ids]
    df = llm.createDataFrame(plain, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, tagger).collect()}
    assert got == pytest.approx(brute_scores(plain, learnt, tagger), abs=1e-9)
    assert got[903] == got[904] > 0.9 and got[900] == got[901] < 0.3


def test_rare_toxic_labels_are_drawn_first(llm):
    """A small chain sample, in which chance alone would leave no toxic document."""
    every = llm.range(900).selectExpr("id as doc_id", "0 as toxic")
    by_chance = {r._label_id for r in toxicity.training_rows(every).orderBy(
        toxicity.F.xxhash64("_label_id", toxicity.F.lit(1)), "_label_id").limit(30).collect()}
    toxic = [k for k in range(900) if k not in by_chance][7::60]
    docs = [(k, prose(k, 40) + (" snarf" if k in toxic else "")) for k in range(900)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    labels = llm.createDataFrame([(k, int(k in toxic)) for k in range(900)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, toxicity.train(df, labels, chain_rows=30))
    assert {r.doc_id for r in got.collect() if r.score >= toxicity.THRESHOLD} == set(toxic)


def test_draw_by_label():
    for toxic, clean in ((60, 29_940), (9000, 21_000), (27_000, 3000), (29_900, 100), (40, 50)):
        some, others, w, v = toxicity.drawn_by_label(toxic, clean, 1500)
        assert some + others == min(1500, toxic + clean)
        assert some == min(toxic, max(750, 1500 - clean))
        assert np.isclose(w * some / (v * others), toxic / clean) and min(w, v) == 1
    assert toxicity.drawn_by_label(0, 10, 1500) == (0, 10, 1.0, 1.0)
    assert toxicity.drawn_by_label(10, 0, 1500) == (10, 0, 1.0, 1.0)
    assert toxicity.drawn_by_label(0, 0, 1500) == (0, 0, 1.0, 1.0)


def test_toxicity_without_labels(llm, odd):
    labels = llm.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    scores = toxicity.score_documents(odd, toxicity.train(odd, labels))
    assert all(r.score < 0.5 for r in scores.collect())
