"""Similarity join, filter audit, whitening: brute force, exact laws and odd input."""

from itertools import permutations
import re

import numpy as np
import pytest
from llm.helpers import rows
from llm.prose import prose

from replyforge.llm import filter_audit, group_join, whitening
from replyforge.llm.bidiagonal import bidiagonalise, dqds, leading

# -- grouped prefix join -------------------------------------------------------


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute_components(docs):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 80 * len(sets[x] | sets[y]):
                old, new = label[x], label[y]
                label = [new if z == old else z for z in label]
    held = {}
    for (i, _), z in zip(docs, label):
        held.setdefault(z, []).append(i)

    def smallest(ids):
        return min((i for i in ids if i is not None), default=None)

    return sorted(
        ((i, len(s), smallest(held[z])) for (i, _), s, z in zip(docs, sets, label)), key=repr
    )


def edited(text, seed, changes):
    words = text.split()
    for k in range(changes):
        words[(seed * 31 + k * 17) % len(words)] = f"new{seed}x{k}"
    return " ".join(words)


def family_docs():
    docs, i = [], 0
    for family in range(12):
        base = prose(family, 40 + 25 * family)
        for member in range(6):
            docs.append((i, edited(base, member, member % 4 * (1 + family // 4))))
            i += 1
    passage = prose(99, 60)
    docs += [(i + k, f"{prose(200 + k, 20 + 4 * k)} {passage} {prose(300 + k, k)}") for k in range(40)]
    i += 40
    # Chains: each is near the next one, the ends are far apart.
    words = prose(7, 120).split()
    for k in range(12):
        docs.append((i + k, " ".join([f"x{k}y{n}" if n < 3 * k else w for n, w in enumerate(words)])))
    i += 12
    docs += [(i, "one two three"), (i + 1, "ONE\ttwo  three"), (i + 2, "one two"), (i + 3, ""),
             (i + 4, None), (i + 5, " \n"), (i + 6, "one two three four five"),
             (i + 7, "Ünï one. two, three-four"), (i + 8, "ünï one. two, three-four")]
    return docs


@pytest.mark.parametrize("frequent, group", [(16, 1024), (2, 4)])
def test_components_like_brute_force(llm, monkeypatch, frequent, group):
    monkeypatch.setattr(group_join, "FREQUENT", frequent)
    monkeypatch.setattr(group_join, "GROUP", group)
    monkeypatch.setattr(group_join, "SLOT", group)
    docs = family_docs()
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_components(docs)
    assert rows(group_join.linked(df), "doc_id", "n_shingles", "component_id") == want
    assert len({c for _, _, c in want}) < len(docs) - 30


def test_similarity_exactly_at_the_threshold(llm):
    """8 of 10 shingles shared is a link, 7 of 9 is none."""
    words = [f"w{k}" for k in range(14)]
    base = " ".join(words[:13])  # 9 shingles
    docs = [(1, base), (2, " ".join(words[1:14])), (3, " ".join(words[2:13]))]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    assert rows(group_join.linked(df)) == brute_components(docs) == [(1, 9, 1), (2, 9, 1), (3, 7, 3)]


def test_groups_with_one_prefix_and_size(llm):
    """Members of one group that are no copies of each other are told apart."""
    sizes = np.arange(1, 400)
    least = np.array([-(-4 * int(n) // 5) for n in sizes])
    assert (group_join.prefix_length(sizes) == sizes - least + 1).all()
    hashes = np.arange(1, 50, dtype=np.uint64)
    ranked = group_join.Order(np.array([7, 3], np.uint64), np.array([5, 9], np.uint8))
    assert ranked.of(hashes)[[2, 6, 7]].tolist() == [9, 5, 0]


def test_join_odd(llm, odd, none):
    got = rows(group_join.linked(odd), "doc_id", "n_shingles", "component_id")
    plain = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got == brute_components(plain)
    assert group_join.linked(none).count() == 0
    docs = [(None, prose(1, 50)), (None, prose(1, 50)), (None, prose(2, 50)), (4, prose(2, 50)),
            (4, prose(3, 50)), (9, prose(3, 50)), (2, prose(3, 50))]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    want = [(2, 46, 2), (4, 46, 2), (4, 46, 4), (9, 46, 2), (None, 46, 4), (None, 46, None),
            (None, 46, None)]
    assert rows(group_join.linked(df), "doc_id", "n_shingles", "component_id") == want


# -- filter audit --------------------------------------------------------------


def failed_filters(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(f for f, fails in (
        ("A", len(words) < 100),
        ("B", 100 * len(set(words)) < 80 * len(words)),
        ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)),
        ("D", any(c in "#$%&*|" for c in text)),
    ) if fails)


def brute_audit(docs, labels):
    """Every order is applied to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for part in {lang or "" for _, _, lang in docs}:
        own = []
        for i, text, lang in docs:
            if (lang or "") == part:
                text = text or ""
                smaller = text in first and (i is None or first[text] < i)
                own.append((i, failed_filters(text) + ("E" if smaller else "")))
        total = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in own[k][1]]
                left = [k for k in left if f not in own[k][1]]
                fails = sum(f in failed for _, failed in own)
                total[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), fails - len(gone),
                              sum(failed == f for _, failed in own),
                              sum(own[k][0] in good for k in gone),
                              sum(own[k][0] in toxic for k in gone), f))
        out += [(*line[:-1], total[line[-1]]) for line in lines]
    return sorted(out, key=repr)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
           "good_lost", "toxic_lost", "shapley")


def test_audit_like_brute_force(llm):
    docs = []
    for k in range(60):
        text = prose(k % 17, 60 + 9 * (k % 11))
        text = text.upper() if k % 5 == 0 else text + " |" * (k % 3)
        text = " ".join([text] * (1 + k % 2))
        docs.append((k, text, ("en", "de", None)[k % 3]))
    docs += [(60, None, "en"), (61, "", "de"), (62, "  \n", None), (None, docs[3][1], "en"),
             (None, "alone", "xx"), (None, "alone", "xx"), (7, docs[7][1], docs[7][2]),
             (7, "another text", "en"), (5, "alone again", "en"), (5, "alone again", "de")]
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 62, 2)] + [
        (4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1)]
    df = llm.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    marks = llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows(filter_audit.audit(df, marks), *COLUMNS)
    assert got == brute_audit(docs, labels)
    assert len(got) == 600 * 4
    steps = [r for r in got if r[0] == "en"]
    removed = sum(r[4] for r in steps)
    assert removed == sum({r[1][r[2] - 1]: r[9] for r in steps}.values())


def test_orders_of_the_lattice():
    edges = filter_audit.lattice(5)
    assert len(edges) == 80
    assert all(sum(w for s, g, w in edges if g == f) == 120 for f in range(5))
    leaving = {s: sum(w for t, _, w in edges if t == s) for s in range(31)}
    assert leaving[0] == 120 and leaving[0b101] == 2 * 6 and leaving[0b1111] == 24


def test_audit_odd(llm, odd, none):
    marks = llm.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    given = odd.selectExpr("*", "source as lang", "1 as n", "2 as part", "3 as failed", "'d' as digest")
    plain = [(r.doc_id, r.text, r.lang) for r in given.select("doc_id", "text", "lang").collect()]
    got = rows(filter_audit.audit(given, marks), *COLUMNS)
    assert got == brute_audit(plain, [(1, 1, 0)])
    assert filter_audit.audit(none.selectExpr("*", "source as lang"), marks).count() == 0
    assert rows(filter_audit.audit(given, marks.where("false")), *COLUMNS) == brute_audit(plain, [])


# -- whitening -----------------------------------------------------------------


def eigen_check(m, k=4):
    d = m.shape[1]
    r = np.zeros((d, d))
    factor = np.linalg.qr(m, mode="r")
    r[: len(factor)] = factor
    values, vectors = leading(r, k)
    want = np.zeros(max(d, k))
    found = np.linalg.svd(m, compute_uv=False) ** 2
    want[: len(found)] = found
    top = max(want[0], 1e-300)
    assert np.abs(values - want[: len(values)]).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(m.T @ (m @ vectors) - vectors * values).max() <= 1e-12 * top


@pytest.mark.parametrize("seed", range(6))
def test_leading_pairs_like_lapack(seed):
    rng = np.random.default_rng(seed)
    eigen_check(rng.normal(size=(200, 40)))
    eigen_check(rng.normal(size=(60, 9)) * 10.0 ** -np.arange(9))
    eigen_check(rng.integers(-2, 3, size=(rng.integers(1, 30), rng.integers(4, 25))).astype(float))
    basis = np.linalg.qr(rng.normal(size=(50, 10)))[0]
    turn = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    for spread in ([3] * 4 + [1] * 6, [3, 3 + 1e-9, 3 - 1e-7, 2, 1, 1, 1, 1, 0, 0], [1] * 10):
        eigen_check(basis * np.array(spread) @ turn)


def test_small_singular_values_are_accurate():
    """A graded bidiagonal matrix: values over 30 powers of ten, each to many digits."""
    a = 10.0 ** -np.arange(0, 30, 3)
    values = dqds((a * a).tolist(), (a[1:] * a[1:] * 0.25).tolist())
    from fractions import Fraction

    product = Fraction(1)
    for v in a:
        product *= Fraction(float(v)) ** 2
    got = Fraction(1)
    for v in values:
        got *= Fraction(v)
    assert abs(float(got / product) - 1) < 1e-12
    diagonal, above, right = bidiagonalise(np.arange(16.0).reshape(4, 4))
    assert np.allclose(right.T @ right, np.eye(4)) and len(diagonal) == 4 and len(above) == 3


def brute_whitened(vectors, k=4):
    """(n, deviations, eigenvalue shares, whitened up to sign) with exact integers and eigh."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    own = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], dtype=float) / n
    shares = values / np.trace(centred.T @ centred / n)
    return n, deviations, shares, own @ basis / np.sqrt(values)


def test_whitening_like_eigh(llm):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(1, 0.2, 12)).astype(np.float32)
    vectors[250:] = vectors[0]  # one row of the fit
    given = [(k, v.tolist(), "x", 1) for k, v in enumerate(vectors)]
    bad = [(1000, None, "x", 1), (1001, [1.0] * 11 + [None], "x", 1),
           (1002, [float("nan")] * 12, "x", 1), (1003, [float("inf")] + [0.0] * 11, "x", 1),
           (1004, [], "x", 1), (1005, [1.0, 2.0], "x", 1), (None, vectors[1].tolist(), None, 2)]
    df = llm.createDataFrame(given + bad, "vec_id long, embedding array<float>, x string, n int")
    got = whitening.whiten(df.repartition(5)).collect()
    n, deviations, shares, want = brute_whitened(vectors)
    assert {r.n for r in got} == {n} == {250} or n == 250
    by_id = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 4 * 301 and max(r.vec_id or 0 for r in got) == 299
    assert all(by_id[k, 1].deviation == deviations[k] for k in range(300))
    found = np.array([[by_id[k, c].whitened for c in (1, 2, 3, 4)] for k in range(300)])
    signs = np.sign((found * want).sum(axis=0))
    assert np.abs(found * signs - want).max() < 1e-9
    assert np.allclose([by_id[0, c].explained for c in (1, 2, 3, 4)], shares, rtol=1e-12)
    assert {r.identity_error for r in got} == {by_id[0, 1].identity_error}
    assert by_id[0, 1].identity_error < 1e-12
    assert by_id[None, 1].whitened == by_id[1, 1].whitened


def test_whitening_odd(llm):
    schema = "vec_id long, embedding array<double>"
    none = llm.createDataFrame([], schema)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(llm.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(llm.createDataFrame([(1, [0.5, 0.25])] * 3, schema)).collect()
    assert len(one) == 6
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (1, 0, None, None, None)}
    line = [(k, [float(k), 2.0 * k, 7.0]) for k in range(5)]
    got = whitening.whiten(llm.createDataFrame(line, schema)).collect()
    assert len(got) == 15 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(r.explained == pytest.approx(1) for r in got if r.component == 1)
    huge = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])]
    got = whitening.whiten(llm.createDataFrame(huge, schema)).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id != 2} == {None}
