"""Registered queries against their SQL, and the pipeline against brute force."""

import os

import pytest
from oracle_check import compare, connect

import corpus_pipeline
from llm.test_models import brute_classes, brute_windows
from llm.test_text_operators import brute_lines, sha
from replyforge.llm.queries import BYTE_BPE, QUERIES, SQL

SF = os.environ.get("REPLYFORGE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(llm, name):
    assert compare(QUERIES[name](llm, SF), connect(SF), SQL[name]) == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(llm):
    from tokenizers import Tokenizer

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = corpus_pipeline.table(llm, SF, "documents")
    labels = {r.doc_id: r.quality for r in corpus_pipeline.table(llm, SF, "labels").collect()}
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(llm, docs, SF), "stage")
        assert docs.columns == columns, name
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(seen), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality classifier":
            good = [i for i, q in labels.items() if q == 1]
            bad = [i for i, q in labels.items() if q == 0]
            assert sum(i in now for i in good) >= 0.98 * len(good)
            assert sum(i in now for i in bad) <= 0.2 * len(bad)
        elif name == "line dedup":
            assert now == {i: text for i, _, _, text in brute_lines(sorted(seen.items()))}
        else:
            assert all(now[i] == seen[i] for i in now), name
        if name == "near-duplicates":
            assert set(now) == {c for _, c in brute_classes(sorted(seen.items()))}
        if name == "benchmark decontamination":
            items = [tuple(r) for r in corpus_pipeline.table(llm, SF, "benchmark").select(
                "item_id", "text").collect()]
            assert set(now) == {i for i, _, hit, _ in brute_windows(sorted(seen.items()), items) if not hit}
            assert set(now) != set(seen)
        seen = now
    library = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in corpus_pipeline.run(llm, SF).collect()}
    want = {}
    for i, text in seen.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(back))
    assert got == want
