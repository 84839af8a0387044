"""Line dedup, tokenizers, token files, chat, sharding: brute force and odd input."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import rows
from llm.prose import prose
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from replyforge.llm import bpe, chat, kd_shards, line_dedup, range_coder, token_files
from replyforge.llm.perfect_hash import PerfectHash
from replyforge.llm.range_coder import decode_blocks, encode_blocks

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- line dedup --------------------------------------------------------------


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    hashed = PerfectHash.load(*PerfectHash.build(high, low).dump())
    assert sorted(hashed.find(high, low)) == list(range(5000))
    empty = PerfectHash.build(high[:0], low[:0])
    assert list(empty.find(high[:3], low[:3])) == [-1, -1, -1]


def brute_lines(docs):
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 20:
                held.setdefault(key, set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = "".join(c.lower() if "A" <= c <= "Z" else c
                          for c in line.strip(" \t\n\x0b\x0c\r"))
            ids = held.get(key, set())
            if len(ids) < 3 or i == max(ids):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_like_brute_force(llm, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)  # several shards
    monkeypatch.setattr(line_dedup, "SHARD_REFS", 5)  # and several copies of each
    common = [f"Common line number {k} of the corpus" for k in range(15)]
    docs = []
    for i in range(40):
        lines = [common[(i * j) % 15] for j in range(1, 4)] + [f"an own line of document {i}"]
        if i % 3 == 0:
            lines.append("  " + common[0].upper() + "\t")
        if i % 5 == 0:
            lines += ["short", "Straße " * 3, common[1], common[1]]
        docs.append((i, "\n".join(lines)))
    df = llm.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "text")
    assert rows(got) == sorted(brute_lines(docs), key=repr)
    assert any(d for _, _, d, _ in brute_lines(docs))


def test_lines_odd(llm, odd, none):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + [
        "n_lines", "n_dropped"]
    found = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in out.collect()}
    assert out.count() == odd.count()
    assert found[(1, "")] == (1, 0) and found[(2, "")] == (1, 0)
    assert found[(3, "  \n\t\n ")] == (3, 0)
    assert line_dedup.drop_repeated_lines(none).count() == 0


# -- tokenizers --------------------------------------------------------------

TRICKY = [
    "", " ", "a ", "  two  blanks ", "it's we'll 's", "x<|endoftext|>y <|endoftext|>", "\n\n a\n b",
    "aaaaaaaaaaaaaaaaaaaa", "tab\t\tx \x85 y z \x1c q", "日本 123 4",
    "Naïve café İ Σς",
]


def test_bpe_like_the_library():
    model, library = bpe.PairIndexBPE(BYTE), Tokenizer.from_file(BYTE)
    ids, counts, joined = model.encode(TRICKY)
    for text, text_ids in zip(TRICKY, joined):
        assert text_ids == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
    assert model.decode(ids, counts) == TRICKY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_bpe_any_text(texts):
    model, library = bpe.tokenizer(BYTE), Tokenizer.from_file(BYTE)
    ids, counts, joined = model.encode(texts)
    assert joined == [
        ",".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts
    ]
    assert model.decode(ids, counts) == texts


def test_bpe_table_turns_over(monkeypatch):
    """A full table becomes the one before; results do not depend on what is kept."""
    monkeypatch.setattr(bpe, "KEEP_BYTES", 3000)
    model, library = bpe.PairIndexBPE(BYTE), Tokenizer.from_file(BYTE)
    for k in range(30):
        texts = [prose(k % 7 + j, 12) + ", it's" for j in range(4)] + TRICKY[k % len(TRICKY):][:2]
        ids, counts, joined = model.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert joined == [",".join(map(str, w)) for w in want]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
        assert model.decode(ids, counts) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_bpe_refuses_other_rules(tmp_path):
    spec = json.load(open(BYTE, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}},
                   {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
                   {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="t.json has"):
            bpe.PairIndexBPE(str(path))


def test_bpe_documents(llm, odd, none):
    encoded = bpe.encode_documents(odd, BYTE, ids=True)
    back = bpe.decode_documents(encoded, BYTE)
    wanted = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    assert rows(back) == wanted
    digests = rows(encoded, "doc_id", "decoded_sha256")
    assert digests == sorted(((i, sha(t)) for i, t in wanted), key=repr)
    assert bpe.encode_documents(none, BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=60), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    sizes = np.array([len(b) for b in blocks])
    ids = np.array([i for b in blocks for i in b], dtype=np.int64)
    payloads, sums = encode_blocks(ids, sizes)
    assert list(decode_blocks(payloads, sizes, sums)) == list(ids)


def test_coder_compresses_and_checks():
    ids = np.tile(np.arange(50), 160)
    sizes = np.array([4096, 3904])
    payloads, sums = encode_blocks(ids, sizes)
    assert sum(map(len, payloads)) < 2 * len(ids) / 8
    with pytest.raises(ValueError):
        decode_blocks([payloads[0][:40] + b"\1\2" + payloads[0][42:], payloads[1]], sizes, sums)
    with pytest.raises(ValueError):
        encode_blocks(np.array([70000]), np.array([1]))


def _order_0_alone(monkeypatch):
    look = range_coder._Models.look

    def alone(self, k):
        look(self, k)
        self.total = self.total - self.u1 - self.u2
        self.u1, self.u2 = np.zeros_like(self.u1), np.zeros_like(self.u2)

    monkeypatch.setattr(range_coder._Models, "look", alone)


def test_all_ids_share_one_distribution():
    """Whatever has been seen, the spans of all ids tile the total, each at least 1."""
    rng = np.random.default_rng(6)
    models = range_coder._Models(3)
    every = np.arange(1 << 16)
    for step in range(150):
        models.look(3)
        x = rng.choice([5, 5, 300, 70, 41000], size=3)
        if step % 50 == 49:
            for lane in range(3):
                one = [np.full(3, i) for i in (0, 5, 69, 70, 71, 300, 40999, 41000, 65535)]
                at = [tuple(v[lane] for v in models.span(3, i)) for i in one]
                assert all(below + size <= later for (below, size), (later, _) in zip(at, at[1:]))
            spans = np.array([models.span(3, np.full(3, i)) for i in every])
            below, size = spans[:, 0], spans[:, 1]
            assert (size > 0).all() and (below[0] == 0).all()
            assert (below[1:] == below[:-1] + size[:-1]).all()
            assert (below[-1] + size[-1] == models.total).all()
            for goal in (np.zeros(3, np.int64), models.total - 1, models.total // 3):
                found = models.find(3, goal)
                low, width = models.span(3, found)
                assert ((low <= goal) & (goal < low + width)).all()
        models.span(3, x)
        models.learn(3, x)


def test_mixing_beats_order_0(monkeypatch):
    texts = [prose(k, 900) for k in range(6)]
    encoder = token_files.WordEncoder(WORD)
    ids, counts = encoder.encode(texts, 2)
    sizes = np.array([len(ids)])
    mixed = len(encode_blocks(ids, sizes)[0][0])
    _order_0_alone(monkeypatch)
    payloads, sums = encode_blocks(ids, sizes)
    assert mixed < 0.9 * len(payloads[0])
    assert (decode_blocks(payloads, sizes, sums) == ids).all()


def test_blocks_of_a_segment_learn_together():
    """one model for many blocks; other segments do not matter."""
    rng = np.random.default_rng(8)
    ids = rng.choice(rng.integers(0, 49000, 300), 16 * 256)
    sizes, segment = np.full(16, 256), np.repeat([0, 1], 8)
    alone = sum(map(len, encode_blocks(ids, sizes)[0]))
    payloads, sums = encode_blocks(ids, sizes, segment)
    assert sum(map(len, payloads)) < 0.95 * alone
    assert (decode_blocks(payloads, sizes, sums, segment) == ids).all()
    assert (decode_blocks(payloads[8:], sizes[8:], sums[8:], segment[8:] - 1) == ids[8 * 256:]).all()


NASTY = [*"aAbZzsStT'\"#$.,1 \n\t\r\0|<>", "'s", "'RE", "é", "É", "e\u0301", "J", "\u030c", "İ", "ß", "×",
         "÷", "ſ", "K", "ш", "Ш", "й", "\u0307", "σ", "Σ", "中", "…", "\u00a0", "=", "\u0338", "ŉ",
         "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\U0001d54f", "ff", "\u1e9e", "ǆ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(NASTY), max_size=12).map("".join), min_size=1, max_size=5))
def test_word_encoder_is_the_library(texts):
    library, encoder = Tokenizer.from_file(WORD), token_files.word_encoder(WORD)
    ids, counts = encoder.encode(texts, 2)
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_words_are_encoded_once(monkeypatch):
    """case and signs beside a word make no new one, and a full table keeps what comes again."""
    asked = []
    encode = token_files.WordEncoder._encode

    def count(self, words):
        asked.extend(words)
        return encode(self, words)

    monkeypatch.setattr(token_files.WordEncoder, "_encode", count)
    monkeypatch.setattr(token_files, "KEEP_WORDS", 40)
    encoder, library = token_files.WordEncoder(WORD), Tokenizer.from_file(WORD)
    encoder.encode(["Word word. WORD, (word) wörd wörd!"], 2)
    assert sorted(asked) == ["!", "(", ")", ",", ".", "word", "wörd"]
    for k in range(12):
        text = " ".join(["word", *(f"{chr(97 + k)}{chr(97 + j)}q" for j in range(20))])
        ids, _ = encoder.encode([text], 2)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [2]
    assert asked.count("word") == 1


def test_token_files(llm, odd, none, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    library = Tokenizer.from_file(WORD)
    more = llm.createDataFrame([(100 + k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    folder = token_files.write_token_files(docs, WORD, end_id=2)
    got = token_files.read_token_files(llm, folder, with_ids=True).collect()
    given_rows = sorted(
        ((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())
    )
    start, wanted = 0, []
    for i, text in given_rows:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        wanted.append((i, start, len(ids), crc, ids))
        start += len(ids)
    found = [(-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)]
    assert sorted(found, key=lambda r: r[1]) == wanted
    folder = token_files.write_token_files(none, WORD, end_id=2)
    assert token_files.read_token_files(llm, folder).count() == 0


# -- chat --------------------------------------------------------------------


def test_tree_paths_and_ranking(llm):
    tree = [
        # tree, node, parent, role, text, score
        (1, 1, None, "user", "root", 0.0),
        (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "user", "more", 1.0), (1, 5, 4, "assistant", "deep", 3.0),
        (1, 5, 4, "assistant", "deep", 3.0),  # a repeated row
        (2, 9, 8, "user", "parent is missing", None),
        (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0),
        (None, 1, None, None, None, None),
    ]
    df = llm.createDataFrame(
        tree, "tree long, node long, parent long, role string, text string, score double"
    )
    out = chat.format_trees(df, branches=None)
    turns = chat.read_turns(out["formatted"])
    found = {
        (r.tree, r.rank): [tuple(t) for t in r.turns]
        for r in out.select("tree", "rank", turns.alias("turns")).collect()
    }
    assert found == {
        (1, 1): [("user", "root"), ("assistant", "good"), ("user", "more"), ("assistant", "deep")],
        (1, 2): [("user", "root"), ("assistant", "bad")],
        (2, 1): [("user", "parent is missing")], (None, 1): [("", "")],
    }
    best = chat.format_trees(df, branches=1)
    assert rows(best, "tree") == sorted([(1,), (2,), (None,)], key=repr)
    loss = chat.read_loss(best["formatted"], best["loss_spans"])
    assert rows(best.where("tree = 1").select(loss.alias("x"))) == [("gooddeep",)]
    assert chat.format_trees(df.where("false")).count() == 0


def test_no_message_is_lost(llm):
    tree = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "one answer", 1.0),
        (1, 2, 1, "assistant", "another answer", 1.0), (1, 2, 1, "assistant", "one answer", 1.0),
        (1, None, 1, "assistant", "no node", 1.0), (1, None, 1, "assistant", "no node", 1.0),
        (1, None, None, "user", "no node, no parent", 1.0), (1, -7, 1, "assistant", "negative", 1.0),
        (2, 1, 2, "user", "cycle a", 0.0), (2, 2, 1, "user", "cycle b", 0.0),
        (2, 3, 2, "user", "below the cycle", 0.0), (None, None, None, "user", "nothing", 0.0),
        (None, None, None, "user", "known", 0.0),
    ]
    df = llm.createDataFrame(
        tree, "tree long, node long, parent long, role string, text string, score double")
    out, unplaced = chat.place_trees(df.repartition(3), branches=None)
    turns = out.select("tree", chat.read_turns(out["formatted"])["text"].alias("texts"))
    assert sorted(((r.tree, tuple(r.texts)) for r in turns.collect()), key=repr) == sorted([
        (1, ("root", "another answer")), (1, ("root", "no node")), (1, ("root", "no node")),
        (1, ("no node, no parent",)), (1, ("root", "negative")), (None, ("nothing",)), (None, ("known",)),
    ], key=repr)
    assert rows(unplaced, "tree", "node", "text", "reason") == sorted([
        (1, 2, "one answer", "another message has this node"), (2, 1, "cycle a", "no root"),
        (2, 2, "cycle b", "no root"), (2, 3, "below the cycle", "no root")], key=repr)


def test_long_thread(llm):
    n = 37
    df = llm.range(n).selectExpr(
        "1L as tree", "id as node", "nullif(id, 0) - 1 as parent", "'user' as role",
        "cast(id as string) as text", "0 as score",
    )
    out = chat.format_trees(df)
    texts = out.select(chat.read_turns(out["formatted"])["text"]).first()[0]
    assert texts == [str(k) for k in range(n)]


def test_escapes_are_reversible(llm):
    texts = ["\\", "\\\\<|end|>", "<<s>", "<|turn|><|turn|>", "[/INST]\\n", "</s>[INST] ok [/INST]",
             "<\\|turn|>", "a\n\\\n", "", *chat.CONTROL]
    df = llm.createDataFrame([(t,) for t in texts], "t string")
    done = df.select("t", chat.escape(df["t"]).alias("e")).select(
        "t", "e", chat.unescape(chat.escape(df["t"])).alias("back"))
    for r in done.collect():
        assert r.back == r.t
        assert not any(c in r.e for c in chat.CONTROL)


# -- sharding ----------------------------------------------------------------


def test_shards(llm, odd, none):
    docs = llm.createDataFrame(
        [(k, f"text {k} " * (k % 37 + 1)) for k in range(600)]
        + [(1000 + k, "one text many times") for k in range(90)],
        "doc_id long, text string",
    )
    out = kd_shards.shard_documents(docs, shards=16).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() < 1.25 * sizes.mean()
    assert out[out.doc_id >= 1000].shard.nunique() == 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(out["size"] - 1) == {len(r.text.encode()) for r in docs.collect()}
    small = kd_shards.shard_documents(docs, target_bytes=int(sizes.sum()))
    assert small.select("shard").distinct().count() == 1

    strange = kd_shards.shard_documents(odd, shards=5).toPandas()
    assert len(strange) == odd.count()
    twice = strange[strange.doc_id == 5]
    assert twice.shard.nunique() == 1 and twice.slot.nunique() == 2
    assert list(strange[strange.doc_id == 1]["size"]) == [1]
    assert kd_shards.shard_documents(none, shards=16).count() == 0


def brute_tree(points, shards, dims=kd_shards.DIMENSIONS):
    """{place in ``points``: shard}: recursive cuts at exact weighted medians."""
    scale = {d: max(p[d] for p in points) - min(p[d] for p in points) for d in dims}
    out = {}

    def split(rows, first, n):
        if n == 1 or not rows:
            out.update(dict.fromkeys(rows, first))
            return
        spread = {d: max(points[r][d] for r in rows) - min(points[r][d] for r in rows) for d in dims}
        dim = max(dims, key=lambda d: (spread[d] / max(scale[d], 1), -dims.index(d)))
        groups = {}
        for r in rows:
            groups.setdefault((points[r][dim], points[r]["tie"]), []).append(r)
        goal = sum(points[r]["size"] for r in rows) * (n // 2) / n
        left, under = [], 0
        for key in sorted(groups):
            weight = sum(points[r]["size"] for r in groups[key])
            if under + weight >= goal:
                if under + weight - goal <= goal - under:
                    left += groups[key]
                break
            left += groups[key]
            under += weight
        split(left, first, n // 2)
        split([r for r in rows if r not in set(left)], first + n // 2, n - n // 2)

    split(list(range(len(points))), 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_tree_like_brute_force(llm, monkeypatch, shards):
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0.0)
    monkeypatch.setattr(kd_shards, "BINS", 8)  # several rounds to each cut
    docs = [(k, f"{prose(k, k * 7 % 29)}\n" * (k % 3) + "é" * (k % 11)) for k in range(120)]
    docs += [(200 + k, "same") for k in range(15)] + [(300, None), (301, "")]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    points = [r.asDict() for r in kd_shards.text_points(df).collect()]
    got = {r.doc_id: r.shard for r in kd_shards.shard_documents(df, shards=shards).collect()}
    want = brute_tree(points, shards)
    assert got == {points[k]["doc_id"]: shard for k, shard in want.items()}
    assert {r["doc_id"]: r["text_crc32"] for r in points} == {
        i: zlib.crc32((t or "").encode()) for i, t in docs}


def test_slots_over_several_buckets(llm, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 2)
    docs = [(k % 70, prose(k % 90, k % 13)) for k in range(200)] + [(None, "x")] * 20
    df = llm.createDataFrame(docs, "doc_id long, text string")
    out = kd_shards.shard_documents(df, shards=4).toPandas()
    assert len(out) == 220
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
