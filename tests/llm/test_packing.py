import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from variloom.llm import packing as P
from variloom.llm import token_matrix as M
from variloom.llm.tokens import default_vocabulary, encoder


@pytest.fixture(scope="module")
def whole(corpus):
    """Ids of each distinct row by the tokenizer itself."""
    t = Tokenizer.from_file(default_vocabulary())
    return {(k, text): [*t.encode(text or "", add_special_tokens=False).ids, 1] for k, text, *_ in corpus}


@pytest.mark.parametrize("text", ["don't STOP'S <|endoftext|>a ＦＵＬＬ x²y a_b É1Ü!! İstanbul ŉ ﬁ ΑΣ’s 12ab,c|d ſ ÅÇé ́x", "Ž\x01a \x7f b\xa0c d e'll", "a b\x85c\x1cd", ""])
def test_words_encode_as_the_text(text):
    e = encoder(default_vocabulary())
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_cover_every_id_once(docs, corpus, whole):
    rows = P.pack_documents(docs).collect()
    at = defaultdict(int)
    for r in rows:
        at[r["doc_id"], r["doc_tokens"], r["start"], zlib.crc32(r["ids"])] += 1
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], r["ids"]))
    want = defaultdict(list)
    for k, text, *_ in corpus:
        want[k].append(whole[k, text])
    for k, lists in want.items():
        ids = sorted(i for _, b in got[k] for i in np.frombuffer(b, "<u4").tolist())
        assert ids == sorted(i for x in lists for i in x)
        if len(lists) == 1:
            place = 0
            for start, b in sorted(got[k]):
                assert start == place and np.frombuffer(b, "<u4").tolist() == lists[0][start : start + len(b) // 4]
                place += len(b) // 4


def test_sequences_keep_the_limits(docs):
    limits = P.Limits(tokens=256, segments=5, loss_tokens=200)
    by = defaultdict(list)
    for r in P.pack_documents(docs, limits=limits).collect():
        by[r["sequence_id"]].append(r)
    used = 0
    for rows in by.values():
        place = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 256 and len(rows) <= 5 and sum(r["loss_tokens"] for r in rows) <= 200
        used += place
    assert used / (200 * len(by)) > 0.9


def test_dot_product_places_the_best_fit():
    tokens = np.array([60, 50, 40, 30, 20])
    bins = P.pack_vectors(tokens, np.zeros(5, int), P.Limits(tokens=100, segments=9, loss_tokens=9), can_cut=False)
    assert sorted(sum(n for _, _, n in b) for b in bins) == [100, 100]


def test_conversations_stay_whole(spark):
    rows = [(1, 2, "assistant", "fine thanks"), (1, 1, "user", "how are you"), (2, 1, "user", None), (None, 1, "assistant", "hello")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in P.pack_conversations(df).collect()}
    e = encoder(default_vocabulary())
    one = e.encode("how are you") + b"\1\0\0\0" + e.encode("fine thanks") + b"\1\0\0\0"
    assert got[1]["ids"] == one and got[1]["loss_tokens"] == len(e.encode("fine thanks")) // 4 + 1
    assert got[2]["loss_tokens"] == 0 and got[None]["length"] == got[None]["loss_tokens"]


def test_empty(empty):
    assert P.pack_documents(empty).count() == M.pack_matrix(empty).count() == 0


def test_tree_finds_the_least_room():
    import random

    rng, tree, have = random.Random(2), M.RoomTree(50), []
    for i in range(3000):
        if rng.random() < 0.5:
            room = rng.randint(1, 50)
            tree.put(room, i)
            have.append(room)
        else:
            need = rng.randint(1, 50)
            want = min((r for r in have if r >= need), default=None)
            got = tree.take(need)
            assert (got and got[0]) == want
            if want:
                have.remove(want)


def test_matrix_rows_read_back(docs, corpus, whole):
    rows = M.pack_matrix(docs, capacity=512).collect()
    back = defaultdict(list)
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert len(ids) == len(places) == 512 and r["cu_seqlens"][-1] == r["n_tokens"]
        for k, start, a, b in zip(r["keys"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            back[k].append((start, ids[a:b].tolist()))
            assert places[a:b].tolist() == list(range(b - a))
        assert not ids[r["n_tokens"] :].any()
    for k, text, *_ in corpus:
        if sum(c[0] == k for c in corpus) == 1:
            assert [i for _, part in sorted(back[k]) for i in part] == whole[k, text]
    total = sum(len(whole[k, t]) for k, t, *_ in corpus)
    assert sum(len(p) for parts in back.values() for _, p in parts) == total
    assert total / (512 * len(rows)) > 0.9
