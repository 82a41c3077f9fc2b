"""Decontamination, personal data, language-model scores and languages against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from variloom.llm import decontaminate as D
from variloom.llm import language as L
from variloom.llm import mixing as X
from variloom.llm import pii as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ------------------------------------------------------------------ decontamination


def dwords(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def bench(corpus):
    some = dwords(corpus[80][1]) or dwords(corpus[10][1])
    w = dwords(corpus[0][1])
    return [(1, " ".join(w[-60:-30])), (2, "x, Y " + " ".join(w[-50:-37])), (3, " ".join(w[2:6])), (4, None), (5, "!!"), (6, "line"), (7, " ".join(some[:20])), (1, " ".join(w[-60:-20])), (None, " ".join(w[-20:]))]


def brute_hits(rows, bench):
    windows = {}
    for item, text in bench:
        w = dwords(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for k, text in rows:
        w, hit, items = dwords(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found - {None}
        out.append((k, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 1])
def test_contamination(spark, docs, corpus, bench, broadcast_rows):
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contamination(docs, b, broadcast_rows=broadcast_rows).collect()
    want = Counter(brute_hits([r[:2] for r in corpus], bench))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want
    assert sum(r["contaminated"] for r in got) > 3


def test_decontaminate(spark, docs, corpus, bench):
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute_hits([r[:2] for r in corpus], bench)
    for rows in (2_000_000, 0):  # keys broadcast, and beyond the bound
        left = D.decontaminate(docs, b, broadcast_rows=rows)
        assert left.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted((w[0] is None, w[0] or 0) for w in want if not w[4])
    cut = {(r["doc_id"], len(dwords(r["text"]))) for r in D.decontaminate(docs, b, remove="spans").collect()}
    assert cut == {(w[0], w[1] - w[2]) for w in want}


def test_no_benchmark(spark, docs, corpus, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).count() == len(corpus) and D.contamination(docs, none).where("n_hit > 0").count() == 0
    assert D.contamination(empty, none).count() == D.decontaminate(empty, none).count() == 0


# ------------------------------------------------------------------ personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail a.b+c@d-e.f.gh, x@y or @z.com; q@w.e_r@t.yu", "10.0.0.1 and 256.1.1.1 or 001.02.3.255.7 1.2.3", "4111 1111 1111 1111 or 4111-1111-1111-1112 or 41111111111111111111", "call +1 (555) 010-9999. or +12 or +49.170.1234567x",
    "\u0001é\u0002 𝒳 a@b.c 𝒳 +1 555 010 9999", "", None, "no data", "1" * 5000, "a@b" + ".c" * 3000, "+1 4111111111111111 2",
]


def base_spans(text):
    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    out = []
    for order, (kind, p) in enumerate(PATTERNS.items()):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return sorted(out)


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in P.find(df).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(TEXTS)}
    assert sum(map(len, got.values())) > 10


def test_patterns_find_unseen_identifiers(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, f"some words here and reach me at u{i}@mail{i % 9}.example.com please") for i in range(30)]
    rows += [(100 + i, f"other words reach me at HX-{rng.randrange(10**6):06d}-q. thanks") for i in range(5)]
    rows += [(200 + i, f"version {i}2345 of chapter {i}6789") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in P.find(df).collect()}
    for i in range(5):
        text = rows[30 + i][1]
        start = text.index("HX-")
        assert found[100 + i] == [("context", start, text.index(". thanks"))]
    assert not any(found[200 + i] for i in range(20))
    cleaned = {r["doc_id"]: r["text"] for r in P.redact(df).collect()}
    assert cleaned[100] == "other words reach me at [CONTEXT]. thanks" and cleaned[0].endswith("at [EMAIL] please") and cleaned[200] == rows[35][1]
    assert P.redact(docs).columns == docs.columns and P.redact(docs).count() == docs.count()
    assert P.find(empty).count() == P.redact(empty).count() == 0


def test_overlapping_spans_go_once(spark):
    df = spark.createDataFrame([(1, "x 1.2.3.4@b.co y")], "doc_id long, text string")
    assert len(P.find(df).first()["base"]) == 2 and P.redact(df).first()["text"] == "x [EMAIL] y"


# ------------------------------------------------------------------ language models


def ltokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


@pytest.mark.parametrize("top", [1 << 18, 5])
def test_base_scores(docs, corpus, top):
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(t for k, text, *_ in corpus if not held(k) for t in ltokens(text))
    n, v = sum(c.values()), len(c)
    got = X.score(docs, top_words=top).collect()
    want = Counter((k, held(k), len(ltokens(t)), sum(c[x] > 0 for x in ltokens(t)), n) for k, t, *_ in corpus)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = sorted(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ltokens(t)) for _, t, *_ in corpus)
    assert sorted(r["base_score"] for r in got) == pytest.approx(base)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_code_is_a_prefix_code():
    import numpy as np

    code = X.Code.of(np.array([5, 3, 9, 7], dtype=np.uint64), np.array([10.0, 1, 5, 1]), np.array([True, True, True, False]), 2.0, 3.0, np.ones(256))
    assert sum(2.0 ** -code.length[:5]) == pytest.approx(1) and sum(2.0 ** -code.length[5:]) == pytest.approx(1)
    assert code.lookup.hashes.tolist() == [3, 5, 7, 9] and code.symbol.tolist() == [0, 1, -1, 2] and code.escape == 3 and code.length[1] <= code.length[0]


def test_lookup():
    import numpy as np

    rng = np.random.default_rng(1)
    have = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    asked = np.concatenate([have[::3], rng.integers(0, 1 << 63, 5000, dtype=np.uint64), have[:50] + np.uint64(1)])
    want = [int(np.searchsorted(have, h)) if h in set(have.tolist()) else -1 for h in asked.tolist()]
    assert X.Lookup(have).find(asked).tolist() == want
    assert X.Lookup(have[:0]).find(asked).tolist() == [-1] * len(asked)


def test_model_predicts_better_than_chance(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words[: 5 if i % 2 else 50]) for _ in range(100))) for i in range(300)]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    mean = sum(r["bits_per_byte"] for r in held) / len(held)
    assert mean < 1.2  # 50 words of 7 bytes: log2(50) / 7 is 0.81, and half the texts have but five
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held) * 1.05


def test_blocks_of_a_tree():
    import numpy as np

    rng = np.random.default_rng(4)
    n, node, bit, _, mark = X._huffman(rng.integers(1, 1000, 300).astype(float))
    stop = np.cumsum(n)
    for i in range(300):
        path = node[stop[i] - n[i] : stop[i]]
        heads = [path[d - d % X.LEVELS] for d in range(len(path))]
        assert (mark[path] >> 3).tolist() == [int(h) for h in heads]
    # No two nodes share a block and a place, and place 0 is free.
    assert len(set(mark.tolist())) == 299 and (mark & 7).min() == 1


def test_held_out_texts_cost_less_than_the_base(spark):
    # A word tells the next but for one in ten, so that contexts are worth having.
    rng = random.Random(5)

    def text():
        at, out = rng.randrange(400), []
        for _ in range(120):
            out.append(f"word{at}")
            at = rng.randrange(400) if rng.random() < 0.1 else (at * 7 + 3) % 400
        return " ".join(out)

    got = X.score(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")).where("held_out").collect()
    assert got and sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)


def test_half_of_the_words_seen_once_are_spelled_in_training():
    import numpy as np
    import pyarrow as pa

    text = pa.array([" ".join(f"only{i}" for i in range(200)) + " twice twice"])
    words = X.words_of(text, lower=True)
    h, n = np.unique(words.hash, return_counts=True)
    code = X.Code.of(h, n.astype(float), np.ones(len(h), bool), 0.0, 1.0, np.ones(256))
    found = code.lookup.find(words.hash)
    assert 60 < code.held_back.sum() < 140
    later, now = (X.symbols_of(words, code, found, training) for training in (False, True))
    assert (later.symbol < code.escape).sum() == 202 and (now.symbol == code.escape).sum() == code.held_back.sum()


def test_every_decision_is_learned_from():
    import numpy as np

    code = X.Code.of(np.array([5, 3, 9], dtype=np.uint64), np.array([10.0, 4, 5]), np.ones(3, bool), 2.0, 3.0, np.ones(256))
    model, rng = X.Model(code), np.random.default_rng(1)
    slots, bit = [rng.integers(0, 1 << 10, 1000).astype(np.intp) for _ in range(2)], rng.integers(0, 2, 1000).astype(np.uint8)
    model.learn(slots, np.zeros(1000, np.int32), bit)
    assert model.map.sum(axis=0).tolist() == [(bit == 0).sum(), (bit == 1).sum()] and model.seen.sum() == 1000
    # The unigram weight's step is the mean gradient over all thousand.
    x = float(code.stretch[0])
    assert model.weights[0][0] == pytest.approx(1 + 0.3 * (bit.mean() - 1 / (1 + math.exp(-x))) * x, abs=1e-5)


def test_small_partitions_train_the_context_weights():
    import numpy as np

    code = X.Code.of(np.array([5, 3, 9], dtype=np.uint64), np.array([10.0, 4, 5]), np.ones(3, bool), 2.0, 3.0, np.ones(256))
    trainer, rng = X.Trainer(code), np.random.default_rng(1)
    # The shorter context tells the bit, the longer one nothing; 40,000 decisions in all.
    for _ in range(10):
        bit = rng.integers(0, 2, 4000).astype(np.uint8)
        slots = [(rng.integers(0, 50, 4000) * 2 + (bit ^ (rng.random(4000) < 0.1))).astype(np.intp), rng.integers(0, 100, 4000).astype(np.intp)]
        trainer.add(np.zeros(4000, np.int32), slots, bit)
    model = trainer.end()
    assert [int(c.sum()) for c in model.counts] == [40_000, 40_000] and model.seen.sum() == 40_000
    trained = model.seen > 0
    assert trained.sum() > 3 and trained.argmax() == 0
    busy = model.seen.argmax()
    assert model.weights[1][busy] > 0.15 and model.weights[1][busy] > 2 * model.weights[2][busy]
    # Weights of gates never used stay as they were, whatever the partitions.
    joined = X.Model.join(code, model.parts())
    assert all((a == b).all() for a, b in zip(joined.counts, model.counts))
    assert np.allclose(joined.weights[1], model.weights[1], atol=1e-6) and joined.map.tolist() == model.map.tolist()


def test_tables_grow_with_the_corpus():
    import numpy as np

    assert X.sizes(1000, 100) == (19, 1 << 18) and X.sizes(390_000, 300_000) == (21, 300_000)
    assert X.sizes(4_000_000, 1 << 30) == (22, 1 << 19) == X.sizes(10**10, 1 << 30)
    code = X.Code.of(np.array([5, 3, 9], dtype=np.uint64), np.array([10.0, 4, 5]), np.ones(3, bool), 2.0, 3.0, np.ones(256))
    code.bits = (21, 20)
    s = X.Symbols(np.zeros(4000, np.int32), (np.arange(4000, dtype=np.uint32) * np.uint32(2654435761),) * 2, np.array([0, 4000]))
    trainer, seen = X.Trainer(code), [set(), set()]
    for node, slots, bit, _, _ in X.decisions(s, code):
        for have, some in zip(seen, slots):
            have.update(some.tolist())
        trainer.add(node, slots, bit)
    model = trainer.end()
    assert [c.shape[0] for c in model.counts] == [1 << 21, 1 << 20] and max(seen[0]) >= 1 << 20
    assert [set(np.flatnonzero(c.sum(axis=1)).tolist()) for c in model.counts] == seen
    # Predictions renewed at the slots counted are those made from all counts.
    model.refresh()
    again = X.Model.join(code, model.parts())
    assert all((a == b).all() for a, b in zip(model.told, again.told))


def test_nothing_to_learn_from(spark, empty):
    k = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = X.score(spark.createDataFrame([(k, "Some text")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and math.isfinite(r["score"])
    assert X.score(empty).count() == 0


# ------------------------------------------------------------------ languages


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(1)
    net = L.Network(["a", "b", "c"], hidden=3)
    net.start(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.integers(0, 9, (6, 4)), rng.random((6, 4)) < 0.8, np.array([0, 1, 2, 1])
    _, g = net.gradients(x, mask, y)
    for k, i in (("Ef", (3, 2)), ("Uf", (1, 4)), ("Eb", (2, 7)), ("Ub", (0, 1)), ("O", (4, 2)), ("o", (1,))):
        at = net.p[k][i]
        losses = []
        for step in (1e-2, -1e-2):
            net.p[k][i] = at + step
            losses.append(net.gradients(x, mask, y)[0])
        net.p[k][i] = at
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[k][i], abs=2e-3)


def test_languages(spark, docs, corpus, empty):
    rng = random.Random(1)
    alphabets = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éüöäabq"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(30)), lang) for i in range(400) for lang in [rng.choice(list(alphabets))]]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (1003, "abc " * 30_000, None)]
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:400]) > 395
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert L.identify(docs).count() == len(corpus) and L.identify(empty).count() == 0
    none = L.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_windows_cover_whole_texts():
    import numpy as np

    data = np.arange(23, dtype=np.uint8)
    x, n, doc = L.windows_of(data, np.array([0, 10, 10, 23]), 4)
    assert doc.tolist() == [0, 0, 0, 2, 2, 2, 2] and n.tolist() == [4, 4, 2, 4, 4, 4, 1]
    assert [b for row, k in zip(x, n) for b in row[:k]] == list(range(23))


def test_texts_are_scored_alike_alone_and_beside_others():
    import numpy as np
    import pyarrow as pa

    net = L.Network(["a", "b", "c"])
    net.start(np.random.default_rng(2))
    texts = ["one", "two words", "x" * 70, "é", "", None, "a longer text of several words that takes more than one window of bytes"]
    alone = np.concatenate([L.document_probabilities(net, pa.array([t], pa.string())) for t in texts])
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        beside = L.document_probabilities(net, pa.array([texts[i] for i in order], pa.string()))
        assert np.allclose(beside, alone[list(order)], atol=1e-6)


def test_probabilities_of_both_bits_add_up_to_one():
    import numpy as np

    from variloom.llm import mixing

    rng = np.random.default_rng(1)
    code = mixing.Code.of(rng.integers(0, 1 << 63, 50, dtype=np.uint64), rng.integers(1, 90, 50).astype(float), np.ones(50, bool), 3.0, 5.0, rng.integers(0, 9, 256).astype(float))
    model = mixing.Model(code)
    model.map += rng.integers(0, 1000, model.map.shape)
    model.refresh()
    node = rng.integers(0, len(code.stretch), 4000).astype(np.int32)
    slots = [rng.integers(0, 1 << b, 4000) for b in code.bits]
    model.weights = [w * 9 for w in model.weights]
    p = [np.exp(model.cost(slots, node, np.full(4000, bit, np.uint8)).astype(float)) for bit in (0, 1)]
    assert np.abs(p[0] + p[1] - 1).max() < 1e-5


def test_keys_are_found_by_their_context(spark):
    from variloom.llm import pii

    rows = [(i, f"some words api_key = {i:02d}ab34cd56ef78ab90cd12ef34 and {i} others") for i in range(6)]
    rows += [(10, "some words api_key = zq77! and others"), (11, "plain words 4711 and others"), (12, "in 2024 api_key is a word")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["context"] for i in range(6)) and not got[11] and not got[12]


def test_many_tokens_in_one_text(spark):
    from variloom.llm import pii

    text = " ".join(f"w{i} 10.0.{i % 200}.{i % 250}" for i in range(3000))
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[s["start"] : s["end"]] for s in r["base"]] == [f"10.0.{i % 200}.{i % 250}" for i in range(3000)]
