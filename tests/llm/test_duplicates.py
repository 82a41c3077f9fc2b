import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from variloom.llm import neardup as N
from variloom.llm import substrings as S
from variloom.llm import words as W
from variloom.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes():
    texts = ["a bb\tccc", None, "", " ", "bb", "é x a", "ccc\x0bccc"]
    w = W.words_of(pa.array(texts))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [SPLIT.findall(t or "") for t in texts]
    flat = [x for g in got for x in g]
    assert len({h: x for h, x in zip(w.hash.tolist(), flat)}) == len(set(flat))
    p = W.Prefix.of(w.hash, W.WORD_BASES[0])
    assert p.window(np.array([1]), np.array([2]))[0] == p.window(np.array([3]), np.array([4]))[0]


def brute_repeats(rows, window):
    first = {}
    for k, text in rows:
        w = SPLIT.findall(text or "")
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if k is not None and (g not in first or k < first[g]):
                first[g] = k
    out = Counter()
    for k, text in rows:
        w = SPLIT.findall(text or "")
        cov = [False] * len(w)
        for i in range(len(w) - window + 1):
            f = first.get(tuple(w[i : i + window]))
            if k is not None and f is not None and f < k:
                cov[i : i + window] = [True] * window
        out[k, len(w), sum(cov), hashlib.sha256(" ".join(x for x, c in zip(w, cov) if not c).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window, seed", [(50, 20), (12, 5)])
def test_repeats_match_brute_force(docs, corpus, window, seed):
    got = S.remove_repeats(docs, window=window, seed=seed).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got) == brute_repeats([(r[0], r[1]) for r in corpus], window)
    assert sum(r["n_removed"] for r in got) > 300


def test_repeats_within_one_document_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text + " " + text), (1, text)], "doc_id long, text string")
    assert {r["n_removed"] for r in S.remove_repeats(df).collect()} == {0}


def brute_classes(rows, k=5, threshold=0.8):
    def shingles(t):
        w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else None

    s = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and sum((s[i] & s[j]).values()) >= threshold * sum((s[i] | s[j]).values()):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[top(i)].append(key)
    return Counter((key, min((k for k in groups[top(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows))


def test_classes_match_brute_force(docs, corpus):
    got = N.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes([(r[0], r[1]) for r in corpus])


def test_one_of_each_class_stays(docs, corpus):
    kept = N.keep_one(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    classes = brute_classes([(r[0], r[1]) for r in corpus])
    named = {c for (_, c) in classes if c is not None}
    assert Counter(r["doc_id"] for r in rows if r["doc_id"] is not None) == Counter(sorted(named)) + Counter({5: sum(1 for r in corpus if r[0] == 5 and r[1].startswith("another"))})


def test_large_group_of_near_copies(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    origin = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(origin)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    df, settings = spark.createDataFrame(rows, "doc_id long, text string"), N.Settings(block=64)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df, settings=settings).collect()}
    idf = N.idf_table(df, "text", settings)
    s = N.shingles_of(pa.array([t for _, t in rows]), 5)
    w = N.weights(s, idf)
    bags = [dict(zip(s.hash[a:b].tolist(), w[a:b].tolist())) for a, b in zip(s.first, s.first[1:])]
    up = list(range(300))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(300):
        for j in range(i):
            both = sum(min(x, bags[j][h]) for h, x in bags[i].items() if h in bags[j])
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    wrong = sum(got[i] != top(i) for i in range(300))
    assert len({top(i) for i in range(300)}) > 20
    assert wrong <= 3  # samples miss a link at the very threshold now and then


def test_bound_holds():
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(30)]
    idf = np.full(1 << 10, 1.0, np.float32)
    s = lambda ts: N.shingles_of(pa.array(ts), 1)
    leader = texts[0]
    wl, w, both, lacks, extra = N.weighted_overlap(s([leader] * 30), s(texts), idf)
    for i in range(30):
        _, _, real, _, _ = N.weighted_overlap(s([texts[i]] * 30), s(texts), idf)
        shared = np.minimum(np.minimum(both[i], both), wl - np.maximum(lacks[i], lacks).sum(axis=1))
        assert (shared + np.minimum(extra[i], extra).sum(axis=1) >= real - 1e-6).all()


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(0)
    settings = N.Settings(bands=100, rows=4)
    a = [f"w{i}" for i in range(400)]
    for n in (20, 60, 150):
        b = list(a)
        for i in rng.choice(400, n, replace=False):
            b[i] = f"x{i}"
        s = N.shingles_of(pa.array([" ".join(a), " ".join(b)]), 1)
        sig = N.Sampler(settings).sign(s, s.count.astype(np.float32))
        assert abs((sig[0] == sig[1]).mean() - (400 - n) / (400 + n)) < 0.09


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty(empty):
    assert S.remove_repeats(empty).count() == N.near_duplicates(empty).count() == N.keep_one(empty).count() == 0


def test_bounds_of_very_long_texts_stay_bounds():
    import numpy as np

    from variloom.llm import neardup

    lacks, extra = np.array([[1.0, 7e4, 1e9]]), np.array([[1.0, 7e4, 1e9]])
    got = neardup.half(lacks, extra).astype(np.float64)
    assert np.isfinite(got[:, :3]).all() and (got[:, :3] <= lacks).all() and (got[:, 3:] >= extra).all()
