"""Quality rules whose cutoffs come with a bound on false rejection.

A rule rejects a document when its score (a share in thousandths) lies above a cutoff.  The
cutoffs are chosen on labelled documents, per stratum: from the most lenient to the strictest,
each is tested by the exact binomial distribution for its false-rejection rate among good
documents, and the first that fails ends the sequence (fixed-sequence testing, which needs no
correction along it).  One sequence lowers all rules' cutoffs together and has half of the
``risk`` and of the level ``delta``; one for each rule alone shares the other half, and levels
are shared over the strata as well (Bonferroni).  So with probability 1 - ``delta`` at least,
no stratum loses more than ``risk`` of its good documents.  Of the cutoffs that pass, the one
is taken that rejects most bad documents against good ones (one good weighs ``COST`` bad), the
more lenient of equals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, limit_batches, materialize, release_memory

SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?"
RULES = ("symbols", "capitals", "marks", "dup_lines", "repeats")
#: Scores are compared in steps of this many thousandths.
STEP = 20
TOP = 1000 // STEP
#: The largest of all scores, for the cutoff that all rules share.
JOINT = "joint"
COST = 5

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long"


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    v = np.uint64(len(seen))
    if len(seen) < 1 << 21:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The columns of FEATURES for one text; a null text has none of anything."""
    if not text:
        return (0,) * 8
    data = text.encode()
    words = data.split()
    n_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), n_chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(data) - len(data.translate(None, CAPITALS)), len(data) - len(data.translate(None, MARKS)),
    )


def _features(texts: pd.Series) -> pd.DataFrame:
    rows = np.array([text_features(t) for t in texts], dtype=np.int64).reshape(-1, 8)
    release_memory()
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


def features(text: Column) -> Column:
    """The base counts of a whole text as a struct."""
    return F.pandas_udf(_features, FEATURES)(text)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def scores(f: Column) -> dict[str, Column]:
    """Each rule's score in steps, 0 to TOP."""

    def share(part: str, whole: str) -> Column:
        return F.least(F.lit(TOP), F.floor(1000 * f[part] / F.greatest(f[whole], F.lit(1)) / STEP)).cast("int")

    pairs = (("n_symbols", "word_chars"), ("n_capitals", "word_chars"), ("n_marks", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
    each = {rule: share(*pair) for rule, pair in zip(RULES, pairs, strict=True)}
    return each | {JOINT: F.greatest(*each.values())}


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(a + 1) + math.lgamma(n - a + 1) for a in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


@dataclass(frozen=True)
class Cutoffs:
    """Per stratum and rule, the highest score that is not rejected; TOP rejects nothing."""

    risk: float
    delta: float
    by_stratum: dict = field(default_factory=dict)

    def rejects(self, f: Column, stratum: Column) -> Column:
        """The names of the rules that reject a row."""
        name, score = F.coalesce(stratum.cast("string"), F.lit("")), scores(f)
        hits = []
        for rule in RULES:
            pairs = [x for s, c in sorted(self.by_stratum.items()) if c[rule] < TOP for x in (F.lit(s), F.lit(c[rule]))]
            if pairs:
                cutoff = F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(TOP))
                hits.append(F.when(score[rule] > cutoff, F.lit(rule)))
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def best_admissible(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int:
    """The most useful cutoff of those that pass in sequence; counts are by score."""
    n_good, n_bad, best, cutoff = int(good.sum()), int(bad.sum()), 0.0, TOP
    for c in range(TOP - 1, -1, -1):
        lost = int(good[c + 1 :].sum())
        if binomial_at_most(lost, n_good, risk) > level:
            break
        gain = int(bad[c + 1 :].sum()) / max(1, n_bad) - COST * lost / max(1, n_good)
        if gain > best:
            best, cutoff = gain, c
    return cutoff


def select_cutoffs(counts: list[tuple[str, str, int, int, int]], risk: float, delta: float) -> Cutoffs:
    """counts: (stratum, rule or JOINT, score, good documents with it, bad ones)."""
    hist: dict[str, dict[str, np.ndarray]] = {}
    for stratum, rule, score, *n in counts:
        hist.setdefault(stratum, {r: np.zeros((TOP + 1, 2), dtype=np.int64) for r in (*RULES, JOINT)})[rule][score] += n
    level, out = delta / 2 / max(1, len(hist)), {}
    for stratum, rules in hist.items():
        joint = best_admissible(rules[JOINT][:, 0], rules[JOINT][:, 1], risk / 2, level)
        out[stratum] = {r: min(joint, best_admissible(rules[r][:, 0], rules[r][:, 1], risk / 2 / len(RULES), level / len(RULES))) for r in RULES}
    return Cutoffs(risk, delta, out)


def fit_cutoffs(scored: DataFrame, labels: DataFrame, f: str = "f_", stratum: str = "lang", key: str = "doc_id", quality: str = "quality", risk: float = 0.05, delta: float = 0.05) -> Cutoffs:
    """Choose cutoffs on the labelled rows of ``scored`` (columns: key, stratum, features struct).

    Good are the ids whose labels are all 1; null labels and ids don't count.  Rows that fail
    the base are left out, as the rules never judge them.  Only counts per stratum, rule and
    score reach the driver (at most 51 x 6 rows a stratum).  Without labels, nothing is rejected.
    """
    told = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key_")).agg((F.min(quality) == 1).alias("good_"))
    used = scored.where(~base_failed(F.col(f))).select(F.col(key).alias("key_"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum_"), *(s.alias(r) for r, s in scores(F.col(f)).items()))
    rows = used.join(told, "key_").select("stratum_", "good_", F.explode(F.create_map(*(x for r in (*RULES, JOINT) for x in (F.lit(r), F.col(r))))).alias("rule_", "score_"))
    counts = rows.groupBy("stratum_", "rule_", "score_").agg(F.count_if("good_"), F.count_if(~F.col("good_"))).collect()
    return select_cutoffs([tuple(r) for r in counts], risk, delta)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: key, base counts, base_failed, rejected_by (rules), kept.

    A null or empty text has no words and fails the base; null strata are one stratum; rows
    repeated are judged each by itself; an empty table gives no rows.
    """
    limit_batches(docs.sparkSession)
    scored = materialize(docs.select(F.col(key).alias(key), F.col(stratum).alias(stratum), features(F.col(text)).alias("f_")), "quality-features")
    cutoffs = fit_cutoffs(scored, labels, stratum=stratum, key=key, risk=risk, delta=delta)
    f = F.col("f_")
    rejected = F.when(base_failed(f), F.array().cast("array<string>")).otherwise(cutoffs.rejects(f, F.col(stratum)))
    return scored.select(key, stratum, "f_.*", base_failed(f).alias("base_failed"), rejected.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that pass the base and the rules, with their own columns.

    The counts are taken twice, once to fit and once to filter: writing the texts out
    between would move more than it saves.
    """
    limit_batches(docs.sparkSession)
    cutoffs = fit_cutoffs(docs.select(F.col(key).alias(key), F.col(stratum).alias(stratum), features(F.col(text)).alias("f_")), labels, stratum=stratum, key=key, risk=risk, delta=delta)
    name = fresh("f_", docs.columns)
    counted = docs.withColumn(name, features(F.col(text)))
    return counted.where(~base_failed(F.col(name)) & (F.size(cutoffs.rejects(F.col(name), F.col(stratum))) == 0)).select(*docs.columns)

