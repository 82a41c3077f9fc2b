"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of fixed patterns for mail addresses, IP addresses, card and phone
numbers, and tokens shaped like keys.  Identifier-like tokens are candidates; what stands before one (one word, two words,
or a ``name=`` within the token) are its lexical patterns.  A pattern's score is the share of
its occurrences whose instances are believed to be identifiers, and an instance is believed
as much as its best pattern (seeds fully); the two are computed in turns over the graph of
patterns and instances.  Tokens that patterns of high score introduce are found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_hash

#: Fixed patterns, in the order in which kinds that start together are listed.
SEEDS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = "context"
#: Tokens of such a shape (long, of letters and digits both) are seeds as well: keys and secrets.
#: They are found, as all others, only where a pattern of high score introduces them.
KEY_SHAPE = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}$"
KINDS = (*SEEDS, FOUND)
#: A run of non-white characters with a digit.
TOKEN = r"[^\s0-9]*+[0-9]\S*+"
OPEN, CLOSE = "\u0001", "\u0002"


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _parts(text: Column, pattern: str, guard: Column) -> Column:
    """The text cut at the matches: every second part is one.  Null where ``guard`` is false."""
    clean = F.translate(text, OPEN + CLOSE, "\u0003\u0003")
    return F.when(guard, F.split(F.regexp_replace(clean, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]"))


#: Parts whose ends are summed up together.
STRETCH = 256


def _ends(parts: Column) -> Column:
    """Where each part ends, in code points; sums run within stretches of parts, then over them."""
    def running(lengths: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + n)).alias("all")))["all"]

    lengths = F.transform(parts, lambda p: F.length(p))
    stretch = lambda c: F.slice(lengths, c * STRETCH + 1, F.lit(STRETCH))
    cuts = _steps(F.ceil(F.size(parts) / STRETCH).cast("int"))
    sums = running(F.transform(cuts, lambda c: F.aggregate(stretch(c), F.lit(0), lambda a, n: a + n)), F.lit(0))
    return F.flatten(F.transform(cuts, lambda c: running(stretch(c), F.coalesce(F.get(sums, c - 1), F.lit(0)))))


def _spans(parts: Column, ends: Column) -> Column:
    one = lambda i: F.struct(F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end"), F.get(parts, 2 * i + 1).alias("value"))
    return F.coalesce(F.transform(_steps(F.floor(F.size(parts) / 2).cast("int")), one), F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _tokens(parts: Column, ends: Column) -> Column:
    """Spans with the last word before them (w1) and the one before that (w2), empty where there is none."""

    def one(i: Column) -> Column:
        # Two tokens back at most lie two words; reversed, the words before come first.
        before = F.concat(*(F.coalesce(F.get(parts, 2 * i - k), F.lit("")) for k in (4, 3, 2, 1, 0)))
        back = F.reverse(before)
        word = lambda pattern: F.reverse(F.regexp_extract(back, pattern, 1))
        return F.struct(F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end"), F.get(parts, 2 * i + 1).alias("value"), word(r"^\s++(\S++)").alias("w1"), word(r"^\s++\S++\s++(\S++)").alias("w2"))

    return F.coalesce(F.transform(_steps(F.floor(F.size(parts) / 2).cast("int")), one), F.array().cast("array<struct<start:int,end:int,value:string,w1:string,w2:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _valid(spans: Column, kind: str) -> Column:
    keep = F.filter(spans, lambda s: VALID[kind](s["value"]))
    return F.transform(keep, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id_, k1_, k2_ (of the text), base_ (valid seed spans in order), tokens_ (candidates)."""
    k1, k2 = row_hash(text)
    df = docs.select(F.col(key).alias("id_"), k1.alias("k1_"), k2.alias("k2_"), F.coalesce(F.col(text), F.lit("")).alias("t_"))
    df = df.withColumn("digit_", F.col("t_").rlike("[0-9]"))
    guards = {"email": F.contains("t_", F.lit("@")), "ip": F.col("digit_"), "card": F.col("digit_"), "phone": F.col("digit_") & F.contains("t_", F.lit("+")), "token": F.col("digit_")}
    patterns = SEEDS | {"token": TOKEN}
    rest = ["id_", "k1_", "k2_"]
    df = df.select(*rest, *(_parts(F.col("t_"), p, guards[k]).alias(f"p_{k}") for k, p in patterns.items()))
    df = df.select("*", *(_ends(F.col(f"p_{k}")).alias(f"e_{k}") for k in patterns))
    df = df.select(*rest, *((_tokens if k == "token" else _spans)(F.col(f"p_{k}"), F.col(f"e_{k}")).alias(f"s_{k}") for k in patterns))
    base = [_valid(F.col(f"s_{kind}"), kind) for kind in SEEDS]
    return df.select(*rest, F.array_sort(F.concat(*base)).alias("base_"), F.col("s_token").alias("tokens_"))


def _candidates(scanned: DataFrame) -> DataFrame:
    """One row per distinct text and identifier-like token: k1_, k2_, start, end, instance, seed, patterns."""
    df = scanned.where(F.size("tokens_") > 0).select("k1_", "k2_", "base_", F.explode("tokens_").alias("t"))
    lead = F.regexp_extract(F.col("t.value"), r"""^(?:[A-Za-z][A-Za-z_-]*[=:])?["'(\[<]*""", 0)
    tail = F.regexp_extract(F.col("t.value"), r"""["')\]>.,;:!?]*$""", 0)
    df = df.select("k1_", "k2_", "base_", (F.col("t.start") + F.length(lead)).alias("start"), (F.col("t.end") - F.length(tail)).alias("end"), F.col("t.value").alias("v"), lead.alias("lead"), tail.alias("tail"), "t.w1", "t.w2")
    core = F.expr("substring(v, length(lead) + 1, length(v) - length(lead) - length(tail))")
    name = F.regexp_extract("lead", r"^([A-Za-z][A-Za-z_-]*[=:])", 1)
    patterns = F.array_compact(F.array(
        F.when(name != "", F.concat(F.lit("in "), F.lower(name))),
        F.when((name == "") & (F.col("w1") != ""), F.concat(F.lit("one "), F.lower("w1"))),
        F.when((name == "") & (F.col("w2") != ""), F.concat(F.lit("two "), F.lower("w2"), F.lit(" "), F.lower("w1"))),
    ))
    known = F.exists("base_", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    seed = known | core.rlike(KEY_SHAPE)
    df = df.select("k1_", "k2_", "start", "end", F.lower(core).alias("instance"), known.alias("known"), seed.alias("seed"), patterns.alias("patterns"))
    likely = (F.length("instance") >= 5) & (F.length(_digits(F.col("instance"))) >= 2)
    return df.where((likely | F.col("seed")) & (F.size("patterns") > 0))


def bootstrap(candidates: DataFrame, rounds: int = 10, still: float = 0.005) -> DataFrame:
    """Patterns with their score and support (distinct instances).

    Beliefs and scores only rise from round to round; rounds end when no score moves by more
    than ``still``, after ``rounds`` at the latest.
    """
    edges = candidates.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = materialize(edges, "pattern-edges")
    seeds = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("seed"))
    belief, patterns = materialize(seeds.withColumnRenamed("seed", "belief"), "beliefs"), None
    for _ in range(rounds):
        scored = edges.join(belief, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / (F.sum("n") + 1)).alias("score"), F.count("*").alias("support"))
        if patterns is not None:
            scored = scored.join(patterns.select("pattern", F.col("score").alias("old")), "pattern").withColumn("moved", F.col("score") - F.col("old"))
        new = materialize(scored, "patterns")
        done = patterns is not None and not new.where(F.col("moved") > still).head(1)
        patterns = new.select("pattern", "score", "support")
        if done:
            break
        best = edges.join(patterns.where("support > 1"), "pattern").groupBy("instance").agg(F.max("score").alias("best"))
        belief = materialize(seeds.join(best, "instance", "left").select("instance", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("belief")), "beliefs")
    return patterns


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 10, least_score: float = 0.7, least_support: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, k1_, k2_ (``row_hash`` of the text), base (seed spans), spans (all).

    A span has start, order (of its kind), end, kind; places are code points, the end
    exclusive.  A null or empty text has none; repeated rows get equal results; equal texts
    count as often as they occur; an empty table gives no rows.
    """
    scanned = materialize(_scanned(docs, key, text), "scanned")
    candidates = materialize(_candidates(scanned), "candidates")
    good = bootstrap(candidates, rounds).where((F.col("score") >= least_score) & (F.col("support") >= least_support)).select("pattern")
    new = candidates.where(~F.col("known")).select("k1_", "k2_", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    span = F.struct("start", F.lit(len(SEEDS)).alias("order"), "end", F.lit(FOUND).alias("kind"))
    # Written, so that the join reads plain exchanges, which Spark splits where many rows share a text.
    new = materialize(new.groupBy("k1_", "k2_").agg(F.collect_set(span).alias("new_")), "found")
    out = scanned.select("id_", "k1_", "k2_", "base_").join(new, ["k1_", "k2_"], "left")
    spans = F.when(F.col("new_").isNull(), F.col("base_")).otherwise(F.array_sort(F.concat("base_", F.col("new_").cast(scanned.schema["base_"].dataType))))
    return out.select(F.col("id_").alias(key), "k1_", "k2_", F.col("base_").alias("base"), spans.alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 10, least_score: float = 0.7, least_support: int = 3) -> DataFrame:
    """``docs`` with its columns, each span in the text replaced by its kind in brackets.

    Spans that overlap go as one, under the name of the first.
    """
    found = find(docs, key, text, rounds, least_score, least_support).where(F.size("spans") > 0)
    a, b, c = (fresh(n, docs.columns) for n in ("k1_", "k2_", "spans_"))
    found = found.select(F.col("k1_").alias(a), F.col("k2_").alias(b), F.col("spans").alias(c)).dropDuplicates([a, b])
    k1, k2 = row_hash(text)
    joined = docs.withColumns({a: k1, b: k2}).join(found, [a, b], "left")
    spans, t = F.col(c), F.col(text)
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"])), F.lit(0))

    def piece(s: Column, i: Column) -> Column:
        past = reach(i)
        return F.when(s["start"] >= past, F.concat(t.substr(past + 1, s["start"] - past), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    cleaned = F.when(spans.isNull(), t).otherwise(F.concat(F.array_join(F.transform(spans, piece), ""), t.substr(last + 1, F.length(t))))
    return joined.withColumn(text, cleaned).select(*docs.columns)
