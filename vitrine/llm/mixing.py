"""Mixing to target weights with soft domain membership.

A classifier of evidence words, fitted on a bounded labelled sample, gives each document a posterior over domains; rows
with a label of their own have that domain. Document rates r >= 0 then solve a least-squares problem by projected gradient
descent: the expected tokens of each domain, ``sum_d r_d t_d p_dk``, should meet its target, with a small pull of every
rate to 1. An iteration is one aggregation to a row of K numbers and one update per document. DataFrame code throughout."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import written
from vitrine.llm.quality_rules import labelled_sample

#: Labelled documents that the classifier is fitted on, at most (those with the lowest hashes of their ids). Each gives
#: its distinct words once, which bounds the vocabulary.
SAMPLE_ROWS = 10_000
#: A word's log-odds count for what they exceed this many standard errors plus this dead zone.
ERRORS, DEAD = 2.5, 1.0
#: Documents that each word is taken to stand in besides, spread over the domains as the sample is: a word of few documents
#: of a small domain is no evidence.
PRIOR = 3.0
#: Words that the classifier weighs, at most, the heaviest; they go to the driver and, as a map, to every executor.
MAX_WORDS = 20_000
ITERATIONS, PULL = 24, 0.02
#: Iterations folded into one expression before the rates are written.
FOLD = 8

DOMAINS = ("clean", "low", "toxic")


def domain_label() -> Column:
    """The domain of a row of ``labels``."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _tokens(text: str) -> Column:
    """The distinct lower-case words of a text column without ASCII punctuation, and marks of style."""
    share = lambda pattern: F.expr(f"floor(20 * length(regexp_replace({text}, '{pattern}', '')) / greatest(1, length({text})))").cast("int").cast("string")
    style = F.array(
        F.concat(F.lit("#upper"), share("[^A-Z]+")),
        F.concat(F.lit("#symbol"), share("[^#*$%&|<>]+")),
        F.concat(F.lit("#mark"), share("[^!?]+")),
        F.concat(F.lit("#digit"), share("[^0-9]+")),
    )
    words = F.expr(rf"split(lower({text}), '[\\x20-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\x09-\\x0D]+')")
    return F.array_remove(F.array_distinct(F.concat(words, style)), "")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _h, n_words); a null text is empty."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')").cast("long")
    return d.select("doc_id", "text", F.xxhash64("text").alias("_h"), n.alias("n_words"))


def fit(docs: DataFrame, labels: DataFrame, domain: Column, domains: tuple[str, ...] = DOMAINS, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The classifier: for each domain but the base, which is the most frequent of the sample, its ``prior`` log-odds
    against the base, the log-odds ``none`` of documents without a word of its ``words``, and these words' weights.

    A word's weight is its smoothed log-odds ratio between the domain and the rest, over all words of the sample, shrunk by
    ERRORS standard errors and DEAD; what isn't positive then is no evidence. So rare words and the many faint ones that go
    with a language count for nothing. Equal texts are one. Without labelled rows the base is the first domain."""
    sample = labelled_sample(docs, labels, domain, sample_rows).select(F.coalesce("text", F.lit("")).alias("text"), "_y")
    sample = sample.groupBy(F.xxhash64("text").alias("_h")).agg(F.min("_y").alias("_y"), F.first("text").alias("text"))
    sample = written(sample.select("_y", _tokens("text").alias("has")), "labelled")
    size = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    total = sum(size.get(k, 0) for k in domains)
    base = max(domains, key=lambda k: size.get(k, 0))
    model = {"domains": domains, "base": base, "of": {}}
    few = [k for k in domains if 0 < size.get(k, 0) < total and k != base]
    for k in domains:
        if k != base:
            model["of"][k] = {"prior": math.log((size.get(k, 0) + 0.5) / (size.get(base, 0) + 0.5)), "words": {}}
            model["of"][k]["none"] = model["of"][k]["prior"]
    if not few:
        return model
    counts = sample.select("_y", F.explode("has").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *[F.count_if(F.col("_y") == k).alias(f"_{i}") for i, k in enumerate(few)])
    weights = []
    for i, k in enumerate(few):
        mine, rest = PRIOR * size[k] / total, PRIOR * (1 - size[k] / total)
        a, b = F.col(f"_{i}") + mine, F.col("n") - F.col(f"_{i}") + rest
        c, d = F.lit(size[k] + 2 * mine) - a, F.lit(total - size[k] + 2 * rest) - b
        weights.append((F.log(a / c) - F.log(b / d) - F.lit(ERRORS) * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d) - F.lit(DEAD)).alias(f"w{i}"))
    heaviest = F.greatest(*[F.col(f"w{i}") for i in range(len(few))], F.lit(0.0))
    found = counts.select("token", *weights).where(heaviest > 0).orderBy(heaviest.desc(), "token").limit(MAX_WORDS).collect()
    found.sort(key=lambda r: r["token"])
    for i, k in enumerate(few):
        model["of"][k]["words"] = {r["token"]: r[f"w{i}"] for r in found if r[f"w{i}"] > 0}
    held = sample.select("_y", *[F.size(F.array_intersect("has", _strings(list(model["of"][k]["words"])))).alias(f"_{i}") for i, k in enumerate(few)])
    none = held.agg(*[F.count_if((F.col("_y") == y) & (F.col(f"_{i}") == 0)).alias(f"{x}{i}") for i, k in enumerate(few) for x, y in (("a", k), ("b", base))]).first()
    for i, k in enumerate(few):
        model["of"][k]["none"] = math.log((none[f"a{i}"] + 0.5) / (none[f"b{i}"] + 0.5))
    return model


def _strings(words: list[str]) -> Column:
    """A constant array, folded once however long it is."""
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def _looked_up(words: str, table: dict[str, float]) -> Column:
    found = F.from_json(F.lit(json.dumps(table)), "map<string,double>")
    return F.transform(words, lambda w: F.element_at(found, w))


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, _h, n_words, copies, p): posterior per domain, computed row by row. Rows of equal id and text are one row
    with ``copies``."""
    d = texts(docs).withColumn("_t", _tokens("text"))
    every = sorted({w for k in model["of"].values() for w in k["words"]})
    d = d.withColumn("_has", F.array_intersect("_t", _strings(every))) if every else d.withColumn("_has", F.array().cast("array<string>"))
    odds = []
    for k in model["domains"]:
        if k == model["base"]:
            odds.append(F.lit(0.0))
            continue
        of = model["of"][k]
        adds = F.filter(_looked_up("_has", of["words"]), lambda x: x.isNotNull())
        score = F.aggregate(adds, F.lit(of["prior"]), lambda a, x: a + x)
        odds.append(F.when(F.size(adds) > 0, score).otherwise(F.lit(of["none"])) if of["words"] else F.lit(of["none"]))
    d = d.withColumn("_s", F.array(*odds)).withColumn("_e", F.expr("transform(_s, x -> exp(x - array_max(_s)))"))
    d = d.select("doc_id", "_h", "n_words", F.expr("transform(_e, x -> x / aggregate(_e, 0D, (a, y) -> a + y))").alias("p"))
    return d.groupBy("doc_id", "_h", "n_words").agg(F.count("*").alias("copies"), F.first("p").alias("p"))


def with_labels(soft: DataFrame, labels: DataFrame, domain: Column, domains: tuple[str, ...]) -> DataFrame:
    """``soft`` with the labelled rows' posteriors set to their domains; of several labels for an id the smallest counts."""
    y = labels.select(F.col("doc_id").alias("_d"), domain.alias("_y")).where(F.col("_d").isNotNull() & F.col("_y").isin(*domains))
    y = y.groupBy("_d").agg(F.min("_y").alias("_y"))
    one = F.array(*[F.when(F.col("_y") == k, 1.0).otherwise(0.0) for k in domains])
    d = soft.join(y, soft["doc_id"] == y["_d"], "left")
    return d.withColumn("p", F.when(F.col("_y").isNotNull(), one).otherwise(F.col("p"))).select(soft.columns)


def solve(soft: DataFrame, targets: list[float], iterations: int = ITERATIONS, pull: float = PULL) -> DataFrame:
    """Add ``rate`` to ``soft`` (``n_words``, ``copies``, ``p``): nonnegative rates whose expected token totals meet the
    ``targets``.

    The gradient is scaled by each document's tokens, so the step does not depend on their number. A table without
    tokens gets rates of 1."""
    k = len(targets)
    t = F.col("n_words") * F.col("copies")
    base = soft.agg(*[F.sum(t * F.col("p")[i]).alias(f"t{i}") for i in range(k)]).first()
    base = [base[i] or 0.0 for i in range(k)]
    scale = [max(a, b, 1.0) for a, b in zip(targets, base)]
    now, steps, step = soft.withColumn("rate", F.lit(1.0)), [], 1 / (1 + pull)

    def rate() -> Column:
        if not steps:
            return F.col("rate")
        rows = ", ".join("array(" + ", ".join(f"{x!r}D" for x in s) + ")" for s in steps)
        dot = " + ".join(f"v[{i}] * p[{i}]" for i in range(k))
        return F.expr(f"aggregate(array({rows}), rate, (r, v) -> greatest(0D, r - {step!r}D * ({dot} + {pull!r}D * (r - 1D))))")

    for j in range(iterations if sum(base) else 0):
        got = now.agg(*[F.sum(t * F.col("p")[i] * rate()).alias(f"t{i}") for i in range(k)]).first()
        steps.append([(got[i] - targets[i]) / scale[i] for i in range(k)])
        if len(steps) == FOLD:
            now, steps = written(now.withColumn("rate", rate()), "rates"), []
    return now.withColumn("rate", rate())


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], budget: float | None = None, domain: Column | None = None, anchor: str | None = None) -> DataFrame:
    """Rates that bring ``docs`` (``doc_id``, ``text``) to the target ``shares`` of tokens per domain.

    ``budget`` is the number of tokens of the mixture, by default that of the corpus; with ``anchor`` it is such that this
    domain's target is its present expected total, and the rates are scaled to meet that one exactly. Returns ``doc_id,
    n_words, copies, p`` (posteriors in the order of ``shares``), ``_h`` (a hash of the text) and ``rate``, one row for each
    distinct (id, text). Null and empty texts have no tokens and rates near 1. An empty table gives no rows."""
    domains = tuple(shares)
    label = domain_label() if domain is None else domain
    model = fit(docs, labels, label, domains)
    soft = written(with_labels(posteriors(docs, model), labels, label, domains), "posteriors")
    t = F.col("n_words") * F.col("copies")
    row = soft.agg(F.sum(t).alias("all"), *[F.sum(t * F.col("p")[i]).alias(f"t{i}") for i in range(len(domains))]).first()
    total = sum(shares.values())
    if anchor is None:
        budget = (row["all"] or 0) if budget is None else budget
        return solve(soft, [budget * shares[k] / total for k in domains])
    now = row[f"t{domains.index(anchor)}"] or 0.0
    budget = now * total / shares[anchor] if budget is None else budget
    rates = written(solve(soft, [budget * shares[k] / total for k in domains]), "rates")
    met = rates.agg(F.sum(t * F.col("p")[domains.index(anchor)] * F.col("rate"))).first()[0] or 0.0
    goal = budget * shares[anchor] / total
    return rates.withColumn("rate", F.col("rate") * F.lit(goal / met if met and goal else 1.0))


def apply_rates(docs: DataFrame, rates: DataFrame, seed: int = 23) -> DataFrame:
    """Repeat or leave out each row of ``docs`` by its rate: the whole part, and one more with the rest's chance, drawn by a
    hash of the id and text. Any other columns pass through."""
    r = rates.select(F.col("doc_id").alias("_d"), F.col("_h"), F.col("rate").alias("_rate"))
    d = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_g", F.xxhash64(F.coalesce("_row.text", F.lit(""))))
    u = F.pmod(F.xxhash64(F.lit(seed), "_row.doc_id", "_g"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    d = d.join(r, d["_row.doc_id"].eqNullSafe(r["_d"]) & (d["_g"] == r["_h"]))
    n = F.floor(F.col("_rate") + u).cast("int")
    return d.select("_row", F.explode(F.array_repeat(F.lit(0), n))).select("_row.*")
