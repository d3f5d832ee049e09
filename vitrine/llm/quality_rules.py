"""Quality rules: a learned decision list over text statistics, as Spark conditional expressions.

Sequential covering: a rule grows by the threshold condition with the best information gain over the labelled rows that no
earlier rule covers, is pruned on held-out rows, and joins the list if it stays precise there. All of it, statistics and
counts included, is DataFrame code; the driver sees only counts per feature and threshold."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import fresh, written

#: Labelled rows that the list is fitted on, at most (the lowest hashes of their ids).
SAMPLE_ROWS = 20_000
#: Candidate thresholds of a feature.
THRESHOLDS = 24
MAX_RULES = 8
#: Rules that may fail on the pruning rows before the list ends.
MAX_FAILED = 3
MAX_CONDITIONS = 3
#: A rule must reject with this precision on the growing and on the pruning rows, and cover so many of the latter.
MIN_PRECISION = 0.98
MIN_COVERED = 2

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = r"[\\x20\\x09-\\x0D]+"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the text statistics to ``docs``: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (all long) and ``_more``, a struct of further ones; columns of these names are replaced, all others
    stay. Null texts count as empty.

    Equal words and windows are told by 64-bit hashes within one text; everything else is exact."""
    u = fresh(docs)
    t, w, l, h, s = (f"{u}{x}" for x in "twlhs")
    d = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(w, F.expr(f"array_remove(split({t}, '{_SPACE}'), '')"))
    d = d.withColumn(l, F.expr(rf"filter(split({t}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn(h, F.expr(f"CASE WHEN size({w}) >= 5 THEN transform(sequence(0, size({w}) - 5), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2), get({w}, i + 3), get({w}, i + 4))) ELSE array() END"))
    # windows sorted with their places; those with an equal neighbour repeat; each covers five words, overlaps once
    covered = f"""
        aggregate(transform(array(sort_array(transform({h}, (h, i) -> struct(h, i)))), s ->
          aggregate(transform(array(sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i))), p ->
            aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0L, (a, x) -> a + x)), 0L, (a, x) -> a + x)), 0L, (a, x) -> a + x)"""
    n = lambda c, name: F.expr(c).cast("long").alias(name)
    made = F.struct(
        n(f"size({w})", "n_words"),
        n(f"length(regexp_replace({t}, '{_SPACE}', ''))", "word_chars"),
        n(f"length(regexp_replace({t}, '[^#*$%&|<>]+', ''))", "n_symbols"),
        n(f"size({l}) - size(array_distinct({l}))", "n_dup_lines"),
        n(f"CASE WHEN size(array_distinct({h})) = size({h}) THEN 0L ELSE {covered} END", "n_repeat_words"),
        F.struct(
            n(f"size({l})", "n_lines"),
            n(f"length(regexp_replace({t}, '[^A-Z]+', ''))", "n_upper"),
            n(f"length(regexp_replace({t}, '[^!?]+', ''))", "n_marks"),
            n(f"length(regexp_replace({t}, '[^0-9]+', ''))", "n_digits"),
        ).alias("_more"),
    )
    # A generator of one row. A later filter on a statistic would else be pushed below the columns that it is made of,
    # and these written out again at each place where they are used.
    d = d.withColumn(s, F.explode(F.array(made)))
    keep = [c for c in docs.columns if c not in (*STATISTICS, "_more")]
    return d.select(*keep, f"{s}.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Features of the rules: sizes and shares. None is null."""
    n, m = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.col("_more")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(m["n_lines"], F.lit(1)).cast("double")
    return {
        "words": n,
        "chars_per_word": F.col("word_chars") / n,
        "words_per_line": n / lines,
        "symbols_per_word": F.col("n_symbols") / n,
        "marks_per_word": m["n_marks"] / n,
        "upper_share": m["n_upper"] / chars,
        "digit_share": m["n_digits"] / chars,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that rejects, else null."""
    of, out = features(), None
    for i, rule in enumerate(rules):
        out = F.when(_holds(rule, of), i) if out is None else out.when(_holds(rule, of), i)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int = SAMPLE_ROWS, key: str = "doc_id") -> DataFrame:
    """(key, text, _y) of at most ``rows`` labelled documents; only their ids and labels are sent to the executors.
    Null ids and labels are left out; of several labels for an id the smallest counts."""
    y = labels.select(key, label.alias("_y")).where(F.col(key).isNotNull() & F.col("_y").isNotNull()).groupBy(key).agg(F.min("_y").alias("_y"))
    y = y.orderBy(F.xxhash64(key), key).limit(rows)
    return docs.select(key, "text").join(F.broadcast(y), key)


def learn(docs: DataFrame, labels: DataFrame, label: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn the list from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id`` and ``label``, by default ``quality``:
    0 is to be rejected, 1 kept). Without labelled rows of both kinds it is empty."""
    label = F.col("quality") if label is None else label
    of = features()
    sample = statistics(labelled_sample(docs, labels, label, sample_rows))
    sample = sample.select((F.col("_y") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(3)) < 2).alias("grow"), *[c.alias(f) for f, c in of.items()])
    sample = written(sample.withColumn("_id", F.monotonically_increasing_id()), "labelled")
    names, plain = list(of), {f: F.col(f) for f in of}
    points = [i / THRESHOLDS for i in range(THRESHOLDS)]
    # thresholds of the rejected and of the kept rows: either crowd may be the narrow one
    found = sample.groupBy("bad").agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in names]).collect()
    if len(found) < 2:
        return []
    cuts = {f: sorted({x for r in found for x in r[f]}) for f in names}
    bucket = [F.expr(f"size(filter(array({', '.join(f'{float(x)!r}D' for x in cuts[f])}), x -> x < {f}))") for f in names]
    sample = written(sample.select("bad", "grow", *names, F.array(*bucket).alias("_b")), "buckets")

    def grown(rest: Column, banned: set[str]) -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            at = sample.where(F.col("grow") & rest & _holds(rule, plain)).select("bad", F.posexplode("_b").alias("f", "b"))
            counts = at.groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            p0, n0 = (sum(r[k] for r in counts if r["f"] == 0) for k in ("p", "n"))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for i, f in enumerate(names):
                if not rule and f in banned:
                    continue
                below = {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == i}
                p = n = 0
                for k, cut in enumerate(cuts[f]):
                    p, n = p + below.get(k, (0, 0))[0], n + below.get(k, (0, 0))[1]
                    for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                        if a:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                            best = max(best, (gain, Condition(f, above, cut)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule = (*rule, best[1])
        return rule

    def pruned(rule: Rule, rest: Column) -> tuple[Rule, float, int]:
        while True:
            options = [rule, *([rule[:i] + rule[i + 1 :] for i in range(len(rule))] if len(rule) > 1 else [])]
            exprs = [F.count_if(_holds(o, plain) & y).alias(f"{k}{i}") for i, o in enumerate(options) for k, y in (("p", F.col("bad")), ("n", ~F.col("bad")))]
            got = sample.where(~F.col("grow") & rest).agg(*exprs).first()
            worth = [(got[f"p{i}"] - got[f"n{i}"]) / max(1, got[f"p{i}"] + got[f"n{i}"]) for i in range(len(options))]
            top = max(range(len(options)), key=lambda i: (worth[i], -len(options[i]), -i))
            if not top:
                seen = sample.where(F.col("grow") & rest & _holds(rule, plain)).agg(F.count_if("bad").alias("p"), F.count("*").alias("n")).first()
                return rule, min(got["p0"] / max(1, got["p0"] + got["n0"]), seen["p"] / max(1, seen["n"])), got["p0"]
            rule = options[top]

    rules, rest, banned = [], F.lit(True), set()
    while len(rules) < MAX_RULES and len(banned) < MAX_FAILED:
        rule = grown(rest, banned)
        if not rule:
            break
        first = rule[0].feature
        rule, precision, covered = pruned(rule, rest)
        if precision < MIN_PRECISION or covered < MIN_COVERED:
            banned.add(first)  # the next try starts from another feature
            continue
        rules.append(rule)
        rest = rest & ~_holds(rule, plain)
    return rules


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the statistics, ``base_failed``, ``rule`` (number of the rule that rejects, else null) and ``kept`` to
    ``docs``; columns of these names are replaced, and one named ``_more`` goes. Null and empty texts fail the base; repeated rows are judged each; an empty table gives no rows."""
    d = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("_more")
