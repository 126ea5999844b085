"""Quality rules: a learned decision list over statistics of texts, emitted as Spark conditional expressions.

Statistics are array expressions within a row (no shuffle of words).  Rules are learnt by sequential covering: a rule
is a conjunction of thresholds, grown condition by condition for the best gain on two thirds of the labelled rows, then
pruned on the other third to the prefix with the best precision; rows that it covers are left out and the next rule is
grown.  Every count is a Spark aggregation over all labelled rows: per condition the driver reads BINS numbers a
statistic.  The result is an ordered list; a text that no rule rejects is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise

WORD = 8
SYMBOLS = "#*$%&|<>"
BINS = 32
#: The statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "punct_share", "upper_share", "digit_share", "distinct_share", "short_line_share")


def _next(x: Column, by: int) -> Column:
    """x combined with itself `by` places on: hashes of twice as many words."""
    return F.when(F.size(x) > by, F.zip_with(F.slice(x, 1, F.size(x) - by), F.slice(x, by + 1, F.size(x) - by), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def repeat_words(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more; grams: the hashes of the windows in order."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(pairs["h"], 1, F.size(pairs) - 1))
    after = F.concat(F.slice(pairs["h"], 2, F.size(pairs) - 1), F.array(F.lit(None).cast("bigint")))
    linked = F.zip_with(F.zip_with(pairs, before, lambda p, b: F.struct(p["h"].alias("h"), p["i"].alias("i"), F.coalesce(p["h"] == b, F.lit(False)).alias("d"))), after, lambda p, a: F.when(p["d"] | F.coalesce(p["h"] == a, F.lit(False)), p["i"]))
    at = F.sort_array(F.filter(linked, lambda i: i.isNotNull()))
    zero = F.struct(F.lit(-WORD).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WORD), i - s["last"])).alias("n")), lambda s: s["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the statistics of rules for each row of docs(doc_id, text); null text: no words."""
    base = id_text(docs)
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    x = base.select("doc_id", "text", F.transform(words, lambda w: F.xxhash64(w)).alias("h1"), F.filter(F.split("text", "\n"), lambda t: t.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"))
    for size in (1, 2, 4):  # one projection each: an expression that is named twice is computed once
        x = x.withColumn(f"h{2 * size}", _next(F.col(f"h{size}"), size))
    count = lambda cls: F.regexp_count("text", F.lit(cls)).cast("long")
    x = x.select(
        "doc_id",
        F.size("h1").cast("long").alias("n_words"),
        (F.length("text") - count("[ \\t\\n\\x0B\\f\\r]")).cast("long").alias("word_chars"),
        count("[" + SYMBOLS + "]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h8")) < F.size("h8"), repeat_words(F.col("h8"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("h1")).cast("long").alias("n_distinct"),
        F.size(F.filter("lines", lambda t: F.length(t) < 30)).cast("long").alias("n_short_lines"),
        count("[.,;:!?]").alias("n_punct"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return x.select(
        "*",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_punct", "word_chars").alias("punct_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_short_lines", "n_lines").alias("short_line_share"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


@dataclass(frozen=True)
class Rule:
    """Rejects the rows that meet all conditions."""

    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _all(conditions: list[Condition]) -> Column:
    return Rule(tuple(conditions), 0, 0.0).column()


def learn(rows: DataFrame, max_rules: int = 6, max_conditions: int = 3, least_covered: int = 10, least_precision: float = 0.85) -> list[Rule]:
    """Rules that reject rows with good = 0; rows(good int, FEATURES...).  An empty or one-sided table teaches none."""
    rows = rows.filter("good in (0, 1)").withColumn("prune", F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0)
    cuts_row = rows.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 2000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    rules: list[Rule] = []
    left = rows
    stack = ", ".join(f"'{f}', cast({f} as double)" for f in FEATURES)
    edges = F.create_map(*(x for f in FEATURES for x in (F.lit(f), F.array(*(F.lit(float(v)) for v in cuts[f])).cast("array<double>"))))
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            part = left.filter(~F.col("prune")).filter(_all(conditions))
            long = part.select("good", F.expr(f"stack({len(FEATURES)}, {stack}) as (feature, value)"))
            place = F.size(F.filter(edges[F.col("feature")], lambda c: c < F.col("value")))
            found = long.groupBy("feature", place.alias("bin")).agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
            best = _best(found, cuts, least_covered)
            if best is None:
                break
            conditions.append(best)
        if not conditions:
            break
        held = left.filter(F.col("prune"))
        counts = held.agg(*(y for i in range(len(conditions)) for y in (F.count_if(_all(conditions[: i + 1])), F.count_if(_all(conditions[: i + 1]) & (F.col("good") == 0))))).first()
        options = [((counts[2 * i + 1] + 0.5) / (counts[2 * i] + 1.0), counts[2 * i], i + 1) for i in range(len(conditions))]
        precision, covered, keep = max(options, key=lambda o: (round(o[0], 6), o[1], -o[2]))
        if covered < max(1, least_covered // 3) or precision < least_precision:
            break
        rules.append(Rule(tuple(conditions[:keep]), covered, precision))
        left = left.filter(~rules[-1].column())
    return rules


def _best(found: list, cuts: dict[str, list[float]], least: int) -> Condition | None:
    """The threshold with the best gain (weighted log precision) for covering rows that aren't good; None: none gains."""
    import math

    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in found:
        by.setdefault(r["feature"], {})[r["bin"]] = (r["n"] - r["good"], r["good"])
    best: tuple[float, Condition] | None = None
    for f in FEATURES:
        bins = by.get(f, {})
        bad, good = sum(b for b, _ in bins.values()), sum(g for _, g in bins.values())
        if not bad or not good:
            return None
        start = math.log(bad / (bad + good))
        low_bad = low_good = 0
        for i, cut in enumerate(cuts[f]):
            b, g = bins.get(i, (0, 0))
            low_bad, low_good = low_bad + b, low_good + g
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p + n >= least and p:
                    gain = p * (math.log(p / (p + n)) - start)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, Condition(f, above, float(cut)))
    return best[1] if best else None


def verdict(rules: list[Rule]) -> Column:
    """kept: false at the first rule that covers a row, else true, as an ordered conditional expression."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def assess(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Statistics, base_failed, rule (number of the rejecting rule, from 1; null: none) and kept for each row of docs.

    Rules learn from labels(doc_id, quality); null labels and ids teach nothing, a doc_id that is labelled twice counts
    as good if any label is.  Null or empty texts have no words and fail the base rule; repeated rows are judged each;
    null doc_ids stay null.  Extra columns are ignored.
    """
    stats = materialise(statistics(docs), "statistics")
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("good")).filter("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.max("good").alias("good"))
    rules = learn(materialise(stats.filter("not base_failed").join(marked, "doc_id").select("good", *FEATURES), "labelled"), **limits)
    out = stats.withColumn("verdict", verdict(rules))
    number = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        number = F.when(r.column(), F.lit(i)).otherwise(number)
    return out.withColumn("rule", number).withColumn("kept", ~F.col("base_failed") & F.col("verdict")).drop("verdict")
