"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Each rule compares one figure of a document with a cutoff. Cutoffs come from labelled
documents: for every stratum and rule, a grid of cutoffs is tested from loose to strict with
the exact binomial tail of the good documents a cutoff would reject. A cutoff counts as
certified while the tail stays below ``delta / (rules x strata)`` (Bonferroni over rules and
strata; the fixed order needs no correction inside a grid). With probability ``1 - delta``
no certified set of cutoffs rejects more than ``alpha`` of the good documents of any
stratum, as each rule may spend ``alpha / rules``. Of the certified cutoffs, the one with
the best balance of bad and good documents rejected is used; without one, the rule is off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import stored
from tremorlake.session import inline

BLANK = "[\\x20\\x09-\\x0D]"
ALPHA, DELTA = 0.03, 0.05
GOOD_WEIGHT = 20.0  #: how many rejected bad documents outweigh one rejected good document
BROADCAST_STRATA = 10_000
SHARES = [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]
#: Rules by name: (figure, cutoffs from loose to strict). A document fails where the figure exceeds the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02]),
    "dup_lines": ("n_dup_lines / n_lines", SHARES),
    "repeats": ("n_repeat_words / n_words", SHARES),
    "capitals": ("n_capitals / word_chars", SHARES),
    "marks": ("n_marks / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
}


def _without(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text (null: no words, no lines).

    Windows of three words are told apart by 64-bit hashes. A word is repeated if a window
    that occurs twice or more in its text covers it: with the sorted starts of such windows,
    each start adds the words up to the next start, three at most.
    """
    step = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    step = step.withColumns({
        "_words": F.expr(f"filter(split(_text, '{BLANK}+'), w -> w <> '')".replace("\\", "\\\\")),
        "_lines": F.expr("filter(split(_text, '\\n'), l -> length(btrim(l, ' \\t\\n\\u000B\\f\\r')) > 0)"),
        "word_chars": F.length(F.regexp_replace("_text", BLANK + "+", "")).cast("bigint"),
        "n_symbols": _without("_text", "[#*$%&|<>]").cast("bigint"),
        "n_capitals": _without("_text", "\\p{Lu}").cast("bigint"),
        "n_marks": _without("_text", "[!?]").cast("bigint"),
    }).drop("_text")
    step = step.withColumns({
        "n_words": F.size("_words").cast("bigint"), "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_h": F.expr("if(size(_words) < 3, array(), transform(sequence(0, greatest(size(_words) - 3, 0)), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"),
    }).drop("_words", "_lines")
    step = step.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), array_sort(transform(_h, (h, i) -> struct(h, i))), null)")).drop("_h")
    step = step.withColumn("_e", F.expr(
        "filter(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (a, b) -> if(a.h = b.h, struct(a.i as p, b.i as q), null)), x -> x is not null)")).drop("_s")
    step = step.withColumn("_p", F.expr("array_sort(array_distinct(concat(transform(_e, x -> x.p), transform(_e, x -> x.q))))")).drop("_e")
    repeat = "3 + aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> least(b - a, 3)), 0, (s, x) -> s + x)"
    return step.withColumn("n_repeat_words", F.expr(f"if(_p is null, 0, {repeat})").cast("bigint")).drop("_p")


def base_failed() -> Column:
    """Fixed rules: too short, or more than half of the words repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def figures(df: DataFrame) -> DataFrame:
    """Add the figure of each rule; 0 where its divisor is 0."""
    return df.withColumns({f"f_{name}": F.coalesce(F.try_divide(*[F.col(c) for c in figure.split(" / ")]), F.lit(0.0)) for name, (figure, _) in RULES.items()})


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence; relative error below 1e-13 for x >= 1."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    back = F.log(x)
    for i in range(1, 8):
        back = back + F.log(x + i)
    return series - back


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(at most k of n) for probability p, where k < n p; 1 elsewhere.

    Starts from the term at k and goes down while terms matter: they fall off over some
    sqrt(n p), so the number of steps is bounded by that, not by k.
    """
    kc, nc = F.col(k).cast("double"), F.col(n).cast("double")
    top = _log_gamma(nc + 1) - _log_gamma(kc + 1) - _log_gamma(nc - kc + 1) + kc * F.log(F.lit(p)) + (nc - kc) * F.log(F.lit(1 - p))
    steps = F.least(kc, 40 + F.ceil(12 * F.sqrt(nc * p))).cast("int")
    total = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, j: F.struct((s["term"] * (kc - j + 1) / (nc - kc + j) * ((1 - p) / p)).alias("term"),
                              (s["sum"] + s["term"] * (kc - j + 1) / (nc - kc + j) * ((1 - p) / p)).alias("sum")),
        lambda s: s["sum"])
    return F.when(kc >= nc * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def certify(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_rejected, bad_rejected, tail): the cutoff used, where one is certified.

    ``labelled`` has a row per labelled document that passes the fixed rules: stratum, good
    (boolean) and the figures. All rows count; they are condensed to one row per stratum,
    rule and step of the grid.
    """
    each = alpha / len(RULES)
    long = labelled.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.expr(f"cast(size(filter(array({', '.join(f'{c}D' for c in cutoffs)}), c -> f_{name} > c)) as int)").alias("over"))
        for name, (_, cutoffs) in RULES.items()])).alias("r")).select("stratum", "good", "r.*")
    found = long.groupBy("stratum", "rule", "over").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    grid = found.select("stratum", "rule").distinct().join(
        F.broadcast(inline(labelled.sparkSession, [(name, i, float(c)) for name, (_, cs) in RULES.items() for i, c in enumerate(cs)], "rule, step, cutoff")), "rule")
    # Cutoff ``step`` (from loose to strict) rejects the documents whose figure exceeds it: those over more than size - 1 - step cutoffs.
    sizes = F.element_at(F.create_map(*[F.lit(v) for name, (_, cs) in RULES.items() for v in (name, len(cs))]), F.col("rule"))
    steps = found.withColumn("step", sizes - F.col("over"))  # loosest step that rejects them; size: none does
    by_step = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counts = grid.join(steps.select("stratum", "rule", "step", "g", "b"), ["stratum", "rule", "step"], "left").fillna(0, ["g", "b"])
    total = found.groupBy("stratum", "rule").agg(F.sum("g").alias("n_good"))
    tested = (counts.withColumns({"good_rejected": F.sum("g").over(by_step), "bad_rejected": F.sum("b").over(by_step)}).drop("g", "b").join(total, ["stratum", "rule"])
              .crossJoin(F.broadcast(found.agg(F.count_distinct("stratum").alias("n_strata")))))
    tested = tested.withColumn("tail", binomial_tail("good_rejected", "n_good", each))
    passed = F.min((F.col("tail") <= delta / (len(RULES) * F.col("n_strata"))).cast("int")).over(by_step)
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc(F.col("bad_rejected") - good_weight * F.col("good_rejected")), "step")
    return (tested.withColumn("passed", passed).where("passed = 1").withColumn("_n", F.row_number().over(best)).where("_n = 1 and bad_rejected > 0")
            .select("stratum", "rule", "cutoff", "n_good", "good_rejected", "bad_rejected", "tail"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    Strata are the values of ``stratum`` (null: one of its own). Labels: quality 1 is good;
    rows with a null id or label are left out, a document with several labels counts as good
    if half of them or more say so. Without labels only the fixed rules decide.
    """
    measured = stored(figures(measure(docs.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")), ["doc_id", "stratum"])
                              .withColumn("base_failed", base_failed())), "measured")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    thresholds = stored(certify(measured.where("not base_failed").join(known, "doc_id"), alpha, delta), "thresholds")
    wide = thresholds.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"t_{name}") for name in RULES])
    if thresholds.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    over = F.lit(False)
    for name in RULES:
        over = over | F.coalesce(F.col(f"f_{name}") > F.col(f"t_{name}"), F.lit(False))
    return measured.join(wide, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
