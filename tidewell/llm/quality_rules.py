"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Counts are taken inside each row with array functions: no text is exploded or
shuffled. Rules compare a rate with a cutoff. All rules have grids of equally many
cutoffs, and step by step, from loose to strict, all are tightened together; a step's
verdict rejects a document if any rule does, so verdicts are nested.

Steps are certified on labelled holdouts: in a stratum, a step whose verdict rejects
``k`` of ``n`` documents labelled good is certified if a binomial variable with the largest
allowed rate of false rejections would be as small as ``k`` with probability at most
``delta`` divided by the number of tested strata. Steps are tested in their fixed order up
to the first that fails, so the steps of a stratum share one level. So, with probability
1 - delta, in no tested stratum does the verdict of all rules together reject more than
that rate of good documents. The strictest certified step is taken; a stratum without one
rejects nothing. A stratum needs log(tested strata / delta) / -log(1 - rate) good labels:
299 if it is the only one, 368 of two, 437 of four.

A stratum with too few good labels to certify a step that rejects none of them cannot
be tested alone. All such strata are tested together as one; the bound then holds for
them together, not for each. Which strata these are hangs on the numbers of good labels
alone, never on what a rule makes of them, so the choice costs no further correction.

Only counts by stratum and step leave the rows, after partial
aggregation, so a stratum that holds most rows costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise, prepare

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES, NON_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules: a rate (of the counts below) and the steps of its grid; a document above the cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / word_chars", [x / 100 for x in range(2, 41, 2)]),
    "capitals": ("n_upper / word_chars", [x / 100 for x in range(5, 101, 5)]),
    "exclamations": ("n_exclamations / word_chars", [x / 100 for x in range(2, 41, 2)]),
    "repeats": ("n_repeat_words / n_words", [x / 100 for x in range(5, 101, 5)]),
}
STEPS = 20  # cutoffs of each grid
MANY_STRATA = 10_000
NOWHERE = 1 << 62  # more good labels than any stratum has


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words found at two places or more."""

    def covered(prints: Column) -> Column:
        ordered = F.array_sort(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(pairs: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
            twice = F.filter(pairs, lambda e, k: same(e, k + 1) | same(e, k - 1))
            starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(prints)) == F.size(prints), F.lit(0)).otherwise(bind(ordered, of))

    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    prints = F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))
    return bind(prints, covered)


def counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each whole text; a null text has no words."""
    text = F.col("__text")
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    split = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select(*keep, "__text", words.alias("__words"))
    return split.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(removed(text, WHITE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(removed(text, SYMBOLS))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        (F.length(text) - F.length(removed(text, UPPER))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(removed(text, "!"))).cast("long").alias("n_exclamations"),
    )


def log_binomial_cdf(k: Column, n: Column, rate: float) -> Column:
    """log P(Binomial(n, rate) <= k), by the recurrence of the terms in logarithms; 0
    (probability 1) from the mean on, where nothing is certified anyway."""
    odds = F.lit(rate / (1 - rate))
    first = n * F.log1p(F.lit(-rate))

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) / i * odds)
        high, gap = F.greatest(a["s"], term), F.abs(a["s"] - term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(-gap))).alias("s"))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), F.struct(first.alias("t"), first.alias("s")), step, lambda a: a["s"])
    return F.when(k >= n * rate, F.lit(0.0)).otherwise(total)


def value_of(rule: str) -> Column:
    """A rule's rate; 0 where the divisor is 0."""
    return F.expr(f"coalesce(try_divide({rule.replace(' / ', ', ')}), 0)")


def step_of(value: Column, grid: list[float]) -> Column:
    """How many cutoffs of a grid a value is above."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: value > g))


def tested_alone(tally: DataFrame, rate: float, delta: float) -> tuple[int, int]:
    """The least number of good labels of a stratum that is tested alone, and how many
    strata are tested, the pool of all others being one: the most strata for which a
    step without false rejections would be certified, in each and, if there is such a
    choice, in the pool too. At most sqrt(2 x labels) different numbers come to the driver."""
    sizes = tally.groupBy("stratum").agg(F.sum("n").alias("n"))
    by_size = sorted(((r["n"], r["strata"]) for r in sizes.groupBy("n").agg(F.count("*").alias("strata")).collect()), reverse=True)
    total, rest, alone, choices = sum(m for _, m in by_size), sum(n * m for n, m in by_size), 0, []
    for n, m in by_size:
        alone, rest = alone + m, rest - n * m
        tested = alone + (alone < total)
        enough = lambda x, tested=tested: x * log1p(-rate) <= log(delta / tested)
        if enough(n):
            choices.append((bool(rest) and not enough(rest), n, tested))
    return min(choices)[1:] if choices else (NOWHERE, 1)


def certified(measured: DataFrame, labels: DataFrame, stratum: str, rate: float, delta: float) -> DataFrame:
    """stratum, at: for each stratum with a certified step, its own or the pool's, the
    number in the grids of the strictest cutoffs (0: the first)."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__id")).distinct()
    held = measured.join(good, F.col("doc_id") == F.col("__id"))
    # a verdict with the cutoffs ``at`` rejects the documents whose step is above it
    step = F.greatest(*(step_of(value_of(rule), grid) for rule, grid in RULES.values()))
    tally = held.select(F.col(stratum).alias("stratum"), step.alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n"))
    tally = materialise(tally, "quality-tally")  # from here on: at most strata x (steps + 1) rows
    least, tested = tested_alone(tally, rate, delta)
    alone = F.sum("n").over(Window.partitionBy("stratum")) >= least
    sized = tally.withColumn("alone", alone).withColumn("unit", F.when(F.col("alone"), F.col("stratum")))
    by_step = sized.groupBy("alone", "unit", "step").agg(F.sum("n").alias("n")).groupBy("alone", "unit").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by"), F.sum("n").alias("n"))
    each = by_step.select("alone", "unit", "n", "by", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("at"))
    above = F.aggregate(F.map_values(F.map_filter(F.col("by"), lambda s, _: s > F.col("at"))), F.lit(0).cast("long"), lambda a, x: a + x)
    # k falls from strict to loose, so every step looser than one that passes has passed before it
    passed = each.select("alone", "unit", "at", "n", above.alias("k")).where(log_binomial_cdf(F.col("k"), F.col("n"), rate) <= F.log(F.lit(delta / tested)))
    found = passed.groupBy("alone", "unit").agg(F.min("at").alias("at")).alias("f")
    strata = sized.select("stratum", "alone", "unit").distinct().alias("s")
    return strata.join(found, (F.col("s.alone") == F.col("f.alone")) & F.col("s.unit").eqNullSafe(F.col("f.unit"))).select("stratum", "at")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Counts and verdict for every document.

    One row per row of ``docs``: doc_id, the five counts, base_failed (fewer than ten
    words, or more than a fifth of the words in repeated windows), kept (false if
    base_failed or if a rule's rate is above its stratum's certified cutoff) and
    failed_rules. ``rate`` bounds the false rejections of all rules together in each
    stratum that has labels enough to be tested alone, and in all the others together;
    ``delta`` bounds the chance that any bound is broken.

    A null or empty text has no words and fails. A null stratum is a stratum of its
    own. Labels that are null or not 1 count for nothing; in a stratum without a good
    label no rule rejects, since nothing was seen of it. Repeated rows get equal rows. Other columns are not read. Windows are
    compared by 64-bit hashes within one text.
    """
    spark = prepare(docs.sparkSession)
    measured = materialise(counts(docs.select("doc_id", F.col(stratum).alias("__stratum"), "text"), ["doc_id", "__stratum"]), "quality-counts")
    found = materialise(certified(measured, labels, "__stratum", rate, delta), "quality-cutoffs")
    few = len(found.select("stratum").head(MANY_STRATA + 1)) <= MANY_STRATA
    joined = measured.join(F.broadcast(found) if few else found, F.col("__stratum").eqNullSafe(F.col("stratum")), "left")
    broken = [F.when(step_of(value_of(rule), grid) > F.col("at"), F.lit(r)) for r, (rule, grid) in RULES.items()]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), F.concat_ws(",", *broken).alias("failed_rules")).select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
