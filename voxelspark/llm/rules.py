"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose rate exceeds a cutoff. Cutoffs are chosen per stratum
(the language) from labelled rows, so that good texts are seldom rejected:

* a cutoff is certified if, of the n good texts held out in the stratum, x are rejected
  and a true rate of false rejection of ``limit / rules`` would show x or fewer with a
  probability of at most ``doubt / (rules * strata)``. That is the exact binomial
  (Clopper-Pearson) bound, with Bonferroni's correction over rules and strata; cutoffs
  of a rule are tested from the loosest on and stop at the first that fails, which needs
  no further correction. All rules together then reject at most ``limit`` of a stratum's
  good texts, with confidence 1 - ``doubt``;
* of the certified cutoffs the one that parts good and bad best on the other labelled
  rows is used; a rule with none that helps doesn't apply in the stratum.

A text is seen whole and once: its counts come from array functions within its row, and
the small table of counts is written before labels and cutoffs are joined to it.
Windows of 8 words are told apart by 64-bit hashes.

Null texts have no words. A null language is a stratum of its own. Ids with
contradicting labels certify nothing; an id is one trial, however many rows or labels
repeat it; without labels only the base rules reject. Very long texts are counted whole in
their row. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
CAPITALS = "".join(chr(c) for c in range(65, 91))
WINDOW = 8

#: Rates that rules look at: name, numerator, denominator.
RULES = (
    ("symbols", "n_symbols", "n_words"),
    ("exclamations", "n_exclamations", "n_words"),
    ("capitals", "n_capitals", "word_chars"),
    ("repeats", "n_repeat_words", "n_words"),
    ("same_words", "n_again", "n_words"),
)
#: Cutoffs, loosest first.
GRID = tuple(4 * 2 ** (-k / 2) for k in range(21))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _paired(a: str, n: int) -> Column:
    """Hashes of each element of array ``a`` with the one n places on."""
    return F.zip_with(F.col(a), F.slice(F.col(a), n + 1, F.greatest(F.size(a) - n, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts of every whole text beside the columns ``keep``."""
    t = F.col("text")
    one = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = one.withColumn("words", F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), ""))
    one = one.withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: F.length(_without(x, common.SPACES)) > 0))
    length = F.length(t)
    one = one.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(t, common.SPACES)).cast("long").alias("word_chars"),
        (length - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (length - F.length(_without(t, "!"))).cast("long").alias("n_exclamations"),
        (length - F.length(_without(t, CAPITALS))).cast("long").alias("n_capitals"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    one = one.withColumn("h2", _paired("h1", 1)).withColumn("h4", _paired("h2", 2))
    one = one.withColumn("h8", F.when(F.size("h1") >= WINDOW, F.slice(_paired("h4", 4), 1, F.greatest(F.size("h1") - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<long>")))
    again = F.size(F.filter(F.zip_with("h1", F.slice("h1", 2, F.greatest(F.size("h1") - 1, F.lit(0))), lambda x, y: x == y), lambda x: x))
    one = one.withColumn("n_again", again.cast("long")).withColumn("twice", F.size(F.array_distinct("h8")) < F.size("h8")).drop("h1", "h2", "h4")
    # Windows in the order of their hashes: those with an equal neighbour occur twice or more.
    one = one.withColumn("sorted", F.when(F.col("twice"), F.array_sort(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, at: F.coalesce(F.get("sorted", at)["h"] == x["h"], F.lit(False))
    one = one.withColumn("at", F.array_sort(F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop("sorted", "h8", "twice")
    steps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return one.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))).drop("at")


def rates() -> list[Column]:
    return [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(name) for name, a, b in RULES]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_factorial(m: Column) -> Column:
    x = m.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """The probability of x or fewer among n. Above the mean it counts as 1: no bound is
    wanted there. Terms 60 standard deviations below x are zero in double precision."""
    from math import log

    low = F.greatest(F.lit(0), x - F.ceil(60 * F.sqrt(n * p) + 60)).cast("long")
    term = lambda k: F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * log(p) + (n - k) * log(1 - p))
    return F.when(x > n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(low, x), F.lit(0.0), lambda s, k: s + term(k)))


def cutoffs(counted: DataFrame, labels: DataFrame, limit: float = 0.05, doubt: float = 0.05, doc_id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """stratum, rule, cutoff, n_held, n_rejected: at most one row a rule and stratum.

    ``labels`` has doc_id and quality (1 good). Half of the ids (by crc32) certify, the
    other half chooses.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", "y")
    seen = counted.where(~base_failed()).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *rates()).join(known, "doc_id")
    # An id is one trial, however many rows repeat it: a rule rejects it if it rejects one of them.
    seen = seen.groupBy("stratum", "doc_id", "y").agg(*[F.max(name).alias(name) for name, *_ in RULES])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("rate")) for name, *_ in RULES])).alias("r")
    # How many cutoffs a rate exceeds: those from GRID[-level] on.
    level = F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: g < F.col("r.rate")))
    held = common.remainder(F.col("doc_id"), 2) == 0
    by = seen.select("stratum", "y", held.alias("held"), each).select("stratum", "y", "held", "r.rule", level.alias("level")).groupBy("stratum", "rule", "level").agg(*[F.count_if(c).alias(k) for k, c in (("good", F.col("held") & (F.col("y") == 1)), ("good2", ~F.col("held") & (F.col("y") == 1)), ("bad2", ~F.col("held") & (F.col("y") == 0)))])
    by = common.stored(counted.sparkSession, by, "levels")  # a row a level, rule and stratum
    strata = by.select("stratum").distinct().count()
    # A row for each cutoff, if rates exceed it or not.
    n = len(GRID)
    rows = by.select("stratum", "rule").distinct().select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("level"))
    full = rows.join(by, ["stratum", "rule", "level"], "left").na.fill(0, ["good", "good2", "bad2"])
    group = Window.partitionBy("stratum", "rule")  # a row a cutoff
    above = group.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = full.select("*", *[F.sum(c).over(above).alias(f"{c}_out") for c in ("good", "good2", "bad2")], *[F.sum(c).over(group).alias(f"{c}_all") for c in ("good", "good2", "bad2")])
    tail = binomial_tail(F.col("good_out"), F.col("good_all"), limit / len(RULES))
    ok = (F.col("good_all") > 0) & (tail <= doubt / len(RULES) / max(strata, 1))
    tested = full.where("level > 0").withColumn("ok", ok)
    # Level n is the loosest cutoff, GRID[0].
    tested = tested.withColumn("certified", F.min("ok").over(above))
    gain = F.col("bad2_out") / F.greatest("bad2_all", F.lit(1)) - 4 * F.col("good2_out") / F.greatest("good2_all", F.lit(1))
    best = F.row_number().over(group.orderBy(gain.desc(), F.col("level").desc()))
    chosen = tested.where("certified").withColumn("gain", gain).where("gain > 0").withColumn("best", best).where("best = 1")
    return chosen.select("stratum", "rule", F.element_at(F.array(*map(F.lit, GRID)), (n + 1 - F.col("level")).cast("int")).alias("cutoff"), F.col("good_all").alias("n_held"), F.col("good_out").alias("n_rejected"))


def judge(counted: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds base_failed, failed_rules and kept."""
    each = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # a value a rule
    joined = counted.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit(""))).join(each.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    broken = F.filter(F.array(*[F.when(rate > F.try_element_at("cutoffs", F.lit(name)), F.lit(name)) for rate, (name, *_) in zip(rates(), RULES, strict=True)]), lambda x: x.isNotNull())
    return joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", "cutoffs")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    counted = common.stored(spark, counts(common.table(spark, sf_dir, "documents")), "counts")
    chosen = common.stored(spark, cutoffs(counted, common.table(spark, sf_dir, "labels")), "cutoffs")
    return judge(counted, chosen).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
