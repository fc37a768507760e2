"""Quality rules with risk-controlled thresholds. DataFrame and SQL functions only.

Base rules reject a text of too few words or made mostly of repeated three-word windows. The other rules reject a text
whose feature (a share, see ``RULES``) is over a cutoff that labelled holdouts select, for each stratum (language) apart:

* a rule's cutoffs are a fixed grid, tested from lenient to strict; testing stops at the first that fails, so a whole grid
  costs one hypothesis (fixed-sequence testing);
* a cutoff passes if, were its true rate of rejecting good texts ``alpha`` / rules or more, so few rejected good holdouts
  had a probability of at most ``delta`` / (strata * rules): the exact one-sided binomial (Clopper-Pearson) bound with
  Bonferroni's correction. With probability 1 - delta, every rule of every stratum then keeps to its part of ``alpha``,
  and all rules of a stratum together reject at most ``alpha`` of its good texts;
* among the cutoffs that passed, that which rejects most bad holdouts for its cost in good ones is taken; one that does
  no good isn't used, and a stratum with too few good holdouts to prove anything keeps all.

Repeated windows are found by sorting, within the row, numbers that hold the upper bits of a window's 64-bit hash above
its position; windows that meet there are compared by their whole hash.

Defined cases: a null text has no words; an empty one fails the base rule; repeated rows and null ids give a row each; a
null or unknown language is the stratum ``other``; a document with labels that contradict each other counts as bad;
documents without a label, and labels without a document or with a null, take no part in the selection; extra columns are
kept, also where their names clash; empty tables give none, and without labels only the base rules hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.common import SPACES, free_name, written

#: Rule: feature from the base columns, cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    "repeats": ("n_repeat_words / n_words", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "capitals": ("n_capitals / word_chars", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
}
STRATA = ("en", "fr", "de", "es")
OTHER = "other"


def features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of counts in a column whose name comes second."""
    q = free_name(docs, "_q")
    t, w, lines, h, bits, over, p, f = (q + x for x in ("t", "w", "l", "h", "b", "o", "p", "f"))
    out = (
        docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
        .withColumn(w, F.filter(F.split(t, SPACES), lambda x: x != ""))
        .withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn(h, F.expr(f"CASE WHEN size({w}) >= 3 THEN transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))) ELSE array() END"))
        .withColumn(bits, F.expr(f"cast(ceil(log2(size({h}) + 1)) AS int)"))
        .withColumn(over, F.expr(f"shiftleft(1L, {bits})"))
        .withColumn(p, F.expr(f"sort_array(transform({h}, (x, i) -> (x & -{over}) | i))"))
    )
    at = tuple(f"cast({x} & ({over} - 1) AS int)" for x in "xy")
    met = f"(x ^ y) BETWEEN 0 AND {over} - 1 AND get({h}, {at[0]}) = get({h}, {at[1]})"
    out = out.withColumn(f, F.expr(f"sort_array(array_distinct(flatten(filter(zip_with({p}, slice({p}, 2, greatest(size({p}), 1)), (x, y) -> if({met}, array({at[0]}, {at[1]}), null)), x -> x IS NOT NULL))))"))
    out = out.withColumn(
        q,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.expr(f"aggregate(zip_with({f}, slice({f}, 2, greatest(size({f}), 1)), (x, y) -> least(3, coalesce(y - x, 3))), 0L, (s, x) -> s + x)").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        ),
    )
    return out.drop(t, w, lines, h, bits, over, p, f), q


def base_failed(q: Column, least_words: int = 50, most_repeats: int = 50) -> Column:
    return (q["n_words"] < least_words) | (100 * q["n_repeat_words"] > most_repeats * q["n_words"])


def feature(rule: str, q: Column) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return q[over] / F.greatest(q[under], F.lit(1))


def stratum(lang: Column, strata: tuple[str, ...]) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise(OTHER)


def so_few(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) of X ~ Bin(n, rate), exact: the last term by logarithms, the others from it by their ratios; 1 over the mean."""
    odds = (1 - rate) / rate
    steps = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))
    last = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i)) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["r"] * odds * i / (n - i + 1)).alias("r"), (a["s"] + a["r"] * odds * i / (n - i + 1)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.exp(last + F.log(total)))


def cutoffs(holdouts: DataFrame, alpha: float = 0.02, delta: float = 0.05, cost: float = 10.0, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """(stratum, one column for each rule): the selected cutoffs, null where none is proven to be worth it.

    ``holdouts`` has stratum, good and a column for each rule's feature. At most a row for each stratum comes out.
    """
    tests = [(r, n, c) for r, (_, grid) in RULES.items() for n, c in enumerate(grid)]
    good, bad = F.col("good"), ~F.col("good")
    counts = holdouts.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        F.count_if(bad).alias("m"),
        *(F.count_if(good & (F.col(r) > c)).alias(f"g_{r}_{n}") for r, n, c in tests),
        *(F.count_if(bad & (F.col(r) > c)).alias(f"b_{r}_{n}") for r, n, c in tests),
    )
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(n).alias("level"), F.lit(c).alias("cut"), F.col(f"g_{r}_{n}").alias("k"), F.col(f"b_{r}_{n}").alias("caught")) for r, n, c in tests))
    each = counts.select("stratum", "n", "m", F.explode(rows).alias("t")).select("stratum", "n", "m", "t.*")
    proven = so_few(F.col("n"), F.col("k"), alpha / len(RULES)) <= delta / (len(RULES) * (len(strata) + 1))
    so_far = Window.partitionBy("stratum", "rule").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    worth = F.col("caught") / F.greatest("m", F.lit(1)) - cost * F.col("k") / F.greatest("n", F.lit(1))
    passed = each.withColumn("worth", worth).withColumn("proven", F.min(proven).over(so_far)).where("proven AND worth > 0")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct("worth", -F.col("level"))).alias("cut"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str | None = "text", lang: str = "lang", quality: str = "quality", strata: tuple[str, ...] = STRATA, keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with a last column, a struct of the counts, base_failed and kept.

    The rows with their counts are written to the shared folder once (without the text if ``keep_text`` is false), and
    serve both to select the cutoffs and to apply them.
    """
    counted, q = features(docs, text)
    held = written(counted if keep_text else counted.drop(text), "quality-counts")
    col = F.col(q)
    known = labels.where(F.col(id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(id).alias("label_id")).agg((F.min(quality) > 0).alias("good"))
    asked = held.where(~base_failed(col)).select(F.col(id).alias("label_id"), stratum(F.col(lang), strata).alias("stratum"), *(feature(r, col).alias(r) for r in RULES))
    chosen = cutoffs(asked.join(known, "label_id"), strata=strata, **options)
    names = {r: f"{q}_{r}" for r in RULES}
    s = f"{q}_stratum"
    # One row for each of the given strata and `other`: its size doesn't follow the data.
    chosen = F.broadcast(chosen.select(F.col("stratum").alias(s), *(F.col(r).alias(n) for r, n in names.items())))
    out = held.join(chosen, stratum(F.col(lang), strata) == F.col(s), "left")
    over = F.lit(False)
    for r, n in names.items():
        over = over | F.coalesce(feature(r, col) > F.col(n), F.lit(False))
    failed = base_failed(col)
    return out.withColumn(q, F.struct(F.col(f"{q}.*"), failed.alias("base_failed"), (~failed & ~over).alias("kept"))).drop(s, *names.values())


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    out = judged(docs, labels, **options)
    return out.where(F.col(out.columns[-1])["kept"]).select(*docs.columns)
