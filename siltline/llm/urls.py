"""URL filters: rules on host and path, and a logistic regression on hashed character n-grams for the rest.

DataFrame and SQL functions only. The regression is trained from a small labelled table, of which at most ``most_labels``
rows (those with the smallest hash) are used. They are gathered in one row, and the training is one expression over it:
gradient descent in the dual, where the weights are a sum of the examples and the examples' products are computed once.
The weights, one for each of ``buckets`` hash buckets, then become a constant of the scoring expression.

Features: character 3- and 4-grams of host and path, each between ``^`` and ``$``, hashed apart for host and path, each
bucket once, over the square root of their number; and one that is always there. A url is blocked at a score over 0.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits; ties between rules of
equal length go to the block, then the first in the alphabet; labelled rows with a null or the same url as another take
no part or count once (blocked if any says so); without labels every score is 0 and allows; repeated rows give a row
each; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.llm.common import ascii_lower

#: Fixed by the query's contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words of the small labelled table, which has hosts and paths of the same shapes on both sides, so that neither the shape
#: nor a preponderance of one side decides about a url.
BLOCKED = ("casino", "poker", "bets", "jackpot", "pills", "pharmacy", "adult", "xxx", "ads", "track", "clicks", "popup", "loans", "payday", "warez", "cracks", "torrents", "spam")
ALLOWED = ("wiki", "library", "museum", "school", "research", "science", "news", "weather", "recipes", "garden", "history", "travel", "forum", "docs", "music", "sports", "village", "journal")
#: Names that say nothing of a site; hosts and paths of both kinds hold them, and a few hosts on their own are allowed.
PLAIN = (
    "river", "mountain", "bakery", "orchard", "carpenter", "lantern", "harbour", "meadow", "bicycle", "kitchen", "painter",
    "compass", "bridge", "station", "valley", "cottage", "teacher", "planet", "window", "saddle", "copper", "juniper", "walnut",
    "falcon", "ember", "glacier", "pottery", "quartz", "willow", "tailor", "archive", "gallery",
)


def seed_labels(spark: SparkSession) -> DataFrame:
    """(url, blocked): eight urls of each word, alone and beside plain names, and 16 of plain names alone, which are allowed."""
    rows = [("", 0)]
    for blocked, names in ((1, BLOCKED), (0, ALLOWED)):
        for n, word in enumerate(names):
            other, plain, second = names[(n + 5) % len(names)], PLAIN[(n * 7 + blocked * 3) % len(PLAIN)], PLAIN[(n * 5 + 1) % len(PLAIN)]
            top = ("org", "net", "com")[n % 3]
            rows += [
                (f"https://{word}.example.{top}/en/{n}", blocked),
                (f"http://www.{word}-{other}.example.org/de/{n * 37}.html", blocked),
                (f"https://m.{other}{word}.example.net/en/{n * 53}?page=2", blocked),
                (f"https://blog.the{word}.example.net/de/{n * 71}/", blocked),
                (f"https://www.{plain}.example.org/{word}/{n * 11}", blocked),
                (f"http://{second}.example.net/en/{other}-{word}.html", blocked),
                (f"http://{word}-{plain}.example.com/fr/{n * 91}.html", blocked),
                (f"https://{second}{word}.example.org/es/{n * 13}", blocked),
            ]
    for n in range(16):
        sub, top, tongue = ("", "www.", "m.", "blog.")[n % 4], ("org", "net", "com")[n % 3], ("en", "de", "fr", "es")[n // 4]
        second = PLAIN[(n * 3 + 2) % len(PLAIN)] if n % 2 else ""
        rows.append((f"http{'s' * (n % 3 > 0)}://{sub}{PLAIN[n]}{second}.example.{top}/{tongue}/{n * 137}{('', '/', '.html')[n % 3]}", 0))
    return spark.createDataFrame(rows, "url string, blocked int")


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?s)(?:(?!://).)*+://([^/?#]*+)([^?#]*+)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rule (action, rule) that fits, longest first; null if none does."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def grams(host: Column, path: Column, buckets: int) -> Column:
    """The buckets of a url's n-grams, each once; the last bucket is always there."""

    def of(text: Column, kind: int, n: int) -> Column:
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        whole = F.transform(F.array(F.filter(letters, lambda c: c != "")), lambda c: F.when(
            F.size(c) >= n,
            F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.pmod(F.xxhash64(F.lit(kind), *(F.get(c, i + k) for k in range(n))), F.lit(buckets - 1)).cast("int")),
        ).otherwise(F.array().cast("array<int>")))
        return F.element_at(whole, 1)

    return F.array_distinct(F.concat(of(host, 0, 3), of(host, 0, 4), of(path, 1, 3), of(path, 1, 4), F.array(F.lit(buckets - 1))))


def train(labels: DataFrame, url: str = "url", blocked: str = "blocked", buckets: int = 4096, most_labels: int = 400, steps: int = 150, rate: float = 4.0, decay: float = 1e-4) -> list[float]:
    """A weight for each bucket."""
    host, path = parts(F.col("u"))
    known = labels.where(F.col(url).isNotNull() & F.col(blocked).isNotNull()).groupBy(F.col(url).alias("u")).agg((F.max(blocked) > 0).cast("double").alias("y"))
    some = known.withColumn("h", F.xxhash64("u")).orderBy("h", "u").limit(most_labels)
    rows = some.select(F.struct("h", "u", "y", grams(host, path, buckets).alias("b")).alias("e")).agg(F.array_sort(F.collect_list("e")).alias("ex"))
    product = "transform(ex, e -> transform(ex, o -> size(array_intersect(e.b, o.b)) / sqrt(size(e.b) * size(o.b))))"
    dot = "aggregate(zip_with(row, a, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    step = f"transform(k, (row, i) -> get(a, i) * (1 - {rate * decay}D) - {rate}D / size(ex) * (1 / (1 + exp(-{dot})) - get(ex, i).y))"
    dual = f"aggregate(sequence(1, {steps}), array_repeat(0D, size(ex)), (a, t) -> {step})"
    # Bound as a lambda's argument, the products are computed once and not in every step.
    solved = rows.where(F.size("ex") > 0).withColumn("a", F.expr(f"transform(array({product}), k -> {dual})[0]"))
    each = solved.select(F.explode(F.arrays_zip("ex", "a")).alias("z")).select((F.col("z.a") / F.sqrt(F.size("z.ex.b"))).alias("a"), F.explode("z.ex.b").alias("b"))
    out = [0.0] * buckets
    for r in each.groupBy("b").agg(F.sum(F.col("a").cast("decimal(38,18)")).cast("double").alias("w")).collect():  # a row for each bucket at most
        out[r.b] = r.w
    return out


def score(host: Column, path: Column, weights: list[float]) -> Column:
    table = F.expr(f"cast(split('{','.join(map(repr, weights))}', ',') AS array<double>)")
    return F.element_at(
        F.transform(F.array(grams(host, path, len(weights))), lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(table, x)) / F.sqrt(F.size(b))), 1
    )


def judged(pages: DataFrame, labels: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, **options) -> DataFrame:
    """(id, host, path, rule, verdict, score): the score is null where a rule decides."""
    weights = train(labels, **options)
    host, path = parts(F.col("_url"))
    base = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    found = base.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    found = found.withColumn("score", F.when(F.col("_r").isNull(), score(F.col("host"), F.col("path"), weights)))
    verdict = F.coalesce(F.col("_r.action"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return found.select(F.col("_id").alias(id), "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "score")
