"""URL filters (operator 2, native): rules, then logistic regression on hashed character n-grams.

The model is fitted from a small labelled URL table by gradient descent in its
dual form: one coefficient a labelled URL, against the matrix of their feature
overlaps, all within one array expression.  The coefficients then sum to one
weight a hash bucket.  Scoring is an array expression over each URL, with no
join and no shuffle.
"""

from __future__ import annotations

import csv
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets; bucket 0 is the intercept.  This bounds what leaves the fit.
BUCKETS = 4096
STEPS, RATE, DECAY = 200, 1.0, 0.002

# The rules of the registered query, as (verdict, host/path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

def labelled_urls(part: str = "train") -> list[tuple[str, int]]:
    """Rows of the labelled URL table that comes with the package, 1 to block: those of the part "train" or "held_out".

    No host name is in both parts, and none is taken from a table that is judged.
    """
    with (resources.files(__package__) / "labelled_urls.csv").open() as f:
        return [(r["url"], int(r["block"])) for r in csv.DictReader(f) if r["part"] == part]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null or a URL without '://'."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, pattern, 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does.

    rules: (verdict, host/path); equally long ones go by their text.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str, n: int) -> Column:
    """Hash buckets of the n-grams of ``text``, in time linear in its length."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    runs = reduce(
        lambda run, k: F.zip_with(run, F.slice(chars, k, F.greatest(F.size(chars) - (k - 1), F.lit(0))), lambda a, b: F.concat(a, b)),
        range(2, n + 1),
        chars,
    )
    whole = F.filter(runs, lambda g: g.isNotNull())
    return F.transform(whole, lambda g: (F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS - 1)) + 1).cast("int"))


def features(host: Column, path: Column) -> Column:
    """The distinct buckets of a URL's 3- and 4-grams, and the intercept's."""
    parts = [_grams(host, "h", 3), _grams(host, "h", 4), _grams(path, "p", 3)]
    return F.array_distinct(F.concat(F.array(F.lit(0)), *parts))


def fit(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> list[float]:
    """A weight for each bucket, from labelled URLs (a few hundred at most)."""
    values = ", ".join("('" + url.replace("\\", "\\\\").replace("'", "\\'") + f"', {y})" for url, y in rows or labelled_urls())
    host, path = url_parts(F.col("url"))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, y)").select(features(host, path).alias("f"), "y", "url")
    one = table.agg(F.sort_array(F.collect_list(F.struct("url", "y", "f"))).alias("rows"))
    overlap = "transform(rows, a -> transform(rows, b -> size(array_intersect(a.f, b.f)) / sqrt(size(a.f) * CAST(size(b.f) AS DOUBLE))))"
    # the overlaps travel in the accumulator, so that they are worked out once
    step = f"""aggregate(sequence(1, {STEPS}), struct({overlap} AS k, transform(rows, r -> 0D) AS w), (s, n) -> struct(s.k AS k,
        transform(s.k, (line, i) -> s.w[i] * {1 - DECAY}D
            + {RATE}D * (rows[i].y - 1D / (1D + exp(-aggregate(zip_with(line, s.w, (k, v) -> k * v), 0D, (x, y) -> x + y))))) AS w)).w"""
    solved = one.withColumn("w", F.expr(step))
    pairs = solved.select(F.explode(F.expr("zip_with(rows, w, (r, v) -> struct(r.f AS f, v / sqrt(size(r.f)) AS v))")).alias("x"))
    sums = pairs.select(F.explode("x.f").alias("bucket"), F.col("x.v").alias("v")).groupBy("bucket").agg(F.sum("v").alias("v"))
    weights = [0.0] * BUCKETS
    for row in sums.collect():  # at most BUCKETS rows
        weights[row.bucket] = row.v
    return weights


def filter_urls(pages: DataFrame, rules=RULES, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.

    verdict is the fitting rule's, else "block" where the model's probability
    (score) is a half or more, else "allow".  A null URL or one without "://"
    has an empty host and path and is judged by the model's intercept and edge
    grams.  Repeated rows give repeated rows; other columns are ignored.
    """
    weights = fit(pages.sparkSession) if weights is None else weights
    table = F.lit(weights)
    host, path = url_parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    f = features(F.col("host"), F.col("path"))
    scored = cut.withColumn("f", f).withColumn(
        "logit", F.aggregate("f", F.lit(0.0), lambda acc, b: acc + F.element_at(table, b + 1)) / F.sqrt(F.size("f"))
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-F.col("logit")))
    own = F.when(F.col("logit") >= 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"))
