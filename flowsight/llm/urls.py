"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The regression learns from a small labelled URL table; rules decide and teach nothing. The table given here (``labelled_urls``) is made
of everyday words (allow) and words of spam (block), put into hosts and paths of the same forms under the same top-level
domains, so neither a domain, a language nor a form tells the verdict, only the words do. Words are laid out three allowed
ones to a blocked one: an address without any evidence is allowed. Everything runs as column expressions and JVM
estimators; the weights reach the tasks as one vector of ``2**15`` numbers.

A null url, or one without ``://``, has an empty host and path; no rule fits it and the regression judges the empty
grams. Very long urls are judged whole. Repeated rows, and rows that share a page_id or have none, are judged each by itself; an empty
table gives an empty one, and columns other than page_id and url are not looked at. Where a labelled table lacks one of
the verdicts, the other one is given to every url that no rule fits, and ``allow`` if it is empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .common import ascii_lower
from .pii import let

# (verdict, host, path): fixed.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SIZES = (3, 4)
BITS = 15
# Words of the labelled table, and what they are put into: {0} a word, {1} the next one of its list, {2} a number.
ALLOWED_WORDS = (
    "academy animal archive atlas author bakery ballet band beach bicycle bird book botany bridge camera castle census charity cinema city "
    "classic climate coast college comet concert cooking council craft culture dance desert design dinner doctor dolphin drama energy "
    "engine essay europe family farm festival field fish flower football forest gallery garden geology glacier grammar guitar harbour health "
    "history home island journal kitchen lake language law lesson letter library lighthouse magazine market medicine mountain museum music nation "
    "nature news novel ocean opera orchard painting paper park physics piano planet poetry radio railway recipe river school science season sport "
    "station story student teacher theatre train travel tree university valley village vineyard weather winter writer zoology"
).split()
BLOCKED_WORDS = (
    "bet bets bingo blackjack bonus casino cheap crack cracked dating erotic escort free gambling jackpot keygen loan lottery lucky nude payday pharma "
    "pills poker porn replica roulette serialz sex sexy slots spins viagra warez webcam win winner xxx"
).split()
HOST_FORMS = ("{0}-{1}.{3}", "www.{0}{1}.{3}", "{0}.site{2}.{3}", "m.{1}-{0}.page.{3}", "blog.{0}.{3}", "site{2}.{3}")
PATH_FORMS = ("/", "/en/{2}.html", "/de/{2}", "/fr/{2}/", "/es/{2}", "/{0}/{1}/{2}.html")
DOMAINS = ("com", "net", "org")
ITERATIONS, PENALTY = 40, 1e-3


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null; of equally long ones the first listed."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams of the text between bounds, marked by where they are from; linear in the text."""
    return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda chars: F.concat(*(_sized(chars, n, mark) for n in SIZES)))


def _sized(chars: Column, n: int, mark: str) -> Column:
    starts = F.slice(chars, 1, F.greatest(F.size(chars) - n + 1, F.lit(0)))
    return F.transform(starts, lambda _, i: F.concat(F.lit(mark), *(F.get(chars, i + k) for k in range(n))))


def with_grams(urls: DataFrame) -> DataFrame:
    """Add ``grams`` and their hashed counts ``features`` to rows with host and path."""
    grams = urls.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << BITS, binary=True).transform(grams)


def train(labelled: DataFrame) -> LogisticRegressionModel | str:
    """A model from rows of (host, path, label); 1 is block. The one verdict there is, if there is just one."""
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return "block" if 1.0 in counts else "allow"
    rows = with_grams(labelled).select("features", "label")
    return LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY, standardization=False).fit(rows)


def _filled(form: str, word: Column, other: Column, number: Column, domain: Column) -> Column:
    parts = {"{0}": word, "{1}": other, "{2}": number.cast("string"), "{3}": domain}
    return F.concat(*(parts.get(p, F.lit(p)) for p in re.split(r"(\{[0-3]\})", form) if p))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(host, path, label): the labelled table, one row for each word, form and domain; a bare ``site`` host has its words in the path.

    With every domain a word is followed by another one of its list.
    """
    out = []
    for label, listed in ((0.0, ALLOWED_WORDS), (1.0, BLOCKED_WORDS)):
        words = F.array(*(F.lit(w) for w in listed))
        rows = spark.range(1).select(F.posexplode(words).alias("k", "word")).select("*", F.posexplode(F.array(*(F.lit(d) for d in DOMAINS))).alias("d", "domain"))
        other = F.get(words, (F.col("k") * 7 + F.col("d") * 11 + 3) % len(listed))
        number = (F.col("k") * 131 + F.col("d") * 17) % 9000 + 100
        for n, form in enumerate(HOST_FORMS):
            path = PATH_FORMS[-1] if "{0}" not in form else PATH_FORMS[n]
            fill = (F.col("word"), other, number, F.col("domain"))
            out.append(rows.select(_filled(form, *fill).alias("host"), _filled(path, *fill).alias("path"), F.lit(label).alias("label")))
    return reduce(DataFrame.unionByName, out)


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``labelled`` holds (host, path, label), 1 for block; without one the table of this module is used. Returns page_id, host, path, rule, verdict and score (probability of block; null where a rule decides)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_path(url)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    model = train(staged(labelled_urls(pages.sparkSession) if labelled is None else labelled, "url-labels"))
    if isinstance(model, str):
        scored = parts.withColumn("score", F.lit(float(model == "block")))
    else:
        scored = model.transform(with_grams(parts)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"),
        F.when(F.col("rule.rule").isNull(), F.col("score")).alias("score"),
    )
