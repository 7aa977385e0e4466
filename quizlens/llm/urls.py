"""URL filters: rules indexed by their rarest literal token.

A rule is a host and a path prefix, or a regular expression over host and path
with literal tokens that any match must contain. Its index entry is that of its
tokens that the fewest URLs have. A URL's tokens fetch candidate rules by a join,
and only candidates run their test. All of it is DataFrame operations.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
lower case; path: what follows up to ``?``, ``#`` or the end. A null URL or one
without ``://`` has both empty and gets the default verdict. The longest fitting
host rule wins; without one, any fitting blocking pattern blocks. Repeated rows
are judged alike.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import LOWER, UPPER, cut_lineage, few_enough

# fixed values: the host rules of the contract
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# fixed values: patterns of pages without prose and of spam, each with literal tokens that a match contains
PATTERN_RULES = (
    (r"/(login|signin)(/|$)", ("login", "signin")),
    (r"/cart(/|$)", ("cart",)),
    (r"/checkout(/|$)", ("checkout",)),
    (r"(^|\.)ads?[0-9]*\.", ("ad", "ads")),
    (r"(^|[./-])(casino|poker|porn|xxx|adult|pills|viagra)([./-]|$)", ("casino", "poker", "porn", "xxx", "adult", "pills", "viagra")),
    (r"/wp-admin(/|$)", ("wp",)),
)


def parsed(url):
    """Host and path expressions."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def tokens(text):
    """Distinct lower-case runs of ASCII letters or digits; a run of letters ends where digits begin."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z]+|[0-9]+)")))


def rule_table(spark, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """One row per rule: ``rule_id, kind, verdict, rule, host, path, pattern, literals``.

    A pattern rule's literals are alternatives, so all of them are indexed; a host
    rule's are needed together, so only the rarest one is.
    """
    rows = [(i, "host", v, h + p, h, p, None) for i, (v, h, p) in enumerate(host_rules)]
    hosts = spark.createDataFrame(
        rows, "rule_id int, kind string, verdict string, rule string, host string, path string, pattern string"
    ).withColumn("literals", tokens(F.concat("host", F.lit(" "), "path")))
    rows = [(len(host_rules) + i, "pattern", "block", p, list(t)) for i, (p, t) in enumerate(pattern_rules)]
    patterns = spark.createDataFrame(
        rows, "rule_id int, kind string, verdict string, pattern string, literals array<string>"
    )
    return hosts.unionByName(patterns, allowMissingColumns=True)


def rarest(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """The index: ``token`` and the rule. ``pages`` has ``tokens``; its counts say how rare a token is."""
    needed = rules.select("rule_id", "kind", F.explode("literals").alias("token"))
    wanted = few_enough(cut_lineage(needed.select("token").distinct()))
    seen = (
        pages.select(F.explode("tokens").alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    counted = needed.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("n", "token"))
    entries = counted.withColumn("place", place).where("kind = 'pattern' or place = 1").select("rule_id", "token")
    return few_enough(cut_lineage(entries.join(rules, "rule_id").drop("literals")))


def judge(pages: DataFrame, rules: DataFrame, default="allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``page_id`` and ``url``."""
    host, path = parsed(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    each = urls.select("host", "path").distinct()
    each = each.withColumn("tokens", tokens(F.concat("host", F.lit(" "), "path")))
    index = rarest(rules, each).alias("r")
    fits = F.when(
        F.col("r.kind") == "host",
        ((F.col("u.host") == F.col("r.host")) | F.endswith("u.host", F.concat(F.lit("."), F.col("r.host"))))
        & F.startswith("u.path", F.col("r.path")),
    ).otherwise(F.regexp_like(F.concat("u.host", "u.path"), F.col("r.pattern")))
    weight = F.struct(
        F.length("r.rule").alias("size"), F.length("r.host").alias("host_size"), F.col("r.rule").alias("rule"),
        F.col("r.verdict").alias("verdict"),
    )
    verdicts = (
        each.select("host", "path", F.explode("tokens").alias("token")).alias("u")
        .join(index, F.col("u.token") == F.col("r.token"))
        .where(fits)
        .groupBy(F.col("u.host").alias("host"), F.col("u.path").alias("path"))
        .agg(F.max(F.when(F.col("r.kind") == "host", weight)).alias("best"), F.lit(True).alias("_fits"))
    )
    return urls.join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        # a URL with candidates that fit but no host rule met a blocking pattern
        F.coalesce("best.verdict", F.when(F.col("_fits"), "block"), F.lit(default)).alias("verdict"),
    )
