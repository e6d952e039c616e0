"""URL filter: host rules with path prefixes, and pattern rules indexed by their rarest literal token.

A pattern is text with these signs: ``*`` any characters, ``^`` one character other than a-z and 0-9 or an end of the url, ``||`` in front the
start of the host or of one of its labels, ``|`` in front or behind the start or end of the url, ``@@`` in front of all an exception. Patterns and
urls are compared with A-Z lower-cased.

1. A literal token of a pattern is a run of a-z and 0-9 that no ``*`` and no open end can lengthen, so a url that matches holds it as a token.
2. Tokens of patterns are counted over all distinct urls; each pattern is indexed by its rarest one, patterns without any by the empty token.
3. The tokens of a url (the empty one is in all) fetch candidates from the index, and only those run their regular expressions.

A matching exception goes before all blocks, else the longest matching pattern decides; a url that matches nothing is allowed. Host rules go
before patterns: a rule fits its host and all subdomains where the path starts with its path; the longest (host and path) wins, then the longer
host, then block.

NULL urls count as empty. Repeated rows are judged once and all returned; other columns of the table are not read. Work per page does not grow with
the number of rules, and all of it is Column code. The rules go to every task only where their measured size is small (``common.bounded``); a larger table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm.common import bounded, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_START = r"\A[^/?#]*?://(?:[^/?#]*[.])?"
BORDER = r"(?:[^a-z0-9]|\A|\z)"

#: Host rules of the registered query, fixed by its contract: (verdict, host, path).
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Patterns of the registered query.
PATTERNS = [
    "^adult^", "^porn^", "^xxx^", "^casino^", "^poker^", "^bets^", "^betting^", "^gambling^", "^pills^", "^viagra^", "^replica^watches^",
    "^payday^loan", "^warez^", "^torrent^", "^spam^", "||ads^", "||adserver^", "||click^track*^id=", "^phishing^", "/wp-login.php|", "^free^*^download^*.exe|",
    "@@^adult^education^", "@@^anti^spam^", "@@^gambling^help^",
]


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a lower-cased url; the empty one is always there."""
    return F.array_union(F.array(F.lit("")), F.split(url, "[^a-z0-9]+"))


def compiled(patterns: DataFrame) -> DataFrame:
    """pattern -> (pattern, excepts, regex, literals), one row per different pattern; NULL and empty ones mean nothing and go."""
    text = F.col("_text")
    inner = F.regexp_replace(F.regexp_replace(text, r"\A\|\|?", ""), r"\|\z", "")
    inner = F.regexp_replace(inner, r"([.\[\]{}()+?$|\\])", r"\\$1")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\*+", ".*"), r"\^", BORDER.replace("\\", r"\\"))
    front = F.when(text.startswith("||"), HOST_START).when(text.startswith("|"), r"\A").otherwise("")
    back = F.when(text.endswith("|") & (F.length(text) > 1), r"\z").otherwise("")
    excepts = F.col("pattern").startswith("@@")
    return (
        patterns.select("pattern").where("pattern is not null").distinct()
        .withColumn("excepts", excepts).withColumn("_text", lowered(F.regexp_replace("pattern", r"\A@@", "")))
        .where("_text <> ''")
        .select("pattern", "excepts", F.concat(F.lit("(?s)"), front, inner, back).alias("regex"),
                F.array_distinct(F.regexp_extract_all(text, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1))).alias("literals"))
    )


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The compiled rules with the ``token`` of theirs that the fewest urls hold; the smaller token where two are as rare."""
    wanted = rules.select("pattern", F.explode_outer("literals").alias("token")).where("token is not null")
    found = urls.select(F.explode(tokens(F.col("low"))).alias("token"))
    counts = found.join(bounded(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return rules.join(rarest, "pattern", "left").withColumn("token", F.coalesce("token", F.lit("")))


def pattern_verdicts(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, pattern, allow) of the urls, columns ``url`` and ``low``, that match a pattern."""
    index = bounded(stored(indexed(compiled(patterns), urls), "url-index").select("token", "pattern", "regex", "excepts"))
    candidates = urls.select("url", "low", F.explode(tokens(F.col("low"))).alias("token")).join(index, "token")
    best = F.max(F.struct("excepts", F.length("pattern").alias("n"), "pattern")).alias("_best")
    return (
        candidates.where(F.regexp_like("low", F.col("regex"))).groupBy("url").agg(best)
        .select("url", F.col("_best.pattern").alias("pattern"), F.col("_best.excepts").alias("allow"))
    )


def host_verdicts(urls: DataFrame, host_rules: DataFrame) -> DataFrame:
    """(url, rule, allow) of the urls that a rule (verdict, host, path) fits."""
    rules = host_rules.where("verdict in ('allow', 'block')").select(
        lowered(F.col("host")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), (F.col("verdict") == "allow").alias("allow")).where("_host <> ''").distinct()
    longest = rules.select(F.max(F.length("_host"))).first()[0] or 0
    # labels behind the dots of the host's last characters: enough for every rule, and no more on an endless host
    labels = F.split(F.substring(F.concat(F.lit("."), "host"), -(longest + 1), longest + 1), "[.]")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fitting = parts.select("url", "path", F.explode(ends).alias("_host")).join(bounded(rules), "_host").where(F.expr("startswith(path, _path)"))
    rule = F.concat("_host", "_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("_host").alias("h"), (~F.col("allow")).alias("blocks"), rule.alias("rule"))).alias("_best")
    return fitting.groupBy("url").agg(best).select("url", F.col("_best.rule").alias("rule"), (~F.col("_best.blocks")).alias("allow"))


def judge(pages: DataFrame, host_rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(page_id, url) -> (page_id, host, path, rule, verdict, pattern), a row for every page; ``pattern`` is what decided where no host rule fits."""
    urls = stored(pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct(), "urls")
    by_host = stored(host_verdicts(urls, host_rules), "url-hosts")
    # verdicts grow with the table: never broadcast, however small their files look
    rest = urls.join(by_host.hint("merge"), "url", "left_anti").withColumn("low", lowered(F.col("url")))
    verdicts = by_host.withColumn("pattern", F.lit(None).cast("string")).unionByName(pattern_verdicts(rest, patterns), allowMissingColumns=True)
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    return rows.join(verdicts.hint("merge"), "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.when(F.coalesce("allow", F.lit(True)), "allow").otherwise("block").alias("verdict"), "pattern")


def rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The host rules and patterns of the registered query."""
    return (spark.createDataFrame(HOST_RULES, "verdict string, host string, path string"), spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))
