"""URL filters by patterns, with DataFrame functions only.

Each rule is indexed by its rarest literal token, rare by the counts of tokens over all distinct urls. The tokens of a url fetch
the rules that may fit it, by an equi-join, and only those run their regular expressions. The longest rule that fits wins.

A pattern is matched within host and path (no scheme, query or fragment; A-Z of the host lower-cased):

    ||  at its start: there begins the host or a part of it after a dot      *  anything
    |   at its start or end: there begins or ends host and path              ^  a separator, or the end

A separator is anything but a letter, a digit or one of _ . % - . All else stands for itself, in any case of A-Z unless match_case.

A literal token is a run of a-z and 0-9 of a pattern that has neither an open end nor a * beside it, so that it is a whole token of
each url that fits. A rule without one would have to run for all urls, and is refused, as is a null pattern.

Null urls and those without :// have an empty host and path and no rule. Urls alike are judged once; repeated rows stay. Extra columns
are not read; an empty table gives an empty one. Rules beyond BROADCAST_RULES or BROADCAST_BYTES meet the urls by a merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import LOWER, UPPER, join_hot, lower, write_table

#: Sent to all tasks only up to so many rules and bytes of patterns.
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 8 << 20
RULES_SCHEMA = "rule string, pattern string, verdict string, tier int, match_case boolean"

#: Fixed by the contract: verdict, host, path.
SITE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: What the method itself rejects or keeps: names of advertising, gambling, adult, pharmacy and spam sites.
PATTERN_RULES = [
    ("block", "||adult-"),
    ("block", "||xxx."),
    ("block", "||casino-"),
    ("block", "-casino."),
    ("block", "/casino/"),
    ("block", "||poker-"),
    ("block", "||free-bets."),
    ("block", "-bets."),
    ("block", "||cheap-pills."),
    ("block", "||*-pharmacy."),
    ("block", "||ads."),
    ("block", "||ads-*."),
    ("block", "||adserver^"),
    ("block", "/banner/*/ads/"),
    ("block", "||spam-"),
    ("block", "||link-farm."),
    ("block", "||payday-loans."),
    ("allow", "||ads-standards."),
    ("allow", "||casino-history."),
    ("allow", "/museum/casino/"),
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """After the first ://; empty without one."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (RULES_SCHEMA) with their regular expression and their literal tokens."""
    pattern = F.when(F.col("match_case"), F.col("pattern")).otherwise(lower(F.col("pattern")))
    start = F.when(pattern.startswith("||"), r"^(?:[^/]*\.)?").when(pattern.startswith("|"), "^").otherwise("")
    end = F.when(F.rtrim(pattern, F.lit("|")) != pattern, r"\z").otherwise("")
    escaped = F.regexp_replace(F.trim(pattern, F.lit("|")), r"([\\.+?|{}()\[\]$])", r"\\$1")
    body = F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:[^A-Za-z0-9_.%\-]|\z)"))
    literal = F.regexp_extract_all(lower(F.col("pattern")), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0))
    return rules.select("*", F.concat(F.lit("(?s)"), start, body, end).alias("regex"), F.array_distinct(literal).alias("literals"))


def rule_table(spark, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Rules of sites (verdict, host, path) and, after them, patterns (verdict, pattern)."""
    sites = [(f"{host}{path}", f"||{host}{path}", verdict, 0, True) for verdict, host, path in site_rules]
    return spark.createDataFrame(sites + [(pattern, pattern, verdict, 1, False) for verdict, pattern in pattern_rules], RULES_SCHEMA)


def hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, tier, rule, pattern, verdict) of the rules that fit each of urls (url, host, path; distinct)."""
    made = write_table(compiled(rules), "url_rules")
    n, size, without = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("regex") + F.octet_length("pattern")), F.lit(0)), F.count_if(F.coalesce(F.size("literals"), F.lit(0)) < 1)).first()
    if without:
        raise ValueError(f"{without} patterns have no literal token: {made.where('coalesce(size(literals), 0) < 1').select('pattern').limit(5).collect()}")
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_RULES and size <= BROADCAST_BYTES else (lambda df: df)
    subject = F.concat("host", "path")
    found = urls.select("url", subject.alias("subject"), F.explode(tokens(lower(subject))).alias("token"))
    literals = made.select("rule", "pattern", F.explode("literals").alias("token"))
    counts = found.join(small(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("rule", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("m"))
    index = write_table(made.join(rarest.select("rule", "pattern", "m.token"), ["rule", "pattern"]).distinct(), "url_index")
    candidates = found.join(small(index), "token")
    fits = F.rlike(F.when(F.col("match_case"), F.col("subject")).otherwise(lower(F.col("subject"))), F.col("regex"))
    return candidates.where(fits).select("url", "tier", "rule", "pattern", "verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, url) with host, path, and the rule, its tier and verdict that wins: first tier, longest pattern; ties by pattern,
    a block before an allow. Null where no rule fits."""
    own = pages.select("page_id", "url")
    host, path = host_and_path()
    urls = write_table(own.where("contains(url, '://')").groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", host.alias("host"), path.alias("path"), "n"), "urls")
    best = F.min(F.struct("tier", (-F.length("pattern")).alias("short"), "pattern", (F.col("verdict") == "allow").alias("mild"), "rule", "verdict")).alias("best")
    winners = hits(urls, rules).groupBy("url").agg(best)
    verdicts = write_table(urls.join(winners.hint("merge"), "url").select("url", "n", "best.tier", "best.rule", "best.verdict"), "url_verdicts")
    return join_hot(own, verdicts, ["url"], "n", "left", merge=True).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "tier", "rule", "verdict")


def query(pages: DataFrame) -> DataFrame:
    judged = judge(pages, rule_table(pages.sparkSession))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("tier") == 0, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("tier") == 1, F.col("rule")).alias("pattern"),
    )


def oracle() -> str:
    """The same by DuckDB, each rule put to each url, without an index."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    sites = ", ".join(f"({text(v)}, {text(h)}, {text(p)})" for v, h, p in SITE_RULES)

    def regex(pattern: str) -> str:
        start = r"^([^/]*\.)?" if pattern.startswith("||") else ""
        literal = "".join({"*": ".*", "^": r"([^a-z0-9_.%\-]|$)", ".": r"\.", "/": "/", "-": "-"}.get(c, c) for c in pattern.strip("|"))
        return "(?s)" + start + literal

    patterns = ", ".join(f"({text(v)}, {text(p)}, {text(regex(p))})" for v, p in PATTERN_RULES)
    cut = "CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END"
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, {cut} AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT * FROM (VALUES {sites}) t(verdict, h, q)), m AS (SELECT * FROM (VALUES {patterns}) t(verdict, pattern, re)),
a AS (SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict FROM p, s
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r),
b AS (SELECT r, arg_min(pattern, (-length(pattern), pattern)) AS pattern, arg_min(verdict, (-length(pattern), pattern)) AS verdict FROM p, m
      WHERE regexp_matches(translate(host || path, '{UPPER}', '{LOWER}'), re) GROUP BY r)
SELECT page_id, host, path, a.rule, coalesce(a.verdict, b.verdict, 'allow') AS verdict, CASE WHEN a.rule IS NULL THEN b.pattern END AS pattern
FROM p LEFT JOIN a ON p.r = a.r LEFT JOIN b ON p.r = b.r"""
