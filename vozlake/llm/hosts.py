"""URL filter: explicit rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled page outcomes (bad or not) are counted per host.  Bad rates are beta-binomial at every level: a
suffix is drawn around the rate of all pages, a registered domain around its suffix, a host around
its domain.  The strength of each prior comes from the data, by the method of moments: the spread of the
children's rates around their parents' beyond what chance gives.  A host is blocked if the lower
posterior bound of its bad rate exceeds ``limit``; few outcomes leave a host near its domain.

Counts are summed before anything is joined, so a host with a third of all pages is one row.

A null url or one without ``://`` has an empty host and path; that host is judged like any other.  A page
counts once for each of its hosts, however often its row repeats; several labels of one page count
as bad if any is.  Pages without labels get their host's or its parents' verdict.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.llm.common import ascii_lower, materialize, unused

LIMIT, DEVIATIONS = 0.5, 1.645
LEAST_SPREAD, MOST_SPREAD, USUAL_SPREAD = 0.001, 0.5, 0.1

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Public suffixes of two labels, the common ones.
DOUBLE_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "net.br", "org.br", "com.cn", "com.mx",
    "com.ar", "com.tr", "com.tw", "co.in", "co.nz", "co.za", "co.il", "com.sg", "com.hk", "com.pl", "com.ua", "com.es",
]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The label before the public suffix, with that suffix; addresses and short hosts are their own domain."""
    parts = F.split(host, r"\.")
    labels = F.when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), 3).otherwise(2)
    last = F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(r"^[0-9.:\[\]]*$") | (F.size(parts) <= labels), host).otherwise(last)


def suffix_of(domain: Column) -> Column:
    """What follows the first label of a registered domain; empty for an address or a single label."""
    return F.when(domain.rlike(r"^[0-9.:\[\]]*$") | ~domain.contains("."), F.lit("")).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def spread(children: DataFrame) -> float:
    """Intraclass correlation of (n, bad) around ``mean``, by moments."""
    miss = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), F.lit(2)) / (F.col("mean") * (1 - F.col("mean"))) - 1
    got = children.where("n > 0").agg(F.sum(miss).alias("over"), F.sum(F.col("n") - 1).alias("pairs")).first()
    if not got["pairs"]:
        return USUAL_SPREAD
    return min(MOST_SPREAD, max(LEAST_SPREAD, got["over"] / got["pairs"]))


def shrunk(strength: float) -> Column:
    """The posterior mean of (n, bad) around ``mean``."""
    return (F.col("bad") + strength * F.col("mean")) / (F.col("n") + strength)


def strength_of(correlation: float) -> float:
    return 1 / correlation - 1


def reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """``outcomes``: host, n, bad (one row per host).  Adds the posterior mean of the bad rate and its lower bound."""
    domain = domain_of(F.col("host"))
    hosts = materialize(outcomes.select("host", domain.alias("domain"), suffix_of(domain).alias("suffix"), "n", "bad"), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("mean", F.lit(overall))
    suffixes = suffixes.select("suffix", shrunk(strength_of(spread(suffixes))).alias("mean"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(strength_of(spread(domains))).alias("mean"))
    own = hosts.join(domains, "domain")
    strength = strength_of(spread(own))
    size = F.col("n") + F.lit(strength)
    mean = shrunk(strength)
    return own.select("host", "domain", "suffix", "n", "bad", mean.alias("bad_rate"), (mean - deviations * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bound"))


def host_outcomes(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """host, n, bad over the labelled pages; hosts without any have zeros.  ``labels``: id and bad (0 or 1)."""
    own = pages.select(F.col(f"`{page_id}`").alias("id"), host_of(F.col(f"`{url}`")).alias("host")).distinct()
    told = labels.where("bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    return own.join(told, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, limit: float = LIMIT, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", out: str = "url_verdict") -> DataFrame:
    """All rows and columns of ``pages`` and a struct ``out``: host, path, rule, verdict, bound."""
    known = reputation(host_outcomes(pages, labels, page_id, url))
    key, bound = unused(pages, "known_host"), unused(pages, "known_bound")
    address = F.col(f"`{url}`")
    both = pages.withColumn(f"{key}_own", host_of(address)).join(known.select(F.col("host").alias(key), F.col("bound").alias(bound)), F.col(f"{key}_own") == F.col(key), "left")
    host, path = F.col(f"{key}_own"), path_of(address)
    rule = rule_for(host, path, rules)
    by_method = F.when(F.col(bound) > limit, "block").otherwise("allow")
    made = F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), F.coalesce(rule["verdict"], by_method).alias("verdict"), F.col(bound).alias("bound"))
    return both.withColumn(out, made).select(*[F.col(f"`{c}`") for c in pages.columns if c != out], out)


def bad_outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if its quality is 0 or it is toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("id"), bad.alias("bad"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    mark = F.col("v")
    return judge(pages.select("page_id", "url"), bad_outcomes(labels), out="v").select("page_id", *[mark[c].alias(c) for c in ("host", "path", "rule", "verdict")])


def _moments(table: str) -> str:
    over = "n * power(bad / n - mean, 2) / (mean * (1 - mean)) - 1"
    return f"SELECT 1 / coalesce(least({MOST_SPREAD}, greatest({LEAST_SPREAD}, sum({over}) / nullif(sum(n - 1), 0))), {USUAL_SPREAD}) - 1 AS k FROM {table} WHERE n > 0"


_LOWER = "translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DOUBLE = "('" + "', '".join(DOUBLE_SUFFIXES) + "')"
_FITS = " ".join(
    f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}') THEN '{own}{start}'" for _, own, start in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_VERDICTS = " ".join(f"WHEN '{own}{start}' THEN '{verdict}'" for verdict, own, start in RULES)
SQL = f"""
WITH p AS (SELECT page_id, coalesce({_LOWER}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
o AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN l ON page_id = doc_id GROUP BY 1),
s AS (SELECT *, string_split(host, '.') AS parts FROM o),
t AS (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN {_DOUBLE} THEN 3 ELSE 2 END AS k FROM s),
d AS (SELECT host, n, bad, CASE WHEN regexp_full_match(host, '[0-9.:\\[\\]]*') OR len(parts) <= k THEN host ELSE array_to_string(parts[-k:], '.') END AS domain FROM t),
h AS (SELECT *, CASE WHEN regexp_full_match(domain, '[0-9.:\\[\\]]*') OR NOT contains(domain, '.') THEN '' ELSE regexp_replace(domain, '^[^.]*\\.', '') END AS suffix FROM d),
g AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS mean FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(g.mean) AS mean FROM h, g GROUP BY 1),
sk AS ({_moments("s0")}),
s1 AS (SELECT suffix, (bad + k * mean) / (n + k) AS mean FROM s0, sk),
d0 AS (SELECT domain, n, bad, mean FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2) JOIN s1 USING (suffix)),
dk AS ({_moments("d0")}),
d1 AS (SELECT domain, (bad + k * mean) / (n + k) AS mean FROM d0, dk),
h0 AS (SELECT h.host, h.n, h.bad, d1.mean FROM h JOIN d1 USING (domain)),
hk AS ({_moments("h0")}),
h1 AS (SELECT host, n + k AS size, (bad + k * mean) / (n + k) AS m FROM h0, hk),
b AS (SELECT host, m - {DEVIATIONS} * sqrt(m * (1 - m) / (size + 1)) AS bound FROM h1),
r AS (SELECT p.*, bound, CASE {_FITS} END AS rule FROM p LEFT JOIN b USING (host))
SELECT page_id, host, path, rule, coalesce(CASE rule {_VERDICTS} END, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
