"""URL verdicts by rules and by the reputation of the host.

Reputation is empirical Bayes: labelled page outcomes (1 = block, 0 = allow) are beta-binomial per host, shrunk towards the registered
domain, that towards its suffix, and that towards the rate over all labelled pages. On each level the weight of
the prior comes from how much the rates of that level differ between its members (method of moments). A host is blocked if the
lower posterior bound of its rate, `z` standard deviations below the mean, is above `threshold`: little evidence allows.

Cases: a url that is null or has no `://` has host and path '', no rule, and the reputation of the host ''. Repeated rows are
judged alike. Without any labelled page nothing is blocked but by rules.

Scale: pages are read twice, and counted per host before they are shuffled; what is joined back is a row per host; three rows of moments go
to the driver. Domain: the last two labels of the host; suffix: the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableprobe.llm.common import prepare, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one. Of equally long ones, the first."""
    text = verdict = F.lit(None).cast("string")
    for outcome, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        text = F.when(fits, of_host + of_path).otherwise(text)
        verdict = F.when(fits, outcome).otherwise(verdict)
    return text, verdict


def _strength(units: DataFrame, rate: float) -> float:
    """The prior weight of one level: how many observations the level's mean is worth to a member."""
    row = units.agg(
        F.count("*").alias("i"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("s"),
    ).first()
    if not row.i or row.i < 2 or rate in (0.0, 1.0):
        return 10.0
    n, spread = float(row.n), rate * (1 - rate)
    rho = ((row.s - n * rate * rate) - (row.i - 1) * spread) / (spread * (n - row.nn / n - (row.i - 1)) or 1.0)
    rho = min(max(rho, 0.001), 0.999)
    return 1 / rho - 1


def judge_urls(
    pages: DataFrame, outcome: Column, rules: Sequence[Rule], url_column: str = "url", z: float = 1.645, threshold: float = 0.5
) -> DataFrame:
    """Every row of `pages` with the structs `url_parts` (host, path) and `judged` (rule, verdict, n, rate, bound).

    `outcome` is a column over `url_parts` and the columns of `pages`: 1, 0 or null. `n`, `rate` and `bound` are the host's labelled
    pages, posterior mean and lower bound.
    """
    prepare(pages.sparkSession)
    url = pages[f"`{url_column}`"]
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    # every host that occurs, labelled or not; written, as all levels and the last join start from it
    counts = pages.select(host_of(url).alias("host"), outcome.cast("int").alias("y")).groupBy("host")
    every = saved(counts.agg(F.count("y").alias("n"), F.sum("y").alias("k")), "url-hosts")
    hosts = every.where("n > 0").withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    rate = whole.k / whole.n if whole.n else 0.0
    m_suffix, m_domain, m_host = (_strength(level, rate) for level in (suffixes, domains, hosts))

    def mean(weight: float, prior: Column, n: Column, k: Column) -> Column:
        return (weight * prior + F.coalesce(k, F.lit(0))) / (weight + F.coalesce(n, F.lit(0)))

    suffixes = suffixes.select("suffix", mean(m_suffix, F.lit(float(rate)), F.col("n"), F.col("k")).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", mean(m_domain, F.col("suffix_rate"), F.col("n"), F.col("k")).alias("domain_rate"), "suffix_rate")
    seen = every.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    seen = seen.join(domains.select("domain", "domain_rate"), "domain", "left").join(suffixes, "suffix", "left")
    prior = F.coalesce("domain_rate", mean(m_domain, F.coalesce("suffix_rate", F.lit(float(rate))), F.lit(0), F.lit(0)))
    seen = seen.select("host", "n", mean(m_host, prior, F.col("n"), F.col("k")).alias("rate"))
    seen = seen.withColumn("bound", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (m_host + F.col("n") + 1)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    found = rows.join(seen, "host", "left")
    judged = F.struct(
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"),
        "n",
        "rate",
        "bound",
    )
    return found.select("row", F.struct("host", "path").alias("url_parts"), judged.alias("judged"))
