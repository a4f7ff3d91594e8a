"""URL filter: block and allow rules, and empirical-Bayes reputation of hosts where no rule fits.

A page with a label is one trial of its host: bad (1) or good (0). A rate is shrunk level by level: all pages to suffix, suffix
to registered domain, domain to host. At each level the units (say, hosts) are taken as draws of a beta distribution round their
parent's posterior mean; its strength comes from the moments of the observed rates: with x_i of n_i bad and parent mean m_i,

    spread = sum (x_i - n_i m_i)^2 / n_i,    rho = (spread - sum m_i(1-m_i)) / sum (n_i - 1) m_i(1-m_i)

where rho is the correlation of trials in one unit, and the strength is 1/rho - 1, held between ``least`` and ``most``. A host
is blocked when the lower bound of its posterior bad rate, ``z`` deviations below the mean, passes ``limit``.

Nothing but sums per unit is gathered, so a host with a third of all pages arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from finality.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First part up to the first "://", then host and path.
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    """Host of a URL in lower case; empty where the URL is null or has no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    at = (F.col("host") == host) | F.col("host").endswith("." + host)
    return at & F.col("path").startswith("/" + path)


def longest_rule(rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (``host/path`` to verdict) that fits; null where none does."""
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in sorted(rules, key=lambda r: (-len(r), r))]) if rules else F.lit(None).cast("string")


def outcomes(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of ``labels`` (doc_id, quality, toxic): toxic or of low quality. Repeated labels of a document: bad if any is."""
    bad = F.coalesce(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int"), (F.col("toxic") == 1).cast("int"), (F.col("quality") == 0).cast("int"))
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad")).filter("bad is not null")


def shrunk(units: DataFrame, unit: str, parent: str, means: DataFrame, least: float, most: float) -> DataFrame:
    """Adds prior mean ``m`` from the parent's posterior, and the beta parameters ``a`` and ``b`` of the posterior, to units (n, x)."""
    joined = units.join(means, parent)
    one = F.col("m") * (1 - F.col("m"))
    moments = joined.filter("n > 0").agg(
        F.sum(F.pow(F.col("x") - F.col("n") * F.col("m"), 2) / F.col("n")).alias("spread"), F.sum(one).alias("units"), F.sum((F.col("n") - 1) * one).alias("trials")
    )
    rho = F.when(F.col("trials") > 0, (F.col("spread") - F.col("units")) / F.col("trials")).otherwise(0.0)
    strength = moments.select(F.least(F.greatest(F.when(rho > 1 / (1 + most), 1 / rho - 1).otherwise(most), F.lit(least)), F.lit(most)).alias("s"))
    return joined.crossJoin(F.broadcast(strength)).select(  # one row
        *units.columns,
        (F.col("s") * F.col("m") + F.col("x")).alias("a"),
        (F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("x")).alias("b"),
    )


def reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(host, n, x, bad_rate, bad_bound) of every host in ``pages`` (page_id, host). Hosts without labels have their domain's prior."""
    judged = pages.join(outcomes(labels), pages.page_id == F.col("doc_id"), "left")
    hosts = judged.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    labels_of = F.split("host", "[.]")
    hosts = hosts.select("host", F.array_join(F.slice(labels_of, F.greatest(F.size(labels_of) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(labels_of, -1).alias("suffix"), "n", "x")
    # every level reads the hosts; pages and labels are read for them once
    hosts = stored(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("every", F.lit(1))
    # half a bad and half a good page more, so that no rate is 0, 1 or undefined
    root = suffixes.groupBy("every").agg(((F.sum("x") + 0.5) / (F.sum("n") + 1)).alias("m"))
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("m")
    by_suffix = shrunk(suffixes, "suffix", "every", root, least, most).select("suffix", mean)
    by_domain = stored(shrunk(domains, "domain", "suffix", by_suffix, least, most).select("domain", mean), "domains")
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return shrunk(hosts, "host", "domain", by_domain, least, most).select(
        "host", "n", "x", (F.col("a") / total).alias("bad_rate"), (F.col("a") / total - z * deviation).alias("bad_bound")
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str], limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, the rule that fits, and the verdict.

    A null URL has an empty host, which is judged as any other host. Labels of no page, and rows without an id, count nowhere.
    """
    placed = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    known = reputation(placed, labels, z)
    ruled = placed.withColumn("rule", longest_rule(rules)).join(known, "host")
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()]) if rules else F.lit(None).cast("string")
    return ruled.select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_bound"
    )
