"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

A host with few labelled pages says little by itself. Its rate of bad pages is shrunk towards
the rate of its registered domain, that towards the rate of its suffix, and that towards all
labelled pages. Every level is a beta-binomial model: a unit with ``bad`` of ``n`` pages and a
parent with rate ``m`` has the posterior Beta(m * s + bad, (1 - m) * s + n - bad), where the
strength ``s`` of the level is fitted by the method of moments over all units of that level.

The posterior's lower bound is its mean less ``z`` standard deviations; a page whose host's bound lies
above ``limit`` is blocked. A host without labelled pages has its domain's posterior mean, that of the suffix where the
domain has none either and the overall rate where the suffix has none, with the same bound. Without any labelled
page at all nothing is known and all hosts are allowed.

Null or empty urls, or urls without ``://``, have an empty host and path, match no rule and are judged as
the host ``''``. Repeated rows give repeated results; an empty table gives an empty result.
Labels that match no page count for nothing; null labels or null ids count as unlabelled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .text import ascii_lower

Rule = tuple[str, str, str]  # host, path, verdict

#: Default suffixes; any other suffix is the last label. ``read_suffixes`` gives the whole public list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
Z = 1.645
LIMIT = 0.30


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host lower-cased in A-Z, and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; rules are configuration, a few to a few thousand."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda r: ((r["host"] == host) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])
    items = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in ordered])
    best = F.get(F.filter(items, fits), 0)
    return F.concat(best["host"], best["path"]), best["verdict"]


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """Rules of a file in the format of the public suffix list, names in other scripts also in their ASCII form."""
    rules = [r["value"].split()[0] for r in spark.read.text(path).collect() if r["value"].strip() and not r["value"].startswith("//")]
    mark = lambda r: r[: len(r) - len(r.lstrip("*!."))]
    coded = {mark(r) + r[len(mark(r)) :].encode("idna").decode() for r in rules}
    return sorted({*rules, *coded})


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Longest suffix that fits, or else the last label. ``*.x`` stands for any one label before x, ``!y.x`` exempts y.x from it."""
    labels = F.split(host, r"\.")
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    plain = [x for x in suffixes if x[0] not in "*!"]
    wild, exempt = [x[2:] for x in suffixes if x[0] == "*"], [x[1:] for x in suffixes if x[0] == "!"]
    among = lambda i, names: tail(i).isin(names) if names else F.lit(False)
    first = lambda fits: F.get(F.filter(F.sequence(F.lit(1), F.size(labels)), fits), 0)
    longest = first(lambda i: among(i, plain) | among(i + 1, wild))
    return tail(F.coalesce(first(lambda i: among(i, exempt)) + 1, longest, F.size(labels)))


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and one label more."""
    labels = F.split(host, r"\.")
    keep = F.size(F.split(suffix, r"\.")) + 1
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), keep), ".")


def _shrunk(units: DataFrame, key: str, n: str, bad: str, mean: Column) -> DataFrame:
    """Add strength, posterior mean and variance of each unit, given its parent's mean.

    Moments: sum (bad - n m)^2 / (m (1 - m)) = sum n (1 + (n - 1) rho), and s = 1 / rho - 1. A level
    without pairs of pages, or with less spread than chance, gets the largest strength.
    """
    rows = units.withColumn("_m", F.least(F.greatest(mean, F.lit(0.001)), F.lit(0.999)))
    n_, b_ = F.col(n), F.col(bad)
    fit = rows.agg(
        F.sum((b_ - n_ * F.col("_m")) * (b_ - n_ * F.col("_m")) / (F.col("_m") * (1 - F.col("_m")))).alias("chi"),
        F.sum(n_).alias("n1"),
        F.sum(n_ * (n_ - 1)).alias("n2"),
    ).first()
    rho = (fit["chi"] - fit["n1"]) / fit["n2"] if fit["n2"] else 0.0
    s = F.lit(1.0 / min(max(rho, 0.001), 0.5) - 1.0)
    a, total = F.col("_m") * s + b_, s + n_
    post = a / total
    return rows.select(*units.columns, post.alias(f"{key}_mean"), (post * (1 - post) / (total + 1)).alias(f"{key}_var"))


def host_reputation(pages: DataFrame, labels: DataFrame, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, low): one row per host of ``pages``; ``low`` is null if no page at all is labelled.

    ``pages`` has page_id and host, ``labels`` page_id and bad (0 or 1). Pages are counted per host
    ahead of every join up the levels, so a hot host is one row.
    """
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    suffix = suffix_of(F.col("host"), suffixes)
    hosts = (
        pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    )
    hosts = materialize(hosts, "host-counts")
    all_pages = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    m0 = float((all_pages["bad"] or 0) + 0.5) / float((all_pages["n"] or 0) + 1)
    up = lambda keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(up(["suffix"]), "suffix", "n", "bad", F.lit(m0)).select("suffix", "suffix_mean")
    domains = _shrunk(up(["suffix", "domain"]).join(suffixes, "suffix"), "domain", "n", "bad", F.col("suffix_mean")).select("domain", "domain_mean")
    out = _shrunk(hosts.join(domains, "domain"), "host", "n", "bad", F.col("domain_mean"))
    low = F.col("host_mean") - Z * F.sqrt("host_var") if all_pages["n"] else F.lit(None).cast("double")
    return out.select("host", "n", "bad", F.col("host_mean").alias("mean"), low.alias("low"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], limit: float = LIMIT, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(parts.select("page_id", "host"), labels, suffixes).select("host", "low")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("low") > limit, "block").otherwise("allow")
    return parts.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict")
    )
