"""URL filter by empirical-Bayes host reputation, in DataFrame functions alone.

Fixed rules (host, path prefix, verdict) judge first; the longest that fits wins. The pages that a rule judges, or that an
outcome table marks, are the labelled outcomes (1: bad). Outcomes are counted per host, then rolled up to registered domain,
suffix and all pages. At each level the bad share of a unit is shrunk towards its parent's by a beta prior
(``strength * parent``, ``strength * (1 - parent)``) whose strength comes from the spread of that level's units (method of
moments of the beta-binomial). A page that no rule judges is blocked if the lower bound of its host's posterior,
``mean - z * sd``, reaches ``limit``; hosts without outcomes fall back on their domain, its suffix, or all pages.

Counts are combined in the map tasks, so a host with a third of all pages is one row per task; the join back to pages deals
each host over ``SALTS`` copies. Null urls and urls without ``://`` have an empty host and path: no rule fits, and they are
judged like a host without outcomes. Repeated rows are judged (and counted) each; extra columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import keep

ALLOW, BLOCK = "allow", "block"
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Registered domains end one label before these, or before the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "co.kr")
LEAST_SHARE, MOST_SHARE = 0.001, 0.999


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(text, verdict) of the longest rule that fits; null if none does. A rule is ``host/path`` with a verdict."""
    known = sorted(((text, verdict, *text.split("/", 1)) for text, verdict in rules), key=lambda r: (-len(r[0]), r[0]))
    if not known:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    listed = F.array(*[
        F.struct(F.lit(t).alias("text"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit("/" + p).alias("path"))
        for t, v, h, p in known
    ])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.when(F.size(fits) > 0, F.struct(fits[0]["text"].alias("text"), fits[0]["verdict"].alias("verdict")))


def suffix_of(host: Column) -> Column:
    last = F.element_at(F.split(host, r"\."), -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(labels == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -3))


def strength(units: DataFrame) -> DataFrame:
    """One row: the prior's strength from units with ``n`` outcomes, ``k`` bad ones and their ``parent`` share.

    With within-unit correlation r the expected square of ``k - n p`` is ``n p q (1 + (n - 1) r)``; the strength is ``1/r - 1``.
    """
    spread = F.col("parent") * (1 - F.col("parent"))
    pure = F.sum(F.col("n") * spread)
    excess = F.sum(F.pow(F.col("k") - F.col("n") * F.col("parent"), 2)) - pure
    share = excess / F.sum(F.col("n") * (F.col("n") - 1) * spread)
    return units.agg(share.alias("r")).select(
        (1 / F.least(F.greatest(F.coalesce("r", F.lit(LEAST_SHARE)), F.lit(LEAST_SHARE)), F.lit(MOST_SHARE)) - 1).alias("strength")
    )


def _level(units: DataFrame) -> DataFrame:
    """Adds ``mean`` (posterior) and ``weight`` (strength + n) to units (n, k, parent)."""
    prior = units.withColumn("strength", strength(units).scalar())
    return prior.withColumn("mean", (F.col("k") + F.col("strength") * F.col("parent")) / (F.col("n") + F.col("strength"))).withColumn(
        "weight", F.col("n") + F.col("strength")
    ).drop("strength")


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Posterior mean and weight of all pages, suffixes, domains and hosts from rows (host, bad)."""
    bad = F.col("bad").cast("double")
    hosts = outcomes.filter("bad IS NOT NULL AND host <> ''").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(bad).alias("k"))
    hosts = keep(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "host-outcomes")
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    # one imaginary good and bad page keep the share of all pages inside (0, 1)
    whole = hosts.agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).select(
        ((F.col("k") + 1) / (F.col("n") + 2)).alias("mean"), (F.col("n") + 2).alias("weight")
    )
    suffixes = _level(hosts.groupBy("suffix").agg(*sums).withColumn("parent", whole.select("mean").scalar()))
    domains = _level(hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("parent")), "suffix"))
    hosts = _level(hosts.join(domains.select("domain", F.col("mean").alias("parent")), "domain"))
    return {"all": whole, "suffix": suffixes, "domain": domains, "host": hosts}


def bound(mean: Column, weight: Column, z: float) -> Column:
    return mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, z: float = 1.645, limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url).

    ``outcomes`` (url, bad 0/1) are further labelled pages; the pages that a rule judges always count.
    """
    parts = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    parts = parts.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    marked = parts.select("host", F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == BLOCK).cast("int")).alias("bad"))
    if outcomes is not None:
        marked = marked.unionByName(outcomes.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.col("bad").cast("int").alias("bad")))
    levels = reputation(marked)
    low = {name: bound(F.col("mean"), F.col("weight"), z).alias(f"{name}_low") for name in levels}
    # judged once per host of the pages, then joined back with hosts dealt over salts
    hosts = parts.select("host").distinct().withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = (
        hosts.join(levels["host"].select("host", low["host"]), "host", "left")
        .join(levels["domain"].select("domain", low["domain"]), "domain", "left")
        .join(levels["suffix"].select("suffix", low["suffix"]), "suffix", "left")
        .withColumn("all_low", levels["all"].select(low["all"]).scalar())
        .select("host", (F.coalesce("host_low", "domain_low", "suffix_low", "all_low") >= limit).alias("bad"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    return salted.join(hosts, ["host", "salt"], "left").select(
        "page_id", "host", "path", F.col("fit.text").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("bad"), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )
