"""Filters for URLs: rules by host and path, and the reputation of hosts by empirical Bayes.

Labelled pages count as good or bad. The share of bad pages of a host is a beta-binomial posterior whose prior comes from
its registered domain, whose own prior comes from its suffix, whose prior is all pages. The strength of every prior is fitted
from how far the groups of that level spread around their parents. A host is blocked where a bound of the posterior is above
the limit. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.joins import split_join
from evidentia.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEAST_SPREAD, MOST_SPREAD, UNKNOWN_SPREAD = 0.0001, 0.5, 0.1  # intra-class correlation; the last where it can't be estimated


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    """The longest of ``suffixes`` under which a host lies or which it is, otherwise its last label; numeric addresses have none."""
    out = F.regexp_extract(host, r"([^.]*)$", 1)
    for s in sorted(suffixes, key=lambda s: (len(s), s)):
        out = F.when((host == s) | F.endswith(host, F.lit("." + s)), F.lit(s)).otherwise(out)
    return F.when(host.rlike(r"^[0-9.]+$"), F.lit("")).otherwise(out)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more label; numeric addresses and suffixes stand for themselves."""
    front = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    label = F.regexp_extract(front, r"([^.]*)$", 1)
    return F.when((suffix == "") | (host == suffix), host).otherwise(F.concat(label, F.lit("."), suffix))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, otherwise null.

    A rule such as ``("example.org/es/", "block")`` fits its host and all subdomains where the path starts with what follows the host.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> float:
    """Strength of the prior of groups ``(labelled, bad, center)``, by the method of moments: 1 / spread - 1 pages."""
    n, x, m = F.col("labelled").cast("double"), F.col("bad").cast("double"), F.col("center")
    chance = m * (1 - m)
    row = groups.where("labelled > 0").agg(
        F.sum((x - n * m) * (x - n * m) - n * chance).alias("over"), F.sum(n * (n - 1) * chance).alias("scale")).first()
    spread = min(max(row["over"] / row["scale"], LEAST_SPREAD), MOST_SPREAD) if row["scale"] else UNKNOWN_SPREAD
    return 1 / spread - 1


def _shrunk(groups: DataFrame) -> DataFrame:
    """Groups with the parameters ``a`` and ``b`` of their posterior; ``center`` is the prior's mean."""
    k = F.lit(_strength(groups))
    return groups.withColumn("a", k * F.col("center") + F.col("bad")).withColumn("b", k * (1 - F.col("center")) + F.col("labelled") - F.col("bad"))


def reputations(hosts: DataFrame, deviations: float = 3.0) -> DataFrame:
    """``hosts(host, domain, suffix, pages, labelled, bad)`` with the posterior ``bad_share`` and its lower bound ``bad_least``.

    The bound is the mean less ``deviations`` standard deviations: by Cantelli's inequality the share lies below it with a probability of at
    most 1 / (1 + deviations^2), whatever the form of the posterior. Without any labelled page all shares are 0.
    """
    hosts = cut_lineage(hosts)
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    total = hosts.agg(*sums).first()
    mean = total["bad"] / total["labelled"] if total["labelled"] else 0.0
    center = lambda df, name: df.select(name, (F.col("a") / (F.col("a") + F.col("b"))).alias("center"))
    suffixes = cut_lineage(_shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("center", F.lit(float(mean)))))
    domains = cut_lineage(split_join(hosts.groupBy("domain", "suffix").agg(*sums), center(suffixes, "suffix"), ["suffix"]))
    domains = cut_lineage(_shrunk(domains))
    judged = _shrunk(cut_lineage(split_join(hosts, center(domains, "domain"), ["domain"])))
    share, weight = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b") + 1
    return judged.withColumn("bad_share", share).withColumn("bad_least", share - F.lit(deviations) * F.sqrt(share * (1 - share) / weight))


def outcomes_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, labelled, bad)`` from the labels of the documents whose number the paths end in (``/en/148.html``).

    A document is bad if any of its labels says low quality or toxic. Pages are counted by (host, number) before they meet the
    labels and by host after, so no host and no document gathers in one task.
    """
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT)")
    counted = pages.select("host", number.alias("doc_id")).groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    met = counted.where("doc_id IS NOT NULL").join(marked.hint("merge"), "doc_id")
    return met.groupBy("host").agg(F.sum("n").alias("labelled"), F.sum(F.col("n") * F.col("bad")).alias("bad"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], suffixes: Sequence[str] = (), limit: float = 0.5,
    deviations: float = 3.0,
) -> DataFrame:
    """Rows ``(page_id, host, path, rule, verdict, labelled, bad, bad_share, bad_least)`` for every row of ``pages(page_id, url)``.

    The verdict is the longest fitting rule's, otherwise ``block`` where the host's share of bad pages is above ``limit`` by the posterior
    bound, else ``allow``. Labels ``(doc_id, quality, toxic)`` reach a page through the number in its path. Urls that are null or without
    ``://`` have an empty host, which is judged like any other. Repeated rows are judged each, keys may be null, empty tables give an
    empty result (without labels nothing is blocked by reputation); other columns are not read. The two shares have six decimals.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = outcomes_by_number(rows, labels)
    counts = cut_lineage(seen.join(known.hint("merge"), "host", "left").fillna(0, ["labelled", "bad"]))
    suffix = suffix_of(F.col("host"), suffixes)
    hosts = counts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    judged = cut_lineage(reputations(hosts, deviations).select("host", "labelled", "bad", "bad_share", "bad_least"))
    met = split_join(rows, judged, ["host"], counts.select("host", F.col("pages").alias("rows")))
    found = rule_column(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("found").isNotNull(), F.col("found.verdict")).when(F.col("bad_least") > limit, "block").otherwise("allow")
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    return met.withColumn("found", found).select(
        "page_id", "host", "path", "found.rule", verdict.alias("verdict"), "labelled", "bad", six("bad_share").alias("bad_share"), six("bad_least").alias("bad_least"))
