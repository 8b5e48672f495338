"""URL filters: allow and block rules, and empirical-Bayes host reputation for all other pages.

Labelled page outcomes are counted per host, and added up to registered domain and public
suffix. At each level the share of bad outcomes of a node is shrunk towards its parent's by a
beta-binomial prior: Beta(m * s, (1 - m) * s) with the parent's posterior mean m and a strength
s that is fitted to the level's nodes by the method of moments. A page that no rule
decides is blocked if the lower bound of its host's posterior (mean less ``BOUND_Z`` standard
deviations) is above ``MAX_BAD``.

All of it is DataFrame operations. Outcomes are summed per host before anything else is
shuffled; the tables of hosts, domains and suffixes join on their own unique keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.shared import written

#: Second labels that form a public suffix together with a two-letter top-level domain (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A page is blocked if the lower bound of its host's posterior share of bad outcomes is above this.
MAX_BAD = 0.25
#: Standard deviations between a posterior's mean and its bound.
BOUND_Z = 1.0
#: Limits of the fitted prior strength, in outcomes.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
#: Share of bad outcomes where nothing at all is labelled, and the outcomes that it counts for.
ROOT_MEAN, ROOT_STRENGTH = 0.1, 10.0


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path in one (``org/fr/``): it fits that host, its subdomains, and paths that start so."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def _after_scheme(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))).otherwise("")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def name_of(host: Column) -> Column:
    """The host without user and port, by which it is placed among domains."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """Public suffix: the last label, or the last two where those are like ``co.uk``. An address is its own suffix."""
    address = host.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    two = F.regexp_extract(host, rf"((?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}))$", 2)
    return F.when(address, host).when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and one label before it (the host itself if there is none)."""
    before = F.when(host == suffix, "").otherwise(F.left(host, F.length(host) - F.length(suffix) - 1))
    return F.when(before == "", host).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (a block rule before an allow rule of equal length), else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _level(nodes: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Posterior (mean and sum of the Beta parameters) of every node of one level, from counts ``bad`` and ``n``.

    The strength of the prior is 1/rho - 1 for the moment estimate of the correlation rho of outcomes inside a node.
    """
    joined = nodes.join(parents.select(F.col(parent), F.col("mean").alias("prior")), parent)
    fit = joined.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2)).alias("spread"),
                     F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("plain"),
                     F.sum(F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior"))).alias("pairs"))
    rho = (F.col("spread") - F.col("plain")) / F.col("pairs")
    strength = F.when(F.col("pairs") > 0, F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)))
                      .otherwise(MAX_STRENGTH)).otherwise(MAX_STRENGTH)
    return (joined.crossJoin(F.broadcast(fit.select(strength.alias("strength"))))  # one row
            .select(key, ((F.col("bad") + F.col("prior") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("mean"),
                    (F.col("n") + F.col("strength")).alias("weight")))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, mean, weight): posterior of every host of ``hosts`` (host, bad, n; one row each)."""
    name = name_of(F.col("host"))
    placed = written(hosts.withColumn("suffix", suffix_of(name)).withColumn("domain", domain_of(name, F.col("suffix"))), "hosts")
    counts = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    domains = placed.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    root = (suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            .select(F.lit("").alias("root"), ((F.col("bad") + ROOT_MEAN * ROOT_STRENGTH) / (F.col("n") + ROOT_STRENGTH)).alias("mean")))
    by_suffix = written(_level(suffixes.withColumn("root", F.lit("")), root, "suffix", "root"), "by-suffix")
    by_domain = written(_level(domains, by_suffix, "domain", "suffix"), "by-domain")
    return _level(placed.select("host", "domain", "bad", "n"), by_domain, "host", "domain")


def document_of(path: Column) -> Column:
    """The document number at a path's end (``/en/825``, ``/en/825/``, ``/en/825.html``), else null."""
    digits = F.regexp_extract(path, r"/([0-9]{1,18})(?:/|\.html)?$", 1)
    return F.when(digits != "", digits.cast("long"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], max_bad: float = MAX_BAD, z: float = BOUND_Z) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row of ``pages`` (page_id, url).

    * An outcome is a label (doc_id, quality, toxic) of the document whose number ends the url's path; bad: quality 0
      or toxic 1. Several label rows of a document count as one, bad if any is.
    * A null url, or one without ``://``, has empty host and path, no rule, and the reputation of the empty host.
      A host without labelled pages has its registered domain's expected share. Null labels are no outcome.
    * Repeated rows give repeated rows and count as often; other columns are not read; empty tables give an empty result
      (without labels every share is ``ROOT_MEAN``).
    """
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marked = marked.fillna("", ["host", "path"]).withColumn("doc", document_of(F.col("path")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    outcome = (labels.select(F.col("doc_id").cast("long").alias("doc"), bad.alias("bad")).dropna()
               .groupBy("doc").agg(F.max("bad").alias("bad")))
    # Pages per (host, document) first: a hot host or document is summed where it is read.
    visits = marked.groupBy("host", "doc").agg(F.count("*").alias("visits"))
    hosts = (visits.join(outcome, "doc", "left").groupBy("host")
             .agg(F.coalesce(F.sum(F.col("bad") * F.col("visits")), F.lit(0)).alias("bad"),
                  F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("visits"))), F.lit(0)).alias("n")))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    verdicts = reputation(hosts).select("host", F.when(F.col("mean") - z * sd > max_bad, "block").otherwise("allow").alias("by_host"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (marked.join(verdicts, "host")
            .select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.col("by_host")).alias("verdict")))
