"""URL filter: rules first, then the reputation of the host.

Labelled page outcomes are counted per host, and shrunk through beta-binomial priors from suffix
to registered domain to host: the posterior mean of a level is the prior mean of the next, with a
weight that the spread between the groups of that level gives (method of moments). A page that no
rule decides is blocked when even the upper bound of its host's posterior lies below ``cut``.

The suffix of a host is its last label, or its last two where ``SUFFIXES`` has them; the registered domain has
one label more. User info and port belong to neither. Addresses share a level of their own, ``address``, in
which each is its own domain.

All of it is DataFrame expressions. Pages are never grouped raw: outcomes are counted per host
before anything is joined, so a host with a third of all pages is one row.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged as
the host ""; labels that contradict one another count by their mean; pages without label
only get verdicts; repeated page rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Fixed: suffixes of two labels below which sites are registered. A parameter: projects bring longer lists.
SUFFIXES = """
ac.jp ac.uk blogspot.com co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn
com.co com.hk com.mx com.my com.ng com.pl com.sg com.tr com.tw com.ua com.vn edu.au edu.cn github.io gitlab.io
go.jp gov.au gov.br gov.cn gov.in gov.uk ne.jp net.au net.br net.cn or.jp org.au org.br org.cn org.uk
""".split()
CUT = 0.5
BOUND = 1.645
#: Weights of a prior, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = None, None
    for decision, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def site(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host."""
    bare = F.regexp_replace(F.regexp_extract(host, "[^@]*$", 0), ":[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    parts = F.split(bare, r"\.")

    def last(n: int) -> Column:
        return F.when(F.size(parts) > n, F.concat_ws(".", F.slice(parts, -n, n))).otherwise(bare)

    long = last(2).isin(list(suffixes)) & (F.size(parts) >= 2)
    suffix = F.when(address, "address").when(long, last(2)).otherwise(last(1))
    return suffix, F.when(address, bare).when(long, last(3)).otherwise(last(2))


def _weight(mean: Column, groups: Column, pages: Column, spread: Column) -> Column:
    """Pages that a prior counts for: p(1-p) over the variance between groups, less 1."""
    noise = mean * (1 - mean)
    between = spread / pages - noise * groups / pages
    weight = F.when((pages > 0) & (between > 0), noise / between - 1).otherwise(F.lit(MOST_WEIGHT))
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), weight))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host: mean and upper bound, from rows (host, n, good).

    ``n`` labelled pages of a host, ``good`` of them fine. Hosts without labelled pages have n = 0.
    """
    suffix, domain = site(F.col("host"))
    hosts = outcomes.withColumns({"suffix": suffix, "domain": domain})

    def level(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    domains = level(hosts, ["suffix", "domain"])
    suffixes = level(domains, ["suffix"])
    # Spread of each level around the mean of all pages: one row.
    mean = suffixes.agg(F.sum("n").cast("double").alias("pages"), ((F.sum("good") + 1.0) / (F.sum("n") + 2.0)).alias("p0"))

    def weight(rows: DataFrame, name: str) -> DataFrame:
        share = F.when(F.col("n") > 0, F.col("good") / F.col("n")).otherwise(F.lit(0.0))
        spread = F.sum(F.when(F.col("n") > 0, F.col("n") * (share - F.col("p0")) * (share - F.col("p0"))).otherwise(0.0))
        own = rows.join(F.broadcast(mean), F.lit(True)).agg(spread.alias("s"), F.sum(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("g"), F.max("p0").alias("p"), F.max("pages").alias("all"))
        return own.select(_weight(F.col("p"), F.col("g"), F.col("all"), F.col("s")).alias(name))

    few = mean
    for rows, name in ((suffixes, "ws"), (domains, "wd"), (hosts, "wh")):
        few = few.join(F.broadcast(weight(rows, name)), F.lit(True))  # one row each
    m0 = suffixes.join(F.broadcast(few), F.lit(True)).select("suffix", "wd", "wh", ((F.col("good") + F.col("ws") * F.col("p0")) / (F.col("n") + F.col("ws"))).alias("m_suffix"))
    m1 = domains.join(m0, "suffix").select("suffix", "domain", "wh", ((F.col("good") + F.col("wd") * F.col("m_suffix")) / (F.col("n") + F.col("wd"))).alias("m_domain"))
    a = F.col("good") + F.col("wh") * F.col("m_domain")
    b = F.col("n") - F.col("good") + F.col("wh") * (1 - F.col("m_domain"))
    out = hosts.join(m1, ["suffix", "domain"]).select("host", a.alias("a"), b.alias("b"))
    total = F.col("a") + F.col("b")
    middle = F.col("a") / total
    bound = middle + BOUND * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return out.select("host", middle.alias("reputation"), bound.alias("upper"))


def judged_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, cut: float = CUT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with the host's reputation.

    ``labels`` (doc_id, quality, toxic) judge the page of the same number: good means quality 1 and not toxic.
    """
    host, path = host_and_path(F.col("url"))
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg((F.avg(good) >= 0.5).cast("long").alias("good"))
    seen = told.select("page_id", "host").join(marked, "page_id", "left")
    outcomes = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    outcomes = stored(outcomes, "url-hosts")  # every level reads it
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < cut, "block").otherwise("allow")
    out = told.join(reputations(outcomes), "host")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("reputation", 6).alias("reputation"))
