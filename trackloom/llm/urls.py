"""URL filters: rules for hosts and paths, and for all other pages the reputation of their host.

Labelled pages give each host a number of good outcomes and a number of outcomes. Three beta-binomial levels shrink them:
the share of a suffix towards that of all pages, the share of a registered domain towards its suffix, the share of
a host towards its domain. How strongly each level shrinks is estimated from the data by moments: the more alike
the hosts of a domain are, the more a host without outcomes inherits. A page is blocked where even the upper
bound of its host's posterior share of good pages stays below a limit; hosts of which little is known are let through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import meet, written

# Public suffixes of more than one label (a choice of the commonest; pass your own list).
SUFFIXES = (
    "ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co "
    "com.hk com.mx com.my com.sg com.tr com.tw com.ua com.vn edu.au edu.cn gov.au gov.br gov.cn gov.in gov.uk ne.jp "
    "net.au net.br net.cn net.nz net.uk or.jp org.au org.br org.cn org.nz org.uk org.za sch.uk"
).split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """allow or block, for a host with all its subdomains and paths that start with `path`."""

    verdict: str
    host: str
    path: str

    def fits(self) -> Column:
        return ((F.col("host") == self.host) | F.endswith(F.col("host"), F.lit("." + self.host))) & F.startswith(F.col("path"), F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Both empty without ://."""
    rest = F.when(url.contains("://"), url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as host and path together; of equally long ones the first by name. Null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path, r.verdict)):
        name, verdict = F.when(rule.fits(), rule.host + rule.path).otherwise(name), F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """Registered domain (the suffix with one label more) and public suffix of a host, without user and port.

    The suffix is the last label, or the last two if they are listed. A host that is itself a suffix, or an address of digits, is its own domain.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(suffixes)
    number = name.rlike(r"^[\d.]+$")
    suffix = F.when(number, "").when(long, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(number, name).when(long, F.substring_index(name, ".", -3)).otherwise(two), suffix


def strength(level: DataFrame, weakest: float, strongest: float) -> float:
    """How many outcomes a level's prior weighs, from its rows (k good of n, prior).

    The moments of a beta-binomial: squared deviations from the prior exceed those of a binomial by a factor that
    grows with n and with the correlation of outcomes, whose inverse less one is the strength. Kept between the two
    bounds; `weakest` where no row has two outcomes.
    """
    off = F.col("k") - F.col("n") * F.col("prior")
    n = F.col("n").cast("double")
    found = level.where("n > 0").agg(F.sum(off * off / (F.col("prior") * (1 - F.col("prior")))).alias("x"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")).first()
    if not found["n"] or found["nn"] <= found["n"]:
        return weakest
    together = (found["x"] - found["n"]) / (found["nn"] - found["n"])
    return min(strongest, max(weakest, 1 / together - 1)) if together > 0 else strongest


def shrunk(level: DataFrame, weakest: float, strongest: float) -> DataFrame:
    """level with the posterior share of good outcomes (`mean`) and the outcomes it stands for (`weight`)."""
    s = strength(level, weakest, strongest)
    return level.withColumn("weight", F.col("n") + s).withColumn("mean", (F.col("prior") * s + F.col("k")) / F.col("weight"))


def reputation(hosts: DataFrame, *, suffixes: list[str], weakest: float = 2.0, strongest: float = 1000.0) -> DataFrame:
    """host, k, n, mean, weight and sd of the posterior beta distribution of every host's share of good outcomes.

    hosts has host (distinct, not null), k good outcomes of n (longs, may be 0) and pages (its number of pages). Hosts of one domain are
    added up before they meet; a domain with very many hosts is met by broadcast.
    """
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    own = hosts.select("host", "k", "n", "pages", domain.alias("domain"), suffix.alias("suffix"))
    add = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    domains = written(own.groupBy("domain", "suffix").agg(*add, F.count("*").alias("hosts")), "domains")
    tops = written(domains.groupBy("suffix").agg(*add, F.count("*").alias("domains")), "suffixes")
    k, n = tops.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tops = shrunk(tops.withColumn("prior", F.lit((k + 1) / (n + 2))), weakest, strongest)
    tops = tops.select("suffix", "domains", F.col("mean").alias("prior"))
    domains = written(meet(domains, tops, "suffix", "domains").select("domain", "k", "n", "hosts", "prior"), "domains")
    domains = shrunk(domains, weakest, strongest).select("domain", "hosts", F.col("mean").alias("prior"))
    known = written(meet(own, domains, "domain", "hosts").select("host", "k", "n", "pages", "prior"), "hosts")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return shrunk(known, weakest, strongest).withColumn("sd", sd)


def judge(pages: DataFrame, rules: list[Rule], *, good: Column | None = None, suffixes: list[str] | None = None, deviations: float = 2.0, least_good: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row of pages (page_id, url).

    The longest rule that fits decides. Any other page is blocked if the mean of its host's posterior share of good pages plus
    `deviations` standard deviations is below least_good, else allowed. good is a column over pages: the outcome of a
    labelled page, null elsewhere; without it the pages that a rule decides are the labelled ones (good: allowed).
    Rules are few (a thousand at most); longer lists belong into `good`. A null url, or one without ://, has an empty
    host and path, which is a host like any other; repeated rows each give a row and count each; an empty table gives
    an empty table; urls are taken whole; further columns are ignored.
    """
    listed = SUFFIXES if suffixes is None else suffixes
    host, path = host_and_path(F.col("url"))
    rule, verdict = first_rule(rules)
    # The outcome is read before further columns, whose names may clash, are left out.
    split = pages.select("page_id", host.alias("host"), path.alias("path"), (F.lit(None) if good is None else good).cast("boolean").alias("good"))
    split = split.withColumn("rule", rule).withColumn("decided", verdict)
    if good is None:
        split = split.withColumn("good", F.col("decided") == "allow")
    free = F.col("decided").isNull()
    counts = [F.count_if(F.col("good")).alias("k"), F.count("good").alias("n"), F.count_if(free).alias("pages")]
    hosts = reputation(written(split.groupBy("host").agg(*counts), "hosts"), suffixes=listed)
    bad = F.col("mean") + deviations * F.col("sd") < least_good
    judged = hosts.where("pages > 0").select("host", "pages", F.when(bad, "block").otherwise("allow").alias("reputed"))
    # Decided pages need no host; they keep theirs under another name.
    asked = split.select("page_id", F.col("host").alias("own"), "path", "rule", "decided", F.when(free, F.col("host")).alias("host"))
    met = meet(asked, judged, "host", "pages")
    return met.select("page_id", F.col("own").alias("host"), "path", "rule", F.coalesce("decided", "reputed").alias("verdict"))


#: The rules of the query.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]

#: The same over `pages` in SQL.
SQL = r"""
with urls as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), split as (
  select page_id, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host
  from urls
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged as (
  select s.*, f.rule, f.decided
  from (select row_number() over () as id, * from split) s left join (
    select t.id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as decided
    from (select row_number() over () as id, * from split) t
    join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by t.id
  ) f using (id)
), names as (
  select host, count(*) filter (where decided = 'allow') as k, count(decided) as n,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name
  from judged group by host
), hosts as (
  select host, k, n, case when regexp_matches(name, '^[0-9.]+$') then name when two in (select unnest(LISTED)) then array_to_string(string_split(name, '.')[-3:], '.') else two end as domain,
    case when regexp_matches(name, '^[0-9.]+$') then '' when two in (select unnest(LISTED)) then two else string_split(name, '.')[-1] end as suffix
  from (select *, array_to_string(string_split(name, '.')[-2:], '.') as two from names)
), l1 as (
  select suffix, sum(k) as k, sum(n) as n, (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) from hosts) as prior from hosts group by suffix
), s1 as (STRENGTH(l1)
), l2 as (
  select domain, suffix, sum(h.k) as k, sum(h.n) as n, any_value((l1.prior * s + l1.k) / (l1.n + s)) as prior
  from hosts h join l1 using (suffix), s1 group by domain, suffix
), s2 as (STRENGTH(l2)
), l3 as (
  select host, h.k, h.n, (l2.prior * s + l2.k) / (l2.n + s) as prior from hosts h join l2 using (domain, suffix), s2
), s3 as (STRENGTH(l3)
), posterior as (
  select host, n + s as weight, (prior * s + k) / (n + s) as mean from l3, s3
)
select page_id, host, path, rule, coalesce(decided, case when mean + 2 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.5 then 'block' else 'allow' end) as verdict
from judged join posterior using (host)
"""
STRENGTH = """
  select case when n is null or nn <= n then 2.0 when x <= n then 1000.0 else least(1000.0, greatest(2.0, (nn - n) / (x - n) - 1)) end as s
  from (select sum((k - n * prior) ** 2 / (prior * (1 - prior))) as x, sum(n)::double as n, sum(n::double * n) as nn from LEVEL where n > 0)
"""
for _level in ("l1", "l2", "l3"):
    SQL = SQL.replace(f"STRENGTH({_level})", STRENGTH.replace("LEVEL", _level))
SQL = SQL.replace("LISTED", str(SUFFIXES))
