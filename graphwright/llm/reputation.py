"""URL filters: rules of hosts and paths, and for the rest the reputation of hosts, by empirical Bayes.

Labelled outcomes of pages are counted by host, registered domain and public suffix. A rate of bad pages is beta distributed around that of the level above:
host around domain, domain around suffix, suffix around all. How closely is estimated from the data themselves, by moments: the variance
between a level's members beyond that of chance gives the intraclass correlation rho, and a prior weighs 1 / rho - 1 pages. A host is blocked when its posterior mean
less DEVIATIONS posterior standard deviations is above a limit: whatever the distribution, its rate is then below the limit with a chance of at most
1 / (1 + DEVIATIONS^2), by Cantelli's inequality. A new host has its domain's reputation, and hosts with little evidence aren't blocked.

Pages, hosts and domains are added up by key before they are joined, and every join with a table of the level above deals its rows over SALTS shares of each
key, so that a host with a third of the pages, or a domain with a third of the hosts, isn't one task's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.sources.scratch import stored

#: Rules: verdict, host (its subdomains too), start of the path.
RULES: list[tuple[str, str, str]] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Public suffixes of two labels; all others are of one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.za", "github.io", "blogspot.com")
#: A host is blocked where its rate of bad pages is above this, by DEVIATIONS standard deviations of its posterior.
LIMIT, DEVIATIONS = 0.4, 2.0
#: Bounds of the intraclass correlation, and its value where nothing can be estimated.
LEAST_RHO, MOST_RHO, DEFAULT_RHO = 0.001, 0.5, 0.1
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site(host: Column) -> Column:
    """A host without user, final dot and port."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def suffix(site: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix of a site; empty for an address of numbers."""
    two = F.regexp_extract(site, r"([^.]+\.[^.]+)\z", 1)
    known = F.create_map(*[F.lit(x) for s in suffixes for x in (s, True)])
    return F.when(site.rlike(r"^[0-9.]*\z|\]\z"), F.lit("")).when(F.coalesce(known[two], F.lit(False)), two).otherwise(F.regexp_extract(site, r"([^.]*)\z", 1))


def domain(site: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain of a site: its suffix and the label before; a site that is no more than a suffix, or numbers, is its own."""
    end = suffix(site, suffixes)
    before = F.substring(site, F.lit(1), F.greatest(F.length(site) - F.length(end) - 1, F.lit(0)))
    return F.when((end == "") | (before == ""), site).otherwise(F.concat(F.regexp_extract(before, r"([^.]*)\z", 1), F.lit("."), end))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does. Of equally long rules the one given first."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def dealt_join(rows: DataFrame, above: DataFrame, key: str, by: str) -> DataFrame:
    """A left join by `key`, null-safe, each key dealt over SALTS shares by the column `by`; `above` has one row a key."""
    shares = above.withColumnRenamed(key, "_key").withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(shares, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_share")), "left").drop("_key", "_share", "_salt")


def outcomes(pages: DataFrame, bad: DataFrame) -> DataFrame:
    """(site, n, bad): labelled pages of each site, and the bad ones among them.

    `pages` has (site, doc), `bad` (doc, bad). Pages are counted for each (site, doc) before the join. A page without a label counts nowhere.
    """
    counted = pages.where("doc is not null").groupBy("site", "doc").agg(F.count("*").alias("pages"))
    labelled = dealt_join(counted, bad, "doc", "site").where("bad is not null")
    return labelled.groupBy("site").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))


def _rho(members: DataFrame, group: str | None) -> DataFrame:
    """One row: the intraclass correlation of members (n, bad) within groups, pooled over groups, by moments."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = members.where("n > 0").groupBy(*([group] if group else [])).agg(
        F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.sum(bad * bad / n).alias("between"), F.sum(n * n).alias("squares"), F.count("*").alias("members")
    )
    rate = F.col("bad") / F.col("n")
    sums = sums.where((F.col("bad") > 0) & (F.col("bad") < F.col("n")) & (F.col("members") > 1))
    chance = (F.col("members") - 1).cast("double")
    beyond = (F.col("between") - F.col("bad") * rate) / (rate * (1 - rate)) - chance
    room = F.col("n") - F.col("squares") / F.col("n") - chance
    total = sums.agg(F.sum(beyond).alias("beyond"), F.sum(room).alias("room"))
    return total.select(F.when(F.col("room") > 0, F.least(F.greatest(F.col("beyond") / F.col("room"), F.lit(LEAST_RHO)), F.lit(MOST_RHO))).otherwise(F.lit(DEFAULT_RHO)).alias("rho"))


def reputations(sites: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(site, bad_rate, bound) of sites (site, n, bad): the mean of the posterior rate of bad pages, and DEVIATIONS standard deviations below.

    Sites with n of 0 have their domain's. The rate of all sites is (bad + 1) / (n + 2), 0.5 without labels.
    """
    hosts = sites.select("site", domain(F.col("site"), suffixes).alias("domain"), suffix(F.col("site"), suffixes).alias("suffix"), "n", "bad")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = ends.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    # single rows
    one = whole.crossJoin(_rho(ends, None).withColumnRenamed("rho", "of_ends")).crossJoin(_rho(domains, "suffix").withColumnRenamed("rho", "of_domains")).crossJoin(_rho(hosts, "domain").withColumnRenamed("rho", "of_hosts")).first()

    def posterior(prior: Column, rho: float) -> tuple[Column, Column]:
        weight = F.lit(1 / rho - 1)
        return weight * prior + F.col("bad"), weight + F.col("n")

    a, n = posterior(F.lit(one.mean), one.of_ends)
    ends = ends.select("suffix", (a / n).alias("prior"))
    a, n = posterior(F.col("prior"), one.of_domains)
    domains = dealt_join(domains, ends, "suffix", "domain").select("domain", (a / n).alias("prior"))
    a, n = posterior(F.col("prior"), one.of_hosts)
    found = dealt_join(hosts, domains, "domain", "site").select("site", (a / n).alias("bad_rate"), n.alias("_n"))
    deviation = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("_n") + 1))
    return found.select("site", "bad_rate", F.greatest(F.col("bad_rate") - DEVIATIONS * deviation, F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, bad: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES, id_column: str = "page_id", url_column: str = "url", doc: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bound) of each row of `pages`: the verdict of the longest rule that fits, else `block` for hosts whose bound is above the limit, else `allow`.

    `bad` has (doc, bad): outcomes, 1 or 0, of documents; `doc` gives a page's document, by default its id. Rows of `bad` with a null are left out;
    of several rows of a document the greatest counts. A null url, one without `://` and an empty host are one host with an empty name. Repeated pages count, and are
    judged, each. Without labels every rate is 0.5 and nothing is blocked but by rules. No label of a page is looked at but through its host's counts. Columns of
    `pages` with other names are ignored.
    """
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("id"), host(url).alias("host"), path(url).alias("path"), (F.col(id_column) if doc is None else doc).alias("doc"))
    rows = stored(rows.withColumn("site", site(F.col("host"))))
    known = bad.where("doc is not null and bad is not null").groupBy("doc").agg(F.max("bad").cast("long").alias("bad"))
    counted = outcomes(rows.select("site", "doc"), known)
    # sites without labels too, with counts of 0
    bare = rows.groupBy("site").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    sites = stored(counted.unionByName(bare).groupBy("site").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    told = dealt_join(rows, reputations(sites, suffixes), "site", "id")
    fits = fitting_rule(F.col("host"), F.col("path"), rules)
    told = told.withColumn("fits", fits)
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return told.select("id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bound")


def oracle(limit: float = LIMIT) -> str:
    """The query in SQL, with the bounds and default of this module."""

    def rho(table: str, group: str) -> str:
        return f"""(SELECT CASE WHEN sum(room) > 0 THEN least(greatest(sum(beyond) / sum(room), {LEAST_RHO}), {MOST_RHO}) ELSE {DEFAULT_RHO} END FROM (
  SELECT (b - bad * rate) / (rate * (1 - rate)) - (k - 1) AS beyond, n - sq / n - (k - 1) AS room FROM (SELECT *, bad / n AS rate FROM (
    SELECT sum(n::DOUBLE) AS n, sum(bad::DOUBLE) AS bad, sum(bad::DOUBLE * bad / n) AS b, sum(n::DOUBLE * n) AS sq, count(*) AS k FROM {table} WHERE n > 0 GROUP BY {group}) WHERE bad > 0 AND bad < n AND k > 1)))"""

    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    fits = [f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{name}{start}'" for _, name, start in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    verdicts = [f"WHEN '{name}{start}' THEN '{verdict}'" for verdict, name, start in RULES]
    return f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT page_id, host, path, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '[.]?(:[0-9]*)?\\z', '') AS site, try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) AS doc FROM u),
l AS (SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
site AS (SELECT site, count(l.bad) AS n, coalesce(sum(l.bad), 0) AS bad FROM r LEFT JOIN l USING (doc) GROUP BY site),
named AS (SELECT *, CASE WHEN regexp_matches(site, '^[0-9.]*\\z|[]]\\z') THEN '' WHEN regexp_extract(site, '([^.]+[.][^.]+)\\z', 1) IN ({two}) THEN regexp_extract(site, '([^.]+[.][^.]+)\\z', 1) ELSE regexp_extract(site, '([^.]*)\\z', 1) END AS suffix FROM site),
h AS (SELECT *, CASE WHEN suffix = '' OR length(site) <= length(suffix) + 1 THEN site ELSE regexp_extract(left(site, length(site) - length(suffix) - 1), '([^.]*)\\z', 1) || '.' || suffix END AS domain FROM named),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
e AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
w AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS mean, 1 / {rho('e', '()')} - 1 AS we, 1 / {rho('d', 'suffix')} - 1 AS wd, 1 / {rho('h', 'domain')} - 1 AS wh FROM e),
pe AS (SELECT suffix, (we * mean + bad) / (we + n) AS prior FROM e, w), pd AS (SELECT domain, (wd * prior + bad) / (wd + n) AS prior FROM d JOIN pe USING (suffix), w),
ph AS (SELECT site, (wh * prior + bad) / (wh + n) AS m, wh + n AS size FROM h JOIN pd USING (domain), w),
pb AS (SELECT site, m, greatest(m - {DEVIATIONS} * sqrt(m * (1 - m) / (size + 1)), 0) AS bound FROM ph),
f AS (SELECT page_id, host, path, site, CASE {" ".join(fits)} END AS rule FROM r)
SELECT page_id, host, path, rule, CASE rule {" ".join(verdicts)} ELSE CASE WHEN bound > {limit} THEN 'block' ELSE 'allow' END END AS verdict, round(m, 6) AS bad_rate, round(bound, 6) AS bound FROM f JOIN pb USING (site)"""
