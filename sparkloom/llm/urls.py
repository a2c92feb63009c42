"""URL filter with empirical-Bayes host reputation, with DataFrame functions only.

Labelled outcomes are counted per host, registered domain and suffix. Each level
has a beta-binomial prior whose mean is the shrunken rate of the level above and
whose strength comes from the spread between its groups (method of moments). A
host is blocked if the lower posterior bound of its bad rate exceeds a limit.
Explicit rules go before the reputation.

Edge cases: a null url or one without ``://`` has empty host and path; null
outcomes are left out; repeated outcomes of a page count once (bad if any is
bad); hosts without outcomes take the shrunken rate of their domain; with no
outcomes at all nothing is blocked; a port, a user name or a trailing dot belongs to
the host but not to its domain; addresses (also IPv6 in brackets) are their own
domain; very long urls count whole; repeated pages give a row each; empty tables give
no rows; columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Public suffixes of two labels that are told apart unless a longer list is given.
TWO_LABEL_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg",
    "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "github.io", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.mx", "org.nz", "org.uk", "org.za", "blogspot.com",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BESIDE, ADDRESS = r"^.*@|\.*(:[0-9]*)?$", r"^([0-9.]+|\[.*)$"
Z, MAX_BAD = 1.645, 0.25


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path``) and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix, without user, port and trailing dots; an address or single label is its own domain.

    ``suffixes``: the public suffixes of more than one label (two of them are looked at).
    """
    host = F.regexp_replace(host, BESIDE, "")
    two = F.substring_index(host, ".", -2)
    known = two.isin(*suffixes)
    address = host.rlike(ADDRESS)
    suffix = F.when(address, F.lit("")).when(known, two).otherwise(F.substring_index(host, ".", -1))
    return F.when(address, host).when(known, F.substring_index(host, ".", -3)).otherwise(two), suffix


def _strength(level: DataFrame) -> DataFrame:
    """One row: overall rate p and prior strength s of a level's groups (n, x)."""
    tot = level.agg(F.sum("n").cast("double").alias("N"), F.sum("x").cast("double").alias("X"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.col("x").cast("double") * F.col("x") / F.col("n")).alias("xx"))
    p = F.col("X") / F.col("N")
    spread = (F.col("xx") - F.col("X") * F.col("X") / F.col("N")) / (p * (1 - p)) - (F.col("k") - 1)
    room = F.col("N") - F.col("nn") / F.col("N") - (F.col("k") - 1)
    rho = F.when((F.col("N") > 0) & (F.col("X") > 0) & (F.col("X") < F.col("N")) & (room > 0), F.least(F.lit(0.99), F.greatest(F.lit(0.001), spread / room))).otherwise(F.lit(0.5))
    return tot.select(F.when(F.col("N") > 0, p).otherwise(F.lit(0.0)).alias("p"), (1 / rho - 1).alias("s"))


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Posterior (bad_mean, bad_low) of each of ``hosts`` (host) from ``outcomes`` (host, bad)."""
    dom, suf = domain_and_suffix(F.col("host"))
    per_host = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("x")).filter("n > 0").withColumn("domain", dom).withColumn("suffix", suf)
    per_host = Workspace(hosts.sparkSession, "urls").write(per_host, "per-host")  # the outcomes are counted once
    per_dom = per_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    per_suf = per_dom.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    # three rows of two numbers: the only thing that reaches the driver
    (p0, s0), (_, s1), (_, s2) = (_strength(x).first() for x in (per_suf, per_dom, per_host))
    zero = F.lit(0)
    shrunk = lambda up, s: (F.coalesce(F.col("x"), zero) + s * up) / (F.coalesce(F.col("n"), zero) + s)
    out = hosts.select("host").distinct().withColumn("domain", dom).withColumn("suffix", suf)
    out = out.join(per_suf, "suffix", "left").withColumn("m_suffix", shrunk(F.lit(p0), s0)).drop("n", "x")
    out = out.join(per_dom.drop("suffix"), "domain", "left").withColumn("m_domain", shrunk(F.col("m_suffix"), s1)).drop("n", "x")
    out = out.join(per_host.drop("domain", "suffix"), "host", "left")
    m = shrunk(F.col("m_domain"), s2)
    size = F.coalesce(F.col("n"), zero) + s2 + 1
    return out.select("host", m.alias("bad_mean"), (m - Z * F.sqrt(m * (1 - m) / size)).alias("bad_low"), F.coalesce(F.col("n"), zero).alias("n_outcomes"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_low for ``pages`` (page_id, url) and ``outcomes`` (page_id, bad)."""
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.filter("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rep = reputation(pages.select("page_id", "host").distinct().join(known, "page_id").select("host", "bad"), pages)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(rep, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_mean", "bad_low", "n_outcomes")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the row of ``labels`` whose doc_id is its page_id, bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))).select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(level: str) -> str:
    return f"""SELECT CASE WHEN n > 0 THEN x / n ELSE 0.0 END AS p, 1 / CASE WHEN n > 0 AND x > 0 AND x < n AND n - nn / n - (k - 1) > 0
    THEN least(0.99, greatest(0.001, ((xx - x * x / n) / ((x / n) * (1 - x / n)) - (k - 1)) / (n - nn / n - (k - 1)))) ELSE 0.5 END - 1 AS s
    FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS k, CAST(sum(n * n) AS DOUBLE) AS nn,
    sum(CAST(x AS DOUBLE) * x / n) AS xx FROM {level})"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages
), h AS (
  SELECT DISTINCT host, regexp_replace(host, '{BESIDE}', '', 'g') AS bare FROM p
), h1 AS (
  SELECT host, bare, string_split(bare, '.') AS l, regexp_matches(bare, '{ADDRESS}') AS addr FROM h
), h2 AS (
  SELECT host, bare, l, addr, array_to_string(l[-2:], '.') AS two FROM h1
), hosts AS (
  SELECT host, CASE WHEN addr THEN bare WHEN two IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
    CASE WHEN addr THEN '' WHEN two IN ({_TWO}) THEN two ELSE l[-1] END AS suffix FROM h2
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE (quality IS NOT NULL OR toxic IS NOT NULL) AND doc_id IS NOT NULL GROUP BY doc_id
), per_host AS (
  SELECT host, domain, suffix, count(*) AS n, sum(bad) AS x FROM (SELECT DISTINCT page_id, host FROM p) JOIN o USING (page_id) JOIN hosts USING (host) GROUP BY ALL
), per_dom AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM per_host GROUP BY ALL
), per_suf AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM per_dom GROUP BY ALL
), g0 AS ({_strength_sql("per_suf")}
), g1 AS ({_strength_sql("per_dom")}
), g2 AS ({_strength_sql("per_host")}
), m0 AS (
  SELECT host, domain, suffix, (coalesce(x, 0) + g0.s * g0.p) / (coalesce(n, 0) + g0.s) AS m FROM hosts LEFT JOIN per_suf USING (suffix), g0
), m1 AS (
  SELECT host, (coalesce(x, 0) + g1.s * m) / (coalesce(n, 0) + g1.s) AS m FROM m0 LEFT JOIN per_dom USING (domain), g1
), m2 AS (
  SELECT host, (coalesce(x, 0) + g2.s * m) / (coalesce(n, 0) + g2.s) AS m, coalesce(n, 0) + g2.s + 1 AS size FROM m1 LEFT JOIN per_host USING (host), g2
), r AS (
  SELECT page_id, p.host, path, m - {Z} * sqrt(m * (1 - m) / size) AS low,
    CASE {" ".join(f"WHEN (p.host = '{r.partition('/')[0]}' OR ends_with(p.host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{k} {r}'" for k, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1])))} END AS hit
  FROM p JOIN m2 USING (host)
)
SELECT page_id, host, path, string_split(hit, ' ')[2] AS rule, coalesce(string_split(hit, ' ')[1], CASE WHEN low > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
