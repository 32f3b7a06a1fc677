"""URL filter by empirical-Bayes host reputation.

Outcomes of labelled pages (good: quality 1 and not toxic) are shrunk down a chain of beta-binomial priors: all pages
-> public suffix -> registered domain -> host. At each level the prior's mean is the posterior mean of the level
above, and its strength (pseudo-pages) is fitted by the method of moments to how the level's rates spread around
their parents' means, within ``STRENGTH``. A page stays if the upper bound of its host's posterior, mean + z standard
deviations, reaches ``LEAST``: what can't be shown to be bad stays. A host without labels has its domain's posterior,
a new domain its suffix's.

A host's suffix is the longest that the rules of the public suffix list name, exceptions and wildcards included; the
rules are a parameter (``read_rules`` of a file in the list's format). Without a file, ``RULES`` has a few. Its domain
is the suffix and one label more. An IP address is host, domain and suffix of its own.

All is declarative: counts by host, domain and suffix, each written once to the shared folder as the next level starts
from them, and joins on those keys; sums are of integers. What a level's strength takes is one row that the driver
reads. Pages meet their host's judgement by a broadcast if the host has at least a thousandth of all pages (there are
``HOT`` such hosts at most, however many pages), so that no task gets a platform's pages, and by a shuffle otherwise.

Rows: a url that is null or has no host has host, domain and suffix "" and is judged by the prior of all pages.
Pages without label count nowhere but are judged; a page with several labels counts once, by its worst. Repeated
pages are judged each, and count each. Null ids are judged but have no label. Null labels are left out; without any
label the prior is 1/2 and all stay. Very long urls are hosts like others. No pages, no rows. Only the id and url are
read, so extra columns with the names of results are safe; ``filter_urls`` keeps all columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnote import session

LEAST = 0.5
Z = 1.645
STRENGTH = (2.0, 1000.0)
HOT = 1000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
_IP = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


class Rules(NamedTuple):
    """Suffixes of two labels or more; ``wild`` ones take one label more, ``not_wild`` are exceptions from those."""

    plain: frozenset[str]
    wild: frozenset[str] = frozenset()
    not_wild: frozenset[str] = frozenset()


RULES = Rules(frozenset("ac.uk co.in co.il co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.mx com.sg com.tr com.tw edu.au github.io gov.uk ne.jp net.au or.jp org.au org.uk".split()))


def read_rules(path: str) -> Rules:
    """The rules of a file in the format of the public suffix list; names beyond ASCII in both their forms."""
    plain, wild, no = set(), set(), set()
    with open(path, encoding="utf-8") as f:
        for line in f:
            rule = line.split()[0].lower() if line.strip() and not line.startswith("//") else ""
            for r in {rule, rule.encode("idna").decode() if not rule.isascii() else rule}:
                if r.startswith("!"):
                    no.add(r[1:])
                elif r.startswith("*."):
                    wild.add(r[2:])
                elif "." in r:
                    plain.add(r)
    return Rules(frozenset(plain), frozenset(wild), frozenset(no))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"\.+$", "")


def _most(rules: Rules) -> int:
    return 2 + max((r.count(".") + 1 for part in rules for r in part), default=1)


def _suffix_sql(rules: Rules) -> str:
    """The suffix as SQL over ip, parts (labels of the host) and c1, c2, ... (its last labels); of both dialects."""

    def among(k: int, part: frozenset[str]) -> str:
        found = sorted(r for r in part if r.count(".") + 1 == k)
        return f"c{k} in ({', '.join(repr(r) for r in found)})" if found else "false"

    ks = range(_most(rules), 1, -1)
    cases = [f"when parts >= {k} and {among(k, rules.not_wild)} then c{k - 1}" for k in ks]
    cases += [f"when parts >= {k} and ({among(k, rules.plain)} or {among(k - 1, rules.wild)}) then c{k}" for k in ks]
    return "case when ip then host " + " ".join(c for c in cases if not c.count("false") == 2 and "and false" not in c) + " else c1 end"


def _domain_sql(rules: Rules) -> str:
    return "case when ip then host else case length(suffix) - length(replace(suffix, '.', '')) + 1 " + " ".join(f"when {k} then c{k + 1}" for k in range(1, _most(rules) + 1)) + " end end"


def with_parts(hosts: DataFrame, rules: Rules) -> DataFrame:
    """Adds domain and suffix to ``hosts`` (host)."""
    last = {f"c{k}": F.substring_index("host", ".", -k) for k in range(1, _most(rules) + 2)}
    rows = hosts.withColumns({"ip": F.col("host").rlike(_IP), "parts": F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1, **last})
    rows = rows.withColumn("suffix", F.expr(_suffix_sql(rules)))
    return rows.withColumn("domain", F.expr(_domain_sql(rules))).drop("ip", "parts", *last)


def _strength(level: DataFrame) -> float:
    """The pseudo-pages s for which beta-binomial counts (n, k, around mean m) spread as these do.

    With r = k / n, E (r - m)^2 = m (1 - m) (1 + (n - 1) / (s + 1)) / n; summed over units, solved for s.
    """
    v = F.col("m") * (1 - F.col("m"))
    extra, room = F.sum(F.pow(F.col("k") / F.col("n") - F.col("m"), 2) - v / F.col("n")).alias("extra"), F.sum(v * (F.col("n") - 1) / F.col("n")).alias("room")
    s = F.when((F.col("extra") > 0) & (F.col("room") > 0), F.least(F.greatest(F.col("room") / F.col("extra") - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))
    return level.where("n > 0").agg(extra, room).select(F.round(F.coalesce(s, F.lit(STRENGTH[1])), 6)).first()[0]


def _shrunk(level: DataFrame) -> DataFrame:
    """level has counts n, k and the parent's mean m; adds its posterior mean p and strength t."""
    s = _strength(level)
    return level.withColumn("p", F.round((F.col("k") + s * F.col("m")) / (F.col("n") + s), 9)).withColumn("t", F.col("n") + s)


def judged_hosts(pages: DataFrame, labels: DataFrame, rules: Rules = RULES, least: float = LEAST, z: float = Z, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(host, domain, suffix, rate, upper, kept, pages) of every host of ``pages``."""
    seen = labels.select(F.col(label_id).alias("id"), (F.col("quality") * (1 - F.col("toxic"))).cast("long").alias("good")).where("id is not null and good is not null")
    seen = seen.groupBy("id").agg(F.min("good").alias("good"))
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counts = rows.select("host", one.alias("pages"), none.alias("n"), none.alias("k"))
    counts = counts.unionByName(rows.where("id is not null").join(seen, "id").select("host", none.alias("pages"), one.alias("n"), F.col("good").alias("k")))
    sums = [F.sum(c).alias(c) for c in ("n", "k")]
    host = session.cut(with_parts(counts.groupBy("host").agg(F.sum("pages").alias("pages"), *sums), rules))
    domain = session.cut(host.groupBy("suffix", "domain").agg(*sums))
    suffix = session.cut(domain.groupBy("suffix").agg(*sums))
    total = suffix.agg(*sums).first()
    top = _shrunk(suffix.withColumn("m", F.lit(((total.k or 0) + 1) / ((total.n or 0) + 2))))
    domain = _shrunk(session.cut(domain.join(top.select("suffix", F.col("p").alias("m")), "suffix")))
    host = _shrunk(session.cut(host.join(domain.select("suffix", "domain", F.col("p").alias("m")), ["suffix", "domain"])))
    upper = F.round(F.col("p") + z * F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("t") + 1)), 6)
    return host.select("host", "domain", "suffix", F.round("p", 6).alias("rate"), upper.alias("upper"), (upper >= least).alias("kept"), "pages")


def reputation(pages: DataFrame, labels: DataFrame, rules: Rules = RULES, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """(id, host, domain, suffix, rate, upper, kept) of every page; rate and upper bound are the host's posterior."""
    judged = judged_hosts(pages, labels, rules, id_col=id_col, url_col=url_col, **how)
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"))
    found = _meet(rows, judged, "host", "inner")
    return found.select(F.col("id").alias(id_col), "host", "domain", "suffix", "rate", "upper", "kept")


def _meet(rows: DataFrame, judged: DataFrame, host: str, how: str) -> DataFrame:
    """``rows`` joined with their host's judgement: by broadcast for the hosts of many pages, by shuffle for the rest."""
    total = judged.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    often = F.col("pages") >= F.lit(max(1, -(-total // HOT)))
    hot = F.broadcast(judged.where(often).withColumnRenamed("host", host))  # at most HOT rows, as their pages add up to no more than all
    rest = judged.where(~often).withColumnRenamed("host", host)
    return rows.join(hot, host, how).unionByName(rows.join(hot.select(host), host, "left_anti").join(rest, host, how))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Rules = RULES, url_col: str = "url", **how) -> DataFrame:
    """The rows of ``pages``, all columns, whose host's posterior bound reaches the least rate."""
    host = "host" + "_" * max(map(len, pages.columns))
    good = judged_hosts(pages, labels, rules, url_col=url_col, **how).where("kept").select("host", "pages")
    rows = pages.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias(host))
    return _meet(rows, good, host, "inner").select("row.*")


def sql(rules: Rules = RULES, least: float = LEAST, z: float = Z) -> str:
    """The same as DuckDB SQL over pages and labels."""

    def shrink(name: str, source: str) -> str:
        return f"""{name}_x as (select *, m * (1 - m) as v from {source}),
{name}_s as (select round(coalesce(case when extra > 0 and room > 0 then least(greatest(room / extra - 1, {STRENGTH[0]}), {STRENGTH[1]}) end, {STRENGTH[1]}), 6) as s
  from (select sum(power(k / n - m, 2) - v / n) filter (n > 0) as extra, sum(v * (n - 1) / n) filter (n > 0) as room from {name}_x)),
{name}_p as (select x.* exclude (m, v), round((k + s * m) / (n + s), 9) as p, n + s as t from {name}_x x cross join {name}_s)"""

    last = ", ".join(f"array_to_string(labels[-least({k}, parts):], '.') as c{k}" for k in range(1, _most(rules) + 2))
    return f"""with hosts as (select page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '{_HOST}', 1)), '\\.+$', '') as host from pages),
cut as (select *, {last} from (select host, string_split(host, '.') as labels, len(string_split(host, '.')) as parts, regexp_matches(host, '{_IP}') as ip from (select distinct host from hosts))),
named as (select *, {_suffix_sql(rules)} as suffix from cut),
urls as (select page_id, host, {_domain_sql(rules)} as domain, suffix from hosts join named using (host)),
seen as (select doc_id, min(quality * (1 - toxic)) as good from labels where doc_id is not null and quality is not null and toxic is not null group by doc_id),
h as (select suffix, domain, host, count(good) as n, coalesce(sum(good), 0)::bigint as k from urls left join seen on page_id = doc_id group by all),
d as (select suffix, domain, sum(n)::bigint as n, sum(k)::bigint as k from h group by all),
x as (select suffix, sum(n)::bigint as n, sum(k)::bigint as k from d group by all),
top as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from x),
{shrink("x", "(select x.*, m from x cross join top)")},
{shrink("d", "(select d.*, p as m from d join (select suffix, p from x_p) using (suffix))")},
{shrink("h", "(select h.*, p as m from h join (select suffix, domain, p from d_p) using (suffix, domain))")},
judged as (select host, domain, suffix, round(p, 6) as rate, round(p + {z} * sqrt(p * (1 - p) / (t + 1)), 6) as upper from h_p)
select page_id, host, domain, suffix, rate, upper, upper >= {least} as kept from urls join judged using (host, domain, suffix)"""
