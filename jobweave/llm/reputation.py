"""URL filters by empirical-Bayes host reputation: labelled pages judge their hosts, shrunk through beta-binomial priors.

A page counts as good if its label has quality 1 and is not toxic. Good pages of a host are binomial; the host's rate
has a beta prior whose mean is the posterior mean of its registered domain, that one's is its suffix's, and that one's
is the rate of all pages. How strongly children follow their parent is one number a level, fitted by moments: the
squared deviations of the children's counts beyond binomial noise. What a parent's own rate lacks in certainty is handed
down as variance. A host with few labels or none thus gets the rate of
what it belongs to, one with many its own. A page is blocked if the upper bound of its host's posterior is below FLOOR,
and rules, where one fits, decide before that.

DataFrame functions only. Pages meet as counts: labels are joined by id, hosts are summed before they are shuffled, and
the levels above are sums of hosts. Hosts are sent to all executors if their counted number is within BROADCAST_ROWS,
and joined by a shuffle above, where Spark splits a popular host. Sums of deviations are whole millionths, so that the
order of rows doesn't matter. Rules are a parameter of the caller, a short list that becomes one expression.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule, and is judged like any other
host, with the rate of its own labelled pages. Rows that repeat or lack a page_id are judged each; those without one
have no label. Labels without doc_id or quality are none, a null `toxic` is 0; of several labels for one page the counts
add up. Among rules of one length the longer host wins, then the first by text. Very long urls are read whole. Extra
columns are ignored by `judged` and kept by `allowed`; an empty table gives an empty one, and without labels each host
has the rate 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import cut

#: Hosts or labelled ids up to which they are sent to all executors.
BROADCAST_ROWS = 200_000
#: Normal quantile of the bound, and the rate of good pages that a host must not be surely below.
Z, FLOOR = 1.645, 0.7
#: Bounds of the correlation within a parent, 1 / (strength + 1), and the one taken where nothing tells.
LEAST_RHO, MOST_RHO, NO_RHO = 0.001, 0.5, 0.1
MILLION = 1_000_000
#: Suffixes of several labels under which names are registered; else a suffix is the last label.
SUFFIXES = ("example.com", "example.net", "example.org", "co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "github.io", "blogspot.com")
#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def last_labels(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def with_parents(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Adds `domain` and `suffix` of the host's name, which has neither user nor port; an address is its own."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    rows = hosts.withColumn("name", name).withColumn("parts", F.split("name", r"\."))
    of = F.lit(1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        of = F.when(last_labels(F.col("parts"), n).isin([s for s in suffixes if s.count(".") + 1 == n]), n).otherwise(of)
    address = F.col("name").rlike(r"^[0-9.]*$|^\[")
    rows = rows.withColumn("of", of).withColumn("suffix", F.when(address, F.col("name")).otherwise(F.expr("array_join(slice(parts, greatest(size(parts) - of + 1, 1), of), '.')")))
    domain = F.expr("array_join(slice(parts, greatest(size(parts) - of, 1), of + 1), '.')")
    return rows.withColumn("domain", F.when(address, F.col("name")).otherwise(domain)).drop("name", "parts", "of")


def spread(rows: DataFrame) -> float:
    """The correlation of outcomes within a parent's children (k of n, expected rate p), by moments."""
    noise = F.col("n") * F.col("p") * (1 - F.col("p"))
    off = F.col("k") - F.col("n") * F.col("p")
    whole = lambda c: F.coalesce(F.sum(F.floor(c * MILLION)), F.lit(0))
    beyond, most = rows.where("n > 1").agg(whole(off * off - noise), whole(noise * (F.col("n") - 1))).first()
    return min(max(beyond / most, LEAST_RHO), MOST_RHO) if most else NO_RHO


def posterior(rows: DataFrame, rho: float) -> DataFrame:
    """Adds `mean` and `var` of the posterior of k of n whose prior has mean p, known with variance v."""
    strength = (1 - rho) / rho
    rows = rows.withColumn("share", F.lit(strength) / (F.col("n") + F.lit(strength))).withColumn("mean", (F.col("k") + F.lit(strength) * F.col("p")) / (F.col("n") + F.lit(strength)))
    return rows.withColumn("var", F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(strength + 1)) + F.col("share") * F.col("share") * F.col("v"))


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, to be sent to all executors if their number is within BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, good, labelled) of pages that have labels."""
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    own = labels.where("doc_id is not null and quality is not null")
    return own.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.sum(good).alias("good"), F.count("*").alias("labelled"))


def reputations(pages: DataFrame, labels: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n_labelled, n_good, reputation, upper) of every host in pages(page_id, url)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"))
    met = own.join(bounded(cut(outcomes(labels))), "page_id", "left")
    hosts = met.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("k"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"))
    hosts = cut(with_parents(hosts, suffixes))
    k, n = hosts.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rate = (k + 1) / (n + 2)
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")))
    tops = cut(domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("p", F.lit(rate)).withColumn("v", F.lit(rate * (1 - rate) / (n + 3))))
    tops = posterior(tops, spread(tops)).select("suffix", F.col("mean").alias("p"), F.col("var").alias("v"))
    domains = cut(domains.join(bounded(tops), "suffix"))
    domains = posterior(domains, spread(domains)).select("domain", "suffix", F.col("mean").alias("p"), F.col("var").alias("v"))
    hosts = cut(hosts.join(bounded(domains), ["domain", "suffix"]))
    hosts = posterior(hosts, spread(hosts))
    above = F.col("mean") + F.lit(Z) * F.sqrt("var")
    return hosts.select("host", "domain", "suffix", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), F.col("mean").alias("reputation"), above.alias("upper"))


def verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """Every row of pages as the struct `row`, with host, path, rule, verdict, n_labelled, reputation and upper."""
    known = cut(reputations(pages, labels).select("host", "n_labelled", "reputation", "upper"))
    own = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")).withColumn("url", F.col("row.url"))
    own = own.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return own.join(bounded(known), "host", "left").select(
        "row", "host", "path", rule.alias("rule"), F.coalesce(action, by_method).alias("verdict"), "n_labelled", "reputation", "upper"
    )


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, reputation, upper) for each row of pages(page_id, url)."""
    return verdicts(pages.select("page_id", "url"), labels, rules, floor).select("row.page_id", "host", "path", "rule", "verdict", "n_labelled", "reputation", "upper")


def allowed(pages: DataFrame, labels: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """The rows of pages, all columns, that are not blocked."""
    return verdicts(pages, labels, rules, floor).where("verdict = 'allow'").select("row.*")
