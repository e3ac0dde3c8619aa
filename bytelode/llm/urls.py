"""URL filters: rules on hosts and paths, and a verdict from the link graph where no rule fits.

Built from DataFrame and SQL functions only. Up to ``INLINE_RULES`` rules are part of the plan; more of them are a table,
which the distinct urls' host suffixes are joined with. Both ways give the same.

Hosts are the nodes, links between different hosts the edges, weighted by their number. Trust is a personalised PageRank
from hosts that an allow rule covers whole, or that have a page which an allow rule fits: that page is vouched for.
Distrust is one over reversed edges from hosts that a block rule covers whole; where only some paths are blocked, the
host itself is not in doubt. A host that is both is blocked. Every seed starts with 1 - damping, so that the scores of a
host don't shrink as the graph grows. Score that reaches a host without links on stays there and is passed on no further.
Rounds go on until all that is still to come is at most ``CHANGE`` in sum. A host is blocked when its distrust is at
least ``threshold`` and exceeds its trust.

A null url, or one without "://", has an empty host and path: no rule fits, and it is allowed. Null html has no
links. Repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, table, tuned, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules up to which they are written into the plan.
INLINE_RULES = 200
DAMPING, CHANGE, THRESHOLD = 0.85, 1e-9, 0.01
#: Rounds in one plan, between two looks at what still moves.
ROUNDS_AT_ONCE = 8
#: Rounds of the SQL, which can't stop by a bound: 0.85 ** 200 is below 1e-14.
SQL_ROUNDS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([a-z][a-z0-9+.\-]*://[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    after = F.when(url.contains("://"), url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    after = F.when(url.contains("://"), url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.regexp_extract(after, r"(?s)^[^/?#]*(.*)", 1), r"^[^?#]*", 0)


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict (null: none)."""
    rule = verdict = F.lit(None).cast("string")
    # from the shortest to the longest, each wrapping what is decided so far; of equal lengths block wins
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block", r[1], r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_rules(df: DataFrame, rules) -> DataFrame:
    """``df`` (host, path and more) with ``rule`` and ``verdict``, null where none fits."""
    if len(rules) <= INLINE_RULES:
        rule, verdict = fitting(F.col("host"), F.col("path"), rules)
        return df.withColumns({"rule": rule, "verdict": verdict})
    own = df.sparkSession.createDataFrame([tuple(r) for r in rules], "kind string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = df.select("host", "path").where("host != ''").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    size = F.length("rule_host") + F.length("rule_path")
    order = F.struct(size.alias("size"), (F.col("kind") == "block").alias("block"), "rule_host", "rule_path", "kind")
    fits = urls.join(own, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.max(order).alias("r"))
    found = written(fits.select("host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.kind").alias("verdict")), "fitting-rules")
    return df.join(found, ["host", "path"], "left")


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    links = pages.where(F.col(html_col).contains("://")).select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), 1)).alias("link"))
    return links.select("src", host_of(F.col("link")).alias("dst")).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, change: float) -> DataFrame:
    """(host, score, moving), written: personalised PageRank of seeds (host) along edges (src, dst, share).

    A round moves ``damping`` of what the round before moved, or less where links end. So all rounds to come add no more
    than a sum of that series, to all hosts together; the last round is the one that leaves ``change`` at most.
    """
    scores = written(seeds.select("host", F.lit(1 - damping).alias("score"), F.lit(1 - damping).alias("moving")), "rank")
    # a host's own row keeps its score, its links pass on what moved last
    nodes = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    own = nodes.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))
    steps = written(edges.select("src", "dst", "share").unionByName(own), "rank-steps")
    moved = F.coalesce(F.col("moving") * F.col("share") * damping, F.lit(0.0))
    while (scores.agg(F.sum("moving")).first()[0] or 0.0) * damping > change * (1 - damping):
        before = scores
        for _ in range(ROUNDS_AT_ONCE):
            scores = steps.join(scores, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.when(F.col("share").isNull(), F.col("score")).otherwise(moved)).alias("score"), F.sum(moved).alias("moving")).withColumnRenamed("dst", "host")
        scores = written(scores, "rank")
        forget(before)
    forget(steps)
    return scores


def shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, share), written: of what a host passes on, the part that goes over each edge."""
    totals = written(edges.groupBy(F.col(src).alias("src")).agg(F.sum("weight").alias("total")), "totals")
    own = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "weight")
    out = written(own.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    forget(totals)
    return out


def blocked_hosts(pages: DataFrame, own: DataFrame, rules, url_col: str, html_col: str, damping: float, change: float, threshold: float) -> DataFrame:
    """(bad_host), written. own: pages with host, path and verdict."""
    edges = written(host_edges(pages, url_col, html_col), "host-edges")
    hosts = own.select("host").unionByName(edges.select(F.col("dst").alias("host"))).where("host != ''").distinct()
    whole = with_rules(hosts.withColumn("path", F.lit("/")), rules).select("host", F.col("verdict").alias("whole"))
    vouched = own.where("verdict = 'allow'").select("host").distinct().withColumn("vouched", F.lit(True))
    seeds = written(whole.join(vouched, "host", "left").where("whole IS NOT NULL OR vouched"), "seeds")
    bad = seeds.where("whole = 'block'").select("host")
    good = seeds.where("coalesce(whole, 'allow') = 'allow'").select("host")
    forward, back = shares(edges, "src", "dst"), shares(edges, "dst", "src")
    trust, distrust = propagate(forward, good, damping, change), propagate(back, bad, damping, change)
    both = distrust.select("host", F.col("score").alias("distrust")).join(trust.select("host", F.col("score").alias("trust")), "host", "left")
    doubt = F.round("distrust", 9)
    out = written(both.where((doubt >= threshold) & (doubt > F.round(F.coalesce("trust", F.lit(0.0)), 9))).select(F.col("host").alias("bad_host")), "blocked-hosts")
    forget(edges, seeds, forward, back, trust, distrust)
    return out


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", damping: float = DAMPING, change: float = CHANGE, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` without html, with ``host``, ``path``, ``rule`` and ``verdict``. Input columns of these names give way."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be from 0 to below 1")
    if any(v not in ("allow", "block") or not h for v, h, _ in rules):
        raise ValueError("a rule allows or blocks, and names a host")
    tuned(pages.sparkSession)
    gone = {html_col.lower(), "host", "path", "rule", "verdict", "bad_host"}
    own = pages.select(*(c for c in pages.columns if c.lower() not in gone), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    order = [*own.columns, "rule", "verdict"]
    own = with_rules(own, rules)
    blocked = blocked_hosts(pages, own, rules, url_col, html_col, damping, change, threshold)
    verdict = F.coalesce("verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow"))
    return own.join(blocked, F.col("host") == F.col("bad_host"), "left").withColumn("verdict", verdict).select(order)


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same in SQL, by a number of rounds that settles all scores."""

    def rank(name: str, src: str, dst: str, seeds: str) -> str:
        return f"""{name}s AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, weight / sum(weight) OVER (PARTITION BY {src}) AS share FROM e),
{name}r AS (SELECT 0 AS k, host, {1 - DAMPING!r}::DOUBLE AS m FROM h WHERE {seeds}
  UNION ALL SELECT k + 1, dst, {DAMPING} * sum(m * share) FROM {name}r JOIN {name}s ON src = host WHERE k < {SQL_ROUNDS} GROUP BY 1, 2),
{name} AS (SELECT host, sum(m) AS score FROM {name}r GROUP BY 1)"""

    def case(host: str, path: str, what: int) -> str:
        chosen = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r[1], r[2]))
        return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for v, h, p in chosen) + " END"

    after = "CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    host = "translate(regexp_extract(" + after + f", '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, html, coalesce({host.format(u="url")}, '') AS host,
  coalesce(regexp_extract(substr({after.format(u="url")}, length(regexp_extract({after.format(u="url")}, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, {case("host", "path", 0)} AS rule, {case("host", "path", 1)} AS verdict FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p),
e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT src, {host.format(u="link")} AS dst FROM l) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
w AS MATERIALIZED (SELECT host, {case("host", "'/'", 1)} AS whole FROM (SELECT host FROM p UNION SELECT dst FROM e) WHERE host <> ''),
h AS MATERIALIZED (SELECT host, coalesce(whole = 'block', false) AS bad, coalesce(whole, '') <> 'block' AND (whole = 'allow' OR host IN (SELECT host FROM j WHERE verdict = 'allow')) AS good FROM w),
{rank("t", "src", "dst", "good")},
{rank("d", "dst", "src", "bad")},
b AS (SELECT d.host FROM d LEFT JOIN t ON t.host = d.host WHERE round(d.score, 9) >= {THRESHOLD} AND round(d.score, 9) > round(coalesce(t.score, 0), 9))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
