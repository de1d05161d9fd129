"""URL filters: rules first, link-graph propagation for the rest (DataFrame operations only).

Hosts are the nodes and links between pages of different hosts the edges.
Trust starts at hosts with pages that a rule allows (and none that a rule
blocks) and follows the links; distrust starts at hosts with blocked pages and
follows them backwards.  Both are personalised PageRanks, in whole numbers, so
that results don't depend on the order of sums:

    rank'(h) = (100 - damping) * seed(h) // 100 + sum over edges a -> h of (damping * rank(a)) // (100 * degree(a))

A host is blocked when ``distrust * 100 > trust * ratio_pct``.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule; the empty host takes no part in the graph and is allowed, like
every host that neither seed reaches.  Null html has no links.  Rows are
judged one by one, so repeated rows are repeated in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: (verdict, host, path) of the rules that the query applies.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
SEED = 10 ** 12
ROUNDS = 10
DAMPING = 85
RATIO_PCT = 100

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_case(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null.  The rules are a parameter, so a CASE holds them."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        out = F.when(fits(host, path, rule[1], rule[2]), F.lit(value(rule))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and rule_verdict of each page."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    h, q = F.col("host"), F.col("path")
    return p.select("page_id", "host", "path", rule_case(h, q, rules, lambda r: r[1] + r[2]).alias("rule"),
                    rule_case(h, q, rules, lambda r: r[0]).alias("rule_verdict"))


def link_host(link: Column) -> Column:
    return host_of(F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs: of links with a host (others stay on their page's host), and,
    in both directions, of a host with the one above it (``a.b.c`` and ``b.c``) if both have pages."""
    links = pages.select(host_of(F.col("url")).alias("src"),
                         F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), link_host))).alias("dst"))
    hosts = pages.select(host_of(F.col("url")).alias("src")).distinct()
    up = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.(.+)$", 1).alias("dst")).where("dst <> ''")
    up = up.join(hosts.withColumnRenamed("src", "dst"), "dst", "left_semi")
    both = links.unionByName(up).unionByName(up.selectExpr("dst AS src", "src AS dst"))
    return both.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(host, trust, distrust).  ``seeds``: (host, kind) with kind 'trust' or 'distrust'.

    One table holds both directions: an edge passes trust from src to dst and
    distrust from dst to src.  Each round is a join on the sending host and a
    partial sum by the receiving one; its ranks are written, which cuts the lineage.
    """
    both = edges.selectExpr("'trust' AS kind", "src AS a", "dst AS b").unionByName(
        edges.selectExpr("'distrust' AS kind", "dst AS a", "src AS b"))
    degree = both.groupBy("kind", "a").agg(F.count("*").alias("degree"))
    both = stage(both.join(degree, ["kind", "a"]), "host-edges")
    base = stage(seeds.select("kind", "host", F.lit(SEED * (100 - damping) // 100).cast("long").alias("rank")), "host-seeds")
    ranks = base
    for _ in range(rounds):
        sent = (both.join(ranks.withColumnRenamed("host", "a"), ["kind", "a"])
                .selectExpr("kind", "b AS host", f"(rank * {damping}) div (100 * degree) AS rank"))
        ranks = stage(sent.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "host-ranks")
    return ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0)).alias("distrust"))


def seed_hosts(judged: DataFrame) -> DataFrame:
    by_host = (judged.where("rule_verdict IS NOT NULL AND host <> ''").groupBy("host")
               .agg(F.max(F.col("rule_verdict") == "block").alias("blocked")))
    return by_host.select("host", F.when(F.col("blocked"), F.lit("distrust")).otherwise(F.lit("trust")).alias("kind"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: int = DAMPING, ratio_pct: int = RATIO_PCT) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    judged = with_rules(pages, rules)
    ranks = propagate(host_edges(pages), seed_hosts(judged), rounds, damping)
    out = judged.join(ranks, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    method = F.when(distrust * 100 > trust * ratio_pct, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"),
                      trust.cast("long").alias("trust"), distrust.cast("long").alias("distrust"))


def sql(rules=RULES, rounds: int = ROUNDS, damping: int = DAMPING, ratio_pct: int = RATIO_PCT) -> str:
    """The same in DuckDB SQL, one CTE a round."""
    def case(value):
        ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in ordered) + " END"

    def host(url):
        return f"translate(regexp_extract(coalesce({url}, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"

    link = LINK.replace("'", "''")
    text = f"""WITH p AS MATERIALIZED (SELECT page_id, {host('url')} AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS rv FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS u FROM p),
u AS MATERIALIZED (SELECT DISTINCT host AS src, regexp_extract(host, '^[^.]+\\.(.+)$', 1) AS dst FROM p
  WHERE regexp_extract(host, '^[^.]+\\.(.+)$', 1) IN (SELECT host FROM p)),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, {host("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")} AS dst FROM l
  UNION ALL SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u) WHERE src <> '' AND dst <> '' AND src <> dst),
b AS MATERIALIZED (SELECT kind, a, b, count(*) OVER (PARTITION BY kind, a) AS degree FROM
  (SELECT 'trust' AS kind, src AS a, dst AS b FROM e UNION ALL SELECT 'distrust', dst, src FROM e)),
s AS (SELECT CASE WHEN max(CASE WHEN rv = 'block' THEN 1 ELSE 0 END) = 1 THEN 'distrust' ELSE 'trust' END AS kind, host,
  {SEED * (100 - damping) // 100}::BIGINT AS rank FROM j WHERE rv IS NOT NULL AND host <> '' GROUP BY host),
r0 AS MATERIALIZED (SELECT kind, host, rank FROM s)"""
    for i in range(rounds):
        text += f""",
r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank)::BIGINT AS rank FROM (SELECT b.kind, b.b AS host, (r.rank * {damping}) // (100 * b.degree) AS rank
  FROM b JOIN r{i} r ON r.kind = b.kind AND r.host = b.a UNION ALL SELECT kind, host, rank FROM s) GROUP BY kind, host)"""
    return text + f""",
h AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN coalesce(distrust, 0) * 100 > coalesce(trust, 0) * {ratio_pct} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM j LEFT JOIN h ON h.host = j.host"""
