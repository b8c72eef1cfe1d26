"""URL filter: host rules first, else trust and distrust propagated over the host graph. DataFrame functions only.

Host edges are absolute links in the pages' html (href and src), one for each pair of hosts, and, with
`domain_edges`, both ways between a host and its parent domain. Trust is a personalised PageRank along the edges from
hosts whose pages rules allow; distrust is the same along reversed edges from hosts whose pages rules block: who links to
the blocked is suspect. A seed's weight is the share of the host's pages under such rules. Ranks shrink as a graph grows, as mass is
split by degree, so a host is judged by shares: a second rank with every host as a full seed runs along, and what links bring a
host is set against what they would bring it then. A share is (1 - damping) * own + damping * linked, and the host's own
where that is more. A host whose distrust share exceeds its trust share by more than `margin` is blocked.

Cases: a null url, or one without ://, has empty host and path and is allowed; null html has no links; repeated rows are
judged each (their links count once, seeds count rows); no seeds or no edges leave hosts at their own seeds' shares; an
empty table gives an empty result; extra columns are ignored; a longest rule that ties goes to the first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_side, stored, text_of

#: (verdict, host, path), each fitting the host and its subdomains where the path begins so.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ROUNDS, MARGIN = 0.85, 10, 0.33
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(text_of(url), PARTS, 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(text_of(url), PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct<verdict, rule>, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered])


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", domain_edges: bool = True) -> DataFrame:
    """Distinct (src, dst) between different hosts."""
    hosts = pages.select(host_of(url_col).alias("src"), text_of(html_col).alias("html")).where("src <> ''")
    links = hosts.select("src", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    if domain_edges:
        child = pages.select(host_of(url_col).alias("src")).where("src <> ''").distinct()
        labels = F.split("src", "\\.")
        up = child.select("src", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, 9999), ".")), lambda d: d.contains("."))).alias("dst"))
        # every ancestor with a dot, each linked to its own parent
        chain = up.select(F.col("dst").alias("src"), F.regexp_replace("dst", r"^[^.]*\.", "").alias("dst")).where("dst like '%.%'")
        links = links.unionByName(chain).unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.where("src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share) of all hosts of edges and seeds, from seeds (host, trust, distrust).

    One table holds both walks, along edges (trust) and against them (distrust), and both ranks of each (`rank` from the seeds, `unit` with
    every host as a full seed), so a round is one join and one aggregation; what a round makes is bounded by hosts and edges. Lineage
    is cut every few rounds."""
    both = edges.select(F.lit(True).alias("good"), "src", "dst").unionByName(edges.select(F.lit(False).alias("good"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("good", "src").agg(F.count("*").alias("degree"))
    walk = stored(both.join(degree, ["good", "src"]).select("good", F.col("src").alias("host"), "dst", (F.lit(damping) / F.col("degree")).alias("part")), "walk")
    start = seeds.select("host", F.explode(F.create_map(F.lit(True), "trust", F.lit(False), "distrust")).alias("good", "rank"))
    start = start.unionByName(walk.select("host", "good", F.lit(0.0).alias("rank"))).unionByName(walk.select(F.col("dst").alias("host"), "good", F.lit(0.0).alias("rank")))
    start = start.groupBy("good", "host").agg((F.max("rank") * (1 - damping)).alias("rank"))
    start = stored(start.select("good", "host", "rank", F.lit(1 - damping).alias("unit"), F.lit(0.0).alias("rank_in"), F.lit(0.0).alias("unit_in")), "seeds")
    ranks = start
    for k in range(rounds):
        brought = [((F.col(x) + F.col(x + "_in")) * F.col("part")).alias(x + "_in") for x in ("rank", "unit")]
        moved = ranks.join(walk, ["good", "host"]).select("good", F.col("dst").alias("host"), F.lit(0.0).alias("rank"), F.lit(0.0).alias("unit"), *brought)
        ranks = moved.unionByName(start).groupBy("good", "host").agg(*[F.sum(x).alias(x) for x in ("rank", "unit", "rank_in", "unit_in")])
        if k % 5 == 4:
            ranks = stored(ranks, "ranks")
    linked = F.when(F.col("unit_in") > 0, F.col("rank_in") / F.col("unit_in")).otherwise(0.0)
    share = F.greatest(F.col("rank") / (1 - damping), F.col("rank") + damping * linked)
    scored = ranks.select("good", "host", (F.col("rank") + F.col("rank_in")).alias("rank"), share.alias("share"))
    pick = lambda good, x: F.sum(F.when(F.col("good") == good, F.col(x)).otherwise(0.0))
    return scored.groupBy("host").agg(pick(True, "rank").alias("trust"), pick(False, "rank").alias("distrust"), pick(True, "share").alias("trust_share"), pick(False, "share").alias("distrust_share"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, margin: float = MARGIN, domain_edges: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("own.verdict") == v, 1.0).otherwise(0.0))
    seeds = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(host_edges(pages, url_col, html_col, domain_edges), seeds, damping, rounds)
    blocked = stored(scores.where(F.round(F.col("distrust_share") - F.col("trust_share"), 9) > margin).select(F.col("host").alias("bad")), "blocked")
    judged = rows.join(small_side(blocked), F.col("host") == F.col("bad"), "left")
    own = F.when(F.col("bad").isNull(), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", own).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(v, h + p)[k]}'" for v, h, p in ordered) + " END"
    link = LINK.replace("'", "''")
    sql = f"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, {case(0)} AS v, {case(1)} AS rule FROM u),
h AS (SELECT DISTINCT host FROM u WHERE host <> ''),
up AS (SELECT host AS src FROM h WHERE contains(host, '.') UNION SELECT regexp_replace(src, '^[^.]*\\.', '') FROM up WHERE regexp_matches(src, '\\..*\\.')),
chain AS (SELECT src, regexp_replace(src, '^[^.]*\\.', '') AS dst FROM up WHERE regexp_matches(src, '\\..*\\.')),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM u WHERE host <> ''),
e AS (SELECT DISTINCT src, dst FROM (SELECT * FROM links UNION ALL SELECT * FROM chain UNION ALL SELECT dst, src FROM chain) WHERE src <> dst),
b AS (SELECT true AS good, src, dst FROM e UNION ALL SELECT false, dst, src FROM e),
w AS MATERIALIZED (SELECT good, src AS host, dst, {DAMPING} / count(*) OVER (PARTITION BY good, src) AS part FROM b),
s AS (SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS t, avg(CASE WHEN v = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS d FROM r WHERE host <> '' GROUP BY host),
k0 AS MATERIALIZED (SELECT good, host, max(rank) * (1 - {DAMPING}) AS rank, 1 - {DAMPING}::DOUBLE AS unit, 0::DOUBLE AS rank_in, 0::DOUBLE AS unit_in FROM (
    SELECT true AS good, host, t AS rank FROM s UNION ALL SELECT false, host, d FROM s UNION ALL SELECT good, host, 0 FROM w UNION ALL SELECT good, dst, 0 FROM w) GROUP BY good, host)"""
    for k in range(1, ROUNDS + 1):
        sql += f""",
k{k} AS MATERIALIZED (SELECT good, host, sum(rank) AS rank, sum(unit) AS unit, sum(rank_in) AS rank_in, sum(unit_in) AS unit_in FROM (
    SELECT w.good, w.dst AS host, 0::DOUBLE AS rank, 0::DOUBLE AS unit, (k.rank + k.rank_in) * w.part AS rank_in, (k.unit + k.unit_in) * w.part AS unit_in
    FROM k{k - 1} k JOIN w USING (good, host) UNION ALL SELECT good, host, rank, unit, rank_in, unit_in FROM k0) GROUP BY good, host)"""
    return (
        sql
        + f""",
shares AS (SELECT good, host, greatest(rank / (1 - {DAMPING}), rank + {DAMPING} * CASE WHEN unit_in > 0 THEN rank_in / unit_in ELSE 0 END) AS share FROM k{ROUNDS}),
bad AS (SELECT host FROM shares GROUP BY host HAVING round(sum(CASE WHEN good THEN -share ELSE share END), 9) > {MARGIN})
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
    )


ORACLE_SQL = _oracle()
