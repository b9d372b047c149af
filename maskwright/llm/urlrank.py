"""Operator 7: URL filters with link-graph propagation, with DataFrame operations only.

Rules decide first: the longest rule whose host is the url's host or a parent domain and whose path
begins the url's path.  Every other url is judged by its host.  Over host edges (links in ``html`` to
another host, with their number as weight) trust flows forward from the pages that rules allow, and
distrust flows backward from the pages that rules block: personalised PageRank with damping
``DAMPING`` percent.  A host is blocked when its distrust exceeds its trust and reaches half of what
it would have if all its pages were blocked.

Mass is counted in whole numbers, ``UNIT`` for each seed page, so sums do not depend on their order.
Masses start at the seeds' own share and only grow, by at most ``DAMPING`` percent of the round before;
rounds end at the fixed point, when no number changes (about 75 rounds, and 14 more for ten times the
pages).  ``GUARD`` rounds without an end, more than 64-bit masses can take, raise an error.  Edges are summed for each pair of hosts
before any join, so a host of very many pages is one row for each host it links to.

The host is what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; the path goes
on to ``? #`` or the end; without ``://`` both are empty.

Defined cases: a null url has empty host and path and, without seeds on the empty host, is allowed;
null html has no link; repeated rows count as pages of their own; extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (rule, verdict); a rule is a host, then the path from its first slash on.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
DAMPING = 85
UNIT = 1_000_000
GUARD = 400
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null; a rule list is a small parameter."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, w`` with the weights' totals of both ends; a host's links to itself say nothing."""
    links = (
        pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
        .select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> ''")
    )
    edges = common.stored(links.groupBy("src", "dst").agg(F.count("*").alias("w")), "host-edges")
    out = edges.groupBy("src").agg(F.sum("w").alias("w_out"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("w_in"))
    return common.stored(edges.join(out, "src").join(into, "dst"), "host-edges")


def _share(mass: str, w: str, total: str) -> Column:
    """``floor(mass * w / total)`` without overflow."""
    return F.expr(f"({mass} div {total}) * {w} + (({mass} % {total}) * {w}) div {total}")


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = GUARD) -> DataFrame:
    """``host, pages, trust, distrust`` from ``hosts(host, pages, allowed, blocked)``."""
    seeds = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct().join(hosts, "host", "full").select(
        "host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "allowed", "blocked")]
    )
    base = [(F.col(c) * UNIT * (100 - DAMPING)).alias(b) for c, b in (("allowed", "t0"), ("blocked", "d0"))]
    state = common.stored(
        seeds.select("host", "pages", *base).select("host", "pages", F.expr("t0 div 100").alias("t0"), F.expr("d0 div 100").alias("d0"))
        .select("*", F.col("t0").alias("trust"), F.col("d0").alias("distrust")), "host-state",
    )
    if edges.isEmpty():
        return state.select("host", "pages", "trust", "distrust")
    for _ in range(rounds):
        forward = edges.join(state.select(F.col("host").alias("src"), "trust"), "src").where("trust > 0").select(
            F.col("dst").alias("host"), _share("trust", "w", "w_out").alias("t"), F.lit(0).cast("long").alias("d")
        )
        backward = edges.join(state.select(F.col("host").alias("dst"), "distrust"), "dst").where("distrust > 0").select(
            F.col("src").alias("host"), F.lit(0).cast("long").alias("t"), _share("distrust", "w", "w_in").alias("d")
        )
        flow = forward.union(backward).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = common.stored(
            state.join(flow, "host", "left").select(
                "host", "pages", "t0", "d0",
                F.expr(f"t0 + coalesce(t, 0L) * {DAMPING} div 100").alias("trust"), F.expr(f"d0 + coalesce(d, 0L) * {DAMPING} div 100").alias("distrust"),
                F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"),
            ), "host-state",
        )
        state = new
        if new.where("trust <> was_t or distrust <> was_d").isEmpty():
            return state.select("host", "pages", "trust", "distrust")
    raise RuntimeError(f"link masses still change after {rounds} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))
    hosts = ruled.select("host", said.alias("v")).groupBy("host").agg(
        F.count("*").alias("pages"), F.count(F.when(F.col("v") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("v") == "block", 1)).alias("blocked")
    )
    masses = propagate(hosts, host_edges(split.select("host", "html")))
    bad = (F.col("distrust") > F.col("trust")) & (2 * 100 * F.col("distrust") >= F.col("pages") * UNIT * (100 - DAMPING))
    blocked = masses.where(bad & (F.col("pages") > 0)).select("host", F.lit("block").alias("by_host"))
    return ruled.drop("html").join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(said, "by_host", F.lit("allow")).alias("verdict")
    )


def op7_link_graph(spark: SparkSession, root: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge(common.table(spark, root, "pages"))


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        name, _, rest = rule.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}'))"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"
    ctes = [
        "cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "parts AS (SELECT page_id, html, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM cut)",
        f"split AS (SELECT page_id, html, translate(h, '{_UPPER}', '{_LOWER}') AS host, "
        "regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts)",
        f"ruled AS (SELECT *, {rule} AS rule FROM split)",
        f"said AS (SELECT *, {said} AS v FROM ruled)",
        "hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (v = 'allow') AS allowed, count(*) FILTER (v = 'block') AS blocked FROM said GROUP BY 1)",
        f"links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK.replace(chr(39), chr(39) * 2)}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM split)",
        "edges AS (SELECT src, dst, count(*) AS w FROM links WHERE src <> dst AND src <> '' GROUP BY 1, 2)",
        "weights AS (SELECT *, sum(w) OVER (PARTITION BY src) AS w_out, sum(w) OVER (PARTITION BY dst) AS w_in FROM edges)",
        "names AS (SELECT host FROM hosts UNION SELECT src FROM edges UNION SELECT dst FROM edges)",
        f"s0 AS (SELECT n.host, coalesce(pages, 0)::HUGEINT AS pages, coalesce(allowed, 0)::HUGEINT * {UNIT * (100 - DAMPING)} // 100 AS t0, "
        f"coalesce(blocked, 0)::HUGEINT * {UNIT * (100 - DAMPING)} // 100 AS d0 FROM names n LEFT JOIN hosts USING (host))",
    ]
    # one round from the last one's rows, while that one changed anything
    flow = (
        "flow AS (SELECT host, sum(t) AS t, sum(d) AS d FROM ("
        "SELECT dst AS host, trust * w // w_out AS t, 0::HUGEINT AS d FROM weights JOIN walk ON host = src UNION ALL "
        "SELECT src, 0, distrust * w // w_in FROM weights JOIN walk ON host = dst) GROUP BY 1)"
    )
    ctes.append(
        "walk AS (SELECT host, pages, t0, d0, t0 AS trust, d0 AS distrust, 0 AS turn, true AS moved FROM s0 UNION ALL "
        f"(WITH {flow} SELECT host, pages, t0, d0, t0 + (coalesce(t, 0) * {DAMPING} // 100)::HUGEINT AS new_t, "
        f"d0 + (coalesce(d, 0) * {DAMPING} // 100)::HUGEINT AS new_d, turn + 1, new_t <> trust OR new_d <> distrust "
        "FROM walk LEFT JOIN flow USING (host) WHERE (SELECT bool_or(moved) FROM walk)))"
    )
    ctes.append("masses AS (SELECT * FROM walk WHERE turn = (SELECT max(turn) FROM walk))")
    return (
        "WITH RECURSIVE " + ", ".join(ctes) + f" SELECT page_id, p.host, path, rule, coalesce(v, CASE WHEN distrust > trust AND "
        f"200 * distrust >= pages * {UNIT * (100 - DAMPING)} THEN 'block' ELSE 'allow' END) AS verdict FROM said p JOIN masses USING (host)"
    )


SQL = _sql()
