"""Operator 7, URL filters: host and path rules, then a tree of path templates per host.

1. A segment with a digit is a wildcard.  At each node of a host's tree, so is a child that has less than SHARE
   percent of the node's urls, or only one, unless the blocked share of its labelled urls differs significantly
   from that of the other wildcards.  Whether a url passes a node is first told by its segments' shares among
   the host's urls of that depth; so all nodes of all depths are judged in one pass, at any depth of path.
2. Templates of one host that differ in their last fixed segment are siblings.  Those with labelled urls are
   taken in order of their blocked share, and neighbours that don't differ significantly are one branch.  A sibling
   without labelled urls joins the branch whose share is nearest to that of its namesakes, the same template on
   other hosts, unless the two differ significantly; namesakes tell as much as PRIOR urls at most.
3. A template's purity is the blocked share of its branch's labelled urls, smoothed by PRIOR urls at the share of the
   same template on all hosts, which is smoothed in turn by PRIOR urls at the share of all.  It is rejected if its
   purity is at least REJECT and at least SUPPORT percent of the branch's urls are labelled.  Those of joined
   templates count for the joined ones only, so a template with labels is judged without them.  Other hosts tell
   which siblings a template is like, and are a weak prior: without a labelled sibling on its own host, or without
   namesakes that are labelled, it is allowed.

Labels are the verdicts of the rules; a rule's verdict goes first.  Shares are compared on labelled urls only,
with one url more of each kind, so that few labels tell little apart.  No limit is a count, so a verdict
doesn't change because all groups grow alike.

All of it is aggregates by host and shape, combined map-side, so a hot host is a few rows; the tables joined
back hold one row a shape, and Spark broadcasts or splits by their measured size.

Cases.  Null url, or one without `://`: empty host and path, no rule, template of the empty host.  Very
long paths: every segment counts.  Ties of shares are ordered by template.  Repeated rows are each counted and
returned; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.llm.storage import materialize

#: (host and path prefix, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Percentages of urls, urls, a share, a percentage of urls.
SHARE, PRIOR, REJECT, SUPPORT = 2, 10, 0.8, 10
#: The 95 % point of chi-square with one degree of freedom.
DIFFERENT = 3.84
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A template's last fixed segment, with the wildcards after it.
_LAST_FIXED = r"[^/]*[^/*][^/]*((?:/\*)*)$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]), r[0]))


def rule_of(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and the path's start, and its verdict; null without any."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in reversed(_longest_first(rules)):
        name, _, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))) & F.startswith(F.col(path), F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shaped(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with shape: the segments of the path, joined, wildcards where they have a digit."""
    segments = F.array_remove(F.split(path, "/"), "")
    return rows.withColumn("shape", F.array_join(F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)), "/"))


def differ(b: Column, n: Column, other_b: Column, other_n: Column) -> Column:
    """Whether two blocked shares, of b in n and other_b in other_n labelled urls, differ significantly."""
    p, q = (b + 1) / (n + 2), (other_b + 1) / (other_n + 2)
    return (p - q) * (p - q) > DIFFERENT * (p * (1 - p) / (n + 2) + q * (1 - q) / (other_n + 2))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, n, labelled, blocked) of shapes (host, shape, n, labelled, blocked)."""
    each = shapes.filter("shape <> ''").select("host", "shape", "n", "labelled", "blocked", F.posexplode(F.split("shape", "/")).alias("d", "segment"))
    own = lambda counted, total: (F.col("segment") != "*") & (F.col(counted) >= 2) & (F.col(counted) * 100 >= SHARE * F.col(total))
    # what is frequent at its depth of the host leads to a node of its own
    deep = each.groupBy("host", "d").agg(F.sum("n").alias("total"))
    often = materialize(each.groupBy("host", "d", "segment").agg(F.sum("n").alias("c")).filter("c >= 2").join(deep, ["host", "d"]).filter(own("c", "total")).select("host", "d", "segment", F.lit(True).alias("often")), "url-frequent")
    before = W.partitionBy("host", "shape").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    way = F.when(F.col("often"), F.col("segment")).otherwise("*")
    nodes = each.join(often, ["host", "d", "segment"], "left").withColumn("way", way).withColumn("node", F.xxhash64(F.collect_list("way").over(before)))
    nodes = materialize(nodes.select("host", "shape", "d", "segment", "node", "n", "labelled", "blocked"), "url-nodes")
    key = ["host", "d", "node"]
    children = nodes.groupBy(*key, "segment").agg(*_sums())
    children = materialize(children.join(children.groupBy(*key).agg(F.sum("n").alias("total")), key).withColumn("own", own("n", "total")), "url-children")
    pools = children.filter("NOT own").groupBy(*key).agg(F.sum("labelled").alias("pool_n"), F.sum("blocked").alias("pool_b"))
    told = children.filter("NOT own AND segment <> '*' AND labelled > 0").join(pools, key).filter("pool_n > labelled")
    apart = told.filter(differ(F.col("blocked"), F.col("labelled"), F.col("pool_b") - F.col("blocked"), F.col("pool_n") - F.col("labelled")))
    fixed = materialize(children.filter("own").select(*key, "segment").unionByName(apart.select(*key, "segment")).withColumn("fixed", F.lit(True)), "url-fixed")
    part = F.struct("d", F.when(F.col("fixed"), F.col("segment")).otherwise("*").alias("segment"))
    made = nodes.join(fixed, [*key, "segment"], "left").groupBy("host", "shape").agg(F.array_join(F.array_sort(F.collect_list(part))["segment"], "/").alias("made"))
    return shapes.join(made, ["host", "shape"], "left").select("host", "shape", F.concat(F.lit("/"), F.coalesce("made", F.lit(""))).alias("template"), "n", "labelled", "blocked")


def joined(silent: DataFrame, branches: DataFrame) -> DataFrame:
    """(host, template, branch_n, branch_labelled, branch_blocked) of the templates without labelled urls that are like a branch of their siblings.

    silent has (host, family, template, n, all_labelled, all_blocked), branches (host, family, branch, branch_*).
    """
    known = branches.withColumn("share", F.col("branch_blocked") / F.col("branch_labelled"))
    known = known.select("host", "family", "branch", "share", F.struct("share", "branch", "branch_n", "branch_labelled", "branch_blocked").alias("here"))
    line = silent.withColumn("share", F.col("all_blocked") / F.col("all_labelled")).unionByName(known, allowMissingColumns=True)
    # the nearest branch is the one before or after in order of shares, so no template meets all branches
    way = W.partitionBy("host", "family").rowsBetween(W.unboundedPreceding, -1)
    below, above = (F.last("here", ignorenulls=True).over(way.orderBy(share, F.asc_nulls_last("branch"))) for share in (F.asc("share"), F.desc("share")))
    line = line.withColumns({"below": below, "above": above}).filter("here IS NULL")
    lower = F.col("above").isNull() | (F.col("share") - F.col("below.share") <= F.col("above.share") - F.col("share"))
    met = line.withColumn("met", F.when(lower, F.col("below")).otherwise(F.col("above"))).filter("met IS NOT NULL").select("host", "family", "template", "n", "all_labelled", "all_blocked", "met.*")
    heard = F.least("all_labelled", F.lit(PRIOR))
    like = met.filter(~differ(F.col("all_blocked") * heard / F.col("all_labelled"), heard, F.col("branch_blocked"), F.col("branch_labelled")))
    together = F.col("branch_n") + F.sum("n").over(W.partitionBy("host", "family", "branch"))
    return like.select("host", "template", together.alias("branch_n"), "branch_labelled", "branch_blocked")


def template_verdicts(rows: DataFrame) -> DataFrame:
    """(host, shape, template, purity, rejected) for every shape of rows (host, shape, label: allow, block or null)."""
    shapes = materialize(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")), "url-shapes")
    found = materialize(templates(shapes), "url-templates")
    own = found.groupBy("host", "template").agg(*_sums()).withColumns({"family": F.regexp_replace("template", _LAST_FIXED, "+$1"), "share": (F.col("blocked") + 1) / (F.col("labelled") + 2)})
    order = W.partitionBy("host", "family").orderBy("share", "template")
    near = own.filter("labelled > 0").withColumns({"m0": F.lag("labelled").over(order), "b0": F.lag("blocked").over(order)})
    new = F.when(F.col("m0").isNotNull() & differ(F.col("blocked"), F.col("labelled"), F.col("b0"), F.col("m0")), 1).otherwise(0)
    told = near.withColumn("new", new).withColumn("branch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = told.groupBy("host", "family", "branch").agg(*(F.sum(c).alias(f"branch_{c}") for c in ("n", "labelled", "blocked")))
    everywhere = own.groupBy("template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")))
    silent = own.filter("labelled = 0").join(everywhere.filter("all_labelled > 0"), "template")
    like = joined(silent.select("host", "family", "template", "n", "all_labelled", "all_blocked"), merged)
    branches = told.join(merged, ["host", "family", "branch"]).select("host", "template", *(f"branch_{c}" for c in ("n", "labelled", "blocked"))).unionByName(like)
    counted = shapes.agg(F.sum("blocked"), F.sum("labelled")).first()
    base = counted[0] / counted[1] if counted[1] else 0.0
    judged = own.join(branches, ["host", "template"], "left").join(everywhere, "template").withColumns({c: F.coalesce(f"branch_{c}", c) for c in ("n", "labelled", "blocked")})
    prior = (F.col("all_blocked") + F.lit(PRIOR * base)) / (F.col("all_labelled") + PRIOR)
    supported = (F.col("labelled") > 0) & (F.col("labelled") * 100 >= SUPPORT * F.col("n"))
    judged = judged.withColumn("purity", (F.col("blocked") + PRIOR * prior) / (F.col("labelled") + PRIOR))
    verdicts = judged.select("host", "template", "purity", ((F.col("purity") >= REJECT) & supported).alias("rejected"))
    return materialize(found.select("host", "shape", "template").join(verdicts, ["host", "template"]), "url-verdicts").select("host", "shape", "template", "purity", "rejected")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, template, purity and verdict."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, label = rule_of("host", "path", rules)
    rows = materialize(shaped(rows.withColumns({"rule": rule, "label": label})), "url-rows")
    judged = rows.join(template_verdicts(rows), ["host", "shape"], "left")
    return judged.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce("label", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _fit_sql(text: str) -> str:
    name, _, rest = text.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"


def _differ_sql(b: str, n: str, other_b: str, other_n: str) -> str:
    p, q = f"(({b} + 1) / ({n} + 2))", f"(({other_b} + 1) / ({other_n} + 2))"
    return f"(({p} - {q}) * ({p} - {q}) > {DIFFERENT}::DOUBLE * ({p} * (1 - {p}) / ({n} + 2) + {q} * (1 - {q}) / ({other_n} + 2)))"


_OWN_SQL = "segment <> '*' AND {0} >= 2 AND {0} * 100 >= " + str(SHARE) + " * {1}"
ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {_fit_sql(t)} THEN '{t}'" for t, _ in _longest_first(RULES))} END AS rule, CASE {" ".join(f"WHEN {_fit_sql(t)} THEN '{v}'" for t, v in _longest_first(RULES))} END AS label,
  array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END), '/') AS shape FROM parsed),
shapes AS (SELECT host, shape, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked FROM ruled GROUP BY host, shape),
each AS (SELECT host, shape, n, labelled, blocked, unnest(string_split(shape, '/')) AS segment, unnest(range(len(string_split(shape, '/')))) AS d FROM shapes WHERE shape <> ''),
often AS (SELECT host, d, segment FROM (SELECT host, d, segment, sum(n) AS c FROM each GROUP BY host, d, segment) JOIN (SELECT host, d, sum(n) AS total FROM each GROUP BY host, d) USING (host, d) WHERE {_OWN_SQL.format("c", "total")}),
nodes AS (SELECT each.*, coalesce(string_agg(CASE WHEN often.host IS NULL THEN '*' ELSE segment END, '/') OVER (PARTITION BY host, shape ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS node FROM each LEFT JOIN often USING (host, d, segment)),
sums AS (SELECT host, d, node, segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM nodes GROUP BY host, d, node, segment),
children AS (SELECT *, {_OWN_SQL.format("n", "(sum(n) OVER (PARTITION BY host, d, node))")} AS own FROM sums),
pools AS (SELECT host, d, node, sum(labelled) AS pool_n, sum(blocked) AS pool_b FROM children WHERE NOT own GROUP BY host, d, node),
fixed AS (SELECT host, d, node, segment FROM children WHERE own UNION ALL SELECT host, d, node, segment FROM children JOIN pools USING (host, d, node)
  WHERE NOT own AND segment <> '*' AND labelled > 0 AND pool_n > labelled AND {_differ_sql("blocked", "labelled", "(pool_b - blocked)", "(pool_n - labelled)")}),
made AS (SELECT host, shape, string_agg(CASE WHEN fixed.host IS NULL THEN '*' ELSE segment END, '/' ORDER BY d) AS made FROM nodes LEFT JOIN fixed USING (host, d, node, segment) GROUP BY host, shape),
found AS (SELECT host, shape, '/' || coalesce(made, '') AS template, n, labelled, blocked FROM shapes LEFT JOIN made USING (host, shape)),
owns AS (SELECT *, regexp_replace(template, '{_LAST_FIXED}', '+\1') AS family, (blocked + 1) / (labelled + 2) AS share FROM (SELECT host, template, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM found GROUP BY host, template)),
near AS (SELECT *, lag(labelled) OVER o AS m0, lag(blocked) OVER o AS b0 FROM owns WHERE labelled > 0 WINDOW o AS (PARTITION BY host, family ORDER BY share, template)),
told AS (SELECT *, sum(CASE WHEN m0 IS NOT NULL AND {_differ_sql("blocked", "labelled", "b0", "m0")} THEN 1 ELSE 0 END) OVER (PARTITION BY host, family ORDER BY share, template ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS branch FROM near),
everywhere AS (SELECT template, sum(labelled) AS all_labelled, sum(blocked) AS all_blocked FROM owns GROUP BY template),
branches AS (SELECT host, family, branch, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM told GROUP BY host, family, branch),
met AS (SELECT o.host, o.family, o.template, o.n AS own_n, b.branch, b.n, b.labelled, b.blocked, all_labelled, all_blocked, least(all_labelled, {PRIOR}) AS heard, all_blocked / all_labelled AS namesakes, b.blocked / b.labelled AS share
  FROM owns o JOIN everywhere USING (template) JOIN branches b ON b.host = o.host AND b.family = o.family WHERE o.labelled = 0 AND all_labelled > 0),
nearest AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY host, template ORDER BY abs(namesakes - share), share, branch DESC) = 1),
alike AS (SELECT *, n + sum(own_n) OVER (PARTITION BY host, family, branch) AS joined_n FROM nearest WHERE NOT {_differ_sql("(all_blocked * heard / all_labelled)", "heard", "blocked", "labelled")}),
merged AS (SELECT host, template, sum(n) OVER b AS n, sum(labelled) OVER b AS labelled, sum(blocked) OVER b AS blocked FROM told WINDOW b AS (PARTITION BY host, family, branch)
  UNION ALL SELECT host, template, joined_n, labelled, blocked FROM alike
  UNION ALL SELECT host, template, n, labelled, blocked FROM owns WHERE labelled = 0 AND NOT EXISTS (FROM alike s WHERE s.host = owns.host AND s.template = owns.template)),
base AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked) / sum(labelled) ELSE 0 END AS base FROM shapes),
judged AS (SELECT host, template, (blocked + {PRIOR} * ((all_blocked + {PRIOR} * base) / (all_labelled + {PRIOR}))) / (labelled + {PRIOR}) >= {REJECT}::DOUBLE AND labelled > 0 AND labelled * 100 >= {SUPPORT} * n AS rejected FROM merged JOIN everywhere USING (template), base)
SELECT page_id, ruled.host, path, rule, coalesce(label, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN found ON found.host = ruled.host AND found.shape = ruled.shape LEFT JOIN judged ON judged.host = ruled.host AND judged.template = found.template
"""
