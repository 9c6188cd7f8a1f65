"""Linking source names to a reference catalog: exact join, weighted candidates, barriers, score, pick.

Sources have (q, name), targets (idx, code, name); q and idx order their rows.  Targets are one catalog, or several
stacked ones that a column tells apart (by): then each source has an exact hit, a top 50 and a pick in each catalog, and
all catalogs go through every step together.

Rows with one clean name are alike to every step, so each distinct name is taken apart, met and scored once: a
name that many rows share is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions import decompose as D
from recordloom.functions import similarity as S
from recordloom.functions.text import clean_lite, normalize, one_decimal, tokens
from recordloom.operators.bounded import meet
from recordloom.operators.fuzzy import distance_allows, overlapping
from recordloom.stored import Steps, materialize
from recordloom.vocab import Vocabulary

TOP, FALLBACK, BAND, SURE = 50, 40, 0.35, 0.98
#: Weights of probes: a token, an anatomy term, the category, the modality, the core.
WEIGHTS = {"token": 1, "anatomy": 8, "category": 4, "modality": 5, "core": 10}
#: Names that a task takes apart; rows beyond which a table isn't broadcast, however small it is on disk, where names repeat.
NAMES, MANY = 1000, 200_000


def prepared(rows: DataFrame, vocab: Vocabulary | None = None, name: str = "name") -> DataFrame:
    """rows with clean and, if there is a vocabulary, the parts of the name; else empty parts."""
    if vocab is None:
        none = F.array().cast("array<string>")
        return rows.withColumn("clean", clean_lite(F.col(name))).withColumns({"anatomy": none, "category": F.lit(None).cast("string"), "modality": F.lit(None).cast("string"), "rest": F.col("clean"), "core": F.col("clean")})
    return D.decompose(rows.withColumn("clean", normalize(F.col(name), vocab)), "clean", vocab)


def taken_apart(rows: DataFrame, how: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """rows with the columns that how adds to a table of names, written down: each distinct name goes through it once."""
    with Steps(label) as steps:
        names = steps.keep(rows.select("name").distinct())
        n = names.count()
        parts = steps.keep(how(names.repartition(-(-n // NAMES) or 1, "name")).withColumnRenamed("name", "__name"))
        told = parts.hint("merge") if n > MANY else parts
        return materialize(rows.join(told, F.col("name").eqNullSafe(F.col("__name")), "left").drop("__name"), label)


def _kept(rows: DataFrame, vocab: Vocabulary | None, label: str) -> DataFrame:
    """prepared() rows, written down."""
    return taken_apart(rows, lambda names: prepared(names, vocab), label) if vocab else materialize(prepared(rows), label)


def _by_merge(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What keeps tables with as many rows as these from being broadcast, if there are many: the planner sees only what they take on disk."""
    many = rows.count() > MANY
    return lambda table: table.hint("merge") if many else table


def dedupe_first(targets: DataFrame, key: str = "clean", order: str = "idx") -> DataFrame:
    """One row of each key: the first in order."""
    return targets.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def exact_link(sources: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(q, idx): sources whose clean name a target has; of several targets the first."""
    first = targets.filter("clean <> ''").groupBy("clean", *by).agg(F.min("idx").alias("idx"))
    return sources.select("q", "clean", *by).join(first, ["clean", *by]).select("q", "idx")


def _tags(rows: DataFrame, tags: bool) -> list[tuple[str, Column]]:
    """(kind, array of probe strings), in probing order."""
    found = [("token", tokens(F.col("clean")))]
    if tags:
        one = lambda mark, c, keep: F.when(keep, F.array(F.concat(F.lit(mark), F.col(c)))).otherwise(F.array().cast("array<string>"))
        found += [
            ("anatomy", F.transform("anatomy", lambda a: F.concat(F.lit("\x01anat:"), a))),
            ("category", one("\x01cat:", "category", F.col("category").isNotNull())),
            ("modality", one("\x01mod:", "modality", F.col("modality").isNotNull())),
            ("core", one("\x01core:", "core", F.length("core") >= 3)),
        ]
    return found


def _within(token: Column, by: tuple[str, ...]) -> Column:
    """The token as one of its catalog."""
    return F.concat_ws("\x04", *(F.col(c).cast("string") for c in by), token) if by else token


def postings(targets: DataFrame, tags: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(token, idx), each once."""
    every = F.array_distinct(F.concat(*(a for _, a in _tags(targets, tags))))
    return targets.select("idx", *by, F.explode(every).alias("token")).select("idx", _within(F.col("token"), by).alias("token"))


def _weighed(probes: Column, weight: int, by: tuple[str, ...]) -> Column:
    return F.transform(probes, lambda t: F.struct(_within(t, by).alias("token"), F.lit(weight).alias("w")))


def candidates(sources: DataFrame, index: DataFrame, tags: bool = True, top: int = TOP, members: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(q, idx, weight, rank): the targets that share the most weight with each source; ties by first contact.

    members (idx, members): where index has one target for several alike, all that it stands for, in order.
    """
    weighed = F.concat(*(_weighed(a, WEIGHTS[kind], by) for kind, a in _tags(sources, tags)))
    probes = sources.select("q", F.posexplode(weighed).alias("pos", "p")).select("q", "pos", "p.token", "p.w")
    # a repeated token weighs as often as it stands, at its first place
    merged = probes.groupBy("q", "token").agg(F.sum("w").alias("w"), F.min("pos").alias("pos"))
    sizes = index.select("idx").distinct().withColumn("n", F.lit(1)) if members is None else members.select("idx", F.size("members").alias("n"))
    met = meet(merged, index, sizes, top)
    if members is not None:
        # a name counts if the names that come before it have too few targets
        named = met.join(members, "idx").withColumn("n", F.size("members"))
        upto = W.partitionBy("q").orderBy(F.desc("weight"), "pos").rangeBetween(W.unboundedPreceding, 0)
        before = F.sum("n").over(upto) - F.sum("n").over(W.partitionBy("q", "weight", "pos"))
        met = named.withColumn("before", before).filter(F.col("before") < top).select("q", "weight", "pos", F.explode("members").alias("idx"))
    order = W.partitionBy("q").orderBy(F.desc("weight"), "pos", "idx")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("q", "idx", "weight", "rank")


def distinct_names(rows: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of each clean name, the first in order."""
    first = rows.groupBy("clean", *by).agg(F.min(order).alias(order))
    return rows.join(first, ["clean", *by, order], "left_semi")


def members_of(targets: DataFrame, top: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """(idx, members): of each clean name the first target and the first ones that can count."""
    ranked = targets.withColumn("__n", F.row_number().over(W.partitionBy("clean", *by).orderBy("idx"))).filter(F.col("__n") <= top)
    return ranked.groupBy("clean", *by).agg(F.min("idx").alias("idx"), F.array_sort(F.collect_list("idx")).alias("members")).select("idx", "members")


def length_band(sources: DataFrame, targets: DataFrame, top: int = FALLBACK, band: float = BAND, by: tuple[str, ...] = ()) -> DataFrame:
    """(q, idx, rank): the first targets whose length differs by at most the band.

    Lengths are joined by equality: a source lists the lengths within its band, and of each length only its
    first `top` targets can be among the first of all.
    """
    n = F.length("clean")
    short = targets.select("idx", *by, n.alias("n")).withColumn("k", F.row_number().over(W.partitionBy("n", *by).orderBy("idx"))).filter(F.col("k") <= top).select("idx", "n", *by)
    near = sources.filter(n > 0).select("q", *by, F.explode(S.lengths_within(n, band)).alias("n")).join(short, ["n", *by])
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("idx"))).filter(F.col("rank") <= top).select("q", "idx", "rank")


def scored(pairs: DataFrame, sources: DataFrame, targets: DataFrame, vocab: Vocabulary | None, threshold: float, sequences: bool = True) -> DataFrame:
    """(q, idx, rank, score) of the pairs that pass the barriers and the length gate; cheap filters come before any Python."""
    parts = ["clean", "anatomy", "category", "modality", "rest", "core"]
    a = sources.select("q", *(F.col(c).alias(f"a_{c}") for c in parts))
    b = targets.select("idx", *(F.col(c).alias(f"b_{c}") for c in parts))
    c = lambda x: F.col(x)
    both = pairs.join(a, "q").join(b, "idx")
    status = D.anatomy_status(c("a_anatomy"), c("b_anatomy"), c("a_category"), c("b_category"))
    modality = D.modality_status(c("a_modality"), c("b_modality"), vocab or Vocabulary())
    both = both.withColumns({"status": status, "agree": modality}).filter((F.col("status") != "SEVERE_CONFLICT") & (F.col("agree") != "CONFLICT"))
    both = both.filter(S.length_gate(c("a_clean"), c("b_clean"), threshold))
    seq = S.sequence_ratio if sequences else lambda x, y: F.lit(0.0)  # noqa: ARG005, E731
    cores = (F.length("a_core") >= 3) & (F.length("b_core") >= 3)
    rests = (F.length("a_rest") > 0) & (F.length("b_rest") > 0)
    names = {"full": ("clean", 0.35), "tech": ("rest", 0.35), "core": ("core", 0.25)}
    both = both.withColumns({f"s_{k}": seq(c(f"a_{n}"), c(f"b_{n}")) for k, (n, _) in names.items()})
    both = both.withColumns({f"m_{k}": F.greatest(S.levenshtein_ratio(c(f"a_{n}"), c(f"b_{n}"), least), F.col(f"s_{k}")) for k, (n, least) in names.items()})
    both = both.filter(~cores | (F.col("m_core") >= 0.35))
    score = S.composite(F.col("status"), D.anatomy_factor(c("a_anatomy"), c("b_anatomy")), F.col("agree"), F.col("m_full"), F.when(rests, F.col("m_tech")).otherwise(F.col("m_full")), F.when(cores, F.col("m_core")).otherwise(F.lit(1.0)))
    return both.select("q", "idx", "rank", score.alias("score")).filter("score > 0")


def pick(pairs: DataFrame) -> DataFrame:
    """(q, idx, score): the first pair that is sure, by rank, else the best."""
    sure = F.col("score") >= SURE
    order = W.partitionBy("q").orderBy(F.desc(sure), F.when(sure, F.col("rank")).asc_nulls_last(), F.desc("score"), "rank")
    return pairs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("q", "idx", "score")


def link(sources: DataFrame, targets: DataFrame, vocab: Vocabulary | None = None, threshold: float = 0.7, tags: bool = True, sequences: bool = True) -> DataFrame:
    """(q, name, match_code, match_name, match_score): one row a source; unmatched is empty with score 0."""
    # each is read in several places: names are taken apart once
    return link_prepared(_kept(sources, vocab, "sources"), _kept(targets, vocab, "targets"), vocab, threshold, tags, sequences)


def link_prepared(src: DataFrame, tgt: DataFrame, vocab: Vocabulary | None = None, threshold: float = 0.7, tags: bool = True, sequences: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """link() of prepared sources and targets; with by, q and idx are unique over all catalogs."""
    tags = tags and vocab is not None
    each, any_target = _by_merge(src), _by_merge(tgt)
    src, tgt = each(src), any_target(tgt)
    exact = exact_link(src, tgt, by)
    left = src.join(exact, "q", "left_anti")
    asked, heads = distinct_names(left, "q", by), distinct_names(tgt, "idx", by)
    near = candidates(asked, postings(heads, tags, by), tags, members=members_of(tgt, by=by), by=by).select("q", "idx", "rank")
    alone = asked.join(near.select("q").distinct(), "q", "left_anti")
    # of targets alike the first has the best rank, and all have one score
    pairs = near.unionByName(length_band(alone, tgt, by=by)).join(heads.select("idx"), "idx", "left_semi")
    best = pick(scored(pairs, asked, heads, vocab, threshold, sequences)).filter(F.col("score") >= threshold)
    answered = asked.select("q", "clean", *by).join(best, "q").drop("q")
    found = exact.withColumn("score", F.lit(1.0)).unionByName(each(left.select("q", "clean", *by)).join(answered, ["clean", *by]).select("q", "idx", "score"))
    named = found.join(tgt.select("idx", F.col("code").alias("match_code"), F.col("name").alias("match_name")), "idx")
    return src.select("q", "name").join(named.drop("idx"), "q", "left").select("q", "name", F.coalesce("match_code", F.lit("")).alias("match_code"), F.coalesce("match_name", F.lit("")).alias("match_name"), F.coalesce(one_decimal(F.col("score")), F.lit(0.0)).alias("match_score"))


def link_lite(sources: DataFrame, targets: DataFrame, vocab: Vocabulary, threshold: float = 0.7, tags: bool = True) -> DataFrame:
    """The light profile: lite cleaning, targets distinct by clean name, weights of tokens, anatomy and category only, sequence ratios with their popularity heuristic, anatomy as the only barrier."""
    parts = lambda names: D.decompose(names.withColumn("clean", clean_lite(F.col("name"))), "clean", vocab)
    src, tgt = taken_apart(sources, parts, "sources"), materialize(dedupe_first(taken_apart(targets, parts, "targets")), "targets")
    each, any_target = _by_merge(src), _by_merge(tgt)
    src, tgt = each(src), any_target(tgt)
    exact = exact_link(src, tgt)
    left = src.join(exact, "q", "left_anti").filter("clean <> ''")
    asked = materialize(distinct_names(left, "q"), "asked")
    plain = {"modality": F.lit(None).cast("string"), "core": F.lit("")}
    near = candidates(asked.withColumns(plain), postings(tgt.withColumns(plain), tags), tags).select("q", "idx", "rank")
    pairs = near.unionByName(length_band(asked.join(near.select("q").distinct(), "q", "left_anti"), tgt))
    names = ["clean", "anatomy", "category", "rest"]
    both = pairs.join(asked.select("q", *(F.col(c).alias(f"a_{c}") for c in names)), "q").join(tgt.select("idx", *(F.col(c).alias(f"b_{c}") for c in names)), "idx")
    c = F.col
    none_a, none_b = F.size("a_anatomy") == 0, F.size("b_anatomy") == 0
    status = F.when(none_a | none_b, "GENERIC").when(F.arrays_overlap("a_anatomy", "b_anatomy"), "EXACT_MATCH").when(c("a_category") == c("b_category"), "SAME_ORGAN_SYSTEM").otherwise("SEVERE_CONFLICT")
    both = both.withColumn("status", status if tags else F.lit("GENERIC")).filter("status <> 'SEVERE_CONFLICT'")
    both = both.withColumns({"full": S.sequence_ratio_lite(c("a_clean"), c("b_clean")), "techs": S.sequence_ratio_lite(c("a_rest"), c("b_rest"))})
    tech = F.when((c("a_rest") != "") & (c("b_rest") != ""), c("techs")).otherwise(c("full"))
    factor = D.anatomy_factor(c("a_anatomy"), c("b_anatomy")) if tags else F.lit(1.0)
    best = pick(both.select("q", "idx", "rank", S.composite_lite(c("status"), factor, c("full"), tech).alias("score")).filter("score > 0")).filter(c("score") >= threshold)
    answered = each(left.select("q", "clean")).join(asked.select("clean", c("q").alias("__q")).join(best.withColumnRenamed("q", "__q"), "__q"), "clean").select("q", "idx", "score")
    named = exact.withColumn("score", F.lit(1.0)).unionByName(answered).join(tgt.select("idx", c("code").alias("match_code"), c("name").alias("match_name")), "idx")
    return sources.select("q", "name").join(named.drop("idx"), "q", "left").select("q", "name", F.coalesce("match_code", F.lit("")).alias("match_code"), F.coalesce("match_name", F.lit("")).alias("match_name"), F.coalesce(F.bround(c("score") * 100, 1), F.lit(0.0)).alias("match_score"))


def link_stacked(sources: DataFrame, targets: DataFrame, catalogs: list, vocab: Vocabulary | None = None, threshold: float = 0.7, sequences: bool = True) -> DataFrame:
    """Each source linked to each of the catalogs: (q, catalog, name, match_code, match_name, match_score).  targets: (catalog, idx, code, name).

    Names are taken apart once, and all catalogs share one candidate stage: tokens are those of a catalog.
    """
    by = ("catalog",)
    whole = _kept(sources, vocab, "sources")
    src = whole.withColumn("catalog", F.explode(F.array(*map(F.lit, catalogs)))).withColumn("q", F.struct("q", "catalog"))
    tgt = _kept(targets.withColumn("idx", F.struct("idx", "catalog")), vocab, "targets")
    linked = link_prepared(src, tgt, vocab, threshold, sequences=sequences, by=by)
    return linked.select("q.q", "q.catalog", "name", "match_code", "match_name", "match_score")


def link_catalogs(sources: DataFrame, first: DataFrame, second: DataFrame, vocab: Vocabulary | None = None, threshold: float = 0.7, sequences: bool = True) -> DataFrame:
    """Each source linked to two catalogs in one pass: q, name, code_1, name_1, score_1, code_2, name_2, score_2."""
    both = first.select(F.lit(1).alias("catalog"), "idx", "code", "name").unionByName(second.select(F.lit(2).alias("catalog"), "idx", "code", "name"))
    linked = link_stacked(sources, both, [1, 2], vocab, threshold, sequences)
    side = [F.max(F.when(F.col("catalog") == k, F.col(f"match_{c}"))).alias(f"{c}_{k}") for k in (1, 2) for c in ("code", "name", "score")]
    return linked.groupBy("q", "name").agg(*side)


def close_match(sources: DataFrame, targets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(q, match_code, match_name, match_score): the exact target, else the one with the highest sequence ratio from the threshold on, of equal ones the last by name; no barriers.

    Names are met by the characters that they must have in common.
    """
    src, tgt = materialize(sources.withColumn("clean", clean_lite(F.col("name"))), "sources"), materialize(dedupe_first(targets.withColumn("clean", clean_lite(F.col("name")))), "targets")
    exact = exact_link(src, tgt).withColumn("score", F.lit(1.0))
    left = src.join(exact, "q", "left_anti").filter("clean <> ''")
    asked = distinct_names(left, "q").select("q", F.col("clean").alias("wanted"))
    met = overlapping(asked, tgt.select("idx", F.col("clean").alias("text")), threshold).join(asked, "q").join(tgt.select("idx", "clean"), "idx")
    near = met.filter(distance_allows(F.col("clean"), F.col("wanted"), threshold)).withColumn("score", S.sequence_ratio_lite(F.col("clean"), F.col("wanted"))).filter(F.col("score") >= threshold)
    best = near.groupBy("wanted").agg(F.max(F.struct("score", "clean", "idx")).alias("b")).withColumn("score", S.sequence_ratio_lite(F.col("wanted"), F.col("b.clean")))
    best = best.filter(F.col("score") >= threshold).select(F.col("wanted").alias("clean"), "b.idx", "score")
    found = exact.unionByName(left.join(best, "clean").select("q", "idx", "score"))
    named = found.join(tgt.select("idx", F.col("code").alias("match_code"), F.col("name").alias("match_name")), "idx")
    return sources.select("q").join(named.drop("idx"), "q", "left").select("q", F.coalesce("match_code", F.lit("")).alias("match_code"), F.coalesce("match_name", F.lit("")).alias("match_name"), F.coalesce(F.bround(F.col("score") * 100, 1), F.lit(0.0)).alias("match_score"))


def best_exhaustive(sources: DataFrame, targets: DataFrame, vocab: Vocabulary | None = None, threshold: float = 0.7, sequences: bool = True) -> DataFrame:
    """(q, idx, score) of the best of all targets, whether they share a token or not.

    Each distinct name is compared once, and names meet by the lengths that the length gate lets pass.
    """
    src, tgt = _kept(sources, vocab, "sources"), _kept(targets, vocab, "targets")
    asked, heads = distinct_names(src, "q"), distinct_names(tgt, "idx")
    near = asked.select("q", F.explode(S.lengths_within(F.length("clean"), S.gate_band(threshold))).alias("n"))
    pairs = near.join(heads.select("idx", F.length("clean").alias("n"), F.col("idx").alias("rank")), "n").select("q", "idx", "rank")
    best = pick(scored(pairs, asked, heads, vocab, threshold, sequences))
    return src.select("q", "clean").join(asked.select("clean", F.col("q").alias("asked")), "clean").join(best.withColumnRenamed("q", "asked"), "asked").select("q", "idx", "score")


def with_locks(fresh: DataFrame, locked: DataFrame, code: str = "code", name: str = "name", order: str = "row_id") -> DataFrame:
    """fresh results, with those of locked rows in their place: found by code, or by name where there is none; of equal keys the last lock."""
    key = lambda: F.when(F.coalesce(F.col(code), F.lit("")) != "", F.concat(F.lit("code:"), F.col(code))).otherwise(F.concat(F.lit("name:"), F.coalesce(F.col(name), F.lit(""))))
    results = [c for c in fresh.columns if c not in (code, name, order)]
    held = locked.filter("is_locked").withColumn("__key", key())
    last = held.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(F.desc(order)))).filter("__n = 1").select("__key", F.lit(True).alias("__held"), *(F.col(c).alias(f"__{c}") for c in results))
    joined = fresh.withColumn("__key", key()).join(last, "__key", "left")
    return joined.select(order, code, name, *(F.when(F.col("__held"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in results), F.coalesce("__held", F.lit(False)).alias("is_locked"))


def run_shares(stats: DataFrame) -> DataFrame:
    """The statistics of a run with each count's percentage of all rows, to one decimal; 0 of no rows."""
    counts = [c for c in stats.columns if c != "total"]
    share = lambda c: F.when(F.col("total") > 0, F.bround(F.col(c) * 100 / F.col("total"), 1)).otherwise(0.0)
    return stats.select("total", *counts, *(share(c).alias(f"{c}_pct") for c in counts))


def run_stats(results: DataFrame) -> DataFrame:
    """One row: total, matched in either catalog (by code or name), in both, in none."""
    one = (F.col("code_1") != "") | (F.col("name_1") != "")
    two = (F.col("code_2") != "") | (F.col("name_2") != "")
    n = lambda c: F.count_if(c)
    return results.agg(F.count("*").alias("total"), n(one).alias("matched_1"), n(two).alias("matched_2"), n(one & two).alias("matched_both"), n(~one & ~two).alias("unmatched"))
