"""Hierarchies: closures, counts of descendants, levels, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import cut as _cut

# Levels from the most special to the most general.
LEVELS = ("SUBINSTANCE", "INSTANCE", "L1_CATEGORY", "L2_CATEGORY", "L3_CATEGORY", "L4_CATEGORY", "L5_CATEGORY")
NO_LEVEL = {"NA": -1, "UNKNOWN": -2}
# Relationships that lead from a child to a parent.
RELATIONSHIPS = ("isa", "mapped_to", "classified_as", "has_mechanism_of_action", "has_target", "has_active_ingredient", "tradename_of", "has_structural_class", "has_phenotype")


def level_rank(level: Column) -> Column:
    return F.coalesce(*[F.when(level == v, F.lit(i)) for i, v in enumerate(LEVELS)], *[F.when(level == v, F.lit(i)) for v, i in NO_LEVEL.items()], F.lit(-2))


def next_level(level: Column) -> Column:
    """One level more general; the most general stays, and so do NA and UNKNOWN."""
    return F.coalesce(*[F.when(level == a, F.lit(b)) for a, b in zip(LEVELS, LEVELS[1:])], level)


def checked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges``, or an error if there is none or one names an id that isn't in ``nodes`` (id)."""
    if edges.isEmpty():
        raise ValueError("a hierarchy needs edges")
    ends = edges.select(F.col("head_id").alias("id")).union(edges.select("tail_id")).distinct()
    unknown = [r["id"] for r in ends.join(nodes.select("id"), "id", "left_anti").orderBy("id").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown ids in edges: {unknown}")
    return edges


def ancestors(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int = 5, relationships: tuple[str, ...] | None = None) -> DataFrame:
    """(node, ancestor, depth): the least depth at which each ancestor is reached, going up at most ``max_depth`` edges.

    ``edges``: head_id (parent) and tail_id (child), with ``relationships`` also relationship, and others than these aren't
    followed.  ``seeds`` (node): whose ancestors are wanted.  One join per level, distinct in between, so that cycles end.
    """
    if relationships is not None:
        edges = edges.filter(F.col("relationship").isin(list(relationships)))
    up = edges.select(F.col("tail_id").alias("_c"), F.col("head_id").alias("_p")).distinct()
    start = up if seeds is None else up.join(seeds.select(F.col("node").alias("_c")).distinct(), "_c", "left_semi")
    frontier = start.select(F.col("_c").alias("node"), F.col("_p").alias("ancestor"))
    levels = [frontier.withColumn("depth", F.lit(1))]
    for depth in range(2, max_depth + 1):  # a few joins of one plan
        frontier = frontier.join(up, frontier["ancestor"] == up["_c"]).select("node", F.col("_p").alias("ancestor")).distinct()
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.union, levels).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor) at any depth: levels are added until one has no new pair, so that cycles end too."""
    up = _cut(edges.select(F.col("tail_id").alias("_c"), F.col("head_id").alias("_p")).distinct())
    known = frontier = up.select(F.col("_c").alias("node"), F.col("_p").alias("ancestor"))
    while True:
        stepped = frontier.join(up, frontier["ancestor"] == up["_c"]).select("node", F.col("_p").alias("ancestor")).distinct()
        frontier = _cut(stepped.join(known, ["node", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.union(frontier)


def descendant_counts(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, count): a node's own count and those of its distinct descendants at any depth; nodes without counts have 0."""
    pairs = closure(edges).filter("node != ancestor").select(F.col("ancestor").alias("node"), F.col("node").alias("below")).distinct()
    nodes = edges.select(F.col("head_id").alias("node")).union(edges.select("tail_id")).union(counts.select("node")).distinct()
    every = pairs.union(nodes.select("node", F.col("node").alias("below")))
    own = counts.select(F.col("node").alias("below"), F.col("count").alias("_n"))
    return every.join(own, "below", "left").groupBy("node").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("count"))


def without_cycles(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Edges that lie on no cycle and lead from no cycle to another: what peeling leaves and roots take away is kept.

    Nodes without parents are peeled off round by round; edges between the nodes that remain in the end, after peeling
    childless ones as well, are on cycles or between them and go.  Rounds are half the longest path, and a graph that isn't done
    in ``max_rounds`` is an error.
    """
    rest = _cut(edges.select("head_id", "tail_id").distinct())
    before = -1
    for _ in range(max_rounds):
        if (now := rest.count()) == before:
            return edges.join(rest, ["head_id", "tail_id"], "left_anti")
        before = now
        rest = rest.join(rest.select(F.col("tail_id").alias("_t")).distinct(), F.col("head_id") == F.col("_t"), "left_semi")
        rest = rest.join(rest.select(F.col("head_id").alias("_h")).distinct(), F.col("tail_id") == F.col("_h"), "left_semi")
        rest = _cut(rest)
    raise RuntimeError(f"peeling did not end in {max_rounds} rounds")


def assigned_levels(edges: DataFrame, counts: DataFrame, thresholds: list[float], max_rounds: int = 15) -> DataFrame:
    """(node, level): levels rise from leaf to root wherever a node's share of the total count passes the next threshold.

    A leaf is INSTANCE.  Going up an edge, the level rises by one if the parent's share is above the threshold of the
    level it would get, else it stays; where paths disagree the higher level holds.  The frontier holds states (node, level).
    """
    total = counts.agg(F.sum("count").alias("_all"))
    up = edges.select(F.col("tail_id").alias("_c"), F.col("head_id").alias("_p")).distinct()
    share = counts.crossJoin(F.broadcast(total)).select(F.col("node").alias("_n"), (F.col("count") / F.col("_all")).alias("_share"))  # one row
    nodes = counts.select("node")
    leaves = nodes.join(edges.select(F.col("head_id").alias("node")), "node", "left_anti")
    steps = _cut(up.join(share, F.col("_p") == F.col("_n")).select("_c", "_p", "_share"))
    frontier = _cut(leaves.select("node", F.lit(1).alias("rank")))
    found = [frontier]
    limit = lambda rank: F.coalesce(*[F.when(rank == i, F.lit(t)) for i, t in enumerate(thresholds, 2)], F.lit(2.0))
    for _ in range(max_rounds):
        stepped = frontier.join(steps, F.col("node") == F.col("_c"))
        rank = F.when(F.col("_share") > limit(F.col("rank") + 1), F.col("rank") + 1).otherwise(F.col("rank"))
        frontier = stepped.select(F.col("_p").alias("node"), F.least(rank, F.lit(len(LEVELS) - 1)).alias("rank")).groupBy("node").agg(F.max("rank").alias("rank"))
        frontier = _cut(frontier)
        if frontier.isEmpty():
            break
        found.append(frontier)
    best = reduce(DataFrame.union, found).groupBy("node").agg(F.max("rank").alias("rank"))
    return best.select("node", F.element_at(F.array(*[F.lit(v) for v in LEVELS]), F.col("rank") + 1).alias("level"))


def chosen_rollup(edges: DataFrame, nodes: DataFrame, type_scores: DataFrame) -> DataFrame:
    """(node, rollup): the parent with the best score by type and level, or the node itself.

    ``nodes``: node, level, type; ``type_scores``: child_type, ancestor_type, score.  A parent below the child's level, or
    of a type that isn't wanted, is disqualified; score = ln(type + 1) + ln(level + 1), nearer levels higher, ties by id.
    """
    child = nodes.select(F.col("node").alias("tail_id"), level_rank(F.col("level")).alias("_cl"), F.col("type").alias("child_type"))
    parent = nodes.select(F.col("node").alias("head_id"), level_rank(F.col("level")).alias("_pl"), F.col("type").alias("ancestor_type"))
    pairs = edges.join(child, "tail_id").join(parent, "head_id").join(type_scores, ["child_type", "ancestor_type"])
    level_score = len(LEVELS) - (F.col("_pl") - F.col("_cl"))
    scored = pairs.filter(F.col("_pl") >= F.col("_cl")).withColumn("_s", F.log(F.col("score") + 1.0) + F.log(level_score + 1.0)).filter("_s > 0")
    rank = F.row_number().over(Window.partitionBy("tail_id").orderBy(F.round("_s", 9).desc(), "head_id"))
    best = scored.withColumn("_r", rank).filter("_r = 1").select(F.col("tail_id").alias("node"), "head_id")
    return nodes.select("node").join(best, "node", "left").select("node", F.coalesce("head_id", "node").alias("rollup"))


def two_hop_rollup(entities: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds instance_rollup (the parent's name) and category_rollup (the grandparent's), or the last name there is.

    ``parents``: child, parent, parent_name; of several parents that with the least id counts.
    """
    one = parents.groupBy("child").agg(F.min(F.struct("parent", "parent_name")).alias("_p")).select("child", F.col("_p.parent").alias("parent"), F.col("_p.parent_name").alias("parent_name"))
    first = one.select(F.col("child").alias("entity_id"), F.col("parent").alias("_p1"), F.col("parent_name").alias("_n1"))
    second = one.select(F.col("child").alias("_p1"), F.col("parent_name").alias("_n2"))
    joined = entities.join(first, "entity_id", "left").join(second, "_p1", "left")
    return joined.select("entity_id", "name", F.coalesce("_n1", "name").alias("instance_rollup"), F.coalesce("_n2", "_n1", "name").alias("category_rollup"))


def lineage_edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """(head_id, tail_id) of paths from root to leaf: each element's parent is the one before it."""
    steps = F.explode(F.transform(F.sequence(F.lit(2), F.size(path)), lambda i: F.struct(F.element_at(path, i - 1).alias("head_id"), F.element_at(path, i).alias("tail_id"))))
    return paths.filter(F.size(path) >= 2).select(steps.alias("_e")).select("_e.*").distinct()


def missing_edges(children: DataFrame, parents: DataFrame, edges: DataFrame, longest: int = 3) -> DataFrame:
    """(head_id, tail_id): children without any parent whose name has a parent's synonym among its word n-grams.

    ``children``: id, name; ``parents``: id, term.  An equi-join on n-grams, so that names that share none never meet.
    """
    alone = children.join(edges.select(F.col("tail_id").alias("id")).distinct(), "id", "left_anti")
    grams = alone.select(F.col("id").alias("tail_id"), F.explode(F.array_distinct(text.all_ngrams(text.tokens(F.col("name")), longest))).alias("term"))
    terms = parents.select(F.col("id").alias("head_id"), F.lower("term").alias("term"))
    return grams.join(terms, "term").filter("head_id != tail_id").select("head_id", "tail_id").distinct()


def shared_synonyms(synonyms: DataFrame) -> DataFrame:
    """(id, keep): ids that share a term with a smaller id, and the least such id."""
    least = synonyms.groupBy("term").agg(F.min("id").alias("_least"), F.countDistinct("id").alias("_n")).filter("_n > 1")
    return synonyms.join(least, "term").filter("id != _least").groupBy("id").agg(F.min("_least").alias("keep"))
