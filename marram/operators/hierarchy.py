"""Section hierarchy: nodes, expansion to sections, promotion, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.ranking import positions, top_k
from marram.functions.references import node_id, prefixes

KEY = ("reference_group_id", "guideline_id")


def memberships(refs: DataFrame) -> DataFrame:
    """node, depth, reference_id: every reference under each of its ancestor paths; without a hierarchy, under
    its guideline's root (depth 0)."""
    paths = F.when(F.size("hierarchy") > 0, prefixes(F.col("hierarchy"))).otherwise(F.array(F.expr("slice(hierarchy, 1, 0)")))
    each = refs.select("reference_id", *KEY, F.explode(paths).alias("path"))
    return each.select(node_id(*[F.col(k) for k in KEY], F.col("path")).alias("node"), F.size("path").alias("depth"), "reference_id")


def nodes(refs: DataFrame) -> DataFrame:
    """node, depth, parent, label, descendants: one row per node."""
    paths = F.when(F.size("hierarchy") > 0, prefixes(F.col("hierarchy"))).otherwise(F.array(F.expr("slice(hierarchy, 1, 0)")))
    each = refs.select("reference_id", *KEY, F.explode(paths).alias("path"))
    key = [F.col(k) for k in KEY]
    parent = F.when(F.size("path") > 1, node_id(*key, F.expr("slice(path, 1, size(path) - 1)")))
    last = F.try_element_at("path", F.lit(-1))
    label = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.nullif(last["heading_number"], F.lit("")), F.nullif(last["title"], F.lit("")))), F.lit("")), F.col("guideline_id").cast("string"))
    return each.groupBy(node_id(*key, F.col("path")).alias("node")).agg(F.max(F.size("path")).alias("depth"), F.max(parent).alias("parent"), F.max(label).alias("label"), F.count_distinct("reference_id").alias("descendants"))


def descendants(refs: DataFrame) -> DataFrame:
    """node, reference_id, place: every node's references in the hierarchy's order (A15), as rows: a node may have
    any share of all references."""
    order = F.array_join(F.transform("hierarchy", lambda h: F.lpad(h["order"].cast("string"), 20, "0")), "/")
    placed = memberships(refs).join(refs.select("reference_id", order.alias("_order")), "reference_id")
    return positions(placed, "node", ["_order", "reference_id"], "place").select("node", "reference_id", "place")


def target_depth(mode: str, levels_up: int = 1, heading_level: int | None = None) -> Column:
    """Depth of the section that a reference expands to, from its hierarchy."""
    n = F.size("hierarchy")
    if mode == "direct_parent":
        depth = n - 1
    elif mode == "levels_up":
        depth = n - levels_up
    elif mode == "heading_level":
        if heading_level is None:
            raise ValueError("heading_level needs a level")
        depth = F.coalesce(F.array_max(F.transform("hierarchy", lambda e, i: F.when(e["heading_level"] <= heading_level, i + 1))), F.lit(1))
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.least(n, F.greatest(F.lit(1), depth))


def targets(seeds: DataFrame, refs: DataFrame, mode: str, levels_up: int = 1, heading_level: int | None = None) -> DataFrame:
    """query_id, reference_id, seed_rank, target: the node that each seed expands to. seeds: query_id, reference_id, seed_rank."""
    path = F.slice("hierarchy", F.lit(1), target_depth(mode, levels_up, heading_level))
    target = node_id(*[F.col(k) for k in KEY], F.when(F.size("hierarchy") > 0, path).otherwise(F.col("hierarchy")))
    found = refs.withColumn("target", target).withColumn("path", path)
    return seeds.join(found.select("reference_id", "target", "path", *KEY), "reference_id")


def expand(seeds: DataFrame, refs: DataFrame, mode: str = "direct_parent", levels_up: int = 1, heading_level: int | None = None) -> DataFrame:
    """query_id, reference_id, first_seed: all references of the seeds' target sections (S7, J16), each once,
    with the rank of the first seed that brought it."""
    wanted = targets(seeds, refs, mode, levels_up, heading_level).groupBy("query_id", "target").agg(F.min("seed_rank").alias("seed_rank"))
    found = wanted.join(memberships(refs).withColumnRenamed("node", "target"), "target")
    return found.groupBy("query_id", "reference_id").agg(F.min("seed_rank").alias("first_seed"))


def promote(seeds: DataFrame, refs: DataFrame, ratio: float, mode: str = "direct_parent", levels_up: int = 1, heading_level: int | None = None) -> DataFrame:
    """query_id, reference_id, promoted: a target section of whose references at least ``ratio`` are seeds
    replaces them, unless an ancestor does (J17); seeds outside promoted sections stay (S8)."""
    at = targets(seeds, refs, mode, levels_up, heading_level)
    sizes = memberships(refs).groupBy(F.col("node").alias("target")).agg(F.count_distinct("reference_id").alias("size"))
    covered = at.groupBy("query_id", "target").agg(F.count_distinct("reference_id").alias("seeds"), F.any_value("path").alias("path"), *[F.any_value(k).alias(k) for k in KEY])
    full = covered.join(sizes, "target").where(F.col("seeds") / F.greatest(F.lit(1), F.col("size")) >= ratio)
    above = full.select("query_id", "target", F.explode(F.expr("transform(sequence(1, greatest(size(path) - 1, 1)), i -> slice(path, 1, i))")).alias("up"), F.size("path").alias("depth"), *KEY)
    above = above.where("size(up) < depth").select("query_id", "target", node_id(*[F.col(k) for k in KEY], F.col("up")).alias("ancestor"))
    under = above.join(full.select("query_id", F.col("target").alias("ancestor")), ["query_id", "ancestor"], "left_semi").select("query_id", "target").distinct()
    chosen = full.select("query_id", "target").join(under, ["query_id", "target"], "left_anti")
    members = chosen.join(memberships(refs).withColumnRenamed("node", "target"), "target").select("query_id", "reference_id").distinct()
    rest = seeds.select("query_id", "reference_id").distinct().join(members, ["query_id", "reference_id"], "left_anti")
    return members.withColumn("promoted", F.lit(True)).unionByName(rest.withColumn("promoted", F.lit(False)))


def neighborhood(seeds: DataFrame, refs: DataFrame, window: int = 1, direction: str = "both") -> DataFrame:
    """query_id, reference_id, place: seeds first, then each seed's preceding and succeeding references,
    each once (S10, J13). refs has pos, the place in its group and guideline by hierarchy order."""
    low, high = (-window if direction in ("preceding", "both") else 0), (window if direction in ("succeeding", "both") else 0)
    key = ["reference_group_id", "guideline_id", "pos"]
    at = seeds.join(refs.select("reference_id", *key), "reference_id")
    offsets = F.explode(F.array(*[F.lit(o) for o in range(low, high + 1)]))
    near = at.select("query_id", "seed_rank", *key[:2], "pos", offsets.alias("off")).withColumn("pos", F.col("pos") + F.col("off"))
    found = near.join(refs.select(*key, "reference_id"), key)
    place = F.struct(F.when(F.col("off") == 0, 0).otherwise(1).alias("kind"), "seed_rank", "off")
    first = found.groupBy("query_id", "reference_id").agg(F.min(place).alias("first"))
    return top_k(first, 2**31 - 1, [F.col("first"), F.col("reference_id")], ["query_id"], "place").select("query_id", "reference_id", "place")
