"""Graph operators over edges(src, dst, type): cascades, neighbours, paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed as _checkpointed


def upstream(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where((F.col("type") == "upstream_of") & (F.col("dst") == entity)).orderBy("pos").select(F.col("src").alias("entity"))


def downstream(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where((F.col("type") == "upstream_of") & (F.col("src") == entity)).orderBy("pos").select(F.col("dst").alias("entity"))


def all_edges(companies: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the file, and those that companies imply by sectors and competitors."""
    own = companies.select(F.col("name").alias("src"), F.explode("sectors").alias("dst")).withColumn("type", F.lit("belongs_to"))
    rival = companies.select(F.col("name").alias("src"), F.explode("competes_with").alias("dst")).withColumn("type", F.lit("competes_with"))
    return edges.select("src", "dst", "type").unionByName(own).unionByName(rival)


def add_edge(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones; one of each (src, dst, type)."""
    return edges.unionByName(new).groupBy("src", "dst", "type").agg(F.min("label").alias("label"), F.min("pos").alias("pos"))


def sector_topics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """sector -> itself and the subsectors that belong to it."""
    own = nodes.where(F.col("type").isin("sector", "subsector", "theme")).select(F.col("name").alias("sector"), F.col("name").alias("topic"))
    return own.unionByName(edges.where(F.col("type") == "belongs_to").select(F.col("dst").alias("sector"), F.col("src").alias("topic"))).distinct()


def paths(edges: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Every simple path from ``start`` (entity) to a node without out-edges, of at most ``max_hops`` if that is given.

    A branch that comes back to a node it has visited gives no path.
    """
    hop = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    sinks = hop.select(F.col("_d").alias("last")).unionByName(start.select(F.col("entity").alias("last"))).distinct().join(hop.select(F.col("_s").alias("last")).distinct(), "last", "left_anti")
    live = start.select(F.array("entity").alias("path"), F.col("entity").alias("last"))
    found = live.join(sinks, "last", "left_semi")
    for _ in count() if max_hops is None else range(max_hops):
        live = _checkpointed(live.join(hop, F.col("last") == F.col("_s")).where(~F.array_contains("path", F.col("_d"))).select(F.array_append("path", F.col("_d")).alias("path"), F.col("_d").alias("last")))
        if live.isEmpty():
            break
        found = found.unionByName(live.join(sinks, "last", "left_semi"))
    return found.select("path", F.size("path").alias("n"))


def reach(edges: DataFrame, start: DataFrame, max_hops: int = 10) -> DataFrame:
    """entity -> least number of hops from any start, up to ``max_hops``; by frontier, so each node is expanded once."""
    hop = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    seen = _checkpointed(start.select("entity", F.lit(0).alias("hops")).distinct())
    frontier = seen
    for n in range(1, max_hops + 1):
        frontier = _checkpointed(frontier.join(hop, F.col("entity") == F.col("_s")).select(F.col("_d").alias("entity")).distinct().join(seen.select("entity"), "entity", "left_anti").withColumn("hops", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = _checkpointed(seen.unionByName(frontier))
    return seen


def find_path(edges: DataFrame, start: str | int, goal: str | int, max_hops: int = 10) -> DataFrame:
    """A shortest path as one row (path, hops); of several the least in order of its nodes; no row beyond ``max_hops``.

    Breadth first: each node is expanded once, with the least of its paths.
    """
    hop = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    kind = hop.schema["_s"].dataType
    seen = _checkpointed(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("entity"), F.array(F.lit(start).cast(kind)).alias("path")))
    frontier = seen
    for _ in range(max_hops):
        if not frontier.where(F.col("entity") == F.lit(goal)).isEmpty():
            break
        nearer = frontier.join(hop, F.col("entity") == F.col("_s")).select(F.col("_d").alias("entity"), F.array_append("path", F.col("_d")).alias("path"))
        frontier = _checkpointed(nearer.groupBy("entity").agg(F.min("path").alias("path")).join(seen.select("entity"), "entity", "left_anti"))
        if frontier.isEmpty():
            break
        seen = _checkpointed(seen.unionByName(frontier))
    return seen.where(F.col("entity") == F.lit(goal)).select("path", (F.size("path") - 1).alias("hops"))


def company_sectors(companies: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per company and sector of it: the sector's tier, and what is upstream and downstream of it, sorted."""
    member = companies.select(F.col("name").alias("company"), F.explode("sectors").alias("sector"))
    flow = edges.where("type = 'upstream_of'")
    up = flow.groupBy(F.col("dst").alias("sector")).agg(F.array_sort(F.collect_set("src")).alias("upstream"))
    down = flow.groupBy(F.col("src").alias("sector")).agg(F.array_sort(F.collect_set("dst")).alias("downstream"))
    none = F.array().cast("array<string>")
    info = nodes.select(F.col("name").alias("sector"), "tier").join(up, "sector", "left").join(down, "sector", "left")
    return member.join(info, "sector", "left").select("company", "sector", "tier", F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"))


def related(companies: DataFrame, nodes: DataFrame, entity: str, have: DataFrame) -> DataFrame:
    """Pages related to an entity: its sectors, their companies, its themes; or a sector's companies and parents; among ``have``."""
    own = companies.where(F.col("name") == entity)
    sectors = own.select(F.explode("sectors").alias("entity"))
    member = companies.select(F.explode("sectors").alias("s"), F.col("name").alias("entity"))
    peers = member.join(sectors.select(F.col("entity").alias("s")), "s").select("entity")
    themes = own.select(F.explode("themes").alias("entity"))
    inside = member.where(F.col("s") == entity).select("entity")
    parents = nodes.where(F.col("name") == entity).select(F.explode("parent_theme").alias("entity"))
    return sectors.union(peers).union(themes).union(inside).union(parents).where(F.col("entity") != entity).distinct().join(have.select("entity").distinct(), "entity", "left_semi")
