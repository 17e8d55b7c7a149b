"""All graph analytics of a case graph from one projection."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.operators import analytics, centrality, communities
from threadline.session import cut_lineage, discard


class CaseAnalytics:
    """The nine analytics of every case of a graph.

    Edges are projected to pairs once, and pairs and nodes are written once; each of the
    analytics reads them, is computed when it is first asked for, and then kept.

    ``edges``: case_id, src_id, tgt_id, evidence_id, rel_id.  ``nodes`` (case_id, id,
    entity_type) adds nodes without edges.  ``stamps`` (case_id, epoch) are the events of the
    time patterns, ``asked`` (case_id, source_id, target_id) the paths, by default between
    the two nodes of highest rank, ``egos`` (case_id, id) the centres of neighbourhoods, by
    default the sources of those paths.
    """

    def __init__(
        self, edges: DataFrame, nodes: DataFrame | None = None, stamps: DataFrame | None = None, asked: DataFrame | None = None,
        egos: DataFrame | None = None,
    ) -> None:
        self.pairs = cut_lineage(analytics.project_graph(edges))
        self.nodes = cut_lineage(nodes.select("case_id", "id", "entity_type")) if nodes is not None else None
        self._stamps, self._asked, self._egos = stamps, asked, egos

    @cached_property
    def frequency(self) -> DataFrame:
        return analytics.weighted_frequency(self.pairs)

    @cached_property
    def degree(self) -> DataFrame:
        return analytics.degree_centrality(self.pairs, self.nodes)

    @cached_property
    def betweenness(self) -> DataFrame:
        return cut_lineage(centrality.betweenness(self.pairs, self.nodes))

    @cached_property
    def pagerank(self) -> DataFrame:
        return cut_lineage(analytics.pagerank(self.pairs, self.nodes))

    @cached_property
    def weak(self) -> DataFrame:
        return cut_lineage(analytics.weak_components(self.pairs, self.nodes))

    @cached_property
    def strong(self) -> DataFrame:
        return cut_lineage(analytics.strong_components(self.pairs, self.nodes))

    @cached_property
    def communities(self) -> DataFrame:
        return cut_lineage(communities.communities(self.pairs, self.nodes))

    @cached_property
    def asked(self) -> DataFrame:
        return self._asked if self._asked is not None else cut_lineage(analytics.top_two(self.pagerank))

    @cached_property
    def paths(self) -> DataFrame:
        return cut_lineage(analytics.shortest_path_weighted(self.pairs, self.asked))

    @cached_property
    def neighbours(self) -> DataFrame:
        egos = self._egos if self._egos is not None else self.asked.select("case_id", F.col("source_id").alias("id")).distinct()
        return analytics.k_hop_neighbors(self.pairs, egos)

    @cached_property
    def patterns(self) -> DataFrame | None:
        return analytics.timestamp_patterns(self._stamps) if self._stamps is not None else None

    def all(self) -> dict[str, DataFrame | None]:
        """Every analytic by name."""
        names = ("frequency", "degree", "betweenness", "pagerank", "weak", "strong", "communities", "paths", "neighbours", "patterns")
        return {name: getattr(self, name) for name in names}

    def summary(self) -> DataFrame:
        """(case_id, unique_pairs, max_frequency, weak_components, strong_components, top_degree, top_betweenness) per case with edges."""
        weak = self.weak.groupBy("case_id").agg(F.count_distinct("component_id").alias("weak_components"))
        frequency = self.pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("unique_pairs"), F.max("weight").alias("max_frequency"))
        strong = self.strong.select("case_id", F.col("strongly_connected_count").alias("strong_components"))
        degree = self.degree.groupBy("case_id").agg(F.round(F.max("degree_centrality"), 6).alias("top_degree"))
        between = self.betweenness.groupBy("case_id").agg(F.round(F.max("betweenness"), 6).alias("top_betweenness"))
        found = frequency
        for part in (weak, strong, degree, between):
            found = found.join(part, "case_id")
        return found

    def close(self) -> None:
        """Delete what was written; results that were not read yet are lost."""
        kept = [self.pairs, self.nodes, *[self.__dict__.get(n) for n in ("betweenness", "pagerank", "weak", "strong", "communities", "paths")]]
        discard(*[frame for frame in kept if frame is not None])
