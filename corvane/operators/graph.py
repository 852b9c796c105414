"""Graphs as vertex and edge tables: traversal, components, communities (G rows)."""

from __future__ import annotations

import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.relational import class_links, endpoints, set_overlap
from corvane.session import cut_lineage, release, write_packed


def edge_table(relations: DataFrame) -> DataFrame:
    """``(edge_id, src, dst, predicate, confidence, evidence)`` of relations, one row per id, both ends known."""
    kept = relations.dropDuplicates(["relation_id"]).where(F.col("subject_entity_id").isNotNull() & F.col("object_entity_id").isNotNull())
    return kept.select(F.col("relation_id").alias("edge_id"), F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"), F.lower(F.trim("predicate")).alias("predicate"), "confidence", F.col("evidence_span").alias("evidence"))


def vertex_table(entities: DataFrame) -> DataFrame:
    """``(id, label, entity_text, entity_type, normalized_id)`` of entities, one row per id."""
    one = entities.dropDuplicates(["entity_id"])
    return one.select(F.col("entity_id").alias("id"), F.lit("Entity").alias("label"), "entity_text", "entity_type", "normalized_id")


def directed_paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """G1: ``(seed, id, hops, edge_ids, predicates, confidences, evidences)`` of paths along edges from each seed.

    A path uses no edge twice, though it may come back to a vertex. One equi-join each hop, no path is longer than ``hops``.
    """
    e = edges.select("edge_id", F.col("src").alias("_at"), F.col("dst").alias("_to"), "predicate", "confidence", "evidence")
    now = seeds.select(F.col(seeds.columns[0]).alias("seed")).where("seed is not null").distinct().select("seed", F.col("seed").alias("id"), F.array().cast("array<string>").alias("edge_ids"), F.array().cast("array<string>").alias("predicates"), F.array().cast("array<double>").alias("confidences"), F.array().cast("array<string>").alias("evidences"))
    found = None
    for h in range(1, hops + 1):
        step = now.join(e, now["id"] == e["_at"]).where(~F.array_contains("edge_ids", F.col("edge_id").cast("string")))
        now = step.select("seed", F.col("_to").alias("id"), F.array_append("edge_ids", F.col("edge_id").cast("string")).alias("edge_ids"), F.array_append("predicates", F.col("predicate")).alias("predicates"), F.array_append("confidences", F.col("confidence").cast("double")).alias("confidences"), F.array_append("evidences", F.col("evidence")).alias("evidences"))
        here = now.withColumn("hops", F.lit(h))
        found = here if found is None else found.unionByName(here)
    return found


def relations_near(relations: DataFrame, seeds: DataFrame, hops: int, few: int = 20_000) -> DataFrame:
    """The relations that ``directed_paths`` of at most ``hops`` from ``seeds`` can use, so that no others are shuffled for them.

    Where a hop starts is written and counted: up to ``few`` ids are broadcast, more are shuffled. Repeated rows stay.
    """
    at, found = seeds.select(F.col(seeds.columns[0]).alias("subject_entity_id")), None
    for _ in range(hops):
        at = cut_lineage(at.distinct())
        step = cut_lineage(relations.join(F.broadcast(at) if at.count() <= few else at, "subject_entity_id", "left_semi"))
        found = step if found is None else found.unionByName(step)
        at = step.select(F.col("object_entity_id").alias("subject_entity_id"))
    return found


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Distinct ``(seed, id, hops)`` of vertices reached in either direction by paths that visit no vertex twice; the seed itself at 0."""
    both = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).union(edges.select("dst", "src")).where("_at <> _to").distinct()
    now = seeds.select(F.col(seeds.columns[0]).alias("seed")).where("seed is not null").distinct().select("seed", F.col("seed").alias("id"), F.array(F.col("seed")).alias("path"))
    found = now.select("seed", "id", F.lit(0).alias("hops"))
    for h in range(1, hops + 1):
        now = now.join(both, now["id"] == both["_at"]).where(~F.array_contains("path", F.col("_to"))).select("seed", F.col("_to").alias("id"), F.array_append("path", F.col("_to")).alias("path"))
        found = found.unionByName(now.select("seed", "id", F.lit(h).alias("hops")))
    return found.distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 50) -> DataFrame:
    """``(id, component)``, the component being its smallest id.

    Alternating stars: every vertex links its larger neighbours, then its smaller ones, to the least of them, until
    nothing changes. Rounds grow with the logarithm of the longest path, the last is kept in the checkpoint folder, and
    only a count and a checksum come back to the driver. If links still change after ``most_rounds``, that is an error. Loops don't link; vertices without edges are their own component.
    """
    src, dst = edges.columns[0], edges.columns[1]
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    all_ids = e.select(F.col("u").alias("id")).union(e.select("v"))
    if vertices is not None:
        all_ids = all_ids.union(vertices.select(vertices.columns[0]))
    all_ids = all_ids.where("id is not null").distinct()
    folder = _Folder(e)
    links = folder.keep(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for done in range(most_rounds + 1):
        if done == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds; raise most_rounds")
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        old, links = links, folder.keep(small)
        folder.remove(old)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    links = cut_lineage(links)
    folder.remove()
    return all_ids.join(links.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(components: DataFrame) -> DataFrame:
    """The ids of the component of most ids; the smallest name of equals."""
    top = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(top.select("component")), "component", "left_semi")


def overlap_vertices(meta_graphs: DataFrame, entities: DataFrame) -> DataFrame:
    """``(meta_graph_id, chunk_id, nct_id, entity_count, description)`` of each chunk's graph with at least one entity.

    Entities are sent to their graph once, where repeated rows are folded and counted.
    """
    e = entities.select("meta_graph_id", "entity_id", "entity_text").where("meta_graph_id is not null").repartition("meta_graph_id").distinct()
    per = e.groupBy("meta_graph_id").agg(F.count("entity_id").alias("entity_count"), F.slice(F.sort_array(F.collect_list("entity_text")), 1, 10).alias("top"))
    v = meta_graphs.select("meta_graph_id", "chunk_id", "nct_id").dropDuplicates(["meta_graph_id"]).join(per, "meta_graph_id")
    return v.select("meta_graph_id", "chunk_id", "nct_id", "entity_count", F.concat(F.lit("Chunk "), F.coalesce("nct_id", F.lit("Unknown")), F.lit(": "), F.array_join("top", ", ")).alias("description"))


def overlap_edges(pairs: DataFrame) -> DataFrame:
    """Edges ``(src, dst, weight)`` of what ``set_overlap`` finds."""
    return pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("shared").cast("double").alias("weight"))


def overlap_graph(meta_graphs: DataFrame, entities: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(meta_graph_id, chunk_id, nct_id, entity_count, description)`` and edges ``(src, dst, weight)``.

    A vertex is a chunk's graph with at least one entity, an edge joins two that share ``least`` entity texts in lower case.
    """
    return overlap_vertices(meta_graphs, entities), overlap_edges(set_overlap(entities.select("meta_graph_id", F.lower("entity_text").alias("t")), "meta_graph_id", "t", least))


def overlap_components(members: DataFrame, classes: DataFrame, least: int = 5) -> DataFrame:
    """``(id, c, component)`` of the overlap graph without its edges, from sets and classes as ``overlap_classes`` gives them.

    Sets without an overlap have no row. A component is its smallest id.
    """
    comp = connected_components(cut_lineage(class_links(classes, least)))
    release(classes.sparkSession)
    root = comp.select(F.col("id").alias("c"), F.col("component").alias("root"))
    # equal sets overlap each other
    kept = classes.select("c", "n").join(root, "c", "left").where("root is not null or n > 1").select("c", F.coalesce("root", "c").alias("root"))
    first = members.groupBy("c").agg(F.min("id").alias("id"))
    named = kept.join(kept.join(first, "c").groupBy("root").agg(F.min("id").alias("component")), "root").select("c", "component")
    return members.join(named, "c").select("id", "c", "component")


# Fixed value: gains below it are rounding.
_LEAST_GAIN = 1e-12


def _order(seed: int, c: str) -> Column:
    """A number of a vertex by which equal gains are told apart: in the order of ids a path would settle end to end."""
    return F.xxhash64(F.lit(seed).cast("long"), c)


def _settle(ids: list, hashes: dict, edges: list[tuple], limit: int) -> dict:
    """``{id: community}`` of one component: the rounds of ``_settled`` in the memory of a task."""
    near, degree = defaultdict(list), defaultdict(float)
    for a, b, w in edges:
        near[a].append((b, w)), near[b].append((a, w))
        degree[a] += w
        degree[b] += w
    m2 = sum(degree.values())
    label = {x: x for x in ids}
    merging, stale = True, 0
    while stale < 2:
        total, size = defaultdict(float), defaultdict(int)
        for x, c in label.items():
            total[c] += degree[x]
            size[c] += 1
        links = defaultdict(float)
        for x in ids:
            for y, w in near[x]:
                links[(label[x] if merging else x), label[y]] += w
        offers = []
        for (x, c), w in links.items():
            own = x if merging else label[x]
            if own == c or size[c] + (size[own] if merging else 1) > limit:
                continue
            gain = w - total[c] * total[own] / m2 if merging else (w - links.get((x, own), 0.0)) - degree[x] * (total[c] - (total[own] - degree[x])) / m2
            if gain > _LEAST_GAIN and (x < c or not merging):
                offers.append((gain, hashes[x] ^ hashes[c], x, c, own))
        best = {}
        for o in offers:
            for c in o[3:]:
                best[c] = max(best.get(c, o), o)
        taken = [o for o in offers if best[o[3]] == o == best[o[4]]]
        if merging:
            into = {c: own for *_, c, own in taken}
            label = {x: into.get(c, c) for x, c in label.items()}
        else:
            label |= {x: c for _, _, x, c, _ in taken}
        # a kind of step goes on while it finds something; both finding nothing in turn is the end
        stale = 0 if taken else stale + 1
        merging = merging if taken else not merging
    return label


class _Folder:
    """A folder in the checkpoint folder for the tables of a loop of joins.

    A checkpoint goes on with the size the planner guessed, which joins multiply from round to round until the number
    itself is too large; a table read from files has the size of its files.
    """

    def __init__(self, df: DataFrame) -> None:
        cut_lineage(df.limit(0))  # makes the checkpoint folder where there is none
        self.spark, self.n = df.sparkSession, 0
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        write_packed(df, f"{self.path}/{self.n}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")
        kept._at = f"{self.path}/{self.n}"
        return kept

    def remove(self, *kept: DataFrame) -> None:
        """Delete tables that aren't read any more, or without any the folder."""
        sc = self.spark.sparkContext
        for path in [df._at for df in kept] or [self.path]:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _settled(vertices: DataFrame, e: DataFrame, limit: int, seed: int) -> DataFrame:
    """``(id, label)`` of components too large for a task: the same rounds as ``_settle``, as joins.

    In a round every pair of linked communities offers to merge, or every vertex to move to a linked community. An offer
    is taken if it gains most for both communities it touches; what is taken touches no community twice, so the gains
    add up and modularity only rises. Rounds end when nothing gains. ``vertices`` has id and component.
    """
    folder = _Folder(e)
    both = folder.keep(e.select("src", "dst", "weight").union(e.select("dst", "src", "weight")).join(vertices.select(F.col("id").alias("src"), "component"), "src"))
    degree = folder.keep(both.groupBy("component", F.col("src").alias("id")).agg(F.sum("weight").alias("d")))
    m2 = folder.keep(degree.groupBy("component").agg(F.sum("d").alias("m2")))
    state = folder.keep(degree.select("id", "d", F.col("id").alias("label")))
    merging, stale = True, 0
    while stale < 2:
        sums = folder.keep(state.groupBy("label").agg(F.sum("d").alias("total"), F.count("*").alias("size")))
        side = lambda c: sums.select(F.col("label").alias(c), F.col("total").alias(f"{c}_total"), F.col("size").alias(f"{c}_size"))  # noqa: B023, E731
        far = both.join(state.select(F.col("id").alias("dst"), F.col("label").alias("c")), "dst")
        if merging:
            links = far.join(state.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").where("x < c").groupBy("component", "x", "c").agg(F.sum("weight").alias("w"))
            links = links.withColumn("own", F.col("x")).join(m2, "component").join(side("own"), "own").join(side("c"), "c")
            offers = links.where(F.col("c_size") + F.col("own_size") <= limit).withColumn("gain", F.col("w") - F.col("c_total") * F.col("own_total") / F.col("m2"))
        else:
            links = far.groupBy("component", F.col("src").alias("x"), "c").agg(F.sum("weight").alias("w")).join(state.select(F.col("id").alias("x"), "d", F.col("label").alias("own")), "x")
            inner = links.where("c = own").select("x", F.col("w").alias("inner"))
            links = links.where("c <> own").join(inner, "x", "left").na.fill(0.0, ["inner"]).join(m2, "component").join(side("own"), "own").join(side("c"), "c")
            offers = links.where(F.col("c_size") + 1 <= limit).withColumn("gain", (F.col("w") - F.col("inner")) - F.col("d") * (F.col("c_total") - (F.col("own_total") - F.col("d"))) / F.col("m2"))
        offer = F.struct("gain", _order(seed, "x").bitwiseXOR(_order(seed, "c")).alias("h"), "x", "c", "own")
        offers = folder.keep(offers.where(F.col("gain") > _LEAST_GAIN).select(offer.alias("o")))
        best = folder.keep(offers.select("o", F.explode(F.array("o.c", "o.own")).alias("at")).groupBy("at").agg(F.max("o").alias("o")))
        taken = folder.keep(best.groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select("o.*"))
        if taken.limit(1).count():
            key, to = ("label", "own") if merging else ("id", "c")
            moved = taken.select(F.col("c" if merging else "x").alias(key), F.col(to).alias("_to"))
            old, state = state, folder.keep(state.join(moved, key, "left").select("id", "d", F.coalesce("_to", "label").alias("label")))
            folder.remove(old)
            stale = 0
        else:
            merging, stale = not merging, stale + 1
        folder.remove(sums, offers, best, taken)
    out = cut_lineage(state.select("id", "label"))
    folder.remove()
    return out


def communities(edges: DataFrame, max_size: int = 10, seed: int = 0xDEADBEEF, most_vertices: int = 20_000, components: DataFrame | None = None) -> DataFrame:
    """``(id, level, cluster)``: components at level 0, cut by modularity into communities of at most ``max_size`` at level 1.

    A component within ``max_size`` is one community. Larger ones are settled by merges and moves that gain most, each
    component by itself. One of at most ``most_vertices`` vertices is settled in a task, a larger one by joins, with the
    same offers taken in the same rounds, equal ones in an order by ``seed``: where the work is done doesn't change the communities (sums of weights that
    aren't whole numbers apart, which may differ in the last digit). ``components`` ``(id, component)`` may be known already.
    """
    comp = connected_components(edges) if components is None else components.select("id", "component")
    sized = cut_lineage(comp.join(comp.groupBy("component").agg(F.count("*").alias("n")), "component"))
    e = edges.select(F.col(edges.columns[0]).alias("src"), F.col(edges.columns[1]).alias("dst"), (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight")).where("src <> dst")
    inside = e.join(sized.where(F.col("n") > max_size).select(F.col("id").alias("src"), "component", "n"), "src")
    small = inside.where(F.col("n") <= most_vertices).withColumns({"hs": _order(seed, "src"), "hd": _order(seed, "dst")})

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = dict(zip(rows["src"], rows["hs"].tolist(), strict=True)) | dict(zip(rows["dst"], rows["hd"].tolist(), strict=True))
        label = _settle(sorted(hashes), hashes, sorted(zip(rows["src"], rows["dst"], rows["weight"], strict=True)), max_size)
        return pd.DataFrame({"id": label.keys(), "label": label.values()})

    kind = dict(edges.dtypes)[edges.columns[0]]
    cut = small.groupBy("component").applyInPandas(split, f"id {kind}, label {kind}")
    large = sized.where((F.col("n") > max_size) & (F.col("n") > most_vertices))
    if large.limit(1).count():
        cut = cut.unionByName(_settled(large, inside.where(F.col("n") > most_vertices).select("src", "dst", "weight"), max_size, seed))
    cut = cut_lineage(cut)
    named = cut.join(cut.groupBy("label").agg(F.min("id").alias("cluster")), "label").select("id", F.col("cluster").cast("string").alias("cluster"))
    top = sized.select("id", F.lit(0).alias("level"), F.col("component").cast("string").alias("cluster"))
    whole = sized.join(named, "id", "left").select("id", F.lit(1).alias("level"), F.coalesce("cluster", F.col("component").cast("string")).alias("cluster"))
    return top.unionByName(whole)


def community_tables(members: DataFrame, edges: DataFrame | None, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G9, M13, K11 as rows: ``(cluster_key, level, title, n_nodes, n_edges, n_chunks, occurrence)`` and ``(cluster_key, level, id)``.

    The same as ``community_schema`` without gathering a community in a row: however large one is, it is only counted.
    Without ``edges`` there is no ``n_edges``.
    """
    v = vertices.select(F.col(vertices.columns[0]).alias("id"), "chunk_id")
    rows = members.select(F.col("cluster").alias("cluster_key"), "level", "id")
    nodes = rows.join(v, "id", "left").groupBy("cluster_key", "level").agg(F.countDistinct("id").alias("n_nodes"), F.countDistinct(F.coalesce("chunk_id", F.col("id").cast("string"))).alias("n_chunks"))
    out = nodes
    if edges is not None:
        a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
        counted = rows.join(edges.select(F.col("src").alias("id"), a, b).union(edges.select("dst", a, b)), "id").select("cluster_key", "level", "a", "b").distinct().groupBy("cluster_key", "level").agg(F.count("*").alias("n_edges"))
        out = nodes.join(counted, ["cluster_key", "level"], "left").na.fill(0, ["n_edges"])
    largest = out.agg(F.max("n_chunks").alias("_m"))  # one row
    title = F.concat(F.lit("Clinical Community "), "cluster_key").alias("title")
    return out.crossJoin(F.broadcast(largest)).select("cluster_key", "level", title, "n_nodes", *(["n_edges"] if edges is not None else []), "n_chunks", (F.col("n_chunks") / F.col("_m")).alias("occurrence")), rows


def community_schema(members: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(cluster_key, level, title, nodes, edges, chunk_ids, occurrence)`` of communities ``(id, level, cluster)``.

    Edges are those that touch a member, also to others; occurrence is the number of chunks by the largest of all.
    """
    v = vertices.select(F.col(vertices.columns[0]).alias("id"), "chunk_id")
    nodes = members.join(v, "id", "left").groupBy("cluster", "level").agg(F.sort_array(F.collect_set("id")).alias("nodes"), F.sort_array(F.collect_set(F.coalesce("chunk_id", F.col("id").cast("string")))).alias("chunk_ids"))
    pair = F.struct(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    touching = members.join(edges.select(F.col("src").alias("id"), pair.alias("e")).union(edges.select("dst", pair)), "id").groupBy("cluster", "level").agg(F.sort_array(F.collect_set("e")).alias("edges"))
    out = nodes.join(touching, ["cluster", "level"], "left")
    largest = out.agg(F.max(F.size("chunk_ids")).alias("_m"))
    empty = F.array().cast(dict(touching.dtypes)["edges"])
    return out.crossJoin(F.broadcast(largest)).select(F.col("cluster").alias("cluster_key"), "level", F.concat(F.lit("Clinical Community "), "cluster").alias("title"), "nodes", F.coalesce("edges", empty).alias("edges"), "chunk_ids", (F.size("chunk_ids") / F.col("_m")).alias("occurrence"))


def stabilised(edges: DataFrame) -> DataFrame:
    """Edges with their ends in order, once each, sorted."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]).dropDuplicates(["src", "dst"]).orderBy("src", "dst")


def true_modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The modularity of a partition ``(id, cluster)`` of a weighted graph, in one row."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    a = members.select(F.col("id").alias("src"), F.col("cluster").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    inside = e.join(a, "src").join(b, "dst").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    ends = e.select(F.col("src").alias("id"), "w").union(e.select("dst", "w")).join(members.select("id", "cluster"), "id").groupBy("cluster").agg(F.sum("w").alias("d"))
    squares = ends.agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    return inside.crossJoin(squares).select(F.when(F.col("m") > 0, F.col("inside") / F.col("m") - F.col("s") / (4 * F.col("m") * F.col("m"))).otherwise(0.0).alias("modularity"))


def label_histogram(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, label, n)`` of vertices by label and edges by predicate."""
    return vertices.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("vertex").alias("kind"), "label", "n").unionByName(edges.groupBy(F.col("predicate").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def chunk_snapshot(entities: DataFrame, relations: DataFrame, chunk_id: str) -> tuple[DataFrame, DataFrame]:
    """The entities of a chunk by place and text, and its relations by confidence."""
    e = entities.where(F.col("chunk_id") == chunk_id).dropDuplicates(["entity_id"]).orderBy(F.asc_nulls_last("start_char"), "entity_text", "entity_id")
    r = relations.where(F.col("chunk_id") == chunk_id).dropDuplicates(["relation_id"]).orderBy(F.desc_nulls_last("confidence"), "relation_id")
    return e, r


def degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """G10 for entities with a relation: ``(entity_id, degree)``."""
    ends = endpoints(relations).groupBy("entity_id").agg(F.countDistinct("relation_id").alias("degree"))
    return entities.select("entity_id").distinct().join(ends, "entity_id")


def first_reached(paths: DataFrame, seen: DataFrame, n: int = 100) -> DataFrame:
    """What paths reach beyond ``seen``: one row per id with ``hops``, ``predicate_path``, ``confidence``, ``evidence``, ``score``.

    The first ``n`` paths in order of hops, seed and edges count, before repeated ids are left out.
    """
    ordered = paths.orderBy("hops", "seed", F.array_join("edge_ids", ","), "id").limit(n)
    mean = F.expr("aggregate(filter(confidences, c -> c is not null), 0D, (s, c) -> s + c) / nullif(size(filter(confidences, c -> c is not null)), 0)")
    text = F.when(F.size("predicates") > 0, F.array_join("predicates", " → ")).otherwise("related")
    evidence = F.substring(F.array_join(F.slice(F.filter("evidences", lambda x: x.isNotNull()), 1, 2), " | "), 1, 200)
    kept = ordered.withColumn("_o", F.struct("hops", "seed", F.array_join("edge_ids", ","))).join(seen.select(F.col(seen.columns[0]).alias("id")).distinct(), "id", "left_anti")
    w = Window.partitionBy("id").orderBy("_o")
    one = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    confidence = F.coalesce(mean, F.lit(0.5))
    return one.select("id", "seed", "hops", text.alias("predicate_path"), confidence.alias("confidence"), evidence.alias("evidence"), (F.greatest(F.lit(0.1), F.lit(0.5) / F.col("hops")) * confidence).alias("score"))
