"""Evaluation metrics as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.retrieval import weight

# How much entity and relation types count in evaluation, and which vocabularies are authoritative.
ENTITY_WEIGHTS = {"medication": 1.0, "drug": 1.0, "adverse_event": 0.95, "condition": 0.9, "disease": 0.9, "procedure": 0.85, "measurement": 0.8, "organization": 0.7, "population": 0.75, "endpoint": 0.8, "temporal": 0.6}
RELATION_WEIGHTS = {"treats": 1.0, "causes": 0.95, "prevents": 0.9, "interacts_with": 0.85, "measured_by": 0.8, "associated_with": 0.75, "occurs_in": 0.7}
AUTHORITATIVE = ("umls", "snomed", "rxnorm", "icd10", "loinc")


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def entity_breakdown(entities: DataFrame) -> DataFrame:
    """``(entity_type, n, percentage, avg_confidence, normalization_rate, clinical_weight)``."""
    per = entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), (F.count("normalized_id") / F.count("*")).alias("normalization_rate"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("entity_type", "n", (F.col("n") / F.col("t") * 100).alias("percentage"), "avg_confidence", "normalization_rate", weight(ENTITY_WEIGHTS, F.col("entity_type"), 0.5).alias("clinical_weight"))


def relation_breakdown(relations: DataFrame) -> DataFrame:
    """``(predicate, n, percentage, avg_confidence, clinical_weight)``."""
    per = relations.groupBy("predicate").agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("predicate", "n", (F.col("n") / F.col("t") * 100).alias("percentage"), "avg_confidence", weight(RELATION_WEIGHTS, F.col("predicate"), 0.5).alias("clinical_weight"))


def clinical_relevance(entities: DataFrame) -> DataFrame:
    """``(clinical_relevance)``: the mean of type weight plus 0.2 for an authoritative vocabulary, times confidence."""
    boost = F.when(F.col("normalized_source").isin(*AUTHORITATIVE), 0.2).otherwise(0.0)
    one = (weight(ENTITY_WEIGHTS, F.col("entity_type"), 0.3) + boost) * F.coalesce("confidence", F.lit(0.0))
    return entities.agg(F.coalesce(F.avg(one), F.lit(0.0)).alias("clinical_relevance"))


def heuristic_entities(entities: DataFrame) -> DataFrame:
    """``(precision, recall, f1)`` estimated from confidence, normalisation, types and entities a chunk."""
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    p = 0.4 * mean(F.coalesce("confidence", F.lit(0.0)) > 0.7) + 0.3 * mean(F.col("normalized_id").isNotNull()) + 0.3 * mean(F.coalesce(F.col("entity_type").isin(*ENTITY_WEIGHTS), F.lit(False)))
    r = F.least(F.lit(1.0), F.count("*") / F.greatest(F.countDistinct("chunk_id"), F.lit(1)) / 10.0)
    return entities.agg(p.alias("precision"), r.alias("recall")).select("precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def connectivity(relations: DataFrame) -> DataFrame:
    """``(nodes, edges, connectivity)``: ten times the density of the directed graph, at most 1."""
    ends = relations.select(F.col("subject_entity_id").alias("id")).union(relations.select("object_entity_id")).where("id is not null")
    n, e = ends.agg(F.countDistinct("id").alias("nodes")), relations.agg(F.count("*").alias("edges"))
    v = F.col("nodes").cast("double")
    return n.crossJoin(e).select("nodes", "edges", F.when(v >= 2, F.least(F.lit(1.0), F.col("edges") / (v * (v - 1)) * 10)).otherwise(0.0).alias("connectivity"))


def semantic_coherence(relations: DataFrame) -> DataFrame:
    """``(coherence)``: 0.3 diversity, 0.4 confidence, 0.3 weight of the predicates in use."""
    per = relations.groupBy("predicate").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("c"))
    out = per.agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.avg(weight(RELATION_WEIGHTS, F.col("predicate"), 0.3)).alias("w"))
    mean = F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(0.0)
    score = 0.3 * (1 - F.least(F.col("types") / F.col("n"), F.lit(0.5))) + 0.4 * mean + 0.3 * F.col("w")
    return out.select(F.when(F.coalesce("n", F.lit(0)) > 0, score).otherwise(0.0).alias("coherence"))


def heuristic_relations(relations: DataFrame) -> DataFrame:
    """``(precision, recall, f1)`` from confidence, known predicates and connectivity."""
    p = 0.6 * F.coalesce(F.avg("confidence"), F.lit(0.0)) + 0.4 * F.coalesce(F.avg(F.coalesce(F.col("predicate").isin(*RELATION_WEIGHTS), F.lit(False)).cast("double")), F.lit(0.0))
    both = relations.agg(p.alias("precision")).crossJoin(connectivity(relations).select(F.col("connectivity").alias("recall")))
    return both.select("precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def community_statistics(communities: DataFrame, total_entities: int | Column) -> DataFrame:
    """Number, mean size, coverage, and the heuristics for modularity and silhouette, in one row.

    ``communities`` has the occurrence and either the nodes of each or their number ``n_nodes``.
    """
    size = (F.col("n_nodes") if "n_nodes" in communities.columns else F.size("nodes")).cast("double")
    intra = F.sum(size * (size - 1) / 2 * F.col("occurrence"))
    spread = 1 / (1 + F.var_pop(size) / F.avg(size))
    total = total_entities if isinstance(total_entities, Column) else F.lit(total_entities)
    return communities.agg(F.count("*").alias("communities"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average_size"), (F.coalesce(F.sum(size), F.lit(0.0)) / F.greatest(total, F.lit(1))).alias("coverage"), F.when(intra > 0, 1.0).otherwise(0.0).alias("modularity_heuristic"), F.when(F.count("*") >= 2, (spread + F.avg("occurrence")) / 2).otherwise(0.0).alias("silhouette_heuristic"))


def community_coherence(members: DataFrame, entities: DataFrame) -> DataFrame:
    """``(coherence)``: over communities, the mean of 0.6 share of the commonest type and 0.4 mean weight.

    ``members`` is ``(meta_graph_id, cluster)``. Types are counted first, so a large community isn't gathered.
    """
    per = members.join(entities, "meta_graph_id").groupBy("cluster", "entity_type").agg(F.count("*").alias("n"))
    w = weight(ENTITY_WEIGHTS, F.col("entity_type"), 0.3)
    one = per.groupBy("cluster").agg((0.6 * F.max("n") / F.sum("n") + 0.4 * F.sum(F.col("n") * w) / F.sum("n")).alias("c"))
    return one.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("coherence"))


def clustering_quality(members: DataFrame, entities: DataFrame) -> DataFrame:
    """``(quality)``: over communities, the mean of 0.4 type coherence, 0.3 normalised, 0.3 known types."""
    known = F.coalesce(F.col("normalized_source").isin(*AUTHORITATIVE), F.lit(False))
    per = members.join(entities, "meta_graph_id").groupBy("cluster", "entity_type").agg(F.count("*").alias("n"), F.count_if(known).alias("k"))
    clinical = F.sum(F.when(F.col("entity_type").isin(*ENTITY_WEIGHTS), F.col("n")).otherwise(0)) / F.sum("n")
    one = per.groupBy("cluster").agg((0.4 * (1 - F.least(F.count("entity_type") / F.sum("n"), F.lit(0.8))) + 0.3 * F.sum("k") / F.sum("n") + 0.3 * clinical).alias("q"))
    return one.agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias("quality"))


def frequency_correlation(entities: DataFrame) -> DataFrame:
    """``(correlation)`` of a type's frequency and weight, at least 0."""
    per = entities.groupBy("entity_type").agg(F.count("*").cast("double").alias("n")).withColumn("w", weight(ENTITY_WEIGHTS, F.col("entity_type"), 0.3))
    return per.agg(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.corr("n", "w"), F.lit(0.0)), F.lit(0.0))).alias("correlation"))


def ranking_metrics(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 5, 10), standard: bool = False) -> DataFrame:
    """``(query_id, mrr, ndcg_k…, precision_k…, recall_k…)`` of ranked items ``(query_id, item, rank)`` from rank 1.

    ``expected`` is ``(query_id, item)``. Rank i counts 1 / log2(i) from the third on and fully before; with ``standard`` it
    counts 1 / log2(i + 1). Queries without expected or without ranked items are left out.
    """
    e = expected.distinct()
    n = e.groupBy("query_id").agg(F.count("*").alias("expected"))
    hits = ranked.join(e.withColumn("hit", F.lit(1.0)), ["query_id", "item"], "left").na.fill(0.0, ["hit"])
    gain = lambda r: 1 / F.log2(r + 1) if standard else F.when(r <= 2, F.lit(1.0)).otherwise(1 / F.log2(r.cast("double")))
    within = lambda k: F.when(F.col("rank") <= k, F.col("hit")).otherwise(0.0)
    sums = hits.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("hit") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"), *(F.sum(within(k) * gain(F.col("rank"))).alias(f"dcg_{k}") for k in ks), *(F.sum(within(k)).alias(f"hits_{k}") for k in ks), *(F.count_if(F.col("rank") <= k).alias(f"seen_{k}") for k in ks))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("expected"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i))
    out = sums.join(n, "query_id")
    return out.select("query_id", "mrr", *((F.col(f"dcg_{k}") / ideal(k)).alias(f"ndcg_{k}") for k in ks), *((F.col(f"hits_{k}") / F.col(f"seen_{k}")).alias(f"precision_{k}") for k in ks), *((F.col(f"hits_{k}") / F.col("expected")).alias(f"recall_{k}") for k in ks))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """The means over queries, 0 without any."""
    return per_query.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in per_query.columns if c != "query_id"))


def match_scores(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """``(tp, fp, fn, precision, recall, f1)`` of distinct keys, texts compared in lower case."""
    norm = lambda d: d.select(*(F.lower(F.trim(F.col(k).cast("string"))).alias(k) for k in keys)).distinct()
    both = norm(found).withColumn("a", F.lit(1)).join(norm(truth).withColumn("b", F.lit(1)), keys, "full_outer")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return out.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def overall_scores(parts: DataFrame) -> DataFrame:
    """``(overall_relevance, compliance)``: weighted sums of the parts.

    ``parts`` has entity_f1, clinical_relevance, relation_f1, coherence, modularity, community_quality, mrr and ndcg_5.
    """
    c = F.col
    relevance = 0.4 * c("clinical_relevance") + 0.3 * c("coherence") + 0.3 * c("community_quality")
    four = (0.5 * c("entity_f1") + 0.5 * c("clinical_relevance"), 0.5 * c("relation_f1") + 0.5 * c("coherence"), 0.3 * c("modularity") + 0.7 * c("community_quality"), 0.4 * c("mrr") + 0.6 * c("ndcg_5"))
    return parts.select(relevance.alias("overall_relevance"), (0.25 * reduce(lambda x, y: x + y, four)).alias("compliance"))


def dataset_info(entities: DataFrame, relations: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """Counts of the tables and entities a chunk, in one row."""
    e = entities.agg(F.count("*").alias("total_entities"), F.countDistinct("chunk_id").alias("total_chunks"))
    r = relations.agg(F.count("*").alias("total_relations"))
    c = communities.agg(F.count("*").alias("total_communities")) if communities is not None else r.select(F.lit(0).cast("long").alias("total_communities"))
    return e.crossJoin(r).crossJoin(c).withColumn("entities_per_chunk", F.col("total_entities") / F.greatest("total_chunks", F.lit(1)))


def routing_statistics(routes: DataFrame) -> DataFrame:
    """``(total_queries, default_count, reasoning_count, …, avg_tokens)`` of routed questions ``(model, reason, estimated_tokens)``."""
    n = F.count("*")
    d, r = F.count_if(F.col("model") == "gpt-4.1"), F.count_if(F.col("model") == "gpt-5-mini")
    return routes.agg(n.alias("total_queries"), d.alias("default_count"), r.alias("reasoning_count"), (d / n * 100).alias("default_percentage"), (r / n * 100).alias("reasoning_percentage"), F.floor(F.sum("estimated_tokens") / n).alias("avg_tokens"))


def similarity_benchmark(pairs: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Least, mean and largest similarity of pairs and the share above each threshold."""
    s = F.col("similarity")
    return pairs.agg(F.count("*").alias("pairs"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("largest"), *(F.avg((s >= t).cast("double")).alias(f"share_{int(t * 100)}") for t in thresholds))


def rank_items(scored: DataFrame, query_col: str, score_col: str, item_col: str) -> DataFrame:
    """Ranks from 1 by score, ties by item."""
    w = Window.partitionBy(query_col).orderBy(F.desc(score_col), item_col)
    return scored.select(F.col(query_col).alias("query_id"), F.col(item_col).alias("item"), F.row_number().over(w).alias("rank"))
