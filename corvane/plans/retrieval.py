"""Hybrid retrieval as one lazy plan: communities, entities, vectors, graph, ranking, context (R rows)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import graph as G
from corvane.operators import relational as R
from corvane.session import cut_lineage, release

# How much entity types and vocabularies count.
TYPE_WEIGHTS = {"drug": 1.0, "medication": 1.0, "disease": 0.9, "condition": 0.9, "symptom": 0.8, "adverse_event": 0.8, "procedure": 0.7, "measurement": 0.6, "population": 0.5, "temporal": 0.4}
VOCABULARY_WEIGHTS = {"rxnorm": 1.0, "snomed": 0.9, "umls": 0.8, "icd10": 0.7, "loinc": 0.6}
HIGH_VALUE_TYPES = ("drug", "medication", "disease", "condition", "adverse_event")
SAFETY_TERMS = frozenset({"adverse", "safety", "monitor", "effect", "event", "risk"})


@dataclass
class Limits:
    """Caps that are part of the results' meaning; each comes with a total order."""

    communities: int = 100
    top_communities: int = 10
    community_entities: int = 500
    entities: int = 200
    seeds: int = 20
    paths: int = 100
    hops: int = 2
    results: int = 50
    chunks: int = 10


@dataclass
class Context:
    """What a question may be narrowed to; nothing by default."""

    entity_types: list[str] = field(default_factory=list)
    vocabularies: list[str] = field(default_factory=list)
    least_confidence: float | None = None


def weight(values: dict[str, float], key: Column, default: float) -> Column:
    """A fixed weight by key."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), key), F.lit(default))


def entity_score(query: str, text: Column, kind: Column, confidence: Column, source: Column) -> Column:
    """M8: words of the question found in a mention, times its type's weight, its confidence and its vocabulary's weight."""
    low = F.lower(text)
    terms = [t for t in query.lower().split() if len(t) >= 3]
    one = lambda t: F.when(low == t, 2.0).when(F.startswith(low, F.lit(t)) | F.endswith(low, F.lit(t)), 1.5).when(F.contains(low, F.lit(t)), 1.0).otherwise(0.0)
    base = reduce(lambda a, b: a + b, map(one, terms), F.lit(0.0))
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.5).otherwise(confidence)
    known = F.when(F.coalesce(source, F.lit("")) != "", 1 + weight(VOCABULARY_WEIGHTS, F.lower(source), 0.5)).otherwise(1.0)
    return F.when(text.isNull(), 0.0).otherwise(base * weight(TYPE_WEIGHTS, kind, 0.3) * sure * known)


def community_scores(query: str, communities: DataFrame, members: DataFrame, entities: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``communities`` with ``relevance``, the best first.

    ``communities`` has cluster_key, level, title, occurrence; ``members`` cluster_key and the meta_graph_id of its nodes;
    ``entities`` entity_id, meta_graph_id, entity_text, entity_type, repeated rows or not. Communities of most occurrence are looked at, and in each the first entities by id that hold a term.
    """
    limits = limits or Limits()
    terms = T.search_terms(query)
    words = terms or query.lower().split()
    top = communities.orderBy(F.desc("occurrence"), "cluster_key").limit(limits.communities)
    low = F.lower("entity_text")
    long = [t for t in terms if len(t) > 2]
    # only rows that hold a term are sent to their graph, where repeated ones are folded
    e = entities.select("meta_graph_id", "entity_id", "entity_text", "entity_type").where("meta_graph_id is not null")
    e = (e.where(T.any_contains(low, long)) if long else e).repartition("meta_graph_id").distinct()
    # at most ``limits.communities`` rows
    inside = members.select("cluster_key", "meta_graph_id").join(F.broadcast(top.select("cluster_key")), "cluster_key").join(e, "meta_graph_id")
    w = Window.partitionBy("cluster_key").orderBy("entity_id")
    inside = inside.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limits.community_entities)
    exact = low.isin([t for t in words if len(t) > 2]) if any(len(t) > 2 for t in words) else F.lit(False)
    part = T.any_contains(low, [t for t in words if len(t) > 3])
    hit = exact | part
    points = F.when(exact, 2.0).when(part, 1.0).otherwise(0.0) + F.when(hit & F.col("entity_type").isin(*HIGH_VALUE_TYPES), 0.5).otherwise(0.0)
    per = inside.groupBy("cluster_key").agg(F.sum(points).alias("points"), F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    found = F.when(F.coalesce("hits", F.lit(0)) > 0, F.col("points") / F.col("n") + F.col("hits") * 0.01).otherwise(0.0)
    title = F.when(T.any_contains(F.lower(F.coalesce("title", F.lit(""))), terms), 0.3).otherwise(0.0)
    boost = 1.5 if SAFETY_TERMS & set(terms) else 1.0
    scored = top.join(per, "cluster_key", "left").withColumn("relevance", (title + 0.7 * found) * boost).drop("points", "n", "hits")
    return scored.where("relevance > 0").orderBy(F.desc("relevance"), "cluster_key").limit(limits.top_communities)


def entity_candidates(query: str, entities: DataFrame, relations: DataFrame, relevant: DataFrame | None, members: DataFrame | None = None, context: Context | None = None, limits: Limits | None = None) -> DataFrame:
    """The entities of relevant communities that hold one of the first two words or are normalised, scored.

    Those with most relations come first, then by type, confidence and id. Without ``relevant`` all entities are looked at.
    ``relations`` may be counted by end already. Repeated rows of entities are folded. The first ones are found by the columns that
    order them, and only these are read whole.
    """
    limits, context = limits or Limits(), context or Context()
    words = [t for t in query.lower().split() if len(t) > 2][:2] or [query.lower()]
    e = entities
    e = e.where(T.any_contains(F.lower(F.coalesce("entity_text", F.lit(""))), words) | F.col("normalized_id").isNotNull())
    if context.entity_types:
        e = e.where(F.col("entity_type").isin(context.entity_types))
    if context.vocabularies:
        e = e.where(F.lower("normalized_source").isin(context.vocabularies))
    if context.least_confidence is not None:
        e = e.where(F.col("confidence") >= context.least_confidence)
    key = ["entity_id", "meta_graph_id", "entity_type", "confidence"]
    if relevant is not None:
        # at most ``limits.top_communities`` rows
        own = members.select("cluster_key", "meta_graph_id").join(F.broadcast(relevant.select("cluster_key", "relevance")), "cluster_key")
        own = R.first_by(own, ["meta_graph_id"], [F.desc("relevance"), F.col("cluster_key")]).select("meta_graph_id", F.col("cluster_key").alias("community_id"))
        slim = e.select(key).where("meta_graph_id is not null").repartition("meta_graph_id").distinct().join(own, "meta_graph_id")
        about = relevant.select(F.col("cluster_key").alias("community_id"), F.col("relevance").alias("community_relevance"), F.col("title").alias("community_title"))
    else:
        slim = e.select(key).distinct().withColumn("community_id", F.lit(None).cast("string"))
        about = None
    group = F.when(F.col("entity_type").isin("drug", "medication", "adverse_event", "disease"), 1).when(F.col("entity_type").isin("procedure", "measurement"), 2).otherwise(3)
    top = R.relation_counts(slim, relations).orderBy(F.desc("relation_count"), group, F.desc_nulls_last("confidence"), "entity_id").limit(limits.entities)
    top = top.withColumns({"community_relevance": F.lit(None).cast("double"), "community_title": F.lit(None).cast("string")}) if about is None else top.join(F.broadcast(about), "community_id")
    # at most ``limits.entities`` rows are joined to the table
    same = reduce(lambda x, y: x & y, [F.col(f"w.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key])
    top = e.alias("w").join(F.broadcast(top.alias("t")), same).select("w.*", *(f"t.{c}" for c in top.columns if c not in key)).dropDuplicates(key)
    return top.withColumn("score", entity_score(query, F.col("entity_text"), F.col("entity_type"), F.col("confidence"), F.col("normalized_source")))


def nearest_chunks(vector: list[float], chunks: DataFrame, n: int, embedding: str = "embedding", id_col: str = "chunk_id") -> DataFrame:
    """The ``n`` chunks most similar to a vector, as ``(chunk_id, similarity, similarity_half)``; a top-k, no sort of all."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    scored = chunks.where(F.size(embedding) == len(vector)).select(id_col, V.cosine(F.col(embedding), q).alias("similarity")).where("similarity is not null")
    return scored.withColumn("similarity_half", 1 - (1 - F.col("similarity")) / 2).orderBy(F.desc("similarity"), id_col).limit(n)


def semantic_results(vector: list[float], chunks: DataFrame, n: int) -> DataFrame:
    """Nearest chunks as results of their own: a preview, type ``semantic_chunk``, the similarity as confidence."""
    near = nearest_chunks(vector, chunks.dropDuplicates(["chunk_id"]), n)
    own = near.join(chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "content"), "chunk_id")
    return own.select(F.col("chunk_id").alias("entity_id"), T.preview(F.col("content")).alias("entity_text"), F.lit("semantic_chunk").alias("entity_type"), F.col("similarity_half").alias("confidence"), F.lit(None).cast("string").alias("normalized_id"), F.lit("semantic_search").alias("normalized_source"), "chunk_id", F.lit(0).cast("long").alias("relation_count"))


def ranked(results: DataFrame) -> DataFrame:
    """Results by score plus 0.3 of their community's relevance."""
    final = F.col("score") + F.coalesce(F.col("community_relevance") * 0.3, F.lit(0.0))
    return results.withColumn("final_score", final).orderBy(F.desc("final_score"), "hops", "entity_id")


def retrieve(query: str, entities: DataFrame, relations: DataFrame, communities: DataFrame | None = None, members: DataFrame | None = None, chunks: DataFrame | None = None, context: Context | None = None, limits: Limits | None = None, dim: int | None = None, vector: list[float] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``(entity_id, entity_text, entity_type, chunk_id, …, score, final_score, hops, predicate_path)`` for a question.

    Repeated rows of ``entities`` and ``relations`` count once; ``communities`` and ``members`` are what ``community_tables`` gives,
    ``counts`` what ``end_counts`` gives of the relations, if it is at hand.

    Entities of relevant communities, nearest chunks where they are fewer than half of the results wanted and a vector is given,
    what relations reach from the first of them, ranked together.
    """
    limits = limits or Limits()
    one = entities
    relevant = cut_lineage(community_scores(query, communities, members, one, limits)) if communities is not None else None
    # what tables stored just before have shuffled goes before mentions are shuffled
    release(one.sparkSession, now=True)
    cols = ["entity_id", "entity_text", "entity_type", "confidence", "normalized_id", "normalized_source", "chunk_id", "relation_count"]
    found = entity_candidates(query, one, counts if counts is not None else relations.dropDuplicates(["relation_id"]), relevant, members, context, limits).select(*cols, "community_id", "community_title", "community_relevance", "score")
    if vector is not None and chunks is not None:
        extra = semantic_results(vector, chunks, limits.results)
        short = found.agg((F.count("*") < limits.results // 2).alias("_short"))
        extra = extra.crossJoin(F.broadcast(short)).where("_short").drop("_short")
        extra = extra.withColumn("score", entity_score(query, F.col("entity_text"), F.col("entity_type"), F.col("confidence"), F.col("normalized_source")))
        found = found.unionByName(extra, allowMissingColumns=True)
    # a few hundred rows that seeds, what was seen and the ranking all start from: written once
    found = cut_lineage(found).withColumns({"hops": F.lit(0), "predicate_path": F.lit(None).cast("string"), "evidence": F.lit(None).cast("string")})
    seeds = found.where("entity_type <> 'semantic_chunk'").orderBy(F.desc("score"), "entity_id").limit(limits.seeds).select("entity_id")
    seeds = cut_lineage(seeds)
    reached = G.first_reached(G.directed_paths(G.edge_table(G.relations_near(relations, seeds, limits.hops)), seeds, limits.hops), found.select("entity_id"), limits.paths)
    names = one.select(F.col("entity_id").alias("id"), "entity_text", "entity_type", "normalized_id", "chunk_id", F.lower(F.regexp_extract("normalized_id", r"^([^:]+):", 1)).alias("normalized_source"))
    # at most ``limits.paths`` rows decide which names are read on
    more = names.join(F.broadcast(reached), "id").dropDuplicates(["id"]).select(F.col("id").alias("entity_id"), "entity_text", "entity_type", "confidence", "normalized_id", F.when(F.col("normalized_source") != "", F.col("normalized_source")).alias("normalized_source"), "chunk_id", "score", "hops", "predicate_path", "evidence")
    return ranked(found.unionByName(more, allowMissingColumns=True)).limit(limits.results)


def context_chunks(results: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """The chunks with most results: ``(chunk_id, entities, similarity, position, content, document_id)``.

    The cut to ``n`` comes before chunks without a text are left out; similarity is the best result's score.
    """
    per = results.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.count("*").alias("entities"), F.max("final_score").alias("similarity"))
    top = per.orderBy(F.desc("entities"), F.desc("similarity"), "chunk_id").limit(n)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("entities"), F.desc("similarity"), "chunk_id")))
    # at most ``n`` rows decide which texts are read on
    return chunks.select("chunk_id", "content", "document_id").join(F.broadcast(placed), "chunk_id").dropDuplicates(["chunk_id"]).select(*placed.columns, "content", "document_id").orderBy("position")


def flag_notes(flags: Column) -> Column:
    """notes on a mention's context."""
    notes = (("is_negated", "denied"), ("is_historical", "in the past"), ("is_hypothetical", "only supposed"), ("is_uncertain", "not certain"), ("is_family", "of a relative"))
    return F.array_compact(F.array(*(F.when(flags[k], F.lit(v)) for k, v in notes)))


def prompt(query: str, picked: DataFrame, results: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """``(prompt)`` in one row: the texts of at most ten chunks, each with its first direct and graph results.

    ``picked`` is what ``context_chunks`` gives, so what is put together is bounded: 1500 characters and 15 results a chunk.
    """
    r = results.join(flags.select("entity_id", "context_flags").dropDuplicates(["entity_id"]), "entity_id", "left") if flags is not None else results.withColumn("context_flags", F.lit(None).cast("struct<is_negated:boolean,is_uncertain:boolean,is_historical:boolean,is_hypothetical:boolean,is_family:boolean>"))
    notes = flag_notes(F.col("context_flags"))
    name = F.concat("entity_text", F.lit(" ("), "entity_type", F.lit(")"), F.when(F.size(notes) > 0, F.concat(F.lit(" ["), F.array_join(notes, ", "), F.lit("]"))).otherwise(""))
    w = Window.partitionBy("chunk_id", F.col("hops") > 0).orderBy(F.desc("final_score"), "entity_id")
    r = r.join(picked.select("chunk_id"), "chunk_id", "left_semi").withColumn("_n", F.row_number().over(w)).withColumn("name", name)
    direct = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("hops") == 0) & (F.col("_n") <= 10), F.struct("_n", "name")))), lambda x: x["name"]), ", ")
    via = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("hops") > 0) & (F.col("_n") <= 5), F.struct("_n", F.concat("name", F.lit(" at distance "), F.col("hops").cast("string")).alias("name"))))), lambda x: x["name"]), ", ")
    lists = r.groupBy("chunk_id").agg(direct.alias("direct"), via.alias("via"))
    head = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] document "), F.col("document_id").cast("string"))
    found = F.when(F.col("direct") != "", F.concat(F.lit("Mentions found: "), "direct"))
    linked = F.when(F.col("via") != "", F.concat(F.lit("Reached over relations: "), "via"))
    block = F.concat_ws("\n", head, F.substring("content", 1, 1500), found, linked)
    parts = picked.join(lists, "chunk_id", "left").select("position", block.alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "b"))), lambda x: x["b"]), "\n\n")
    return parts.agg(F.concat(F.lit("Excerpts of study documents:\n\n"), body, F.lit(f"\n\nAnswer from these excerpts alone and give the number of the excerpt that each statement rests on.\n{query}")).alias("prompt"))


def global_context(results: DataFrame) -> DataFrame:
    """Counts of the results in one row; type counts as a map of the ten most frequent."""
    types = results.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(10).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_types"))
    sums = results.agg(F.count("*").alias("total_entities"), F.countDistinct("entity_type").alias("unique_entity_types"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"), F.countDistinct("community_id").alias("communities_involved"), F.count("normalized_id").alias("with_normalization"), F.count("community_id").alias("with_communities"), F.count_if(F.col("hops") > 0).alias("with_relations"))
    return sums.crossJoin(types)


def community_context(results: DataFrame) -> DataFrame:
    """``(community_id, title, total_results, average_relevance, entity_types)`` of the results' communities."""
    per = results.where(F.col("community_id").isNotNull()).groupBy("community_id", "entity_type").agg(F.count("*").alias("n"), F.sum("final_score").alias("s"), F.max("community_title").alias("t"))
    return per.groupBy("community_id").agg(F.max("t").alias("title"), F.sum("n").alias("total_results"), (F.sum("s") / F.sum("n")).alias("average_relevance"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_types"))


def answer(question: DataFrame, prompts: DataFrame, ask=None) -> DataFrame:
    """``question`` (one row) with the prompt, the model it is routed to, and the answer ``ask(model, prompt)`` gives, null without it."""
    row = question.crossJoin(prompts).withColumn("route", T.route(F.col("question"), F.lit(0), F.array("prompt")))
    if ask is None:
        return row.withColumn("answer", F.lit(None).cast("string"))
    call = F.udf(lambda m, p: ask(m, p), "string")  # one row: a model's answer
    return row.withColumn("answer", call(F.col("route.model"), F.col("prompt")))
