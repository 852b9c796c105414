"""Registered queries: files written from the tables and read back by the loaders, sinks and roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import chunking as C
from corvane.operators import sinks as K
from corvane.plans import evaluation as EV
from corvane.plans.queries_relational import _q, r6
from corvane.plans.views import Query, Tables
from corvane.session import shared_folder
from corvane.sources import artefacts as A
from corvane.sources import vocabularies as V


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files/{uuid.uuid4()}"


def _file(t: Tables, lines: DataFrame, order: list, header: str | None = None, **options: str) -> str:
    """One text file of the lines in order, as releases come; the columns but the order are tab-separated under a header."""
    path = _folder(t)
    out = lines.orderBy(*order).select("line").coalesce(1)
    if header is None:
        out.write.options(**options).text(path)
    else:
        out.select(F.split("line", "\t").alias("f")).select(*(F.get("f", i).alias(c) for i, c in enumerate(header.split()))).write.options(header=True, sep="\t", quote="", **options).csv(path)
    return path


def _rich(size: int, **fields: Column) -> Column:
    """A pipe-separated line of ``size`` fields, those named ``f<place>`` given."""
    at = {int(k[1:]): v.cast("string") for k, v in fields.items()}
    return F.concat_ws("|", *(at.get(i, F.lit("")) for i in range(size)), F.lit("")).alias("line")


def _concept_file(t: Tables) -> str:
    """Labels of the vocabulary entries: synonyms first, the display name as the preferred label."""
    names = t.nodes.select("code", "vocabulary", F.col("display_name").alias("label"), F.lit("Y").alias("pref"), F.lit(1).alias("o"))
    more = t.nodes.select("code", "vocabulary", F.explode("metadata.synonyms").alias("label"), F.lit("N").alias("pref"), F.lit(0).alias("o"))
    c = F.col
    lines = names.unionByName(more).select("code", "o", "label", _rich(18, f0=c("code"), f1=F.lit("ENG"), f6=c("pref"), f11=F.upper("vocabulary"), f12=F.lit("SY"), f13=c("code"), f14=c("label")))
    return _file(t, lines, ["code", "o", "label"])


def _relation_file(t: Tables) -> str:
    o = t.raw("orders")
    return _file(t, o.select("o_orderkey", _rich(16, f0=F.col("o_custkey"), f3=F.when(F.col("o_orderkey") % 3 > 0, "RO").otherwise(""), f4=F.col("o_orderkey"), f7=F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise(""), f10=F.lit("SRC"))), ["o_orderkey"])


_RELATION_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS source_code, CAST(o_orderkey AS VARCHAR) AS target_code, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) WHEN o_orderkey % 3 > 0 THEN 'RO' ELSE 'related_to' END AS predicate FROM orders"


def _kin(t: Tables) -> DataFrame:
    """Parts as concepts, even ones the parents of the next."""
    c, p = F.col, t.raw("part")
    concepts = _file(t, p.select("p_partkey", _rich(18, f0=c("p_partkey"), f1=F.lit("ENG"), f6=F.lit("Y"), f11=F.lit("RXNORM"), f12=F.lit("SCD"), f13=c("p_partkey"), f14=F.concat(F.lit("part "), c("p_partkey").cast("string")))), ["p_partkey"])
    relations = _file(t, p.where("p_partkey % 2 = 0").select("p_partkey", _rich(16, f0=c("p_partkey"), f3=F.lit("PAR"), f4=c("p_partkey") + 1)), ["p_partkey"])
    return V.rxnorm_nodes(t.spark, concepts, relations).select("code", "display_name", F.array_join("metadata.synonyms", "|").alias("synonyms"))


def _second_format(t: Tables) -> DataFrame:
    """Suppliers as concepts, every fifth inactive, odd ones without a full name."""
    s = t.raw("supplier")
    key = F.col("s_suppkey").cast("string")
    line = lambda *x: F.concat_ws("\t", *x).alias("line")
    concepts = _file(t, s.select("s_suppkey", line(key, F.lit("20250101"), F.when(F.col("s_suppkey") % 5 == 0, "0").otherwise("1"), F.lit("m"))), ["s_suppkey"], "id effectiveTime active moduleId")
    full = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit(0).alias("o"), line(F.lit("1"), F.lit("1"), key, F.lit("en"), F.lit(V.FULL_NAME), F.concat("s_name", F.lit(" (supplier)"))))
    other = s.select("s_suppkey", F.lit(1).alias("o"), line(F.lit("2"), F.lit("1"), key, F.lit("en"), F.lit(V.SYNONYM), "s_name"))
    later = s.select("s_suppkey", F.lit(2).alias("o"), line(F.lit("3"), F.lit("1"), key, F.lit("en"), F.lit(V.SYNONYM), F.lit("a later one")))
    texts = _file(t, full.unionByName(other).unionByName(later), ["s_suppkey", "o"], "id active conceptId languageCode typeId term")
    return V.snomed_nodes(t.spark, concepts, texts).select("code", "display_name", F.array_join("metadata.synonyms", "|").alias("synonyms"), "source_version")


def _second_edges(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, V.SNOMED_PREDICATES))
    s = t.raw("supplier")
    line = F.concat_ws("\t", F.lit("1"), F.when(F.col("s_suppkey") % 5 == 0, "0").otherwise("1"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.coalesce(F.try_element_at(kinds, (F.col("s_nationkey") % 9 + 1).cast("int")), F.lit("x"))).alias("line")
    path = _file(t, s.select("s_suppkey", line), ["s_suppkey"], "id active sourceId destinationId typeId")
    return V.snomed_edges(t.spark, path).select("source_code", "target_code", V.predicate_name(F.col("predicate")).alias("predicate"))


def _definitions(t: Tables) -> DataFrame:
    p, c = t.raw("part"), F.col
    twice = p.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("o"))
    lines = twice.select("p_partkey", "o", _rich(8, f0=c("p_partkey"), f4=F.lit("SRC"), f5=F.concat(F.lit("definition "), c("o").cast("string"), F.lit(" of "), c("p_partkey").cast("string"))))
    return V.definitions(t.spark, _file(t, lines, ["p_partkey", "o"], compression="gzip"))


def _discovered(t: Tables) -> DataFrame:
    n = t.raw("nation").join(F.broadcast(t.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _folder(t)
    n.select(F.col("r_name").alias("study"), F.col("n_name").alias("value")).coalesce(1).write.partitionBy("study").text(path)
    return A.discover_files(t.spark, path, ["txt"]).groupBy("study").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def _extractions(t: Tables) -> DataFrame:
    path = _folder(t)
    one = t.raw("nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("extractions"))).alias("value"))
    one.write.text(path)
    return A.read_extractions(t.spark, path, "key long, name string")


def _lines_by(t: Tables) -> DataFrame:
    path = _folder(t)
    K.write_json_by(t.raw("orders").select("o_orderstatus", "o_orderkey", "o_custkey"), path, "o_orderstatus")
    back = t.spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string").json(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"))


def _log(t: Tables) -> DataFrame:
    rows = K.log_rows(t.documents, "parse", F.when(F.col("text").isNull(), "failed").otherwise("parsed"), F.concat(F.lit("characters: "), F.coalesce(F.col("n_chars"), F.lit(0)).cast("string")), "doc_id")
    return rows.select("document_id", "stage", "status", "message", (F.col("created_at") <= F.current_timestamp()).alias("past"), F.col("log_id").isNotNull().alias("named"))


def _overall(t: Tables) -> DataFrame:
    e, r = EV.heuristic_entities(t.entities).select(F.col("f1").alias("entity_f1")), EV.heuristic_relations(t.relations).select(F.col("f1").alias("relation_f1"))
    # every side has one row
    parts = e.crossJoin(r).crossJoin(EV.clinical_relevance(t.entities)).crossJoin(EV.semantic_coherence(t.relations))
    parts = parts.withColumns({k: F.lit(v) for k, v in (("modularity", 0.5), ("community_quality", 0.25), ("mrr", 0.75), ("ndcg_5", 0.5))})
    return EV.overall_scores(parts).select(r6(F.col("overall_relevance"), "overall_relevance"), r6(F.col("compliance"), "compliance"))


def _overall_sql() -> str:
    from corvane.plans.queries_graph import EVALUATION

    own = {q.name: q.sql for q in EVALUATION}
    part = lambda name: f"({own[name]})"
    return f"SELECT round(0.4 * c.clinical_relevance + 0.3 * s.coherence + 0.3 * 0.25, 6) AS overall_relevance, round(0.25 * (0.5 * e.f1 + 0.5 * c.clinical_relevance + 0.5 * r.f1 + 0.5 * s.coherence + 0.3 * 0.5 + 0.7 * 0.25 + 0.4 * 0.75 + 0.6 * 0.5), 6) AS compliance FROM {part('heuristic_prf')} e, {part('clinical_relevance')} c, {part('heuristic_relation_prf')} r, {part('semantic_coherence')} s"


FILES = [
    _q("umls_release", "S17 V1 A34 N6", lambda t: V.umls_nodes(t.spark, _concept_file(t)).select("code", "display_name", F.array_join("metadata.synonyms", "|").alias("synonyms"), F.map_keys("metadata.source_codes")[0].alias("source")), "SELECT code, display_name, array_to_string(list_sort(list_distinct(list_append(metadata.synonyms, display_name))), '|') AS synonyms, upper(vocabulary) AS source FROM repo_nodes"),
    _q("umls_release_edges", "S17 V2", lambda t: V.umls_edges(t.spark, _relation_file(t)).select("source_code", "target_code", "predicate"), _RELATION_SQL),
    _q("rxnorm_release", "S18 V3 J21", _kin, "SELECT CAST(p_partkey AS VARCHAR) AS code, 'part ' || p_partkey AS display_name, array_to_string(list_sort(list(DISTINCT 'part ' || k)), '|') AS synonyms FROM (SELECT p_partkey, p_partkey AS k FROM part UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON b.p_partkey = CASE WHEN a.p_partkey % 2 = 0 THEN a.p_partkey + 1 ELSE a.p_partkey - 1 END) GROUP BY p_partkey"),
    _q("rxnorm_release_edges", "S18 V3", lambda t: V.rxnorm_edges(t.spark, _relation_file(t)).select("source_code", "target_code", "predicate"), _RELATION_SQL),
    _q("snomed_release", "S19 V4 A35", _second_format, "SELECT CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' (supplier)' ELSE s_name END AS display_name, s_name AS synonyms, '20250101' AS source_version FROM supplier WHERE s_suppkey % 5 <> 0"),
    _q("snomed_release_edges", "S19 V4 V8", _second_edges, "SELECT CAST(s_suppkey AS VARCHAR) AS source_code, CAST(s_nationkey AS VARCHAR) AS target_code, coalesce(list_extract(['is_a', 'has_finding_site', 'has_associated_morphology', 'has_causative_agent', 'due_to', 'has_method', 'has_procedure_site', 'has_active_ingredient'], s_nationkey % 9 + 1), 'related_to') AS predicate FROM supplier WHERE s_suppkey % 5 <> 0"),
    _q("release_definitions", "S20", _definitions, "SELECT CAST(p_partkey AS VARCHAR) AS code, 'definition 0 of ' || p_partkey AS definition FROM part"),
    _q("discovered_files", "S6", _discovered, "SELECT 'study=' || r_name AS study, 1 AS files, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    _q("extraction_files", "S24", _extractions, "SELECT n_nationkey AS key, n_name AS name FROM nation"),
    _q("lines_by_group", "K1", _lines_by, "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1"),
    _q("processing_log", "K18 T12", _log, "SELECT CAST(doc_id AS VARCHAR) AS document_id, 'parse' AS stage, CASE WHEN text IS NULL THEN 'failed' ELSE 'parsed' END AS status, 'characters: ' || coalesce(n_chars, 0) AS message, true AS past, true AS named FROM documents"),
    _q("overall_scores", "A32", _overall, _overall_sql()),
    _q("page_sizes", "M14", lambda t: t.raw("lineitem").select(C.desired_page_size(F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("size")).groupBy("size").agg(F.count("*").alias("n")), "SELECT least(100, greatest(l_linenumber, l_linenumber * CAST(l_quantity AS INTEGER))) AS size, count(*) AS n FROM lineitem GROUP BY 1"),
]


def all_queries() -> list[Query]:
    """Everything this module registers."""
    return FILES
