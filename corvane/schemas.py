"""Schemas of the tables of the data model, as DDL that ``spark.read.schema`` and ``createDataFrame`` take.

Ids are strings (UUIDs), semi-structured side-cars are JSON text or structs where their fields are fixed, vectors are
arrays of floats. ``VERSION`` goes up when a schema changes; ``operators.sinks.evolve`` brings older tables along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
FLAGS = "struct<is_negated: boolean, is_uncertain: boolean, is_historical: boolean, is_hypothetical: boolean, is_family: boolean>"
_TIMES = "created_at timestamp, updated_at timestamp"

TABLES = {
    "embeddings": f"embedding_id bigint, nct_id string, document_name string, chunk_id string, segment_index int, segment_count int, section string, token_count int, char_count int, start_word_index int, study_phase string, therapeutic_area string, document_type string, population string, endpoint_type string, page_reference int, artefact_type string, source_path string, parent_chunk_id string, metadata string, embedding array<float>, embedding_model string, quantization_encoding string, quantization_storage_dtype string, quantization_scale double, chunk_text string, {_TIMES}",
    "meta_graphs": f"meta_graph_id string, chunk_id string, nct_id string, document_id string, graph_type string, summary string, entity_count int, relation_count int, processing_metadata string, {_TIMES}",
    "meta_graph_assets": "asset_id string, meta_graph_id string, chunk_id string, asset_kind string, asset_ref string, caption string, page_number int, metadata string, created_at timestamp",
    "entities": f"entity_id string, meta_graph_id string, chunk_id string, source_chunk_id string, entity_text string, entity_type string, start_char int, end_char int, confidence double, normalized_id string, normalized_source string, repository_node_id string, asset_kind string, asset_ref string, context_flags {FLAGS}, normalization_data string, provenance string, cluster_data string, {_TIMES}",
    "relations": f"relation_id string, meta_graph_id string, chunk_id string, subject_entity_id string, predicate string, object_entity_id string, confidence double, evidence_span string, evidence_start_char int, evidence_end_char int, provenance string, {_TIMES}",
    "repo_nodes": f"repo_node_id string, vocabulary string, code string, display_name string, canonical_uri string, description string, metadata struct<synonyms: array<string>, semantic_types: array<string>, source_codes: map<string, array<string>>>, source_version string, ingested_at timestamp, valid_until timestamp, checksum string, is_active boolean, {_TIMES}",
    "repo_edges": f"repo_edge_id string, vocabulary string, source_code string, target_code string, source_repo_node_id string, target_repo_node_id string, predicate string, metadata string, {_TIMES}",
    "repo_entity_links": f"link_id string, meta_graph_id string, chunk_id string, entity_id string, repo_node_id string, vocabulary string, code string, match_confidence double, match_method string, normalization_metadata string, {_TIMES}",
    "tag_summaries": f"tag_summary_id string, meta_graph_id string, layer smallint, tag_key string, tag_label string, confidence double, embedding array<float>, evidence_ref string, metadata string, {_TIMES}",
    "processing_logs": "log_id string, document_id string, stage string, status string, message string, metadata string, created_at timestamp",
    "communities": "cluster_key string, level int, title string, nodes array<string>, edges array<struct<src: string, dst: string>>, chunk_ids array<string>, occurrence double, report_string string, report_json string, created_at timestamp",
    "vocabulary_cache": "query_hash string, original_text string, vocabulary string, concept_id string, concept_name string, semantic_type string, confidence_score double, definition string, synonyms array<string>, created_at timestamp",
    "chunk_entity_links": "embedding_chunk_id string, entity_id string, nct_id string, document_name string, match_confidence float, match_method string",
}
#: Columns that name a row of each table.
KEYS = {
    "embeddings": ["nct_id", "document_name", "chunk_id"], "meta_graphs": ["meta_graph_id"], "meta_graph_assets": ["asset_id"], "entities": ["entity_id"], "relations": ["relation_id"], "repo_nodes": ["vocabulary", "code"], "repo_edges": ["repo_edge_id"],
    "repo_entity_links": ["entity_id"], "tag_summaries": ["meta_graph_id", "layer", "tag_key"], "processing_logs": ["log_id"], "communities": ["cluster_key"], "vocabulary_cache": ["query_hash"], "chunk_entity_links": ["embedding_chunk_id", "entity_id"],
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty table of its schema."""
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns in order: cast where they can be, null where they are missing, others left out."""
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    simple = lambda f: f.dataType.typeName() not in ("array", "struct", "map")
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if simple(f) else F.col(f.name).cast(f.dataType)
    return df.select([(cast(f) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def broken_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that are null in part or stand more than once: what a primary key would refuse."""
    keys = KEYS[table]
    bad = df.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return bad.where((F.col("n") > 1) | missing)
