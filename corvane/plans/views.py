"""Clean views of the tables, as DataFrames and as the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import read_table, stored_once


@dataclass(frozen=True)
class Query:
    """A registered query: what it runs, the SQL twin if there is one, and the inventory rows it stands for."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    rows: str
    sql: str | None = None


class Tables:
    """The tables of a data directory, rows delivered twice kept once, uneven spellings levelled.

    The growing ones are cleaned once an application and stored; queries read what is stored, the columns they need.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        """A table as it is."""
        return read_table(self.spark, self.dir, name)

    def stored(self, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """A table made of raw ones, built at its first use."""
        return stored_once(self.spark, name, [f"{self.dir}/{s}.parquet" for s in sources], build)

    @property
    def entities(self) -> DataFrame:
        """Mentions, once each, types and vocabularies in lower case, blank ids as null."""
        return self._entities().drop("context_flags")

    @property
    def context_flags(self) -> DataFrame:
        """``(entity_id, context_flags)`` of mentions, once each."""
        return self._entities().select("entity_id", "context_flags")

    def _entities(self) -> DataFrame:
        return self.stored("entities", ["entities"], lambda: self._level(self.raw("entities").dropDuplicates(["entity_id"])))

    @staticmethod
    def _level(e: DataFrame) -> DataFrame:
        return e.select("entity_id", "meta_graph_id", "chunk_id", "source_chunk_id", "entity_text", F.lower("entity_type").alias("entity_type"), "start_char", "end_char", "confidence", F.nullif(F.trim("normalized_id"), F.lit("")).alias("normalized_id"), F.lower("normalized_source").alias("normalized_source"), "context_flags")

    @property
    def delivered(self) -> DataFrame:
        """Mentions as in ``entities``, but as they come, repeated rows and all: nothing is stored."""
        return self._level(self.raw("entities"))

    def mentions(self, *columns: str) -> DataFrame:
        """``entity_id`` and ``columns`` of ``entities`` where these are all a query needs: nothing is stored, and only they are shuffled.

        Rows go to their meta graph, where that is asked for, and repeated ones are folded there: a join on it shuffles them no more.
        """
        e = self.delivered.select("entity_id", *columns)
        return (e.where("meta_graph_id is not null").repartition("meta_graph_id") if "meta_graph_id" in columns else e).distinct()

    @property
    def relations(self) -> DataFrame:
        """Relations, once each, predicates in lower case."""

        def clean() -> DataFrame:
            r = self.raw("relations").dropDuplicates(["relation_id"])
            return r.select("relation_id", "meta_graph_id", "chunk_id", "subject_entity_id", F.lower(F.trim("predicate")).alias("predicate"), "object_entity_id", "confidence", "evidence_span")

        return self.stored("relations", ["relations"], clean)

    @property
    def meta_graphs(self) -> DataFrame:
        """Meta graphs, once each."""
        return self.stored("meta_graphs", ["meta_graphs"], lambda: self.raw("meta_graphs").dropDuplicates(["meta_graph_id"]).drop("created_at"))

    @property
    def chunks(self) -> DataFrame:
        """Chunks, once each, without embeddings."""
        return self.stored("chunks", ["chunks"], lambda: self.raw("chunks").drop("embedding", "created_at").dropDuplicates(["chunk_id"]))

    @property
    def documents(self) -> DataFrame:
        """Documents with study numbers in one spelling."""
        return self.raw("documents").withColumn("nct_id", F.upper(F.regexp_replace("nct_id", r"[^A-Za-z0-9]", "")))

    @property
    def nodes(self) -> DataFrame:
        """Vocabulary entries."""
        return self.raw("repo_nodes")


# The SQL of the views above.
E = "e AS (SELECT DISTINCT entity_id, meta_graph_id, chunk_id, source_chunk_id, entity_text, lower(entity_type) AS entity_type, start_char, end_char, confidence, nullif(trim(normalized_id), '') AS normalized_id, lower(normalized_source) AS normalized_source FROM entities)"
R = "r AS (SELECT DISTINCT relation_id, meta_graph_id, chunk_id, subject_entity_id, lower(trim(predicate)) AS predicate, object_entity_id, confidence, evidence_span FROM relations)"
M = "m AS (SELECT DISTINCT meta_graph_id, chunk_id, nct_id, document_id, entity_count, relation_count FROM meta_graphs)"
C = "c AS (SELECT DISTINCT chunk_id, document_id, chunk_index, section_title, content, page_number, parser, token_count FROM chunks)"
D = "d AS (SELECT * REPLACE (upper(regexp_replace(nct_id, '[^A-Za-z0-9]', '', 'g')) AS nct_id) FROM documents)"
ENDS = "ends AS (SELECT subject_entity_id AS entity_id, object_entity_id AS other_id, relation_id, predicate, confidence, evidence_span FROM r UNION ALL SELECT object_entity_id, subject_entity_id, relation_id, predicate, confidence, evidence_span FROM r WHERE subject_entity_id IS DISTINCT FROM object_entity_id)"


def sql(views: str, body: str) -> str:
    """A statement over views named by their letters, such as ``"ER"``."""
    known = {"E": E, "R": R, "M": M, "C": C, "D": D, "N": ENDS}
    return "WITH " + ", ".join(known[v] for v in views) + " " + body if views else body


def weights_sql(values: dict[str, float], key: str, default: float) -> str:
    """A CASE over fixed weights."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def any_sql(column: str, words, literal: bool = True) -> str:
    """Whether a column contains any of the words."""
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")" if words else "false"
