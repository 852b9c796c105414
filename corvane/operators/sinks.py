"""Writes with the meaning of inserts, upserts, updates and deletes on tables that are folders of files (K rows).

A folder can't be read and overwritten at once: the new rows are written beside it and put in its place. ``merge_rows``
and its kin are plain functions of DataFrames, so they can be tested and planned without a write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import cut_lineage


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key.

    Of repeated new keys the first by ``order`` wins, so the last one by a time or number is asked for with its descending
    order. Ties, and keys repeated without an order, go by the content of the whole row: the same rows win whenever a batch is
    run again. A null key is a key like any other.
    """
    whole = F.to_json(F.struct(*new.columns))
    w = Window.partitionBy(*keys).orderBy(*(order or []), whole.desc())
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    gone = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = reduce(lambda x, y: x & y, [old[k].eqNullSafe(gone[f"_k{i}"]) for i, k in enumerate(keys)])
    return old.join(gone, same, "left_anti").unionByName(last, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks; what is there stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update_rows(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with the columns' new values where ``changes`` has a row of its key and a value."""
    c = changes.select(F.col(key), *(F.col(x).alias(f"_{x}") for x in columns))
    return old.join(c, key, "left").withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop(*(f"_{x}" for x in columns))


def of_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """K2, M6: rows whose vector has the right length."""
    return df.where(F.size(column) == dim)


class _Files:
    """Renames and deletes in the file system of a path. A rename that isn't done is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be renamed to {target}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def replace_folder(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` beside ``path`` and put it in its place, so that ``df`` may read ``path`` itself.

    The old folder is kept under another name until the new one is there; if it can't be put there, the old one is put back
    and the error raised. A folder left aside by a run that died in between is taken for the table.
    """
    files = _Files(spark, path)
    fresh, aside = f"{path}.new", f"{path}.old"
    _restore(files, path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    there = files.exists(path)
    if there:
        files.move(path, aside)
    try:
        files.move(fresh, path)
    except OSError:
        if there:
            files.move(aside, path)
        raise
    files.delete(aside)


def _restore(files: _Files, path: str) -> None:
    """Put back a table that a run which died between two renames has left aside."""
    if files.exists(f"{path}.old"):
        if files.exists(path):
            files.delete(f"{path}.old")
        else:
            files.move(f"{path}.old", path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column] | None = None, partition_by: list[str] | None = None) -> None:
    """Merge rows into a folder; a folder that isn't there yet is made.

    With ``partition_by``, columns that are part of the key, only the partitions that new rows fall into are read and
    written again; the others aren't touched. Without it the whole table is.
    """
    if not set(partition_by or []) <= set(keys):
        raise ValueError("a row's partition must be told by its key")
    files = _Files(spark, path)
    _restore(files, path)
    if not files.exists(path):
        replace_folder(spark, merge_rows(new.limit(0), new, keys, order), path, partition_by)
        return
    old = spark.read.parquet(path)
    if not partition_by:
        replace_folder(spark, merge_rows(old, new, keys, order), path)
        return
    touched = new.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(partition_by))).distinct()
    same = reduce(lambda x, y: x & y, [old[c].eqNullSafe(touched[f"_p{i}"]) for i, c in enumerate(partition_by)])
    # written first, for what is read here is overwritten
    merged = cut_lineage(merge_rows(old.join(touched, same, "left_semi"), new, keys, order).select(*old.columns))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def guard_edges(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)``: edges whose ends are both known, and the others."""
    known = nodes.select(F.col(node).alias("_k")).distinct()
    flagged = edges.join(known.withColumnRenamed("_k", source).withColumn("_s", F.lit(True)), source, "left").join(known.withColumnRenamed("_k", target).withColumn("_t", F.lit(True)), target, "left")
    ok = F.coalesce(F.col("_s") & F.col("_t"), F.lit(False))
    return flagged.where(ok).select(*edges.columns), flagged.where(~ok).select(*edges.columns)


def write_json_by(df: DataFrame, path: str, *by: str) -> None:
    """K1: JSON lines in a folder per group."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def artefact_columns(parsed: DataFrame) -> DataFrame:
    """K3: parsed documents as one row per artefact: ``(path, artefact, body)``; images given as data URIs become bytes."""
    parts = F.array(*(F.struct(F.lit(k).alias("artefact"), F.encode(F.col(c), "utf-8").alias("body")) for k, c in (("text", "plain_text"), ("markdown", "markdown"), ("html", "html"))))
    return parsed.select("path", F.explode(parts).alias("a")).select("path", "a.*").where("body is not null")


def extraction_tables(extractions: DataFrame) -> dict[str, DataFrame]:
    """K5, K6: meta graphs, entities, links and relations of extraction results, ready to be written.

    A row of ``extractions`` has chunk_id, nct_id, document_id, ``entities`` array<struct<entity_id, text, type, start_char,
    end_char, confidence, normalized_id, normalized_source>> and ``relations`` array<struct<subject, predicate, object,
    confidence, evidence>>, ends given by text. A relation with an unknown end is dropped.
    """
    from corvane.functions import ids
    from corvane.functions import text as T
    from corvane.operators.relational import resolve_by_text

    base = extractions.withColumn("meta_graph_id", ids.stable_chunk_uuid(F.concat(F.lit("graph:"), "chunk_id")))
    e = base.select("meta_graph_id", "chunk_id", F.explode("entities").alias("e")).select("meta_graph_id", "chunk_id", F.col("e.entity_id").alias("entity_id"), F.col("e.text").alias("entity_text"), F.col("e.type").alias("entity_type"), "e.start_char", "e.end_char", "e.confidence", "e.normalized_id", "e.normalized_source")
    r = base.select("meta_graph_id", "chunk_id", F.posexplode("relations").alias("pos", "r")).select("meta_graph_id", "chunk_id", F.concat_ws(":", "chunk_id", F.col("pos").cast("string")).alias("relation_id"), F.col("r.subject").alias("subject"), F.col("r.predicate").alias("predicate"), F.col("r.object").alias("object"), F.col("r.confidence").alias("confidence"), F.col("r.evidence").alias("evidence_span"))
    r = resolve_by_text(r, e).drop("subject", "object")
    links = e.where("normalized_id is not null").select("meta_graph_id", "chunk_id", "entity_id", F.lower("normalized_source").alias("vocabulary"), T.vocabulary_code(F.col("normalized_id"), F.col("normalized_source")).alias("code"), F.col("confidence").alias("match_confidence"))
    links = links.withColumn("repo_node_id", ids.node_id(F.col("vocabulary"), F.col("code"))).where("code is not null")
    counts = r.groupBy("meta_graph_id").agg(F.count("*").alias("relation_count"))
    graphs = base.select("meta_graph_id", "chunk_id", "nct_id", "document_id", F.size("entities").alias("entity_count")).join(counts, "meta_graph_id", "left").na.fill(0, ["relation_count"])
    return {"meta_graphs": graphs, "entities": e, "links": links, "relations": r}


def delete_graph(relations: DataFrame, entities: DataFrame, meta_graphs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the meta graphs listed in ``gone``."""
    ids = gone.select("meta_graph_id").distinct()
    return tuple(t.join(ids, "meta_graph_id", "left_anti") for t in (relations, entities, meta_graphs))


def log_rows(df: DataFrame, stage: str, status: Column, message: Column, document: str | None = None) -> DataFrame:
    """Processing-log rows; the document may be null."""
    return df.select(F.expr("uuid()").alias("log_id"), (F.col(document).cast("string") if document else F.lit(None).cast("string")).alias("document_id"), F.lit(stage).alias("stage"), status.alias("status"), message.alias("message"), F.current_timestamp().alias("created_at"))


def evolve(df: DataFrame, renames: dict[str, str] | None = None, casts: dict[str, str] | None = None, additions: dict[str, str] | None = None) -> DataFrame:
    """A table under a new schema: columns renamed, cast where they can be (null elsewhere), added as null."""
    df = df.withColumnsRenamed(renames or {})
    df = df.withColumns({c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast(t) for c, t in (casts or {}).items()})
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (additions or {}).items() if c not in df.columns})
