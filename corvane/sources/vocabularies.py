"""Vocabulary releases: pipe-separated rich release files, tab-separated second-format files, literal lists.

Every loader gives nodes ``(repo_node_id, vocabulary, code, display_name, metadata, source_version, is_active)`` and
edges ``(repo_edge_id, vocabulary, source_code, target_code, predicate)``. Lines are ordered by file and place, which
decides which label wins; a file may be compressed with gzip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids

# Term types that make a label the preferred one, and identifiers of the second format.
UMLS_PREFERRED = ("PT", "PN", "MH")
RXNORM_PREFERRED = ("SCD", "SBD", "BPCK", "GPCK")
FULL_NAME, SYNONYM = "900000000000003001", "900000000000013009"
# Relationship types and their names.
SNOMED_PREDICATES = {"116680003": "is_a", "363698007": "has_finding_site", "116676008": "has_associated_morphology", "246075003": "has_causative_agent", "42752001": "due_to", "260686004": "has_method", "363704007": "has_procedure_site", "127489000": "has_active_ingredient"}
PARENT_RELATIONS = ("PAR", "CHD")


def read_rrf(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Rows ``(line, f)`` of a pipe-separated file: fields as an array, rows of fewer than ``least`` left out.

    Lines are read as text: labels hold quotes that a CSV reader would take for its own.
    """
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return text.select("line", F.split(F.regexp_replace("value", r"\|+$", ""), r"\|", -1).alias("f")).where(F.size("f") >= least)


def read_rf2(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file with a header; quotes are ordinary characters. Adds ``line``."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", enforceSchema=False).withColumn("line", F.monotonically_increasing_id())


def _labels(rows: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """``(code, display_name, synonyms)``: the last preferred label, else the first."""
    named = rows.select("line", F.get("f", 0).alias("code"), F.get("f", 6).alias("is_pref"), F.get("f", 11).alias("source"), F.get("f", 12).alias("term_type"), F.get("f", 13).alias("source_code"), F.get("f", 14).alias("label"), F.upper(F.get("f", 1)).alias("lang"))
    named = named.where((F.col("lang") == "ENG") & (F.col("code") != "") & (F.col("label") != ""))
    best = (F.col("is_pref") == "Y") | F.col("term_type").isin(*preferred)
    return named.withColumn("best", best)


def _preferred(named: DataFrame) -> DataFrame:
    last = F.max_by("label", F.when(F.col("best"), F.col("line")))
    return named.groupBy("code").agg(F.coalesce(F.when(F.max(F.col("best")), last), F.min_by("label", "line")).alias("display_name"), F.sort_array(F.collect_set("label")).alias("synonyms"))


def _nodes(df: DataFrame, vocabulary: str, uri: str, version: Column, metadata: Column, active: Column | None = None) -> DataFrame:
    v = F.lit(vocabulary)
    return df.select(ids.node_id(v, F.col("code")).alias("repo_node_id"), v.alias("vocabulary"), "code", "display_name", F.concat(F.lit(uri), F.col("code")).alias("canonical_uri"), metadata.alias("metadata"), version.cast("string").alias("source_version"), (active if active is not None else F.lit(True)).alias("is_active"))


def _edges(df: DataFrame, vocabulary: str) -> DataFrame:
    v = F.lit(vocabulary)
    return df.select(ids.edge_id(v, F.col("source_code"), F.col("predicate"), F.col("target_code")).alias("repo_edge_id"), v.alias("vocabulary"), "source_code", "target_code", "predicate", ids.node_id(v, F.col("source_code")).alias("source_repo_node_id"), ids.node_id(v, F.col("target_code")).alias("target_repo_node_id"))


def umls_nodes(spark: SparkSession, concepts: str, semantic_types: str | None = None, version: str | None = None) -> DataFrame:
    """V1: concepts in English with synonyms, semantic types and source codes."""
    named = _labels(read_rrf(spark, concepts, 15), UMLS_PREFERRED)
    codes = named.where(F.col("source_code") != "").groupBy("code", "source").agg(F.sort_array(F.collect_set("source_code")).alias("codes")).groupBy("code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "codes")))).alias("source_codes"))
    out = _preferred(named).join(codes, "code", "left")
    if semantic_types:
        kinds = read_rrf(spark, semantic_types, 4).select(F.get("f", 0).alias("code"), F.get("f", 3).alias("sty")).where("code <> '' and sty <> ''").groupBy("code").agg(F.sort_array(F.collect_set("sty")).alias("semantic_types"))
        out = out.join(kinds, "code", "left")
    else:
        out = out.withColumn("semantic_types", F.lit(None).cast("array<string>"))
    meta = F.struct("synonyms", F.coalesce("semantic_types", F.array().cast("array<string>")).alias("semantic_types"), "source_codes")
    return _nodes(out, "umls", "https://uts.nlm.nih.gov/umls/concept/", F.lit(version), meta)


def umls_edges(spark: SparkSession, relations: str) -> DataFrame:
    """V2: the relation's name, else its kind, else ``related_to``."""
    r = read_rrf(spark, relations, 11)
    full = lambda i: F.when(F.get("f", F.lit(i)) != "", F.get("f", F.lit(i)))
    return _edges(r.select(full(0).alias("source_code"), full(4).alias("target_code"), F.coalesce(full(7), full(3), F.lit("related_to")).alias("predicate")).where("source_code is not null and target_code is not null"), "umls")


def version_map(spark: SparkSession, sources: str) -> DataFrame:
    """V1: ``(source, version)`` of a release's source list."""
    r = read_rrf(spark, sources, 7)
    return r.select(F.upper(F.get("f", 3)).alias("source"), F.coalesce(F.when(F.get("f", 6) != "", F.get("f", 6)), F.get("f", 2)).alias("version")).where("source <> ''")


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """``(code, definition)``: the first definition of each concept."""
    r = read_rrf(spark, path, 6)
    return r.where((F.get("f", 0) != "") & (F.get("f", 5) != "")).groupBy(F.get("f", 0).alias("code")).agg(F.min_by(F.get("f", 5), "line").alias("definition"))


def database_nodes(spark: SparkSession, path: str, query: str, vocabulary: str, limit: int = 50_000, fallback: list[tuple[str, str, list[str], str]] = ()) -> DataFrame:
    """Nodes from a SQLite file's rows ``(code, name, semantic_type)``, at most ``limit``; ``fallback`` where it can't be read."""
    import sqlite3

    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            found = db.execute(f"SELECT * FROM ({query}) LIMIT {int(limit)}").fetchall()
        rows = [(vocabulary, str(c), str(n), [], t) for c, n, t in found]
    except sqlite3.Error:
        rows = [(vocabulary, c, n, list(s), t) for c, n, s, t in fallback]
    return literal_nodes(spark, rows)


def rxnorm_nodes(spark: SparkSession, concepts: str, relations: str | None = None, version: str | None = None) -> DataFrame:
    """Concepts with their own synonyms and those of parents and children."""
    out = _preferred(_labels(read_rrf(spark, concepts, 15), RXNORM_PREFERRED))
    if relations:
        r = read_rrf(spark, relations, 5).where(F.upper(F.get("f", 3)).isin(*PARENT_RELATIONS)).select(F.get("f", 0).alias("a"), F.get("f", 4).alias("b")).where("a <> '' and b <> ''")
        both = r.unionByName(r.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        kin = both.join(out.select(F.col("code").alias("b"), F.col("synonyms").alias("s")), "b").groupBy(F.col("a").alias("code")).agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("related"))
        out = out.join(kin, "code", "left").withColumn("synonyms", F.array_sort(F.array_distinct(F.concat("synonyms", F.coalesce("related", F.array().cast("array<string>"))))))
    return _nodes(out, "rxnorm", "https://rxnav.nlm.nih.gov/REST/rxcui/", F.lit(version), F.struct("synonyms"))


def rxnorm_edges(spark: SparkSession, relations: str) -> DataFrame:
    """V3: edges between concepts, named like those of V2."""
    r = read_rrf(spark, relations, 5)
    full = lambda i: F.when(F.get("f", F.lit(i)) != "", F.get("f", F.lit(i)))
    return _edges(r.select(full(0).alias("source_code"), full(4).alias("target_code"), F.coalesce(full(7), full(3), F.lit("related_to")).alias("predicate")).where("source_code is not null and target_code is not null"), "rxnorm")


def snomed_nodes(spark: SparkSession, concepts: str, descriptions: str) -> DataFrame:
    """Active concepts named by their full name, else a synonym; the first description of each type counts."""
    c = read_rf2(spark, concepts, "id string, effectiveTime string, active string, moduleId string")
    version = c.where("effectiveTime <> ''").agg(F.min_by("effectiveTime", "line").alias("version"))
    # one row per concept, the last of its lines
    c = c.where("id <> ''").groupBy("id").agg(F.max_by(F.struct("active", "moduleId"), "line").alias("c"))
    header = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(descriptions)
    d = header.select("conceptId", "typeId", "term").withColumn("line", F.monotonically_increasing_id()).where("conceptId <> ''")
    first = d.groupBy("conceptId", "typeId").agg(F.min_by("term", "line").alias("term"))
    by = first.groupBy("conceptId").agg(F.max(F.when(F.col("typeId") == FULL_NAME, F.col("term"))).alias("full"), F.max(F.when(F.col("typeId") == SYNONYM, F.col("term"))).alias("syn"), F.sort_array(F.collect_set(F.when(F.col("typeId") != FULL_NAME, F.col("term")))).alias("synonyms"))
    out = c.where("c.active = '1'").join(by, c["id"] == by["conceptId"]).crossJoin(F.broadcast(version))
    out = out.select(F.col("id").alias("code"), F.coalesce("full", "syn").alias("display_name"), "synonyms", F.col("c.moduleId").alias("module_id"), "version").where("display_name is not null")
    return _nodes(out, "snomed", "https://snomedbrowser.com/Codes/Details/", F.col("version"), F.struct("synonyms", "module_id"))


def snomed_edges(spark: SparkSession, relationships: str) -> DataFrame:
    """V4: active relationships; the predicate is the type's identifier."""
    r = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(relationships)
    return _edges(r.where("active = '1' and sourceId <> '' and destinationId <> ''").select(F.col("sourceId").alias("source_code"), F.col("destinationId").alias("target_code"), F.col("typeId").alias("predicate")), "snomed")


def predicate_name(type_id: Column) -> Column:
    """V8: a relationship type's name, ``related_to`` for unknown ones."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SNOMED_PREDICATES.items() for x in p)), type_id), F.lit("related_to"))


def literal_nodes(spark: SparkSession, rows: list[tuple[str, str, str, list[str], str]]) -> DataFrame:
    """Nodes from a list of ``(vocabulary, code, display_name, synonyms, semantic_type)``."""
    df = spark.createDataFrame(rows, "vocabulary string, code string, display_name string, synonyms array<string>, semantic_type string")
    return df.select(ids.node_id(F.col("vocabulary"), F.col("code")).alias("repo_node_id"), "vocabulary", "code", "display_name", F.struct("synonyms", "semantic_type").alias("metadata"), F.lit(True).alias("is_active"))


def synthetic_edges(nodes: DataFrame, group_cols: list[str], order_col: str, first: int, reach: int = 2, predicate: str = "related_to") -> DataFrame:
    """V7: each of the first ``first`` entries of a group to the next ``reach``; by lead, so no pairs are formed and dropped."""
    w = Window.partitionBy(*group_cols).orderBy(order_col)
    ranked = nodes.withColumn("_n", F.row_number().over(w))
    steps = F.array(*(F.lead(order_col, k).over(w) for k in range(1, reach + 1)))
    out = ranked.withColumn("_next", steps).where(F.col("_n") <= first).select(*group_cols, F.col(order_col).alias("source_code"), F.explode("_next").alias("target_code"))
    return out.where("target_code is not null").withColumn("predicate", F.lit(predicate))


def file_checksums(spark: SparkSession, root: str, bits: int = 256) -> DataFrame:
    """``(name, checksum)`` of the files of a release."""
    files = spark.read.format("binaryFile").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", bits).alias("checksum"))


def release_checksum(files: DataFrame) -> DataFrame:
    """V6: one checksum of a release from the sorted ``name=checksum`` lines of its files."""
    return files.agg(ids.release_checksum(F.collect_list(F.concat_ws("=", "name", "checksum"))).alias("checksum"))


def unpack_archive(archive: str, target: str, algorithm: str = "sha256") -> str:
    """Unpack a zip archive on the driver and return its digest; members outside the target are refused."""
    import hashlib
    import os
    import zipfile

    digest = hashlib.new(algorithm)
    with open(archive, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    with zipfile.ZipFile(archive) as z:
        for m in z.namelist():
            if os.path.commonpath([os.path.abspath(target), os.path.abspath(os.path.join(target, m))]) != os.path.abspath(target):
                raise ValueError(f"{m} lies outside the target")
        z.extractall(target)
    return digest.hexdigest()
