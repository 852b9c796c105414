"""Queries of the training-data problems over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import duplicates, mixing, packing, residue, scans, splitting, vectors, vocabulary
from corvane.llm.tokens import token_count
from corvane.session import cut_lineage, read_table


def settings(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The limits in retrieval_config, a table of fixed size."""
    return {r.config_key: r.config_value for r in read_table(spark, sf_dir, "retrieval_config").select("config_key", "config_value").collect()}


def _similar_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    share = settings(spark, sf_dir)["near_duplicate_min_share"]
    # TESTDATA.md compares runs of three words
    return duplicates.similar_texts(read_table(spark, sf_dir, "chunks"), "chunk_id", "content", share, words=3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that share most of their three-word runs."""
    pairs = duplicates.duplicate_pairs(*_similar_chunks(spark, sf_dir))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, group_id)`` of every chunk that takes part: its own group where it has no near-duplicate."""
    return duplicates.duplicate_groups(*_similar_chunks(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, class_id, copies, links)`` of every chunk that takes part: its class of equal run sets and the other classes linked to it."""
    return duplicates.duplicate_classes(*_similar_chunks(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


def p1_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(group_id, nct_id, chunks)``: the studies that each group of at least two chunks spans, in one spelling."""
    groups = cut_lineage(p1_groups(spark, sf_dir))
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    owner = read_table(spark, sf_dir, "chunks").select("chunk_id", F.col("document_id").alias("doc_id")).distinct()
    studies = read_table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("nct_id", r"[^A-Za-z0-9]", "")).alias("nct_id"))
    spans = groups.join(several, "group_id", "left_semi").join(owner, "chunk_id").join(studies, "doc_id")
    return spans.groupBy("group_id", "nct_id").agg(F.countDistinct("chunk_id").alias("chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the text of an oversized chunk itself ends a unit."""
    limit = settings(spark, sf_dir)
    return splitting.unit_ends(read_table(spark, sf_dir, "chunks"), "chunk_id", "content", int(limit["chunk_limit_tokens"]))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered pieces of the oversized chunks."""
    limit = settings(spark, sf_dir)
    return splitting.split_oversized(read_table(spark, sf_dir, "chunks"), "chunk_id", "document_id", "chunk_index", "content", int(limit["chunk_limit_tokens"]), int(limit["chunk_overlap_tokens"]))


def p2_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new places of all chunks of documents in which one was split."""
    return splitting.new_indexes(read_table(spark, sf_dir, "chunks"), p2_pieces(spark, sf_dir), "chunk_id", "document_id", "chunk_index")


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, tokens, within_limit, overlaps)`` of the split chunks: tokens counted over the pieces, each token once, and whether the limits hold."""
    limit, overlap = (int(settings(spark, sf_dir)[k]) for k in ("chunk_limit_tokens", "chunk_overlap_tokens"))
    shared = F.when(F.col("piece") > 0, overlap).otherwise(0)
    parts = p2_pieces(spark, sf_dir).withColumn("counted", token_count(F.col("content")))
    return parts.groupBy("chunk_id").agg((F.sum(F.col("counted") - shared)).alias("tokens"), (F.max("counted") <= limit).alias("within_limit"), (F.min(F.col("counted") - shared) > 0).alias("overlaps"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of at least the least cosine, one among the other's nearest."""
    limit = settings(spark, sf_dir)
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "embedding")
    near = vectors.nearest_vectors(chunks, "chunk_id", "embedding", int(limit["vector_neighbors_k"]), 128, limit["vector_min_cosine"], recall=0.995)
    return vectors.neighbor_pairs(near)


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other chunks of every chunk with a usable embedding."""
    limit = settings(spark, sf_dir)
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "embedding")
    near = vectors.nearest_vectors(chunks, "chunk_id", "embedding", int(limit["vector_neighbors_k"]), 128, recall=0.93)
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbor_id").alias("neighbor_chunk_id"), F.round("cosine", 4).alias("cosine"), "rank")


def _unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("normalized_id")
    return read_table(spark, sf_dir, "entities").where(ids.isNull() | ~ids.rlike(r"\S")).select("entity_id", "entity_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary entry of every mention that has none yet."""
    mentions, nodes = _unmapped(spark, sf_dir), read_table(spark, sf_dir, "repo_nodes").withColumn("synonyms", F.col("metadata.synonyms"))
    mapped = vocabulary.map_values(mentions, "entity_text", nodes, ["vocabulary", "code"], "display_name", "synonyms")
    return vocabulary.map_mentions(mentions, "entity_id", "entity_text", mapped, ["vocabulary", "code"])


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks")
    pages = chunks.where(F.col("parser") == "ocr").select("document_id", "chunk_id", "chunk_index", "page_number", "content")
    clean = chunks.where((F.col("parser") != "ocr") & F.col("content").isNotNull()).select(F.col("content").alias("text"))
    return scans.inspect_pages(pages, clean, "document_id", "chunk_id", "chunk_index", "page_number", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned pages that are furniture, end in a broken word, or hold misread letters."""
    return scans.line_kinds(_inspected(spark, sf_dir)).select(F.col("id").alias("chunk_id"), "line_no", "kind").distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages of each document as continuous paragraphs."""
    return scans.continuous_text(_inspected(spark, sf_dir)).withColumnRenamed("doc", "document_id")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole or in pieces, with its container."""
    sizes = packing.item_sizes(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_items(sizes, "doc_id", int(settings(spark, sf_dir)["container_tokens"]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split. The packing is written whole, else the planner leaves out all that this doesn't ask for."""
    return cut_lineage(p6_packed(spark, sf_dir)).where(F.col("pieces") > 1).select("doc_id").distinct()


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, all in all."""
    room = int(settings(spark, sf_dir)["container_tokens"])
    full = p6_packed(spark, sf_dir).where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return full.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count("*") * room), 4).alias("filled"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents and tokens packed, and whether no container overflows, none is split without need, and at least 95 in 100 of the room is used."""
    room = int(settings(spark, sf_dir)["container_tokens"])
    packed = cut_lineage(p6_packed(spark, sf_dir))
    full = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t").alias("fullest"), F.avg("t").alias("mean"))
    docs = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("pieces").alias("pieces"))
    sums = docs.agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.every((F.col("pieces") > 1) == (F.col("tokens") > room)).alias("split_by_need"))
    return sums.crossJoin(F.broadcast(full)).select("documents", "tokens", "split_by_need", (F.col("fullest") <= room).alias("within_room"), (F.col("mean") >= 0.95 * room).alias("well_filled"))


def _source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    return cut_lineage(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their target share, by the report on the written mixture."""
    return cut_lineage(p7_shares(spark, sf_dir)).where(~F.col("reachable")).select("source").distinct()


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document of the listed sources is used."""
    return mixing.mix_sources(_source_sizes(spark, sf_dir), "doc_id", read_table(spark, sf_dir, "source_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    sizes, targets = _source_sizes(spark, sf_dir), read_table(spark, sf_dir, "source_targets")
    shares = mixing.reached_shares(mixing.mix_sources(sizes, "doc_id", targets), mixing.source_report(sizes, targets))
    return shares.select("source", "target_share", F.round("share", 4).alias("share"), "used_tokens", "source_tokens", "most_copies", "reachable")


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, records, source_tokens, reachable, within_budget, within_repeats, cut_late)``: what the mixture holds against budgets and repeats."""
    sizes, targets = _source_sizes(spark, sf_dir), read_table(spark, sf_dir, "source_targets")
    mixture = cut_lineage(mixing.mix_sources(sizes, "doc_id", targets))
    largest = mixture.groupBy("source").agg(F.max("tokens").alias("largest"), F.min("copies").alias("fewest"))
    r = mixing.reached_shares(mixture, mixing.source_report(sizes, targets)).join(largest, "source", "left")
    most = F.least("budget", (F.col("source_tokens") * F.col("max_repeats")).cast("double"))
    return r.select("source", "records", "source_tokens", "reachable", (F.col("used_tokens") <= most + 1e-6).alias("within_budget"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.col("used_tokens") > most - F.col("largest") - 1e-6).alias("cut_late"))


def p8_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what marks it as no content, null where it is kept."""
    return residue.mark_residue(read_table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an unfilled slot, or consist of padding, an error message or a notice."""
    return p8_marked(spark, sf_dir).where(F.col("kind").isNotNull()).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p1_found, p1_classes, p1_groups, p1_studies, p2_found, p2_pieces, p2_indexes, p2_checked, p3_found, p3_neighbors, p4_found, p5_found, p5_paragraphs, p6_found, p6_packed, p6_usage, p6_checked, p7_found, p7_mixture, p7_shares, p7_checked, p8_found, p8_marked)}


_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{b}\x{1c}-\x{1f}]+'))"
_LIMIT = "(SELECT config_value FROM retrieval_config WHERE config_key = '{}')"
_SIZES = f"s AS (SELECT t.source, any_value(t.target_share) AS target_share, any_value(t.max_repeats) AS max_repeats, coalesce(sum(n), 0) AS own FROM source_targets t LEFT JOIN (SELECT source, {_TOKENS} AS n FROM documents) d ON d.source = t.source GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can express, by brute force over the whole tables."""
    runs = r"SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM (SELECT chunk_id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL GROUP BY 1) WHERE len(w) >= 3"
    vectors = "SELECT chunk_id, CAST(any_value(embedding) AS FLOAT[128]) AS v FROM chunks WHERE len(embedding) = 128 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 GROUP BY 1"
    pairs = f"c AS ({runs}), n AS (SELECT chunk_id, len(g) AS n FROM c), r AS (SELECT chunk_id, unnest(g) AS x FROM c), p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS k FROM r a JOIN r b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY 1, 2), l AS (SELECT chunk_id_a, chunk_id_b FROM p JOIN n a ON a.chunk_id = chunk_id_a JOIN n b ON b.chunk_id = chunk_id_b WHERE k / (a.n + b.n - k) >= {_LIMIT.format('near_duplicate_min_share')})"
    groups = f"{pairs}, e AS (SELECT chunk_id_a AS x, chunk_id_b AS y FROM l UNION SELECT chunk_id_b, chunk_id_a FROM l UNION SELECT chunk_id, chunk_id FROM n), t AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x), g AS (SELECT x AS chunk_id, min(y) AS group_id FROM t GROUP BY 1)"
    classes = f"{pairs}, k AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY list_sort(g)) AS class_id FROM c), s AS (SELECT class_id, count(*) AS copies FROM k GROUP BY 1), q AS (SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM (SELECT chunk_id_a AS a, chunk_id_b AS b FROM l UNION SELECT chunk_id_b, chunk_id_a FROM l) JOIN k a ON a.chunk_id = a JOIN k b ON b.chunk_id = b WHERE a.class_id <> b.class_id)"
    reached = f"WITH {_SIZES} SELECT s.source, (SELECT count(*) FROM documents d WHERE d.source = s.source) AS records, CAST(own AS BIGINT) AS source_tokens, own * max_repeats >= target_share * (SELECT sum(own) FROM s) AS reachable, true AS within_budget, true AS within_repeats, true AS cut_late FROM s"
    return {
        "p1_groups": f"WITH RECURSIVE {groups} SELECT chunk_id, group_id FROM g",
        "p1_classes": f"WITH {classes} SELECT chunk_id, class_id, copies, (SELECT count(*) FROM q WHERE x = class_id) AS links FROM k JOIN s USING (class_id)",
        "p1_studies": f"WITH RECURSIVE {groups} SELECT group_id, upper(regexp_replace(nct_id, '[^A-Za-z0-9]', '', 'g')) AS nct_id, count(DISTINCT chunk_id) AS chunks FROM g JOIN (SELECT DISTINCT chunk_id, document_id FROM chunks) USING (chunk_id) JOIN documents ON doc_id = document_id WHERE group_id IN (SELECT group_id FROM g GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2",
        "p2_checked": f"SELECT chunk_id, {_TOKENS.replace('text', 'any_value(content)')} AS tokens, true AS within_limit, true AS overlaps FROM chunks GROUP BY 1 HAVING tokens > {_LIMIT.format('chunk_limit_tokens')}",
        "p6_checked": f"SELECT count(*) AS documents, sum({_TOKENS})::BIGINT AS tokens, true AS split_by_need, true AS within_room, true AS well_filled FROM (SELECT coalesce(text, '') AS text FROM documents)",
        "p7_checked": reached,
        "p1_found": f"WITH {pairs} SELECT chunk_id_a, chunk_id_b FROM l",
        "p3_found": f"WITH c AS ({vectors}), s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, array_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.chunk_id <> b.chunk_id), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s) SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM k WHERE n <= {_LIMIT.format('vector_neighbors_k')} AND s >= {_LIMIT.format('vector_min_cosine')}",
        "p6_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_TOKENS} > {_LIMIT.format('container_tokens')}",
        "p7_found": f"WITH {_SIZES} SELECT source FROM s WHERE own * max_repeats < target_share * (SELECT sum(own) FROM s)",
    }
