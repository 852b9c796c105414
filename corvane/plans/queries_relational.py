"""Registered queries: filters, joins, aggregations, ranking, order, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.functions import text as T
from corvane.operators import relational as R
from corvane.operators import sinks as K
from corvane.plans import cypher
from corvane.plans.views import Query, Tables, sql

ROUND = 6
# The overlap graph links chunks' graphs that share so many entity texts.
SHARED = 3
GRAPH_SOURCES = ["entities", "meta_graphs"]


def r6(column, name: str):
    """A float rounded as both engines round it."""
    return F.round(column, ROUND).alias(name)


def _q(name: str, rows: str, run, statement: str | None = None) -> Query:
    return Query(name, lambda spark, sf: run(Tables(spark, sf)), rows, statement)


def overlap_classes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sets of entity texts and their classes, stored. Rows delivered twice make no other sets, so two columns of the table as it is will do."""
    return R.overlap_classes(t.raw("entities").select("meta_graph_id", F.lower("entity_text").alias("t")), "meta_graph_id", "t", SHARED, lambda name, build: t.stored(name, GRAPH_SOURCES, build))


def _nodes_of(t: Tables) -> DataFrame:
    return t.nodes.select("vocabulary", "code", "display_name", F.col("metadata.synonyms").alias("synonyms"), "is_active")


def _code(e: DataFrame) -> DataFrame:
    return e.withColumn("code", T.vocabulary_code(F.col("normalized_id"), F.coalesce("normalized_source", F.lit("?"))))


_CODE_SQL = "CASE WHEN regexp_matches(regexp_replace(normalized_id, '^[A-Za-z0-9_]+:', ''), '[A-Za-z]') THEN upper(trim(regexp_replace(normalized_id, '^[A-Za-z0-9_]+:', ''))) ELSE trim(regexp_replace(normalized_id, '^[A-Za-z0-9_]+:', '')) END"

FILTERS = [
    _q("scan_project_filter", "S25 P1 P2 P9", lambda t: t.entities.where((F.col("entity_type") == "medication") & (F.col("confidence") > 0.8)).select(F.col("entity_id").alias("id"), F.col("entity_text").alias("mention"), "confidence"),
       sql("E", "SELECT entity_id AS id, entity_text AS mention, confidence FROM e WHERE entity_type = 'medication' AND confidence > 0.8")),
    _q("ilike_contains", "P3", lambda t: R.search_filter(t.raw("part"), ["p_name"], ["Ring"]).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'"),
    _q("multi_term_or", "P4 P5", lambda t: R.search_filter(t.documents, ["title", "therapeutic_area"], ["vasculitis", "oncology"]).select("doc_id", "title"),
       "SELECT doc_id, title FROM documents WHERE lower(title) LIKE '%vasculitis%' OR lower(title) LIKE '%oncology%' OR lower(therapeutic_area) LIKE '%vasculitis%' OR lower(therapeutic_area) LIKE '%oncology%'"),
    _q("in_list_semi", "P6 P7 J12", lambda t: R.in_list(t.entities, "meta_graph_id", t.meta_graphs.where("entity_count >= 6").select("meta_graph_id")).select("entity_id", "meta_graph_id"),
       sql("EM", "SELECT entity_id, meta_graph_id FROM e WHERE meta_graph_id IN (SELECT meta_graph_id FROM m WHERE entity_count >= 6)")),
    _q("null_and_coalesce", "P8", lambda t: t.documents.where(F.col("title").isNotNull() & (F.col("title") != "")).select("doc_id", F.coalesce("therapeutic_area", F.lit("unknown")).alias("area"), F.col("nct_id").isNull().alias("no_study")),
       "SELECT doc_id, coalesce(therapeutic_area, 'unknown') AS area, nct_id IS NULL AS no_study FROM documents WHERE title IS NOT NULL AND title <> ''"),
    _q("active_nodes", "P10", lambda t: t.nodes.where("is_active").groupBy("vocabulary").agg(F.count("*").alias("n")), "SELECT vocabulary, count(*) AS n FROM repo_nodes WHERE is_active GROUP BY 1"),
    _q("regex_guarded_cast", "P11", lambda t: t.meta_graphs.select("meta_graph_id", R.guarded_long(F.col("document_id")).alias("document")), sql("M", "SELECT meta_graph_id, CASE WHEN regexp_matches(nullif(trim(document_id), ''), '^[0-9]+$') THEN TRY_CAST(trim(document_id) AS BIGINT) END AS document FROM m")),
    _q("json_text_search", "P12", lambda t: t.raw("events").where(F.contains("props", F.lit('"k": 7'))).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.contains("props", F.lit('"k": 77')).alias("is_77")),
       """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, contains(props, '"k": 77') AS is_77 FROM events WHERE contains(props, '"k": 7')"""),
    _q("case_buckets", "P13 A14", lambda t: t.entities.groupBy(F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "middle").otherwise("low").alias("bucket")).agg(F.count("*").alias("n")),
       sql("E", "SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'middle' ELSE 'low' END AS bucket, count(*) AS n FROM e GROUP BY 1")),
    _q("exists_probe", "P14", lambda t: t.relations.where("predicate = 'treats'").limit(1).agg((F.count("*") > 0).alias("found")), sql("R", "SELECT count(*) > 0 AS found FROM r WHERE predicate = 'treats'")),
    _q("ad_hoc_limit", "P15", lambda t: (t.raw("orders").createOrReplaceTempView("corvane_orders"), R.ad_hoc(t.spark, "SELECT o_orderkey, o_totalprice FROM corvane_orders ORDER BY o_totalprice DESC, o_orderkey;", 10))[1],
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    _q("pattern_one_hop", "P16 J25 A40", lambda t: cypher.run_pattern("MATCH (a:Entity)-[r]->(b:Entity) WHERE a.entity_type = 'medication' RETURN r.predicate AS predicate, b.entity_type AS target_type, count(*) AS n", _vertices(t), _edges(t)),
       sql("ER", "SELECT r.predicate, b.entity_type AS target_type, count(*) AS n FROM r JOIN e a ON a.entity_id = subject_entity_id JOIN e b ON b.entity_id = object_entity_id WHERE a.entity_type = 'medication' GROUP BY 1, 2")),
    _q("min_length_text", "P17", lambda t: t.chunks.where(F.length(F.trim("content")) >= 100).groupBy("parser").agg(F.count("*").alias("n")), sql("C", "SELECT parser, count(*) AS n FROM c WHERE length(trim(content)) >= 100 GROUP BY 1")),
    _q("search_terms", "P18", lambda t: t.documents.where("title is not null").select("doc_id", F.array_join(T.search_terms_column(F.col("title")), "|").alias("terms")),
       "SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(trim(lower(title)), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('" + "','".join(T.STOP_WORDS) + "')), lambda w: regexp_replace(w, '[^\\w\\s]', '', 'g')), lambda w: w <> ''), '|') AS terms FROM documents WHERE title IS NOT NULL"),
    _q("repaired_positions", "P19", lambda t: _repaired(t), sql("EC", """, j AS (SELECT entity_id, content AS t, trim(entity_text) AS x, entity_text, start_char AS s, end_char AS z, length(content) AS n FROM e JOIN c USING (chunk_id) WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND content IS NOT NULL AND trim(entity_text) <> ''),
        w AS (SELECT *, unnest([{'k': 1, 'lo': greatest(0, s - 10), 'hi': least(n, z + 10)}, {'k': 2, 'lo': greatest(0, s - 50), 'hi': least(n, z + 50)}, {'k': 3, 'lo': CASE WHEN length(x) < 100 THEN 0 ELSE greatest(0, s) END, 'hi': CASE WHEN length(x) < 100 THEN n ELSE least(n, z) END}]) AS v FROM j),
        f AS (SELECT *, CASE WHEN strpos(substr(t, v.lo + 1), x) > 0 THEN strpos(substr(t, v.lo + 1), x) - 1 + v.lo END AS a, CASE WHEN strpos(lower(substr(t, v.lo + 1, greatest(0, v.hi - v.lo))), lower(x)) > 0 THEN strpos(lower(substr(t, v.lo + 1, greatest(0, v.hi - v.lo))), lower(x)) - 1 + v.lo END AS b FROM w),
        g AS (SELECT entity_id, any_value(s) AS s, any_value(t) AS t, any_value(x) AS x, any_value(z) AS z, any_value(n) AS n, min_by(coalesce(CASE WHEN a < v.hi THEN a END, b), v.k) FILTER (WHERE coalesce(CASE WHEN a < v.hi THEN a END, b) IS NOT NULL) AS p FROM f GROUP BY entity_id)
        SELECT entity_id, s AS given, CAST(CASE WHEN s >= 0 AND s < z AND z <= n AND trim(substr(t, s + 1, z - s)) = x THEN s ELSE p END AS INTEGER) AS repaired FROM g""").replace(") , j AS", "), j AS")),
    _q("valid_relations", "P20", lambda t: R.valid_relations(_with_evidence(t), t.entities, t.chunks.select("chunk_id", F.col("content").alias("text")).where("text is not null")).select("relation_id", "evidence_start", "evidence_end"),
       sql("ERC", ", v AS (SELECT r.*, strpos(c.content, evidence_span) - 1 AS s, length(c.content) AS n FROM r JOIN c USING (chunk_id) WHERE c.content IS NOT NULL AND evidence_span IS NOT NULL) SELECT relation_id, CAST(s AS INTEGER) AS evidence_start, CAST(s + length(evidence_span) AS INTEGER) AS evidence_end FROM v WHERE s >= 0 AND length(evidence_span) > 0 AND s + length(evidence_span) <= n AND subject_entity_id IN (SELECT entity_id FROM e) AND object_entity_id IN (SELECT entity_id FROM e)").replace(") , v AS", "), v AS")),
    _q("whole_numbers", "P21", lambda t: t.raw("part").select("p_partkey", T.whole_number(F.col("p_retailprice")).alias("price"), T.whole_number(F.col("p_name")).alias("name_number")), "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS price, CAST(NULL AS INTEGER) AS name_number FROM part"),
]


def _vertices(t: Tables) -> DataFrame:
    from corvane.operators.graph import vertex_table

    return vertex_table(t.entities)


def _edges(t: Tables) -> DataFrame:
    from corvane.operators.graph import edge_table

    return edge_table(t.relations)


def _repaired(t: Tables) -> DataFrame:
    j = t.entities.join(t.chunks.select("chunk_id", "content"), "chunk_id").where("start_char is not null and end_char is not null and content is not null and trim(entity_text) <> ''")
    return j.select("entity_id", F.col("start_char").alias("given"), T.repaired_start(F.col("content"), F.col("entity_text"), F.col("start_char"), F.col("end_char")).alias("repaired"))


def _with_evidence(t: Tables) -> DataFrame:
    r = t.relations.where("evidence_span is not null and length(evidence_span) > 0").join(t.chunks.select("chunk_id", "content"), "chunk_id")
    return r.withColumn("evidence_start", (F.instr("content", F.col("evidence_span")) - 1).cast("int")).withColumn("evidence_end", F.col("evidence_start") + F.length("evidence_span")).drop("content")


JOINS = [
    _q("fk_chain", "J1", lambda t: t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity")),
       "SELECT r_name, count(*) AS items, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    _q("entity_search", "J1 R12 O1", lambda t: R.search_filter(t.entities, ["entity_text"], ["headache"]).join(t.chunks.select("chunk_id", "document_id"), "chunk_id").join(t.documents.select("doc_id", "nct_id", "document_type"), F.col("document_id") == F.col("doc_id")).select("entity_id", "entity_text", "confidence", "nct_id", "document_type").orderBy(F.desc_nulls_last("confidence"), "entity_id").limit(50),
       sql("ECD", "SELECT entity_id, entity_text, confidence, d.nct_id, document_type FROM e JOIN c USING (chunk_id) JOIN d ON c.document_id = d.doc_id WHERE entity_text ILIKE '%headache%' ORDER BY confidence DESC NULLS LAST, entity_id LIMIT 50")),
    _q("relation_search", "J2 R12", lambda t: _relation_search(t), sql("ERC", "SELECT relation_id, s.entity_text AS subject, predicate, o.entity_text AS object, c.document_id FROM r JOIN e s ON s.entity_id = subject_entity_id JOIN e o ON o.entity_id = object_entity_id JOIN c ON c.chunk_id = r.chunk_id WHERE predicate = 'treats' AND (s.entity_text ILIKE '%vasculitis%' OR o.entity_text ILIKE '%vasculitis%')")),
    _q("composite_key_join", "J3 F22", lambda t: _code(t.entities.where("normalized_id is not null")).join(t.nodes.select("vocabulary", "code", "display_name"), "code").groupBy("vocabulary").agg(F.count("*").alias("mentions"), F.countDistinct("code").alias("codes")),
       sql("E", f", k AS (SELECT *, {_CODE_SQL} AS code FROM e WHERE normalized_id IS NOT NULL) SELECT vocabulary, count(*) AS mentions, count(DISTINCT k.code) AS codes FROM k JOIN repo_nodes n ON n.code = k.code GROUP BY 1").replace(") , k AS", "), k AS")),
    _q("relation_counts", "J4 G10", lambda t: R.relation_counts(t.entities.select("entity_id"), t.relations), sql("ERN", "SELECT e.entity_id, count(relation_id) AS relation_count FROM e LEFT JOIN ends ON ends.entity_id = e.entity_id GROUP BY 1")),
    _q("left_join_having", "J5 A11 A13", lambda t: _having(t), sql("EM", "SELECT m.meta_graph_id, count(e.entity_id) AS entity_count, array_to_string(list_slice(list(e.entity_text ORDER BY e.entity_text), 1, 10), '|') AS top FROM m LEFT JOIN e ON e.meta_graph_id = m.meta_graph_id GROUP BY 1 HAVING count(e.entity_id) > 0")),
    _q("set_overlap_pairs", "J6 U5", lambda t: R.class_members_overlap(*overlap_classes(t), SHARED),
       sql("E", ", i AS (SELECT DISTINCT meta_graph_id AS id, lower(entity_text) AS t FROM e WHERE entity_text IS NOT NULL) SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM i a JOIN i b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 3").replace(") , i AS", "), i AS")),
    _q("related_entities", "J8 G3 U3", lambda t: R.related_entities(t.entities, t.relations, "vertigo", "medication").select("entity_text", "entity_type", "predicate", "confidence", "evidence_span", "chunk_id"),
       sql("ERN", "SELECT DISTINCT o.entity_text, o.entity_type, predicate, ends.confidence, evidence_span, e.chunk_id FROM e JOIN ends USING (entity_id) JOIN e o ON o.entity_id = other_id WHERE e.entity_text ILIKE '%vertigo%' AND o.entity_type = 'medication'")),
    _q("entity_chunks", "J9", lambda t: t.entities.join(t.chunks, "chunk_id", "left").groupBy("parser").agg(F.count("*").alias("mentions"), F.countDistinct("chunk_id").alias("chunks")),
       sql("EC", "SELECT parser, count(*) AS mentions, count(DISTINCT e.chunk_id) AS chunks FROM e LEFT JOIN c USING (chunk_id) GROUP BY 1")),
    _q("cast_join", "J10", lambda t: t.meta_graphs.join(t.documents.select("doc_id", "lang"), F.col("document_id") == F.col("doc_id").cast("string"), "left").groupBy("lang").agg(F.count("*").alias("graphs")),
       sql("M", "SELECT lang, count(*) AS graphs FROM m LEFT JOIN documents d ON m.document_id = CAST(d.doc_id AS VARCHAR) GROUP BY 1")),
    _q("lateral_topn", "J11", lambda t: R.lateral_first(t.raw("customer").select("c_custkey", "c_name"), t.raw("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3),
       "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)"),
    _q("anti_orphans", "J13 J14 U6", lambda t: R.orphans(t.chunks.select("chunk_id", "document_id"), t.entities, "chunk_id"), sql("EC", "SELECT chunk_id, document_id FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM e WHERE chunk_id IS NOT NULL)")),
    _q("first_match_resolution", "J16 J23 K6", lambda t: _resolved(t), sql("ER", """, g AS (SELECT chunk_id, lower(trim(entity_text)) AS t, min_by(entity_id, (coalesce(start_char, 2147483647), entity_id)) AS x FROM e GROUP BY 1, 2)
        SELECT relation_id, a.x AS subject_entity_id, b.x AS object_entity_id FROM r JOIN e s ON s.entity_id = r.subject_entity_id JOIN e o ON o.entity_id = r.object_entity_id JOIN g a ON a.chunk_id = r.chunk_id AND a.t = lower(trim(s.entity_text)) JOIN g b ON b.chunk_id = r.chunk_id AND b.t = lower(trim(o.entity_text))""").replace(") , g AS", "), g AS")),
    _q("mention_keys", "J17", lambda t: t.entities.select("entity_id", R.mention_key(F.col("entity_text"), F.col("start_char"), F.col("end_char")).alias("key")), sql("E", "SELECT entity_id, lower(trim(entity_text)) || '|' || CAST(start_char AS VARCHAR) || '|' || CAST(end_char AS VARCHAR) AS key FROM e")),
    _q("span_overlap_best", "J18", lambda t: _overlaps(t), sql("E", """, s AS (SELECT chunk_id, entity_id AS span_id, entity_text AS t, start_char AS a, end_char AS z FROM e WHERE start_char < end_char), p AS (SELECT e.entity_id, span_id, a, least(end_char, z) - greatest(start_char, a) AS overlap FROM e JOIN s USING (chunk_id) WHERE start_char < end_char AND least(end_char, z) - greatest(start_char, a) >= 0.5 * (end_char - start_char) AND contains(lower(t), lower(entity_text)))
        SELECT entity_id, span_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY overlap DESC, a, span_id) AS n FROM p) WHERE n = 1""").replace(") , s AS", "), s AS")),
    _q("vocab_exact_match", "J19 U1", lambda t: R.exact_matches(t.entities, "entity_text", t.nodes).select("value", "vocabulary", "code", "matched_by"),
       sql("E", """, v AS (SELECT DISTINCT entity_text AS value, lower(trim(entity_text)) AS k FROM e WHERE trim(entity_text) <> ''), u AS (SELECT lower(display_name) AS k, vocabulary, code, 'name' AS matched_by FROM repo_nodes WHERE is_active UNION ALL SELECT lower(code), vocabulary, code, 'code' FROM repo_nodes WHERE is_active)
        SELECT value, vocabulary, code, max(matched_by) AS matched_by FROM v JOIN u USING (k) GROUP BY 1, 2, 3""").replace(") , v AS", "), v AS")),
    _q("vocab_fuzzy_match", "J20 F20 N2", lambda t: R.fuzzy_matches(t.entities.where("normalized_id is null"), "entity_text", t.nodes)),
    _q("text_backfill", "J22 K15 S26", lambda t: _backfilled(t), sql("CM", "SELECT m.meta_graph_id, m.chunk_id, coalesce(m.nct_id, d.nct_id) AS nct_id FROM m LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS k, min(nct_id) AS nct_id FROM documents GROUP BY 1) d ON d.k = m.document_id")),
    _q("scalar_subqueries", "J24", lambda t: R.table_counts(entities=t.entities, relations=t.relations, chunks=t.chunks).groupBy().pivot("name", ["entities", "relations", "chunks"]).agg(F.first("n")),
       sql("ERC", "SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM c) AS chunks")),
]


def _relation_search(t: Tables) -> DataFrame:
    s = t.entities.select(F.col("entity_id").alias("subject_entity_id"), F.col("entity_text").alias("subject"))
    o = t.entities.select(F.col("entity_id").alias("object_entity_id"), F.col("entity_text").alias("object"))
    j = R.optional_equals(t.relations, predicate="treats").join(s, "subject_entity_id").join(o, "object_entity_id").join(t.chunks.select("chunk_id", "document_id"), "chunk_id")
    return R.search_filter(j, ["subject", "object"], ["vasculitis"]).select("relation_id", "subject", "predicate", "object", "document_id")


def _having(t: Tables) -> DataFrame:
    per = t.meta_graphs.join(t.entities.select("meta_graph_id", "entity_id", "entity_text"), "meta_graph_id", "left").groupBy("meta_graph_id")
    return per.agg(F.count("entity_id").alias("entity_count"), F.array_join(R.first_sorted("entity_text", 10), "|").alias("top")).where("entity_count > 0")


def _resolved(t: Tables) -> DataFrame:
    s = t.entities.select(F.col("entity_id").alias("subject_entity_id"), F.col("entity_text").alias("subject"))
    o = t.entities.select(F.col("entity_id").alias("object_entity_id"), F.col("entity_text").alias("object"))
    given = t.relations.join(s, "subject_entity_id").join(o, "object_entity_id").select("relation_id", "chunk_id", "subject", "object")
    return R.resolve_by_text(given, t.entities).select("relation_id", "subject_entity_id", "object_entity_id")


def _overlaps(t: Tables) -> DataFrame:
    e = t.entities.select("entity_id", "chunk_id", F.col("entity_text").alias("text"), "start_char", "end_char")
    return R.best_overlaps(e, e.withColumnRenamed("entity_id", "span_id"), "chunk_id").select("entity_id", "span_id", "overlap")


def _backfilled(t: Tables) -> DataFrame:
    from corvane.sources.artefacts import backfill_text

    texts = t.raw("documents").select(F.col("doc_id").cast("string").alias("document_id"), "nct_id")
    return backfill_text(t.meta_graphs.select("meta_graph_id", "chunk_id", "document_id", "nct_id"), texts, "document_id", "nct_id").select("meta_graph_id", "chunk_id", "nct_id")


AGGREGATES = [
    _q("table_counts", "A1 A33", lambda t: R.table_counts(entities=t.entities, relations=t.relations, meta_graphs=t.meta_graphs, chunks=t.chunks), sql("ERMC", "SELECT 'entities' AS name, count(*) AS n FROM e UNION ALL SELECT 'relations', count(*) FROM r UNION ALL SELECT 'meta_graphs', count(*) FROM m UNION ALL SELECT 'chunks', count(*) FROM c")),
    _q("count_by_type_topn", "A2", lambda t: R.top_counts(t.relations, ["predicate"], 20), sql("R", "SELECT predicate, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, predicate LIMIT 20")),
    _q("frequent_mentions", "A3", lambda t: R.top_counts(t.entities, ["entity_text", "entity_type"], 50), sql("E", "SELECT entity_text, entity_type, count(*) AS n FROM e GROUP BY 1, 2 ORDER BY n DESC, entity_text NULLS FIRST, entity_type LIMIT 50")),
    _q("document_summary", "A4 R12", lambda t: t.entities.join(t.chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("document_id", "entity_type").agg(F.count("*").alias("n")), sql("EC", "SELECT document_id, entity_type, count(*) AS n FROM e JOIN c USING (chunk_id) GROUP BY 1, 2")),
    _q("distinct_counts", "A5", lambda t: t.entities.agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("normalized_id").alias("concepts"), F.countDistinct(F.lower("entity_text")).alias("texts")), sql("E", "SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT normalized_id) AS concepts, count(DISTINCT lower(entity_text)) AS texts FROM e")),
    _q("completeness", "A6", lambda t: R.completeness(t.documents, ["nct_id", "title", "phase", "source", "updated_at"]), "SELECT count(*) AS total, count(nct_id) AS nct_id_filled, count(title) AS title_filled, count(phase) AS phase_filled, count(source) AS source_filled, count(updated_at) AS updated_at_filled FROM documents"),
    _q("numeric_summary", "A7 A8", lambda t: t.chunks.groupBy("parser").agg(F.round(F.avg("token_count"), 4).alias("mean_tokens"), F.max("token_count").alias("most"), F.min("token_count").alias("least"), F.sum(F.length("content")).alias("characters"), F.expr("sum(length(content)) div count(content)").alias("mean_characters")),
       sql("C", "SELECT parser, round(avg(token_count), 4) AS mean_tokens, max(token_count) AS most, min(token_count) AS least, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(sum(length(content)) // count(content) AS BIGINT) AS mean_characters FROM c GROUP BY 1")),
    _q("conditional_counts", "A9", lambda t: t.entities.groupBy("entity_type").agg(F.count_if(F.col("normalized_id").isNotNull()).alias("normalized"), F.countDistinct(F.when(F.col("confidence") > 0.8, F.col("chunk_id"))).alias("sure_chunks")), sql("E", "SELECT entity_type, count(CASE WHEN normalized_id IS NOT NULL THEN 1 END) AS normalized, count(DISTINCT CASE WHEN confidence > 0.8 THEN chunk_id END) AS sure_chunks FROM e GROUP BY 1")),
    _q("string_agg_distinct", "A10", lambda t: t.entities.groupBy("normalized_source").agg(R.distinct_text("entity_type").alias("types")), sql("E", "SELECT normalized_source, string_agg(DISTINCT entity_type, ', ' ORDER BY entity_type) AS types FROM e GROUP BY 1")),
    _q("array_agg_distinct", "A12", lambda t: t.entities.groupBy("meta_graph_id").agg(F.array_join(F.sort_array(F.collect_set(F.lower("entity_text"))), "|").alias("texts")), sql("E", "SELECT meta_graph_id, array_to_string(list_sort(list(DISTINCT lower(entity_text)) FILTER (WHERE entity_text IS NOT NULL)), '|') AS texts FROM e GROUP BY 1")),
    _q("typeof_groups", "A15", lambda t: t.entities.groupBy((F.typeof("start_char") == "int").alias("is_int")).agg(F.count("*").alias("n")), sql("E", "SELECT typeof(start_char) = 'INTEGER' AS is_int, count(*) AS n FROM e GROUP BY 1")),
    _q("distributions", "A16", lambda t: R.top_counts(t.entities.where("normalized_source is not null"), ["normalized_source"], 10), sql("E", "SELECT normalized_source, count(*) AS n FROM e WHERE normalized_source IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")),
    _q("positive_means", "A17", lambda t: t.relations.groupBy("predicate").agg(r6(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), "mean_confidence")), sql("R", "SELECT predicate, round(avg(CASE WHEN confidence > 0 THEN confidence END), 6) AS mean_confidence FROM r GROUP BY 1")),
    _q("first_per_type", "A35", lambda t: t.documents.where("title is not null").groupBy("document_type").agg(F.min_by("title", "doc_id").alias("first_title")), "SELECT document_type, min_by(title, doc_id) AS first_title FROM documents WHERE title IS NOT NULL GROUP BY 1"),
    _q("status_counters", "A36", lambda t: t.chunks.groupBy(F.when(F.col("content").isNull(), "failed").when(F.length(F.trim("content")) < 100, "skipped").otherwise("processed").alias("status")).agg(F.count("*").alias("n")), sql("C", "SELECT CASE WHEN content IS NULL THEN 'failed' WHEN length(trim(content)) < 100 THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n FROM c GROUP BY 1")),
    _q("normalisation_statistics", "A38", lambda t: t.entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.count("normalized_id").alias("normalized"), r6(F.count("normalized_id") / F.count("*"), "rate")), sql("E", "SELECT entity_type, count(*) AS n, count(normalized_id) AS normalized, round(count(normalized_id) / count(*), 6) AS rate FROM e GROUP BY 1")),
    _q("worst_status", "A39", lambda t: R.worst_status(t.raw("events"), "event_type", ["view", "click", "purchase", "error"]), "SELECT count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error, max_by(event_type, list_position(['view', 'click', 'purchase', 'error'], event_type)) FILTER (WHERE list_position(['view', 'click', 'purchase', 'error'], event_type) > 0) AS overall FROM events"),
    _q("dominant_section", "A41", lambda t: R.first_by(t.chunks.where("section_title is not null").groupBy("document_id", "section_title").agg(F.count("*").alias("n"), F.min("chunk_index").alias("at")), ["document_id"], [F.desc("n"), F.col("at"), F.col("section_title")]).select("document_id", "section_title", "n"),
       sql("C", "SELECT document_id, section_title, n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, place, section_title) AS k FROM (SELECT document_id, section_title, count(*) AS n, min(chunk_index) AS place FROM c WHERE section_title IS NOT NULL GROUP BY 1, 2)) WHERE k = 1")),
]

RANKING = [
    _q("best_match_per_key", "N1 N3", lambda t: R.first_by(t.entities.where("normalized_id is not null"), ["normalized_id"], [F.desc_nulls_last("confidence"), F.col("entity_id")]).select("normalized_id", "entity_id", "confidence"),
       sql("E", "SELECT normalized_id, entity_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY normalized_id ORDER BY confidence DESC NULLS LAST, entity_id) AS k FROM e WHERE normalized_id IS NOT NULL) WHERE k = 1")),
    _q("preferred_vocabulary", "N4", lambda t: R.preferred_vocabulary(_typed_matches(t), "value", "entity_type").select("value", "entity_type", "vocabulary", "code"),
       sql("E", """, v AS (SELECT DISTINCT entity_text AS value, entity_type, lower(trim(entity_text)) AS k FROM e WHERE trim(entity_text) <> ''), j AS (SELECT DISTINCT value, entity_type, vocabulary, code FROM v JOIN repo_nodes n ON n.is_active AND (lower(display_name) = k OR lower(code) = k))
        SELECT value, entity_type, vocabulary, code FROM (SELECT *, row_number() OVER (PARTITION BY value, entity_type ORDER BY CASE WHEN entity_type IN ('medication', 'drug', 'dosage') AND vocabulary = 'rxnorm' THEN 0 WHEN entity_type IN ('condition', 'disease', 'adverse_event') AND vocabulary = 'snomed' THEN 0 WHEN entity_type IN ('condition', 'disease', 'adverse_event') AND vocabulary = 'umls' THEN 1 ELSE 2 END, vocabulary, code) AS n FROM j) WHERE n = 1""").replace(") , v AS", "), v AS")),
    _q("running_index", "N5", lambda t: R.running_index(t.chunks, ["document_id"], [F.col("chunk_index"), F.col("chunk_id")], "sequence").select("chunk_id", F.col("sequence").cast("int").alias("sequence")), sql("C", "SELECT chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS INTEGER) AS sequence FROM c")),
    _q("first_last_label", "N6", lambda t: t.raw("part").groupBy("p_brand").agg(F.coalesce(F.max_by(F.when(F.col("p_size") > 45, F.col("p_name")), F.when(F.col("p_size") > 45, F.col("p_partkey"))), F.min_by("p_name", "p_partkey")).alias("label")), "SELECT p_brand, coalesce(max_by(p_name, p_partkey) FILTER (WHERE p_size > 45), min_by(p_name, p_partkey)) AS label FROM part GROUP BY 1"),
    _q("dedupe_keep_order", "N10", lambda t: R.first_by(t.entities.where("start_char is not null"), ["chunk_id", "entity_text"], [F.col("start_char"), F.col("entity_id")]).select("chunk_id", "entity_text", "entity_id"), sql("E", "SELECT chunk_id, entity_text, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, entity_text ORDER BY start_char, entity_id) AS k FROM e WHERE start_char IS NOT NULL) WHERE k = 1")),
]


def _typed_matches(t: Tables) -> DataFrame:
    kinds = t.entities.select(F.col("entity_text").alias("value"), "entity_type").distinct()
    return R.exact_matches(t.entities, "entity_text", t.nodes).join(kinds, "value")


ORDER = [
    _q("null_placement", "O1 O2 O3", lambda t: t.relations.orderBy(F.desc_nulls_last("confidence"), "relation_id").limit(25).select("relation_id", "confidence"), sql("R", "SELECT relation_id, confidence FROM r ORDER BY confidence DESC NULLS LAST, relation_id LIMIT 25")),
    _q("nulls_first", "O1", lambda t: t.relations.orderBy(F.desc_nulls_first("confidence"), "relation_id").limit(25).select("relation_id", "confidence"), sql("R", "SELECT relation_id, confidence FROM r ORDER BY confidence DESC NULLS FIRST, relation_id LIMIT 25")),
    _q("multi_key_order", "O4 O11", lambda t: R.relation_counts(t.entities, t.relations).orderBy(F.desc("relation_count"), F.when(F.col("entity_type") == "medication", 1).otherwise(2), F.desc_nulls_last("confidence"), "entity_id").limit(200).select("entity_id", "relation_count"),
       sql("ERN", ", k AS (SELECT e.entity_id, any_value(entity_type) AS t, any_value(e.confidence) AS f, count(relation_id) AS relation_count FROM e LEFT JOIN ends USING (entity_id) GROUP BY 1) SELECT entity_id, relation_count FROM k ORDER BY relation_count DESC, CASE WHEN t = 'medication' THEN 1 ELSE 2 END, f DESC NULLS LAST, entity_id LIMIT 200").replace(") , k AS", "), k AS")),
    _q("paging", "O7 O13", lambda t: R.page(t.documents.select("doc_id", "title"), [F.col("doc_id")], 2, 25), "SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50"),
    _q("top_entity_chunks", "O10", lambda t: t.entities.groupBy("chunk_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(10), sql("E", "SELECT chunk_id, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, chunk_id LIMIT 10")),
    _q("stable_partition", "O12", lambda t: t.documents.select("doc_id", F.col("nct_id").isNotNull().alias("has_study")).orderBy(F.desc("has_study"), "doc_id"), "SELECT doc_id, nct_id IS NOT NULL AS has_study FROM documents ORDER BY has_study DESC, doc_id"),
]

SETS = [
    _q("union_all_matches", "U1", lambda t: t.nodes.where(F.lower("display_name").like("%neuritis%")).select("code", F.lit("name").alias("how")).unionAll(t.nodes.where(F.col("code").like("8%")).select("code", F.lit("code").alias("how"))), "SELECT code, 'name' AS how FROM repo_nodes WHERE lower(display_name) LIKE '%neuritis%' UNION ALL SELECT code, 'code' FROM repo_nodes WHERE code LIKE '8%'"),
    _q("union_distinct_endpoints", "U2", lambda t: R.distinct_ends(t.relations), sql("R", "SELECT subject_entity_id AS entity_id FROM r WHERE subject_entity_id IS NOT NULL UNION SELECT object_entity_id FROM r WHERE object_entity_id IS NOT NULL")),
    _q("distinct_pairs", "U3", lambda t: t.entities.select("meta_graph_id", "entity_type").distinct(), sql("E", "SELECT DISTINCT meta_graph_id, entity_type FROM e")),
    _q("concat_results", "U7", lambda t: R.concat_results(t.entities.where("confidence > 0.97").select(F.col("entity_id").alias("id"), "entity_text"), t.relations.where("confidence > 0.97").select(F.col("relation_id").alias("id"), "predicate")), sql("ER", "SELECT entity_id AS id, entity_text, CAST(NULL AS VARCHAR) AS predicate FROM e WHERE confidence > 0.97 UNION ALL SELECT relation_id, NULL, predicate FROM r WHERE confidence > 0.97")),
    _q("first_non_empty", "R13", lambda t: R.first_non_empty(t.chunks.where("section_title = 'no such section'").select("chunk_id"), t.chunks.where("section_title = 'methods'").select("chunk_id"), t.chunks.select("chunk_id")), sql("C", "SELECT chunk_id FROM c WHERE section_title = 'methods'")),
    _q("synthetic_edges", "V7", lambda t: _synthetic(t), "SELECT p_brand AS grp, CAST(a.p_partkey AS VARCHAR) AS source_code, CAST(b.p_partkey AS VARCHAR) AS target_code FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS n FROM part) a JOIN (SELECT p_brand AS g, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS n FROM part) b ON b.g = a.p_brand AND b.n IN (a.n + 1, a.n + 2) WHERE a.n <= 10"),
    _q("predicate_names", "V8", lambda t: _predicates(t), "SELECT coalesce(list_extract(['is_a', 'has_finding_site', 'has_associated_morphology', 'has_causative_agent', 'due_to', 'has_method', 'has_procedure_site', 'has_active_ingredient'], o_custkey % 12 + 1), 'related_to') AS predicate, count(*) AS n FROM orders GROUP BY 1"),
]


def _synthetic(t: Tables) -> DataFrame:
    from corvane.sources.vocabularies import synthetic_edges

    p = t.raw("part").select(F.col("p_brand").alias("grp"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"))
    bare = lambda c: F.col(c).cast("long").cast("string").alias(c)
    return synthetic_edges(p, ["grp"], "code", 10).select("grp", bare("source_code"), bare("target_code"))


def _predicates(t: Tables) -> DataFrame:
    from corvane.sources.vocabularies import SNOMED_PREDICATES, predicate_name

    listed = F.array(*map(F.lit, SNOMED_PREDICATES), F.lit("1"))
    return t.raw("orders").select(predicate_name(F.try_element_at(listed, (F.col("o_custkey") % 12 + 1).cast("int"))).alias("predicate")).groupBy("predicate").agg(F.count("*").alias("n"))


SINKS = [
    _q("upsert_keep_last", "K2 K7 K8 K9 K11 K19", lambda t: K.merge_rows(t.raw("orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("line")), t.raw("lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("status"), F.col("l_linenumber").cast("int").alias("line")), ["o_orderkey"], [F.desc("line")]), "WITH n AS (SELECT l_orderkey AS o_orderkey, l_returnflag AS status, CAST(l_linenumber AS INTEGER) AS line FROM lineitem WHERE l_returnflag <> 'N' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC) = 1) SELECT * FROM n UNION ALL SELECT o_orderkey, o_orderstatus, 0 FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM n)"),
    _q("insert_missing", "K17 K22", lambda t: K.insert_missing(t.raw("orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), t.raw("orders").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"]), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    _q("update_by_key", "K15 K16", lambda t: K.update_rows(t.documents.select("doc_id", "phase"), t.documents.where("n_tokens > 300").select("doc_id", F.lit("LONG").alias("phase")), "doc_id", ["phase"]), "SELECT doc_id, CASE WHEN n_tokens > 300 THEN 'LONG' ELSE phase END AS phase FROM documents"),
    _q("edge_endpoint_guard", "K10", lambda t: K.guard_edges(t.relations, t.entities.where("entity_type <> 'measurement'"), "subject_entity_id", "object_entity_id", "entity_id")[0].select("relation_id"), sql("ER", "SELECT relation_id FROM r WHERE subject_entity_id IN (SELECT entity_id FROM e WHERE entity_type <> 'measurement') AND object_entity_id IN (SELECT entity_id FROM e WHERE entity_type <> 'measurement')")),
    _q("delete_graph", "K14", lambda t: K.delete_graph(t.relations, t.entities, t.meta_graphs, t.meta_graphs.where("nct_id is null"))[1].select("entity_id"), sql("EM", "SELECT entity_id FROM e WHERE meta_graph_id NOT IN (SELECT meta_graph_id FROM m WHERE nct_id IS NULL)")),
    _q("evolve_schema", "K21 M6", lambda t: K.evolve(t.meta_graphs.select("meta_graph_id", "document_id"), {"document_id": "document"}, {"document": "bigint"}, {"summary": "string"}), sql("M", "SELECT meta_graph_id, TRY_CAST(nullif(trim(document_id), '') AS BIGINT) AS document, CAST(NULL AS VARCHAR) AS summary FROM m")),
    _q("repo_links", "K5 K7 F22 V5", lambda t: _code(t.entities.where("normalized_id is not null and normalized_source is not null")).where("code is not null").select("entity_id", "code", ids.cache_key(F.col("entity_text"), F.col("normalized_source"), F.col("entity_type")).alias("cache_key")), sql("E", f"SELECT entity_id, {_CODE_SQL} AS code, md5(concat_ws(':', lower(entity_text), normalized_source, lower(entity_type))) AS cache_key FROM e WHERE normalized_id IS NOT NULL AND normalized_source IS NOT NULL AND {_CODE_SQL} <> ''")),
    _q("artefact_rows", "K3", lambda t: _artefacts(t), "SELECT doc_id, a AS artefact, strlen(text) AS bytes FROM (SELECT doc_id, text, unnest(['markdown', 'text']) AS a FROM documents WHERE text IS NOT NULL)"),
    _q("json_report", "K4 K20", lambda t: t.entities.groupBy("entity_type").agg(F.count("*").alias("n")).select("entity_type", F.to_json(F.struct("entity_type", "n")).alias("report")), sql("E", """SELECT entity_type, '{"entity_type":"' || entity_type || '","n":' || count(*) || '}' AS report FROM e GROUP BY 1""")),
]


def _artefacts(t: Tables) -> DataFrame:
    parsed = t.documents.where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("plain_text"), F.col("text").alias("markdown"), F.lit(None).cast("string").alias("html"))
    return K.artefact_columns(parsed).select(F.col("path").alias("doc_id"), "artefact", F.octet_length("body").cast("long").alias("bytes"))


def all_queries() -> list[Query]:
    """Everything this module registers."""
    return [*FILTERS, *JOINS, *AGGREGATES, *RANKING, *ORDER, *SETS, *SINKS]


__all__ = ["SparkSession", "all_queries", "r6"]
