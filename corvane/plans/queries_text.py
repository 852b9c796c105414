"""Registered queries: text functions, chunking, sources, vectors, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import chunking as C
from corvane.operators.relational import first_by
from corvane.plans import evaluation as EV
from corvane.plans.queries_relational import _q, r6
from corvane.plans.retrieval import nearest_chunks
from corvane.plans.views import Query, Tables, any_sql, sql
from corvane.sources import artefacts as A
from corvane.sources import vocabularies as VO
from corvane.streaming import incremental as S

# Questions about what the tables hold, as SQL and as rows.
_QUESTIONS_SQL = "(SELECT DISTINCT unnest(['What is ' || display_name || '?', 'How does ' || display_name || ' work?', 'Compare ' || display_name || ' with placebo', display_name]) AS q FROM repo_nodes)"


def _questions(t: Tables) -> DataFrame:
    n = F.col("display_name")
    return t.nodes.select(F.explode(F.array(F.concat(F.lit("What is "), n, F.lit("?")), F.concat(F.lit("How does "), n, F.lit(" work?")), F.concat(F.lit("Compare "), n, F.lit(" with placebo")), n)).alias("q")).distinct()


def _lines(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _section_sql(column: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({column}, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}'" for k, ps in T.SECTION_HEADERS.items())
    return f"CASE {parts} ELSE 'unknown' END"


_LINES_SQL = "l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))"
_WORDS_SQL = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"

TEXT = [
    _q("string_functions", "F1 F2", lambda t: t.raw("part").select("p_partkey", F.upper("p_name").alias("up"), F.trim(F.lower("p_brand")).alias("low"), F.replace("p_name", F.lit("ring"), F.lit("RING")).alias("swapped"), F.startswith("p_name", F.lit("hot")).alias("starts"), F.endswith("p_name", F.lit("bolt")).alias("ends"), F.substring("p_name", 2, 4).alias("part"), F.length("p_name").alias("size")),
       "SELECT p_partkey, upper(p_name) AS up, trim(lower(p_brand)) AS low, replace(p_name, 'ring', 'RING') AS swapped, starts_with(p_name, 'hot') AS starts, ends_with(p_name, 'bolt') AS ends, substr(p_name, 2, 4) AS part, CAST(length(p_name) AS INTEGER) AS size FROM part"),
    _q("query_rewrite", "F3 F4 F5", lambda t: _questions(t).select("q", T.rewrite_query(F.col("q")).alias("rewritten"), T.explain_rewrite(F.col("q"), T.rewrite_query(F.col("q"))).isNotNull().alias("changed")),
       f"""SELECT q, coalesce(w, h, q) AS rewritten, coalesce(w, h, q) <> q AS changed FROM (SELECT q, CASE WHEN regexp_matches(trim(q), '(?i)^what\\s+(is|are)\\s+(.+?)(?:\\?|$)') AND len(string_split_regex(trim(x), '\\s+')) <= 3 AND NOT {any_sql('lower(x)', T.COMPARISON_WORDS)} THEN 'Define ' || x || '. ' || x || ' mechanism of action. ' || x || ' description. What ' || v || ' ' || x || '.' END AS w,
        CASE WHEN regexp_matches(trim(q), '(?i)^how\\s+does\\s+(.+?)\\s+work(?:\\?|$)') AND len(string_split_regex(trim(y), '\\s+')) <= 3 THEN y || ' mechanism of action. ' || y || ' mode of action. How does ' || y || ' work. ' || y || ' pharmacology.' END AS h
        FROM (SELECT q, regexp_extract(trim(q), '(?i)^what\\s+(is|are)\\s+(.+?)(?:\\?|$)', 1) AS v, regexp_extract(trim(q), '(?i)^what\\s+(is|are)\\s+(.+?)(?:\\?|$)', 2) AS x, regexp_extract(trim(q), '(?i)^how\\s+does\\s+(.+?)\\s+work(?:\\?|$)', 1) AS y FROM {_QUESTIONS_SQL}))"""),
    _q("section_types", "F6", lambda t: _lines(t).where("trim(line) <> ''").groupBy(T.section_type(F.col("line")).alias("section")).agg(F.count("*").alias("n")), f"WITH {_LINES_SQL} SELECT {_section_sql('lower(trim(line))')} AS section, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1"),
    _q("section_ends", "N7 N8", lambda t: _sections(t), f"""WITH {_LINES_SQL}, o AS (SELECT doc_id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS BIGINT) AS z FROM l), k AS (SELECT *, {_section_sql('lower(trim(line))')} AS section FROM o WHERE trim(line) <> '')
        SELECT doc_id, section, s AS start_char, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), z) AS end_char FROM k WHERE section <> 'unknown'"""),
    _q("sentence_counts", "F7", lambda t: t.documents.where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))),
    _q("references_found", "F8", lambda t: t.chunks.where("content is not null").select("chunk_id", T.refers_to_table(F.col("content")).alias("a_table"), T.refers_to_figure(F.col("content")).alias("a_figure")),
       sql("C", "SELECT chunk_id, regexp_matches(lower(content), '" + "|".join(f"(?:{p})" for p in T.TABLE_REFERENCES) + "') AS a_table, regexp_matches(lower(content), '" + "|".join(f"(?:{p})" for p in T.FIGURE_REFERENCES) + "') AS a_figure FROM c WHERE content IS NOT NULL")),
    _q("entity_hints", "F9", lambda t: t.chunks.where("content is not null").select("chunk_id", F.array_join(T.entity_hints(F.col("content")), ",").alias("hints")), sql("C", "SELECT chunk_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(content), '{p}') THEN '{k}' END" for k, p in T.ENTITY_HINTS.items()) + ") AS hints FROM c WHERE content IS NOT NULL")),
    _q("id_normalise", "F10 F11", lambda t: t.raw("part").select("p_partkey", T.safe_id(F.col("p_brand")).alias("safe"), T.safe_name(F.col("p_name")).alias("file"), T.chunk_key(F.col("p_brand"), F.col("p_size")).alias("chunk"), T.part_key(F.col("p_type"), F.col("p_size")).alias("part"), T.chunk_prefix(T.chunk_key(F.col("p_brand"), F.col("p_size"))).alias("prefix")),
       "SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g') AS safe, regexp_replace(trim(p_name), '[^A-Za-z0-9._-]+', '-', 'g') AS file, regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g') || '-chunk-' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS chunk, CASE WHEN p_size = 0 THEN p_type ELSE p_type || '-part' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS part, regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g') AS prefix FROM part"),
    _q("word_counts", "F12", lambda t: t.documents.where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words")), f"SELECT doc_id, CAST(len({_WORDS_SQL}) AS INTEGER) AS words FROM documents WHERE text IS NOT NULL"),
    _q("token_estimates", "F13 F14", lambda t: t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.fits_context(T.token_estimate(F.col("text")), "gpt-5-mini").alias("fits")), "SELECT doc_id, coalesce(length(text) // 4, 0) AS tokens, coalesce(length(text) // 4, 0) <= 350000 AS fits FROM documents"),
    _q("context_sizes", "F13", lambda t: t.documents.select("doc_id", T.context_tokens(F.col("title"), F.array("text"), F.lit(2), F.lit("Answer briefly.")).getField("total_tokens").alias("total")), "SELECT doc_id, coalesce(length(title) // 4, 0) + 3 + coalesce(length(text) // 4, 0) + 2000 + 10 AS total FROM documents"),
    _q("message_sizes", "F13", lambda t: t.documents.select("doc_id", T.message_tokens(F.array(F.struct(F.lit("system").alias("role"), F.col("title").alias("content"), F.lit(0).alias("images")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(1).alias("images")))).alias("tokens")), "SELECT doc_id, 2 + (4 + 1 + coalesce(length(title) // 4, 0)) + (4 + 1 + coalesce(length(text) // 4, 0) + 1000) AS tokens FROM documents"),
    _q("model_route", "F15 T27", lambda t: _questions(t).select("q", T.route(F.col("q"), F.lit(0), F.array().cast("array<string>")).alias("r"), T.speaks_of_pictures(F.col("q")).alias("pictures")).select("q", "r.model", "r.reason", "r.estimated_tokens", "pictures"),
       f"SELECT q, CASE WHEN {any_sql('lower(q)', T.REASONING_WORDS)} THEN 'gpt-5-mini' ELSE 'gpt-4.1' END AS model, CASE WHEN {any_sql('lower(q)', T.REASONING_WORDS)} THEN 'advanced_reasoning_query' ELSE 'default_text_query' END AS reason, length(q) // 4 AS estimated_tokens, {any_sql('lower(q)', T.VISUAL_WORDS)} AS pictures FROM {_QUESTIONS_SQL}"),
    _q("routing_statistics", "A37", lambda t: EV.routing_statistics(_questions(t).select(T.route(F.col("q"), F.lit(0), F.array().cast("array<string>")).alias("r")).select("r.*")),
       f"SELECT count(*) AS total_queries, count(*) FILTER (WHERE NOT k) AS default_count, count(*) FILTER (WHERE k) AS reasoning_count, count(*) FILTER (WHERE NOT k) / count(*) * 100 AS default_percentage, count(*) FILTER (WHERE k) / count(*) * 100 AS reasoning_percentage, CAST(floor(sum(n) / count(*)) AS BIGINT) AS avg_tokens FROM (SELECT {any_sql('lower(q)', T.REASONING_WORDS)} AS k, length(q) // 4 AS n FROM {_QUESTIONS_SQL})"),
    _q("context_flags", "F16", lambda t: _flags(t), sql("EC", ", w AS (SELECT entity_id, entity_type, lower(substr(content, greatest(0, start_char - 30) + 1, greatest(0, least(length(content), end_char + 30) - greatest(0, start_char - 30)))) AS x FROM e JOIN c USING (chunk_id) WHERE content IS NOT NULL AND start_char IS NOT NULL AND end_char IS NOT NULL) SELECT entity_id, " + ", ".join(f"{any_sql('x', ws)} AS {k}" for k, ws in T.CONTEXT_WORDS.items()) + " FROM w").replace(") , w AS", "), w AS")),
    _q("label_types", "F17 F18", lambda t: t.nodes.select("code", T.type_of_label(F.when(F.col("vocabulary") == "rxnorm", "PERSON").otherwise("TEST"), F.col("display_name")).alias("kind")), "SELECT code, CASE WHEN vocabulary <> 'rxnorm' THEN 'procedure' WHEN regexp_matches(lower(display_name), '(?:" + "|".join(T.DRUG_SUFFIXES) + ")$') THEN 'medication' ELSE 'other' END AS kind FROM repo_nodes"),
    _q("cell_types", "F19", lambda t: t.entities.where("entity_text is not null").select("entity_id", T.cell_type(F.col("entity_text")).alias("kind")), sql("E", f"SELECT entity_id, CASE WHEN {any_sql('lower(entity_text)', T.MEASURE_MARKS)} THEN 'measurement' WHEN {any_sql('lower(entity_text)', T.TIME_MARKS)} THEN 'timepoint' WHEN regexp_matches(entity_text, '[0-9]') THEN 'measurement' WHEN regexp_matches(entity_text, '^(NCT|PROTO|STUDY)') THEN 'protocol' ELSE 'table_data' END AS kind FROM e WHERE entity_text IS NOT NULL")),
    _q("json_fences", "F21", lambda t: t.raw("events").select("event_id", F.get_json_object(T.strip_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    _q("data_uris", "F26", lambda t: t.raw("part").select("p_partkey", T.data_uri(F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("p_name", "utf-8")))).alias("u")).select("p_partkey", F.col("u.extension").alias("extension"), F.decode("u.data", "utf-8").alias("body")), "SELECT p_partkey, '.png' AS extension, p_name AS body FROM part"),
    _q("previews", "F27", lambda t: t.chunks.where("content is not null").select("chunk_id", T.preview(F.col("content")).alias("preview")), sql("C", "SELECT chunk_id, '[SEMANTIC] ' || substr(content, 1, 100) || '...' AS preview FROM c WHERE content IS NOT NULL")),
    _q("word_window_chunks", "N11", lambda t: C.word_windows(t.documents, "doc_id", "text", 100, 20).select("doc_id", "window", "start_word", "words", F.md5("text").alias("digest")),
       f"SELECT doc_id, CAST(s // 80 AS INTEGER) AS window, CAST(s AS INTEGER) AS start_word, CAST(len(list_slice(w, s + 1, s + 100)) AS INTEGER) AS words, md5(array_to_string(list_slice(w, s + 1, s + 100), ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS s FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL))"),
    _q("segment_heuristic", "M12 F11", lambda t: C.segments(t.documents.where("text is not null").withColumn("key", F.col("doc_id").cast("string")), "key", "text", "n_tokens", 128).select("segment_key", "segment_index", "segment_count", "start_word", "token_count", "char_count"),
       f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS key, text, CAST(coalesce(n_tokens, 0) AS INTEGER) AS t, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT *, t > 128 AND len(w) > 0 AS many, CAST(CASE WHEN t > 128 AND len(w) > 0 THEN greatest(1, ceil(len(w) / ceil(t / 128.0))) ELSE greatest(1, len(w)) END AS INTEGER) AS per FROM w), s AS (SELECT *, unnest(CASE WHEN many THEN range(0, len(w), per) ELSE [0] END) AS a FROM p), x AS (SELECT *, CAST(a // per AS INTEGER) AS i, list_slice(w, a + 1, a + per) AS part FROM s)
        SELECT CASE WHEN i = 0 THEN key ELSE key || '-part' || lpad(CAST(i AS VARCHAR), 2, '0') END AS segment_key, i AS segment_index, CAST(CASE WHEN many THEN ceil(len(w) / per) ELSE 1 END AS INTEGER) AS segment_count, CAST(a AS INTEGER) AS start_word, CAST(CASE WHEN many THEN least(128, CASE WHEN round_even(len(part) * (t / len(w)), 0) <= 0 THEN len(part) ELSE round_even(len(part) * (t / len(w)), 0) END) ELSE t END AS INTEGER) AS token_count, CAST(CASE WHEN many THEN length(array_to_string(part, ' ')) ELSE length(text) END AS INTEGER) AS char_count FROM x"""),
    _q("semantic_chunks", "N12 M11 A41", lambda t: C.semantic_chunks(t.documents, "doc_id", "text", 120, 20, 40, 200).drop("text")),
    _q("section_windows", "F23", lambda t: C.section_windows(t.documents, "doc_id", "text", size=1_500, back=300, overlap=100, least=50).select("doc_id", "section", "start_char", "end_char")),
]


def _sections(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    l = _lines(t).withColumn("start_char", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # noqa: E741
    l = l.withColumn("whole", F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id")) - 1)  # noqa: E741
    k = l.where("trim(line) <> ''").withColumn("section", T.section_type(F.col("line"))).where("section <> 'unknown'")
    return k.select("doc_id", "section", "start_char", F.coalesce(F.lead("start_char").over(w), "whole").alias("end_char"))


def _flags(t: Tables) -> DataFrame:
    j = t.entities.join(t.chunks.select("chunk_id", "content"), "chunk_id").where("content is not null and start_char is not null and end_char is not null")
    return j.select("entity_id", T.context_flags(F.col("content"), F.col("start_char"), F.col("end_char"), F.col("entity_type")).alias("f")).select("entity_id", "f.*")


_STUDY_SQL = "SELECT doc_id, coalesce(upper(regexp_replace(nct_id, '[^A-Za-z0-9]', '', 'g')), '') AS nct, title, phase FROM documents"


def _studies(t: Tables) -> DataFrame:
    """Study payloads made of the documents, as JSON text."""
    d = t.documents
    study = F.struct(
        F.struct(F.struct(F.col("nct_id").alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"), F.struct(F.array("phase").alias("phases")).alias("designModule")).alias("protocolSection"),
        F.struct(F.struct(F.array(F.struct(F.col("document_type").alias("label"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))).alias("largeDocs")).alias("largeDocumentModule")).alias("documentSection"),
    )
    return A.parse_studies(d.select("doc_id", F.to_json(study).alias("payload")))


def _tables(t: Tables) -> DataFrame:
    """Table artefacts made of the chunks: their text as a cell."""
    item = F.struct(F.col("chunk_id").alias("id"), F.col("section_title").alias("caption"), F.lit(None).cast("string").alias("markdown"), F.concat(F.lit("<table><tr><td>"), F.col("parser"), F.lit("</td><th class='x'>week 4</th><td>12 mg</td><td>ok</td></tr></table>")).alias("html"))
    return t.chunks.select(F.col("chunk_id").alias("document"), F.array(item).alias("items"))


SOURCES = [
    _q("study_metadata", "S4", lambda t: A.study_metadata(_studies(t)).select("nct_id", "brief_title", F.array_join("phases", ",").alias("phases"), "overall_status"), f"SELECT nct AS nct_id, coalesce(title, '') AS brief_title, coalesce(phase, '') AS phases, '' AS overall_status FROM ({_STUDY_SQL}) WHERE nct <> ''"),
    _q("study_documents", "S5", lambda t: A.study_documents(_studies(t), "https://documents.example.org/").select("nct_id", "filename", "document_type", "document_url"),
       "SELECT nct AS nct_id, 'f' || doc_id || '.pdf' AS filename, coalesce(nullif(document_type, ''), 'Study Document') AS document_type, 'https://documents.example.org/' || right(nct, 2) || '/' || nct || '/f' || doc_id || '.pdf' AS document_url FROM (SELECT doc_id, document_type, upper(regexp_replace(nct_id, '[^A-Za-z0-9]', '', 'g')) AS nct FROM documents) WHERE nct <> ''"),
    _q("text_fallback", "S8 S10", lambda t: t.documents.where("text is not null").select("doc_id", F.md5(A.text_fallback(F.col("text"))["html"]).alias("html"), A.text_fallback(F.col("text"))["character_count"].alias("size")), "SELECT doc_id, md5('<p>' || replace(text, chr(10), '<br/>') || '</p>') AS html, CAST(length(text) AS INTEGER) AS size FROM documents WHERE text IS NOT NULL"),
    _q("table_segments", "S13", lambda t: A.table_segments(_tables(t), "document", "items").select("chunk_id", "table_id", "caption", "text"), sql("C", "SELECT 'table-' || chunk_id AS chunk_id, chunk_id AS table_id, nullif(trim(coalesce(section_title, '')), '') AS caption, CASE WHEN trim(coalesce(section_title, '')) <> '' THEN trim(section_title) ELSE '<table><tr><td>' || parser || '</td><th class=''x''>week 4</th><td>12 mg</td><td>ok</td></tr></table>' END AS text FROM c")),
    _q("html_cells", "S15 F19", lambda t: A.table_cells(_tables(t), "document", "items").select("document", "cell_index", "text", "entity_type"), sql("C", "SELECT chunk_id AS document, CAST(i AS INTEGER) AS cell_index, CASE i WHEN 0 THEN parser WHEN 1 THEN 'week 4' ELSE '12 mg' END AS text, CASE i WHEN 0 THEN 'table_data' WHEN 1 THEN 'timepoint' ELSE 'measurement' END AS entity_type FROM c, unnest([0, 1, 2]) AS u(i) UNION ALL SELECT chunk_id, NULL, section_title, 'table_caption' FROM c WHERE coalesce(section_title, '') <> ''")),
    _q("figure_segments", "S14 S16", lambda t: _figures(t), sql("C", "SELECT 'figure-' || chunk_id || '-caption' AS chunk_id, 'figure_caption' AS artefact_type, page_number AS page_reference FROM c WHERE trim(coalesce(section_title, '')) <> '' UNION ALL SELECT 'figure-' || chunk_id || '-image', 'figure_image', page_number FROM c")),
    _q("chunk_uuids", "S11 V5", lambda t: t.chunks.select("chunk_id", ids.stable_chunk_uuid(F.col("chunk_id")).alias("uuid")), sql("C", "SELECT chunk_id, lower(chunk_id) AS uuid FROM c")),
    _q("vocabulary_nodes", "V5 S22", lambda t: t.nodes.select("code", ids.node_id(F.col("vocabulary"), F.col("code")).alias("node_id"), F.length(ids.row_checksum(F.col("display_name"), F.col("is_active"))).alias("checksum_size")), "SELECT code, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS node_id, 64 AS checksum_size FROM (SELECT code, sha1(unhex('" + ids.NODE_NAMESPACE.hex + "') || encode(vocabulary || ':' || code)) AS h FROM repo_nodes)"),
    _q("release_checksum", "V6", lambda t: VO.release_checksum(t.nodes.select(F.col("code").alias("name"), F.sha2(F.encode("display_name", "utf-8"), 256).alias("checksum"))), "SELECT sha256(string_agg(code || '=' || sha256(display_name), '' ORDER BY code || '=' || sha256(display_name))) AS checksum FROM repo_nodes"),
]


def _figures(t: Tables) -> DataFrame:
    page = F.col("page_number").cast("string")
    none = F.lit(None).cast("string")
    item = F.struct(F.col("chunk_id").alias("id"), F.col("section_title").alias("caption"), F.lit("x.png").alias("image_path"), none.alias("image_uri"), F.array(F.struct(none.alias("page_no"), page.alias("page"), none.alias("page_number"))).alias("provenance"))
    return A.figure_segments(t.chunks.select(F.col("chunk_id").alias("document"), F.array(item).alias("items")), "document", "items").select("chunk_id", "artefact_type", "page_reference")


# A fixed direction in the 64 dimensions of the table of vectors: 1, 2, 3 and so on.
_DIRECTION = [float(i) for i in range(1, 65)]
_DIRECTION_SQL = "list_transform(range(1, 65), lambda i: CAST(i AS DOUBLE))"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_DIRECTION_SQL})"


def _vec(t: Tables) -> DataFrame:
    return t.raw("embeddings")


VECTORS = [
    _q("knn_cosine", "M1 O6 R4 R10", lambda t: nearest_chunks(_DIRECTION, _vec(t).withColumn("vec_id", F.col("vec_id").cast("string")), 10, id_col="vec_id").select("vec_id", r6(F.col("similarity"), "similarity"), r6(F.col("similarity_half"), "similarity_half")), f"SELECT CAST(vec_id AS VARCHAR) AS vec_id, round(s, 6) AS similarity, round(1 - (1 - s) / 2, 6) AS similarity_half FROM (SELECT vec_id, {_COS} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10"),
    _q("knn_filtered", "R4 R10", lambda t: nearest_chunks(_DIRECTION, _vec(t).where("label = 2").withColumn("vec_id", F.col("vec_id").cast("string")), 5, id_col="vec_id").select("vec_id", r6(F.col("similarity"), "similarity")), f"SELECT CAST(vec_id AS VARCHAR) AS vec_id, round({_COS}, 6) AS similarity FROM embeddings WHERE label = 2 ORDER BY {_COS} DESC, vec_id LIMIT 5"),
    _q("l2_normalise", "M2", lambda t: _vec(t).select("vec_id", F.posexplode(V.l2_normalise(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", r6(F.col("x"), "x")), "SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(unnest(v), 6) AS x FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"),
    _q("hash_embedding", "M3", lambda t: t.nodes.select("code", F.posexplode(V.hash_embedding(F.col("display_name"), 32)).alias("i", "x")).select("code", "i", r6(F.col("x"), "x")), "SELECT code, CAST(i AS INTEGER) AS i, round(v[i + 1] / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT code, list_transform(range(0, 32), lambda i: CAST(strpos('0123456789abcdef', substr(h, i * 2 + 1, 1)) - 1 AS DOUBLE) * 16 / 255.0 + (strpos('0123456789abcdef', substr(h, i * 2 + 2, 1)) - 1) / 255.0 - 0.5) AS v FROM (SELECT code, sha256(display_name) AS h FROM repo_nodes)), unnest(range(0, 32)) AS u(i)"),
    _q("int8_quantise", "M4", lambda t: _vec(t).select("vec_id", V.int8_quantise(F.col("embedding")).alias("q")).select("vec_id", r6(F.col("q.scale"), "scale"), F.array_join(F.transform("q.values", lambda x: x.cast("string")), ",").alias("vals")), "SELECT vec_id, round(s, 6) AS scale, array_to_string(list_transform(list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(-127, least(127, CAST(round_even(x / s, 0) AS INTEGER)))), lambda x: CAST(x AS VARCHAR)), ',') AS vals FROM (SELECT vec_id, embedding, CASE WHEN list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) > 0 THEN list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127.0 ELSE 1.0 END AS s FROM embeddings)"),
    _q("bf16_quantise", "M5", lambda t: _vec(t).select("vec_id", V.bfloat16_restore(V.bfloat16_bits(F.col("embedding"))).alias("v")).select("vec_id", F.size("v").alias("n"))),
    _q("vector_dims", "M6", lambda t: t.raw("chunks").dropDuplicates(["chunk_id"]).groupBy(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")).agg(F.count("*").alias("n")), "SELECT len(embedding) AS dims, count(*) AS n FROM (SELECT chunk_id, any_value(embedding) AS embedding FROM chunks GROUP BY 1) GROUP BY 1"),
    _q("similarity_benchmark", "A42 M1", lambda t: EV.similarity_benchmark(_vec(t).select(V.cosine(F.col("embedding"), F.array(*map(F.lit, _DIRECTION))).alias("similarity")), (0.1,)).select("pairs", r6(F.col("least"), "least"), r6(F.col("mean"), "mean"), r6(F.col("largest"), "largest"), r6(F.col("share_10"), "share_10")), f"SELECT count(*) AS pairs, round(min(s), 6) AS least, round(avg(s), 6) AS mean, round(max(s), 6) AS largest, round(avg(CASE WHEN s >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_10 FROM (SELECT {_COS} AS s FROM embeddings)"),
    _q("nearest_per_label", "N1 M1", lambda t: first_by(_vec(t).select("label", "vec_id", V.cosine(F.col("embedding"), F.array(*map(F.lit, _DIRECTION))).alias("s")), ["label"], [F.desc("s"), F.col("vec_id")]).select("label", "vec_id", r6(F.col("s"), "similarity")), f"SELECT label, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k FROM (SELECT label, vec_id, {_COS} AS s FROM embeddings)) WHERE k = 1"),
]

STREAMS = [
    _q("tumbling_windows", "extension", lambda t: S.tumbling(t.raw("events"), "ts", "1 hour", ["event_type"]).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    _q("event_sessions", "extension", lambda t: S.sessions(t.raw("events"), "ts", "30 minutes", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")), "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY 1, 2) GROUP BY 1"),
    _q("pending_work", "T22", lambda t: S.pending(t.entities.select("entity_id"), t.entities.where("normalized_id is not null"), "entity_id"), sql("E", "SELECT entity_id FROM e WHERE normalized_id IS NULL")),
]


def all_queries() -> list[Query]:
    """Everything this module registers."""
    return [*TEXT, *SOURCES, *VECTORS, *STREAMS]
