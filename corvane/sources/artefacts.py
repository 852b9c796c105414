"""Sources of parsed documents: studies, files, chunk files, tables, figures, extraction results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.functions import text as T

# Endings of files that can be parsed.
DOCUMENT_ENDINGS = ("pdf", "docx", "doc", "pptx", "ppt", "html", "htm")
STUDY_SCHEMA = (
    "protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>, descriptionModule: struct<briefSummary: string>,"
    " designModule: struct<studyType: string, phases: array<string>>, outcomesModule: struct<primaryOutcomes: array<struct<measure: string>>, secondaryOutcomes: array<struct<measure: string>>>,"
    " statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, primaryCompletionDateStruct: struct<date: string>>,"
    " sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>, conditionsModule: struct<conditions: array<string>>>,"
    " documentSection struct<largeDocumentModule: struct<largeDocs: array<struct<typeAbbrev: string, label: string, filename: string, size: long>>>>"
)
CHUNK_ITEM = "struct<id: string, chunk_id: string, text: string, token_count: int, contains_tables: boolean, section_header: string, section: string, start_word_index: int, page_reference: string, page: string, page_ref: string>"


def search_query(terms: str | None, areas: Iterable[str], phases: Iterable[str], status: str | None) -> str:
    """The query string of a study search: parts joined by AND, lists by OR; ``completed`` where there are none."""
    parts = [terms] if terms else []
    if areas := list(areas):
        parts.append("(" + " OR ".join(areas) + ")")
    if phases := list(phases):
        parts.append("(" + " OR ".join(f'"{p}"' for p in phases) + ")")
    if status:
        parts.append(status.lower())
    return " AND ".join(parts) or "completed"


def search_parameters(max_studies: int, page_size: int | None = None, **query) -> dict[str, object]:
    """The parameters of a search request; a page holds 1 to 100 studies."""
    return {"format": "json", "query.term": search_query(query.get("terms"), query.get("areas", ()), query.get("phases", ()), query.get("status")), "pageSize": min(100, max(1, page_size or max_studies))}


def register_study_source(spark: SparkSession, fetch: Callable[[str, dict], dict], name: str = "studies") -> None:
    """A Python data source of one row ``(payload)`` for each study that ``fetch(path, parameters)`` finds.

    ``fetch`` does the transport; the source retries it three times with growing waits. Options: ``max_studies``,
    ``terms``, ``status``, ``areas`` and ``phases`` (comma-separated), or ``nct_id`` for one study's documents; a study
    that isn't found has no rows.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            import json
            import time

            o, split = self.options, lambda k: [x.strip() for x in self.options.get(k, "").split(",") if x.strip()]
            one = o.get("nct_id")
            path = f"studies/{one}" if one else "studies"
            parameters = {} if one else search_parameters(int(o.get("max_studies", 100)), terms=o.get("terms"), areas=split("areas"), phases=split("phases"), status=o.get("status"))
            for attempt in range(3):
                try:
                    found = fetch(path, parameters)
                    break
                except FileNotFoundError:
                    return
                except OSError:
                    if attempt == 2:
                        raise
                    time.sleep(min(8, 2**attempt) if o.get("wait", "true") == "true" else 0)
            for study in [found] if one else found.get("studies", [])[: int(o.get("max_studies", 100))]:
                yield (json.dumps(study),)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "payload string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


def download(df: DataFrame, url_col: str, fetch: Callable[[str], tuple[bytes, str | None]]) -> DataFrame:
    """S3: ``df`` with ``content`` and ``extension``; a download that fails has null content and its ``error``."""

    def load(batches):
        for b in batches:
            rows = []
            for url in b[url_col]:
                try:
                    body, kind = fetch(url)
                    rows.append((body, extension_of(kind, url), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, str(e)))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["content", "extension", "error"])], axis=1)

    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(load, f"{shape}, content binary, extension string, error string")


def extension_of(content_type: str | None, url: str) -> str:
    """S3: a file's ending from its content type or its address, ``.pdf`` in doubt."""
    kind = (content_type or "").lower()
    if "pdf" in kind:
        return ".pdf"
    if "word" in kind:
        return ".docx"
    m = re.search(r"\.(?:pdf|docx?)$", url, re.I)
    return m.group(0) if m else ".pdf"


def safe_filename(name: Column) -> Column:
    """S3: a download's name."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "document.pdf").otherwise(clean)


def parse_studies(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``study`` as a struct from JSON text; malformed text gives null."""
    return payloads.withColumn("study", F.from_json(column, STUDY_SCHEMA))


def study_metadata(df: DataFrame, study: str = "study") -> DataFrame:
    """Twelve flat fields of each study; a missing text is empty, a missing list has no items. Studies without an id are left out."""
    p = F.col(f"{study}.protocolSection")
    text = lambda *path: F.coalesce(_path(p, *path), F.lit(""))
    items = lambda *path: F.coalesce(_path(p, *path), F.array().cast("array<string>"))
    measures = lambda kind: F.coalesce(F.transform(_path(p, "outcomesModule", kind), lambda x: F.coalesce(x["measure"], F.lit(""))), F.array().cast("array<string>"))
    out = df.select(
        _path(p, "identificationModule", "nctId").alias("nct_id"), text("identificationModule", "briefTitle").alias("brief_title"), text("identificationModule", "officialTitle").alias("official_title"), text("designModule", "studyType").alias("study_type"),
        items("designModule", "phases").alias("phases"), items("conditionsModule", "conditions").alias("conditions"), measures("primaryOutcomes").alias("primary_outcomes"), measures("secondaryOutcomes").alias("secondary_outcomes"),
        text("statusModule", "overallStatus").alias("overall_status"), text("statusModule", "startDateStruct", "date").alias("start_date"), text("statusModule", "primaryCompletionDateStruct", "date").alias("completion_date"), text("sponsorCollaboratorsModule", "leadSponsor", "name").alias("lead_sponsor"),
    )
    return out.where(F.coalesce("nct_id", F.lit("")) != "")


def _path(column: Column, *names: str) -> Column:
    for n in names:
        column = column[n]
    return column


def study_documents(df: DataFrame, base_url: str, study: str = "study") -> DataFrame:
    """``(nct_id, filename, size, document_type, content_type, document_url)`` of each study's documents."""
    nct = F.upper(F.trim(F.col(f"{study}.protocolSection.identificationModule.nctId")))
    docs = df.select(nct.alias("nct_id"), F.explode(F.col(f"{study}.documentSection.largeDocumentModule.largeDocs")).alias("d"))
    full = lambda c: F.when(c != "", c)
    kind = F.coalesce(full(F.col("d.label")), full(F.col("d.typeAbbrev")), F.lit("Study Document"))
    url = F.concat_ws("/", F.lit(base_url.rstrip("/")), F.right("nct_id", F.lit(2)), F.col("nct_id"), F.col("d.filename"))
    kept = docs.where((F.coalesce("d.filename", F.lit("")) != "") & (F.coalesce("nct_id", F.lit("")) != ""))
    return kept.select("nct_id", "d.filename", "d.size", kind.alias("document_type"), F.lit("application/pdf").alias("content_type"), url.alias("document_url"))


def documents_first(df: DataFrame, sequence: str, study: str = "study") -> DataFrame:
    """Studies with documents before those without, each part in its own order."""
    docs = F.col(f"{study}.documentSection.largeDocumentModule.largeDocs")
    has = F.coalesce(F.exists(docs, lambda d: F.coalesce(d["filename"], F.lit("")) != ""), F.lit(False))
    return df.withColumn("has_documents", has).orderBy(F.desc("has_documents"), sequence)


def discover_files(spark: SparkSession, root: str, endings: Iterable[str] = DOCUMENT_ENDINGS) -> DataFrame:
    """``(study, document, path, modified, bytes)`` of the files of a tree ``root/<study>/<file>`` that can be parsed, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join([*endings, *(e.upper() for e in endings)]) + "}").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("study"), F.element_at(parts, -1).alias("document"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("study", "document")


def parse_documents(files: DataFrame, parse: Callable[[bytes, str], dict], fallback: Callable[[bytes], str | None] | None = None, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """``(path, status, plain_text, markdown, html, tables, error)`` of files ``(path, content)``.

    ``parse`` is tried, then again without tables, then ``fallback`` gives plain text, then ``ocr``; a file that none of them
    reads has status ``failed`` and its error. Parsers are what the caller brings: models run outside this engine.
    """
    import html as H

    def work(batches):
        for b in batches:
            rows = []
            for path, body in zip(b["path"], b["content"], strict=True):
                error = None
                for tables in ("with_tables", "without_tables"):
                    try:
                        r = parse(body, tables)
                        rows.append((path, "parsed" if tables == "with_tables" else "parsed_without_tables", r.get("plain_text", ""), r.get("markdown", ""), r.get("html", ""), r.get("tables", []), None))
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                else:
                    for status, read in (("text_fallback", fallback), ("ocr", ocr)):
                        text = read(body) if read else None
                        if text:
                            rows.append((path, status, text, text, f"<p>{H.escape(text, quote=False)}</p>".replace("\n", "<br/>"), [], error))
                            break
                    else:
                        rows.append((path, "failed", None, None, None, [], error))
            yield pd.DataFrame(rows, columns=["path", "status", "plain_text", "markdown", "html", "tables", "error"])

    return files.select("path", "content").mapInPandas(work, "path string, status string, plain_text string, markdown string, html string, tables array<string>, error string")


def join_pages(pages: Column) -> Column:
    """The text of a document from its pages: each without blanks around it, empty ones left out; null if nothing is left."""
    text = F.array_join(F.filter(F.transform(pages, lambda p: F.trim(p)), lambda p: p != ""), "\n")
    return F.when(text != "", text)


def text_fallback(text: Column) -> Column:
    """``struct<plain_text, markdown, html, character_count>`` of a document that only gave text."""
    html = F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    return F.when(text.isNotNull(), F.struct(text.alias("plain_text"), text.alias("markdown"), html.alias("html"), F.length(text).alias("character_count")))


def read_chunk_files(spark: SparkSession, paths: str | list[str], nct_id: str | None = None, limit: int | None = None) -> DataFrame:
    """``(nct_id, document_id, chunk_index, chunk_id, chunk_uuid, content, token_count, status, sequence_index)`` of chunk files.

    A file ``<nct_id>/<document>.json`` holds a list of chunks or an object with a list ``chunks``; one that is neither
    gives a row of status ``failed`` without a chunk. A chunk without an id gets one from its place. The order is that of
    study, file and place.
    """
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = F.split(F.url_decode("path"), "/")
    listed, wrapped = F.from_json("value", f"array<{CHUNK_ITEM}>"), F.from_json("value", f"struct<chunks: array<{CHUNK_ITEM}>>")
    is_list = F.trim("value").startswith("[")
    files = files.select(F.element_at(parts, -2).alias("nct_id"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("document_id"), F.when(is_list, listed).otherwise(wrapped["chunks"]).alias("items"))
    if nct_id:
        files = files.where(F.col("nct_id") == nct_id)
    good = files.where(F.col("items").isNotNull()).select("nct_id", "document_id", F.posexplode("items").alias("chunk_index", "c")).where(F.col("c").isNotNull())
    key = F.coalesce(F.when(F.col("c.id") != "", F.col("c.id")), F.when(F.col("c.chunk_id") != "", F.col("c.chunk_id")), F.concat_ws("-", "nct_id", "document_id", F.col("chunk_index").cast("string")))
    rows = good.select("nct_id", "document_id", "chunk_index", key.alias("chunk_id"), ids.stable_chunk_uuid(key).alias("chunk_uuid"), F.coalesce("c.text", F.lit("")).alias("content"), F.col("c.token_count").alias("token_count"), F.lit("ok").alias("status"))
    rows = rows.orderBy("nct_id", "document_id", "chunk_index")
    rows = rows.limit(limit) if limit is not None else rows
    bad = files.where(F.col("items").isNull()).select("nct_id", "document_id", F.lit("failed").alias("status"))
    return rows.unionByName(bad, allowMissingColumns=True)


def usable_chunks(df: DataFrame, text_col: str, least: int = 50) -> DataFrame:
    """Rows whose text has at least ``least`` characters without the blanks around it."""
    return df.where(F.length(F.trim(text_col)) >= least)


def normal_identifier(raw: Column, fallback: Column) -> Column:
    """An artefact's id fit for a key."""
    clean = F.regexp_replace(F.replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^[#/]+", ""), F.lit("/"), F.lit("-")), r"[^A-Za-z0-9._-]+", "-")
    clean = F.regexp_replace(clean, r"^[- ]+|[- ]+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def table_segments(df: DataFrame, document_col: str, items_col: str) -> DataFrame:
    """``(chunk_id, document, artefact_type, table_id, caption, text)`` of tables ``array<struct<id, caption, markdown, html>>``.

    The text is caption and markdown, or the HTML where there is neither; a table without text has no row.
    """
    rows = df.select(F.col(document_col).alias("document"), F.posexplode(items_col).alias("i", "t"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    blocks = F.filter(F.array(clean(F.col("t.caption")), clean(F.col("t.markdown"))), lambda x: x != "")
    text = F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(clean(F.col("t.html")))
    base = normal_identifier(F.col("t.id"), F.concat(F.col("document"), F.lit("-table-"), F.lpad(F.col("i").cast("string"), 4, "0")))
    out = rows.select(F.concat(F.lit("table-"), base).alias("chunk_id"), "document", F.lit("table").alias("artefact_type"), F.coalesce(F.when(F.col("t.id") != "", F.col("t.id")), base).alias("table_id"), F.when(clean(F.col("t.caption")) != "", clean(F.col("t.caption"))).alias("caption"), text.alias("text"))
    return out.where("text <> ''")


def figure_segments(df: DataFrame, document_col: str, items_col: str) -> DataFrame:
    """Caption and image rows of figures ``array<struct<id, caption, image_path, image_uri, provenance: array<struct<page_no, page, page_number>>>>``."""
    rows = df.select(F.col(document_col).alias("document"), F.posexplode(items_col).alias("i", "f"))
    base = normal_identifier(F.col("f.id"), F.concat(F.col("document"), F.lit("-figure-"), F.lpad(F.col("i").cast("string"), 4, "0")))
    pages = F.filter(F.transform("f.provenance", lambda p: F.coalesce(T.whole_number(p["page_no"]), T.whole_number(p["page"]), T.whole_number(p["page_number"]))), lambda p: p.isNotNull())
    parent = F.concat(F.lit("figure-"), base)
    rows = rows.select("document", parent.alias("parent_chunk_id"), F.coalesce(F.when(F.col("f.id") != "", F.col("f.id")), base).alias("figure_id"), F.get(pages, 0).alias("page_reference"), F.trim(F.coalesce("f.caption", F.lit(""))).alias("caption"), F.coalesce(F.when(F.col("f.image_path") != "", F.col("f.image_path")), F.col("f.image_uri")).alias("image_path"))
    captions = rows.where("caption <> ''").select(F.concat("parent_chunk_id", F.lit("-caption")).alias("chunk_id"), "document", F.lit("figure_caption").alias("artefact_type"), "figure_id", "parent_chunk_id", "page_reference", F.col("caption").alias("text"), F.lit(None).cast("string").alias("image_path"))
    images = rows.where("image_path <> ''").select(F.concat("parent_chunk_id", F.lit("-image")).alias("chunk_id"), "document", F.lit("figure_image").alias("artefact_type"), "figure_id", "parent_chunk_id", "page_reference", F.lit(None).cast("string").alias("text"), "image_path")
    return captions.unionByName(images)


def table_cells(df: DataFrame, document_col: str, items_col: str, least: int = 3) -> DataFrame:
    """``(document, table_index, cell_index, text, entity_type, start_char, end_char, confidence)`` of HTML table cells.

    Cells are numbered before those of fewer than ``least`` characters are left out. A caption is an entity of its own.
    """
    rows = df.select(F.col(document_col).alias("document"), F.posexplode(items_col).alias("table_index", "t"))
    cells = F.regexp_extract_all(F.coalesce("t.html", F.lit("")), F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1))
    bare = F.transform(cells, lambda c: F.trim(F.regexp_replace(_unescape(F.regexp_replace(c, r"(?s)<[^>]*>", "")), r"\s+", " ")))
    own = rows.select("document", "table_index", F.posexplode(bare).alias("cell_index", "text")).where(F.length("text") >= least)
    own = own.select("document", "table_index", "cell_index", "text", T.cell_type(F.col("text")).alias("entity_type"), F.lit(0.85).alias("confidence"))
    html = F.coalesce("t.html", F.lit("")) != ""
    captions = rows.where(html & (F.coalesce("t.caption", F.lit("")) != "")).select("document", "table_index", F.lit(None).cast("int").alias("cell_index"), F.col("t.caption").alias("text"), F.lit("table_caption").alias("entity_type"), F.lit(0.9).alias("confidence"))
    both = own.unionByName(captions)
    return both.select("document", "table_index", "cell_index", "text", "entity_type", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), "confidence")


def _unescape(text: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def caption_entities(df: DataFrame, document_col: str, items_col: str) -> DataFrame:
    """Figure captions as entities."""
    rows = df.select(F.col(document_col).alias("document"), F.posexplode(items_col).alias("figure_index", "f")).where(F.trim("f.caption") != "")
    return rows.select("document", "figure_index", F.col("f.caption").alias("text"), F.lit("figure_caption").alias("entity_type"), F.lit(0).alias("start_char"), F.length("f.caption").alias("end_char"), F.lit(0.9).alias("confidence"))


def read_extractions(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One row for each item of ``extractions`` in JSON files."""
    return spark.read.schema(f"extractions array<struct<{schema}>>").json(paths, multiLine=True).select(F.explode("extractions").alias("e")).select("e.*")


def backfill_text(target: DataFrame, texts: DataFrame, key: str, text: str, second_key: str | None = None) -> DataFrame:
    """``target`` with ``text`` filled from ``texts``, by its key, else by its second key; what it has is kept."""
    one = texts.groupBy(F.col(key).alias("_k")).agg(F.min(text).alias("_t"))
    out = target.join(one, target[key] == F.col("_k"), "left").withColumn(text, F.coalesce(F.col(text), F.col("_t"))).drop("_k", "_t")
    if second_key:
        out = out.join(one, out[second_key] == F.col("_k"), "left").withColumn(text, F.coalesce(F.col(text), F.col("_t"))).drop("_k", "_t")
    return out


def asset_provenance(kind: str, study: Column, document: Column, index: Column | None = None) -> Column:
    """Where a table, figure or text comes from."""
    ref = {"table": F.concat(F.lit("tables/"), study, F.lit("/"), document, F.lit(".json")), "figure": F.concat(F.lit("figures/"), study, F.lit("/"), document, F.lit("/"))}.get(kind, F.lit(None).cast("string"))
    return F.struct(F.lit(kind if kind in ("table", "figure") else "text").alias("asset_kind"), ref.alias("asset_ref"), (index if index is not None else F.lit(None)).cast("int").alias("asset_index"), study.alias("nct_id"), document.alias("document_id"))
