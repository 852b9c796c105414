import json

from corvane.functions import ids
from corvane.sources import artefacts as A
from corvane.sources import vocabularies as V
from pyspark.sql import functions as F


def _conso(code, lang, pref, sab, tty, source, label):
    f = [""] * 18
    f[0], f[1], f[6], f[11], f[12], f[13], f[14] = code, lang, pref, sab, tty, source, label
    return "|".join(f) + "|"


def _rel(a, rel, b, rela=""):
    f = [""] * 16
    f[0], f[3], f[4], f[7], f[10] = a, rel, b, rela, "X"
    return "|".join(f) + "|"


def test_rich_release_files(spark, tmp_path):
    (tmp_path / "C.RRF").write_text("\n".join([_conso("C1", "ENG", "N", "MSH", "SY", "D1", "Homo sapiens"), _conso("C1", "ENG", "Y", "MSH", "PT", "D1", 'Human "being"'), _conso("C1", "FRE", "Y", "MSH", "PT", "D1", "Humain"), _conso("C2", "ENG", "N", "SCT", "SY", "", "Pain")]))
    (tmp_path / "S.RRF").write_text("C1|T1|A|Human type|\nC1|T2\n")
    (tmp_path / "R.RRF").write_text("\n".join([_rel("C1", "PAR", "C2"), _rel("C1", "RO", "C2", "causes"), _rel("", "RO", "C2")]))
    nodes = {r.code: r for r in V.umls_nodes(spark, str(tmp_path / "C.RRF"), str(tmp_path / "S.RRF")).collect()}
    assert nodes["C1"].display_name == 'Human "being"' and nodes["C1"].metadata.synonyms == ["Homo sapiens", 'Human "being"']
    assert nodes["C1"].metadata.semantic_types == ["Human type"] and nodes["C1"].metadata.source_codes == {"MSH": ["D1"]} and nodes["C2"].display_name == "Pain"
    assert sorted(r.predicate for r in V.umls_edges(spark, str(tmp_path / "R.RRF")).collect()) == ["PAR", "causes"]
    rx = {r.code: r.metadata.synonyms for r in V.rxnorm_nodes(spark, str(tmp_path / "C.RRF"), str(tmp_path / "R.RRF")).collect()}
    assert rx["C2"] == ["Homo sapiens", 'Human "being"', "Pain"]
    assert V.rxnorm_edges(spark, str(tmp_path / "R.RRF")).count() == 2


def test_second_format_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("id\teffectiveTime\tactive\tmoduleId\n1\t20250131\t1\tm\n2\t20250131\t0\tm\n")
    (tmp_path / "d.txt").write_text("id\tactive\tconceptId\tlanguageCode\ttypeId\tterm\n9\t1\t1\ten\t900000000000003001\tPain (finding)\n8\t1\t1\ten\t900000000000013009\tPain\n7\t1\t2\ten\t900000000000013009\tGone\n")
    (tmp_path / "r.txt").write_text("id\tactive\tsourceId\tdestinationId\ttypeId\n1\t1\t1\t2\t116680003\n2\t0\t1\t2\t116680003\n")
    (n,) = V.snomed_nodes(spark, str(tmp_path / "c.txt"), str(tmp_path / "d.txt")).collect()
    assert (n.code, n.display_name, n.metadata.synonyms, n.source_version) == ("1", "Pain (finding)", ["Pain"], "20250131")
    (e,) = V.snomed_edges(spark, str(tmp_path / "r.txt")).collect()
    assert e.predicate == "116680003" and e.source_repo_node_id == n.repo_node_id
    assert V.release_checksum(V.file_checksums(spark, str(tmp_path))).first().checksum


def test_chunk_files(spark, tmp_path):
    for study, name, body in (("NCT1", "a", [{"id": "c1", "text": "x" * 60, "token_count": 5}, {"text": "short"}]), ("NCT1", "b", {"chunks": [{"chunk_id": "c2", "text": "y"}]}), ("NCT2", "bad", "{not json")):
        (tmp_path / study).mkdir(exist_ok=True)
        (tmp_path / study / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    rows = {(r.document_id, r.chunk_index): r for r in A.read_chunk_files(spark, str(tmp_path / "*" / "*.json")).collect()}
    assert rows["a", 0].chunk_id == "c1" and rows["a", 1].chunk_id == "NCT1-a-1" and rows["b", 0].chunk_id == "c2"
    assert rows["bad", None].status == "failed" and A.read_chunk_files(spark, str(tmp_path / "*" / "*.json"), "NCT1", 2).where("status = 'ok'").count() == 2
    assert A.usable_chunks(A.read_chunk_files(spark, str(tmp_path / "*" / "*.json")), "content").count() == 1


def test_studies(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": " nct00000012 "}, "outcomesModule": {"primaryOutcomes": [{"measure": "OS"}, {}]}}, "documentSection": {"largeDocumentModule": {"largeDocs": [{"label": "Protocol", "filename": "p.pdf", "size": 3}, {"label": "x"}]}}}
    df = A.parse_studies(spark.createDataFrame([(0, "{}"), (1, json.dumps(study)), (2, "{bad")], "seq int, payload string"))
    (m,) = A.study_metadata(df).collect()
    assert m.brief_title == "" and m.phases == [] and m.primary_outcomes == ["OS", ""]
    (d,) = A.study_documents(df, "https://x/").collect()
    assert d.document_url == "https://x/12/NCT00000012/p.pdf" and d.document_type == "Protocol"
    assert [r.seq for r in A.documents_first(df, "seq").collect()] == [1, 0, 2]
    assert A.search_query("a", ["b", "c"], ["P1"], "COMPLETED") == 'a AND (b OR c) AND ("P1") AND completed' and A.search_query(None, [], [], None) == "completed"


def test_study_source_retries(spark, tmp_path):
    mark = str(tmp_path / "asked")

    def fetch(path, parameters):
        import json as J
        import os

        if path == "studies/NONE":
            raise FileNotFoundError
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("try again")
        os.remove(mark)
        return {"studies": [J.loads('{"a": 1}')] * 3}

    A.register_study_source(spark, fetch)
    assert spark.read.format("studies").option("max_studies", 2).option("wait", "false").load().count() == 2
    assert spark.read.format("studies").option("nct_id", "NONE").load().count() == 0


def test_parsing_falls_back(spark, tmp_path):
    def parse(body, tables):
        if body == b"bad" or tables == "with_tables" and body == b"half":
            raise ValueError("no")
        return {"plain_text": body.decode(), "markdown": "m", "html": "h", "tables": ["t"]}

    files = spark.createDataFrame([("1", b"good"), ("2", b"half"), ("3", b"bad"), ("4", b"bad")], "path string, content binary")
    got = {r.path: r.status for r in A.parse_documents(files, parse, lambda b: None, None).collect()}
    assert got == {"1": "parsed", "2": "parsed_without_tables", "3": "failed", "4": "failed"}
    (tmp_path / "S").mkdir()
    (tmp_path / "S" / "a.PDF").write_bytes(b"x")
    (tmp_path / "S" / "b.txt").write_bytes(b"x")
    assert [r.document for r in A.discover_files(spark, str(tmp_path)).collect()] == ["a.PDF"]


def test_cells_and_figures(spark):
    df = spark.createDataFrame([("d", [("t1", "Cap", None, "<table><tr><td>5&nbsp;mg</td><td>ok</td><th>NCT123</th><td><b>week</b> 4</td></tr></table>")])], "doc string, items array<struct<id:string,caption:string,markdown:string,html:string>>")
    assert [(r.cell_index, r.text, r.entity_type) for r in A.table_cells(df, "doc", "items").orderBy(F.asc_nulls_last("cell_index")).collect()] == [(0, "5 mg", "measurement"), (2, "NCT123", "measurement"), (3, "week 4", "timepoint"), (None, "Cap", "table_caption")]
    assert A.table_segments(df, "doc", "items").first().text == "Cap"
    assert A.table_segments(df.limit(0), "doc", "items").count() == 0
    nodes = V.literal_nodes(spark, [("rxnorm", "1", "x", ["y"], "drug")])
    assert nodes.first().repo_node_id == spark.range(1).select(ids.node_id(F.lit("rxnorm"), F.lit("1")).alias("x")).first().x
