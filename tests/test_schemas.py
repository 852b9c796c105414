import sqlite3

from corvane import schemas
from corvane.sources import vocabularies as V


def test_every_table_has_its_keys(spark):
    for name, keys in schemas.KEYS.items():
        assert set(keys) <= set(schemas.empty(spark, name).columns)
    df = spark.createDataFrame([("a", "12", "x"), ("a", "no", "y"), (None, None, "z")], "meta_graph_id string, entity_count string, other string")
    out = schemas.conform(df, "meta_graphs")
    assert out.columns == schemas.empty(spark, "meta_graphs").columns and sorted(r.entity_count or 0 for r in out.collect()) == [0, 0, 12]
    assert {(r.meta_graph_id, r.n) for r in schemas.broken_keys(out, "meta_graphs").collect()} == {("a", 2), (None, 1)}


def test_database_source_and_fallback(spark, tmp_path):
    path = str(tmp_path / "v.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (c, n, s)")
        db.executemany("insert into t values (?, ?, ?)", [(i, f"n{i}", "x") for i in range(5)])
    assert V.database_nodes(spark, path, "select c, n, s from t order by c", "umls", 3).count() == 3
    assert V.database_nodes(spark, str(tmp_path / "none.db"), "select 1", "umls", fallback=[("1", "a", ["b"], "x")]).first().display_name == "a"
    (tmp_path / "D.RRF").write_text("C1|A|S|x|MSH|First words|N|\nC1|A|S|x|MSH|Later|N|\n")
    assert V.definitions(spark, str(tmp_path / "D.RRF")).first().definition == "First words"
