import random
from pathlib import Path

import pytest
from corvane import session
from corvane.functions.fuzzy import token_sort_ratio
from corvane.operators import graph as G
from corvane.operators import relational as R
from corvane.operators import sinks as K
from corvane.plans import cypher
from corvane.plans import evaluation as E
from corvane.plans import retrieval as RT
from pyspark.sql import functions as F


def test_loops_count_once(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    r = spark.createDataFrame([("1", "a", "a"), ("2", "a", "b"), ("3", None, "b")], "relation_id string, subject_entity_id string, object_entity_id string")
    assert {x.entity_id: x.relation_count for x in R.relation_counts(e, r).collect()} == {"a": 2, "b": 2, "c": 0}


def test_set_overlap_equals_brute_force(spark):
    rng = random.Random(1)
    sets = {f"s{i}": {"hot", *(f"t{rng.randrange(12)}" for _ in range(rng.randrange(8)))} for i in range(60)}
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v] + [("s0", None), (None, "hot")], "id string, item string")
    for least in (1, 3, 5):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        assert {tuple(r) for r in R.set_overlap(df, "id", "item", least).collect()} == want
    assert R.set_overlap(df.limit(0), "id", "item", 2).count() == 0


@pytest.mark.parametrize("most", [1_000, 1])
def test_overlaps_of_equal_and_large_sets_and_their_sums(spark, monkeypatch, most):
    monkeypatch.setattr(R, "_MOST_COMBINATIONS", most)  # with 1, every set of more than 3 items is a large one
    rng = random.Random(2)
    sets = {f"s{i:02d}": {f"t{rng.randrange(14)}" for _ in range(rng.randrange(9))} for i in range(25)}
    sets |= {f"x{k}": set(v) for k, v in list(sets.items())[:12]} | {"own": {"only", "here"}}
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "id string, item string")
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 3}
    got = [tuple(r) for r in R.set_overlap(df, "id", "item", 3).collect()]
    assert len(got) == len(want) and set(got) == want
    members, classes = R.overlap_classes(df, "id", "item", 3)
    assert classes.count() < members.count()
    comp = {r.id: (r.c, r.component) for r in G.overlap_components(members, classes, 3).collect()}
    near = {x: {x} for a, b, _ in want for x in (a, b)}
    for _ in near:
        for a, b, _ in want:
            near[a] = near[b] = near[a] | near[b]
    assert {k: v[1] for k, v in comp.items()} == {k: min(v) for k, v in near.items()}
    sums = R.class_sums(classes, 3).agg(F.sum("n_edges").alias("n"), F.sum("weight").alias("w")).first()
    assert (sums.n, sums.w) == (len(want), sum(w for *_, w in want))


def test_components_of_the_overlap_graph_need_no_edges(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(G, "set_overlap", None)  # would write every pair
    run, where = entry.queries(), "/root/testdata/sf0.001"
    parts = {r.part: r.n for r in run["graph_store"](spark, where).collect()}
    comp = {r.id: r.component for r in run["connected_components"](spark, where).collect()}
    assert (parts["members"], parts["communities"]) == (len(comp), len(set(comp.values())))
    for name in ("largest_component", "community_schema", "community_statistics", "community_coherence", "clustering_quality", "true_modularity"):
        assert run[name](spark, where).count()


def test_overlap_vertices_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "set_overlap", None)  # would compare all sets
    m = spark.createDataFrame([("a", "c1", "n"), ("a", "c1", "n"), ("b", "c2", None), ("none", "c3", None)], "meta_graph_id string, chunk_id string, nct_id string")
    e = spark.createDataFrame([("1", "a", "y"), ("1", "a", "y"), ("2", "a", "x"), ("3", "b", None), ("4", None, "z")], "entity_id string, meta_graph_id string, entity_text string")
    got = {r.meta_graph_id: (r.entity_count, r.description) for r in G.overlap_vertices(m, e).collect()}
    assert got == {"a": (2, "Chunk n: x, y"), "b": (1, "Chunk Unknown: ")}


def test_combinations_are_shuffled_without_their_sets(spark):
    classes = spark.createDataFrame([(1, [1, 2, 3, 4], 1), (2, [2, 3, 4], 2)], "c long, items array<long>, n long")
    one, keys = R._combinations(classes, 3)
    assert one.columns == ["c", *keys] and {t for _, t in one.dtypes} == {"bigint"}
    assert sorted(map(tuple, one.collect())) == [(1, 1, 2, 3), (1, 1, 2, 4), (1, 1, 3, 4), (1, 2, 3, 4), (2, 2, 3, 4)]
    assert [tuple(r) for r in R.class_overlaps(classes, 3).collect()] == [(1, 1, 2, 2, 3)]


def test_the_overlap_graph_reads_two_columns_of_raw_entities(spark):
    import __spark_entry__
    from corvane.session import shared_folder

    where = "/root/testdata/sf0.001"
    before = {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("stored/*")}
    other = [n for n in ("set_overlap_pairs", "overlap_graph_stats", "connected_components", "overlap_vertices") if __spark_entry__.queries()[n](spark, f"{where}/.").count() == 0]
    made = {p.name.split("-")[0] for p in Path(shared_folder(spark).removeprefix("file:")).glob("stored/*") if p.name not in before}
    assert not other and "overlap_classes" in made and not made & {"entities", "meta_graphs"}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components_equal_union_find(spark, n):
    rng = random.Random(n)
    edges = [(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(n)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(n and 33)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in G.connected_components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("lone",)], "id string")).collect()}
    assert got == {x: root(x) for x in parent} | {"lone": "lone"}


def test_communities_are_a_partition_of_bounded_size(spark):
    rng = random.Random(2)
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcd" for i in range(8) for j in range(i) if rng.random() < 0.8] + [("a0", "b0", 1.0), ("b1", "c0", 1.0), ("c1", "d0", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    rows = G.communities(df, max_size=10).where("level = 1").collect()
    size = {}
    for r in rows:
        size[r.cluster] = size.get(r.cluster, 0) + 1
    assert len(rows) == len({r.id for r in rows}) == len({x for e in edges for x in e[:2]}) and max(size.values()) <= 10
    part = spark.createDataFrame([(r.id, r.cluster) for r in rows], "id string, cluster string")
    assert G.true_modularity(part, df).first().modularity > 0.6
    assert G.communities(df, max_size=10, most_vertices=5).where("level = 1").count() == len(rows)


def test_communities_are_the_same_in_a_task_and_by_joins(spark):
    rng = random.Random(5)
    groups = [(f"g{g:02d}_{i}", f"g{g:02d}_{j}", 3.0) for g in range(8) for i in range(7) for j in range(i) if rng.random() < 0.7]
    links = [(f"g{g:02d}_{rng.randrange(7)}", f"g{g + 1:02d}_{rng.randrange(7)}", 1.0) for g in range(7)]
    edges = groups + links + [("g00_0", f"leaf{i:02d}", 1.0) for i in range(12)] + [(f"p{i:02d}", f"p{i + 1:02d}", 1.0) for i in range(25)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    rows = [sorted(map(tuple, G.communities(df, most_vertices=m).collect())) for m in (20_000, 30, 5)]
    assert rows[0] == rows[1] == rows[2]
    part = spark.createDataFrame([(i, c) for i, level, c in rows[0] if level == 1], "id string, cluster string")
    assert part.groupBy("cluster").count().where("count > 10").count() == 0
    assert G.true_modularity(part, df).first().modularity > 0.75


def test_paths(spark):
    e = spark.createDataFrame([("1", "a", "b", "p", 0.5, "x"), ("2", "b", "a", "q", None, None), ("3", "b", "c", "r", 1.0, "z")], "edge_id string, src string, dst string, predicate string, confidence double, evidence string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {(r.id, r.hops) for r in G.directed_paths(e, seeds, 3).collect()}
    assert got == {("b", 1), ("a", 2), ("c", 2)}
    near = {(r.id, r.hops) for r in G.neighbourhood(e, seeds, 2).collect()}
    assert near == {("a", 0), ("b", 1), ("c", 2)}
    reached = {r.id: (r.hops, r.predicate_path, round(r.score, 3)) for r in G.first_reached(G.directed_paths(e, seeds, 2), seeds).collect()}
    assert reached == {"b": (1, "p", 0.25), "c": (2, "p → r", 0.188)}


def test_patterns(spark):
    v = spark.createDataFrame([("a", "Entity", "drug", "x"), ("b", "Entity", "condition", "y")], "id string, label string, entity_type string, entity_text string")
    e = spark.createDataFrame([("1", "a", "b", "treats", 0.5, "x")], "edge_id string, src string, dst string, predicate string, confidence double, evidence string")
    run = lambda q: [tuple(r) for r in cypher.run_pattern(q, v, e).collect()]
    assert run("MATCH (n:Entity) RETURN count(n) AS n") == [(2,)]
    assert run("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n") == [("Entity", 2)]
    assert run("MATCH (a {entity_text: 'x'})-[r:TREATS]->(b) RETURN b.entity_id AS b, type(r) AS t") == [("b", "treats")]
    assert run("MATCH p = (a)-[r:RELATES_TO*1..2]->(b) WHERE a.entity_id IN ['a'] RETURN b.entity_text AS t, length(p) AS n LIMIT 5") == [("y", 1)]
    for bad in ("CREATE (n)", "MATCH (a)<-[r]-(b) RETURN a.id", "MATCH (a) RETURN collect(a)"):
        with pytest.raises(ValueError):
            run(bad)


def test_upserts_into_a_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    shape = "k int, v string, n int"
    K.upsert(spark, path, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], shape), ["k"])
    K.upsert(spark, path, spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], shape), ["k"], [F.desc("n")])
    assert {tuple(r)[:2] for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_repeated_keys_and_null_keys_merge_the_same_way_every_time(spark):
    shape = "k int, v string, n int"
    old = spark.createDataFrame([(1, "a", 1), (None, "b", 1)], shape)
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 2), (1, "z", 1), (None, "c", 1), (None, "d", 3)], shape)
    for rows in (new, new.orderBy(F.rand(1)), new.repartition(5)):
        assert {tuple(r) for r in K.merge_rows(old, rows, ["k"], [F.desc("n")]).collect()} == {(1, "y", 2), (None, "d", 3)}
        assert {tuple(r) for r in K.merge_rows(old, rows, ["k"]).collect()} == {(1, "z", 1), (None, "d", 3)}
    assert {tuple(r) for r in K.merge_rows(old, new.limit(0), ["k"]).collect()} == {(1, "a", 1), (None, "b", 1)}


def test_upserts_touch_only_their_partitions(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "p string, k int, v string"
    K.upsert(spark, path, spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], shape), ["p", "k"], partition_by=["p"])
    files = lambda p: sorted(f.name for f in (tmp_path / "t" / f"p={p}").glob("*.parquet"))
    before = files("a"), files("b")
    K.upsert(spark, path, spark.createDataFrame([("b", 1, "y"), ("c", 2, "z")], shape), ["p", "k"], partition_by=["p"])
    assert files("a") == before[0] and files("b") != before[1]
    assert {tuple(r) for r in spark.read.parquet(path).select("p", "k", "v").collect()} == {("a", 1, "x"), ("b", 1, "y"), ("c", 2, "z")}
    with pytest.raises(ValueError):
        K.upsert(spark, path, spark.createDataFrame([], shape), ["k"], partition_by=["p"])


def test_a_rename_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    path, shape = str(tmp_path / "t"), "k int"
    K.upsert(spark, path, spark.createDataFrame([(1,)], shape), ["k"])
    move = K._Files.move

    def fails(self, source, target):
        if source.endswith(".new"):
            raise OSError("no")
        move(self, source, target)

    monkeypatch.setattr(K._Files, "move", fails)
    with pytest.raises(OSError):
        K.upsert(spark, path, spark.createDataFrame([(2,)], shape), ["k"])
    assert [r.k for r in spark.read.parquet(path).collect()] == [1]
    # a run that died between the renames
    monkeypatch.setattr(K._Files, "move", move)
    (tmp_path / "t").rename(tmp_path / "t.old")
    K.upsert(spark, path, spark.createDataFrame([(3,)], shape), ["k"])
    assert {r.k for r in spark.read.parquet(path).collect()} == {1, 3}


def test_components_that_need_more_rounds_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    with pytest.raises(RuntimeError):
        G.connected_components(chain, most_rounds=1)
    assert {r.component for r in G.connected_components(chain).collect()} == {0}


def test_extraction_tables_and_guard(spark):
    e = "array<struct<entity_id:string,text:string,type:string,start_char:int,end_char:int,confidence:double,normalized_id:string,normalized_source:string>>"
    r = "array<struct<subject:string,predicate:string,object:string,confidence:double,evidence:string>>"
    row = ("c", "n", "d", [("1", "Drug", "medication", 9, 13, 0.9, "RXNORM:5", "rxnorm"), ("2", "drug", "medication", 2, 6, 0.9, None, None), ("3", "pain", "condition", 20, 24, 0.9, None, None)], [("DRUG", "treats", "pain", 0.5, "x"), ("drug", "treats", "unknown", 0.5, "x")])
    t = K.extraction_tables(spark.createDataFrame([row], f"chunk_id string, nct_id string, document_id string, entities {e}, relations {r}"))
    assert [(x.subject_entity_id, x.object_entity_id) for x in t["relations"].collect()] == [("2", "3")]
    assert t["links"].first().code == "5" and t["meta_graphs"].first().relation_count == 1
    kept, skipped = K.guard_edges(spark.createDataFrame([("1", "3"), ("1", "9"), (None, "3")], "s string, t string"), t["entities"], "s", "t", "entity_id")
    assert kept.count() == 1 and skipped.count() == 2


def test_span_overlap_ties_and_backfill(spark):
    m = spark.createDataFrame([("m", "c", "pain", 10, 14)], "entity_id string, chunk_id string, text string, start_char int, end_char int")
    s = spark.createDataFrame([("far", "c", "pain", 100, 104), ("half", "c", "chest pain", 12, 22), ("all", "c", "chest pain", 4, 14), ("same", "c", "pain", 10, 14)], "span_id string, chunk_id string, text string, start_char int, end_char int")
    assert R.best_overlaps(m, s, "chunk_id").first().span_id == "all"


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item string, rank int")
    truth = spark.createDataFrame([("q", "b"), ("q", "z"), ("none", "a")], "query_id string, item string")
    (m,) = E.ranking_metrics(ranked, truth).collect()
    assert (m.mrr, m.precision_1, m.recall_5, round(m.ndcg_5, 4)) == (0.5, 0.0, 0.5, 0.5)
    s = E.match_scores(spark.createDataFrame([("A ",), ("b",)], "x string"), spark.createDataFrame([("a",), ("c",)], "x string"), ["x"]).first()
    assert (s.tp, s.fp, s.fn, s.f1) == (1, 1, 1, 0.5)
    parts = spark.createDataFrame([(1.0,) * 8, (0.0,) * 8], "entity_f1 double, clinical_relevance double, relation_f1 double, coherence double, modularity double, community_quality double, mrr double, ndcg_5 double")
    assert sorted(tuple(r) for r in E.overall_scores(parts).collect()) == [(0.0, 0.0), (1.0, 1.0)]


def test_fuzzy_matches(spark):
    nodes = spark.createDataFrame([("umls", "1", "type 2 diabetes", True), ("umls", "2", "diabetes type", True), ("snomed", "3", "type 2 diabetes", False)], "vocabulary string, code string, display_name string, is_active boolean")
    values = spark.createDataFrame([("diabetes type 2",), ("nothing like it",), (None,)], "v string")
    assert [(r.value, r.code, r.confidence) for r in R.fuzzy_matches(values, "v", nodes).collect()] == [("diabetes type 2", "1", 1.0)]


def test_fuzzy_matches_equal_brute_force_with_qualifiers_and_typos(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    names = sorted({" ".join([*([rng.choice(["juvenile", "nocturnal", "chronic"])] if rng.random() < 0.7 else []), s, rng.choice(["dermatosis", "drowsiness", "headache"])]) for s in stems}) + ["", "x" * 70 + " " + "yz" * 40, None]
    nodes = [(f"v{i % 3}", str(i), n, True) for i, n in enumerate(names)]
    values = ["", " ", "SUSPECTED " + names[0].upper(), "x" * 66 + "q" + " " + "yz" * 38, "suspected" + names[1][4:]]
    for n in names[:40]:
        t = list(n)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = rng.choice("qxk")
        values += ["".join(t), f"Suspected {n}", f"quite probable {n[2:]}"]
    v, n = spark.createDataFrame([(x,) for x in values], "v string"), spark.createDataFrame(nodes, "vocabulary string, code string, display_name string, is_active boolean")
    want = {}
    for value in filter(str.strip, values):
        for vocabulary, code, name, _ in nodes:
            score = token_sort_ratio(value.strip().lower(), name) if name else 0
            if score >= 70:
                want[value, vocabulary] = min(want.get((value, vocabulary), (0, "")), (-score, code))
    want = {k: (code, round(-score / 100, 6)) for k, (score, code) in want.items()}
    for blocks in ({}, {"block": 25}):
        assert {(r.value, r.vocabulary): (r.code, r.confidence) for r in R.fuzzy_matches(v, "v", n, **blocks).collect()} == want
    assert len(want) > 40


def _stored_by(spark, folder, name):
    """The tables that a query stores on data it meets for the first time, and its rows."""
    import __spark_entry__
    from corvane.session import shared_folder

    (folder / "in").symlink_to("/root/testdata/sf0.001")
    before = {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("stored/*")}
    rows = __spark_entry__.queries()[name](spark, str(folder / "in")).collect()
    return {p.name.rpartition("-")[0] for p in Path(shared_folder(spark).removeprefix("file:")).glob("stored/*") if p.name not in before}, rows


def test_clustering_quality_stores_no_entities(spark, tmp_path):
    stored, rows = _stored_by(spark, tmp_path, "clustering_quality")
    assert len(rows) == 1 and "overlap_components" in stored and "entities" not in stored


def test_community_statistics_stores_neither_entities_nor_meta_graphs(spark, tmp_path):
    stored, rows = _stored_by(spark, tmp_path, "community_statistics")
    assert len(rows) == 1 and "communities" in stored and not stored & {"entities", "meta_graphs"}


@pytest.mark.parametrize("name", ["community_scores", "community_scores_drugs"])
def test_community_scores_store_no_entities(spark, tmp_path, name):
    stored, _ = _stored_by(spark, tmp_path, name)
    assert "communities" in stored and not stored & {"entities", "meta_graphs"}


def test_community_scores_count_repeated_mentions_once(spark):
    c = spark.createDataFrame([("a", 0, "t", 1.0)], "cluster_key string, level int, title string, occurrence double")
    m = spark.createDataFrame([("a", "g")], "cluster_key string, meta_graph_id string")
    rows = [("1", "g", "headache", "condition"), ("2", "g", "headaches", "condition"), ("3", None, "headache", "condition")]
    once, twice = (RT.community_scores("headache", c, m, spark.createDataFrame(x, "entity_id string, meta_graph_id string, entity_text string, entity_type string")).collect() for x in (rows, rows[:1] + rows))
    assert once == twice and len(once) == 1


@pytest.mark.parametrize("name", ["hybrid_retrieval", "graph_store", "context_chunks", "community_context", "community_ranking", "global_context"])
def test_retrieval_stores_neither_mentions_nor_relations(spark, tmp_path, name):
    stored, rows = _stored_by(spark, tmp_path, name)
    assert rows and "relation_counts" in stored and not stored & {"entities", "counted_entities", "relations", "meta_graphs", "chunks"}


@pytest.mark.parametrize("name", ["community_context", "community_ranking", "global_context"])
def test_retrieval_counts_no_edges_of_the_overlap_graph(spark, tmp_path, name):
    stored, rows = _stored_by(spark, tmp_path, name)
    assert rows and "communities" in stored and "overlap_sums" not in stored


def test_communities_without_edges_are_those_with_edges(spark):
    m = spark.createDataFrame([("a", 0, "a"), ("b", 0, "a"), ("c", 0, "c")], "id string, level int, cluster string")
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    v = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", None)], "meta_graph_id string, chunk_id string")
    with_edges, without = (G.community_tables(m, x, v)[0] for x in (e, None))
    assert "n_edges" not in without.columns and sorted(with_edges.drop("n_edges").collect()) == sorted(without.collect())
    assert {r.cluster_key: (r.n_nodes, r.n_edges, r.n_chunks) for r in with_edges.collect()} == {"a": (2, 1, 3), "c": (1, 0, 1)}


def test_files_of_shuffles_are_released_at_once_where_asked(spark, monkeypatch):
    calls = []
    monkeypatch.setattr("corvane.session.gc.collect", lambda: calls.append(1))
    session.release(spark, now=True)
    session.release(spark)
    session.release(spark, now=True)
    assert len(calls) == 2


def test_candidates_of_repeated_rows_and_relations_near_seeds(spark):
    rows = [("1", "g", "headache", "condition", 0.5, None, None), ("2", "g", "x", "condition", None, "C1", "umls"), ("3", None, "headache", None, 0.9, None, None), ("4", "g", "x", "condition", 0.1, None, None)]
    kind = "entity_id string, meta_graph_id string, entity_text string, entity_type string, confidence double, normalized_id string, normalized_source string"
    r = spark.createDataFrame([("r1", "1", "2"), ("r2", "2", "3"), ("r3", "3", "1"), ("r4", "4", "4")], "relation_id string, subject_entity_id string, object_entity_id string")
    once, twice = ([tuple(x) for x in RT.entity_candidates("headache", spark.createDataFrame(e, kind), R.end_counts(r), None).select("entity_id", "confidence", "relation_count").orderBy("entity_id").collect()] for e in (rows, rows + rows))
    assert once == twice == [("1", 0.5, 2), ("2", None, 2), ("3", 0.9, 2)]
    seeds = spark.createDataFrame([("1",)], "id string")
    for few in (20_000, 0):
        assert [sorted({x.relation_id for x in G.relations_near(r, seeds, n, few).collect()}) for n in (1, 2)] == [["r1"], ["r1", "r2"]]


def test_communities_of_known_components_need_no_search_for_them(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"{a:02}", f"{b:02}", 1.0) for a, b in {tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)}], "src string, dst string, weight double")
    known = G.connected_components(df)
    want = sorted(map(tuple, G.communities(df, max_size=5).collect()))
    monkeypatch.setattr(G, "connected_components", None)
    assert sorted(map(tuple, G.communities(df, max_size=5, components=known).collect())) == want
