from collections import defaultdict
from itertools import combinations

from corvane.llm import mixing as M
from corvane.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(hist, buckets):
    sizes = sorted(hist)
    counts = [hist[s] for s in sizes]
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))
    got = P.bucket_bounds(sizes, counts, buckets)
    best = min(cost([*c, sizes[-1]]) for c in combinations(sizes[:-1], min(buckets, len(sizes)) - 1))
    assert got[-1] == sizes[-1] and len(got) <= max(buckets, 1) and cost(got) == best


def test_containers_hold_what_fits_and_nothing_is_lost(spark):
    sizes = [(i, (i * 37) % 130) for i in range(500)] + [(900, 0), (901, 64), (901, 64), (902, 257)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("bucket", F.lit("clash")).select("doc_id", "tokens")
    out = P.pack_items(df, "doc_id", 64, buckets=8, rows_per_salt=50).collect()
    assert sum(r.tokens for r in out) == sum(n for _, n in sizes)
    room = defaultdict(int)
    for r in out:
        assert (r.container is None) == (r.tokens == 0)
        if r.container is not None:
            room[r.container] += r.tokens
    assert max(room.values()) <= 64 and sorted(room) == list(range(len(room)))
    assert {r.doc_id for r in out if r.pieces > 1} == {i for i, n in sizes if n > 64}
    assert sum(room.values()) / (64 * len(room)) > 0.85


def test_empty_tables(spark):
    assert P.pack_items(spark.createDataFrame([], "doc_id long, tokens long"), "doc_id", 64).count() == 0
    sizes = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert M.mix_sources(sizes, "doc_id", targets).count() == 0
    assert M.source_report(sizes, targets).collect()[0].source_tokens == 0


def test_mixture_reaches_shares_within_a_record(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(2000)] + [(10_000 + i, "small", 5) for i in range(100)] + [(20_000 + i, "tiny", 1) for i in range(3)] + [(30_000, None, 50), (30_001, "other", 50)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.05, 3), ("tiny", 0.05, 4), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in M.source_report(sizes, targets).collect()}
    mix = M.mix_sources(sizes, "doc_id", targets, ranges=16).collect()
    used, most = defaultdict(int), defaultdict(int)
    for r in mix:
        used[r.source] += r.tokens * r.copies
        most[r.source] = max(most[r.source], r.copies)
    assert not report["tiny"].reachable and most["tiny"] == 4 and most["small"] <= 3 and most["big"] == 1
    assert 0 <= report["big"].budget - used["big"] <= 16 and 0 <= report["small"].budget - used["small"] <= 5
    assert len(mix) == 2103 and {r.source for r in mix} == {"big", "small", "tiny"}


def test_found_queries_do_the_whole_packing_and_mixing(spark, monkeypatch):
    from corvane.llm import queries as Q

    written, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    split = {r.doc_id for r in Q.p6_found(spark, "/root/testdata/sf0.001").collect()}
    assert split == {r.doc_id for r in Q.p6_packed(spark, "/root/testdata/sf0.001").where("pieces > 1").collect()}
    short = {r.source for r in Q.p7_found(spark, "/root/testdata/sf0.001").collect()}
    assert short == {r.source for r in Q.p7_shares(spark, "/root/testdata/sf0.001").where("not reachable").collect()}
    assert any("container" in c for c in written) and any("used_tokens" in c for c in written)


def test_many_sizes_are_merged_into_classes():
    sizes, counts = list(range(1, 5_001)), [1 + i % 3 for i in range(5_000)]
    kept, merged = P.size_classes(sizes, counts, 100)
    assert len(kept) <= 100 and kept[-1] == 5_000 and sum(merged) == sum(counts) and kept == sorted(set(kept))
    assert merged[0] == sum(c for s, c in zip(sizes, counts) if s <= kept[0])
    assert P.size_classes(sizes, counts, 5_000) == (sizes, counts)
    best, near = P.bucket_bounds(sizes[:400], counts[:400], 6), P.bucket_bounds(*P.size_classes(sizes[:400], counts[:400], 80), 6)
    total = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes[:400], counts[:400]))
    assert total(best) <= total(near) <= 1.1 * total(best)


def test_the_mixture_does_not_depend_on_the_ranges(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", 1 + i % 9) for i in range(600)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 2)], "source string, target_share double, max_repeats int")
    got = [{tuple(r) for r in M.mix_sources(sizes, "doc_id", targets, ranges=n).collect()} for n in (None, 1, 37)]
    assert got[0] == got[1] == got[2]
