import random

import pytest

from corvane.llm import duplicates as D

SHAPE = "id string, text string, class long, share double"


def _texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(80)]
        out.append((f"d{k}", " ".join(base)))
        for j in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(1, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((f"d{k}e{j}", " ".join(copy)))
    return out + [("x1", "same words in every copy of it"), ("x2", "Same words, in every copy of it!"), ("x2", "Same words, in every copy of it!"), ("short", "two words"), ("empty", ""), ("null", None), (None, "no id here at all")]


def _brute(rows, share, words):
    sets = {i: set(D.run_hashes(t, words).tolist()) for i, t in rows if i is not None and t is not None}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= share}


@pytest.mark.parametrize(("words", "share"), [(3, 0.6), (5, 0.8)])
def test_pairs_equal_brute_force(spark, words, share):
    rows = _texts()
    df = spark.createDataFrame([(i, t, 1, 0.1) for i, t in rows], SHAPE)
    members, links = D.similar_texts(df, "id", "text", share, words)
    got = {tuple(r) for r in D.duplicate_pairs(members, links).collect()}
    assert got == _brute(rows, share, words)


def test_a_hot_shard_is_searched_in_blocks_without_loss(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"h{k:03d}", " ".join([*base, f"own{k}"])) for k in range(90)]
    df = spark.createDataFrame([(i, t, 1, 0.1) for i, t in rows], SHAPE)
    signed = D.signatures(df, "id", "text", 3, 32, 4)
    found = D.candidate_classes(signed, 32, 128, 0.6, block=16)
    assert found.count() == 90 * 89 // 2


def test_groups_have_one_row_per_id(spark):
    rows = _texts()
    df = spark.createDataFrame([(i, t, 1, 0.1) for i, t in rows], SHAPE)
    groups = {r.id: r.group_id for r in D.duplicate_groups(*D.similar_texts(df, "id", "text", 0.6, 3)).collect()}
    assert groups["x1"] == groups["x2"] == "x1" and "short" not in groups
    for a, b in _brute(rows, 0.6, 3):
        assert groups[a] == groups[b]


def test_empty_table(spark):
    members, links = D.similar_texts(spark.createDataFrame([], SHAPE), "id", "text", 0.6, 3)
    assert members.count() == 0 and links.count() == 0


def test_tree_finds_what_lies_within_the_radius():
    rng = random.Random(5)
    prints = [rng.getrandbits(32) for _ in range(300)] + [7, 7]
    tree = D.BKTree()
    for i, p in enumerate(prints):
        tree.add(p, i)
    for q in prints[:20]:
        for r in (0, 5, 10):
            assert sorted(tree.within(q, r)) == [i for i, p in enumerate(prints) if (p ^ q).bit_count() <= r]


def test_a_text_copied_many_times_is_one_class(spark):
    same = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"
    rows = [(i, same) for i in range(3_000)] + [(10_000, same + " today"), (10_001, "no"), (10_002, None)]
    members, links = D.similar_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.6, words=3)
    got = {r.id: (r.class_id, r.copies, r.links) for r in D.duplicate_classes(members, links).collect()}
    assert len(got) == 3_001 and got[2_999] == (0, 3_000, 1) and got[10_000] == (10_000, 1, 1)


def test_texts_hashed_together_are_hashed_as_alone():
    texts = ["", "a", "a b c", "a b c a b c", "c b a", "x " * 5_000, "Ä-Ä_ä 1 2 3"]
    for words in (1, 3, 5):
        together = D.run_sets(texts, words)
        assert [x.tolist() for x in together] == [D.run_hashes(t, words).tolist() for t in texts]
    assert len(D.run_hashes("a b c a b c", 3)) == 3 and len(D.run_hashes("x " * 5_000, 3)) == 1
    assert D.run_hashes("a b c", 3).tolist() != D.run_hashes("c b a", 3).tolist()
