from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import splitting as S
from corvane.llm.tokens import TOKEN, token_count
from pyspark.sql import functions as F

SHAPE = "id string, parent long, pos int, text string, piece int, cut_at string"


def test_units():
    text = "Methods\nDr. Lee gave 5 mg vs. 10 mg, e.g. once. It helped!  \n\n1. First item. Still the item.\n2) Second\nA\tB\tC\nEnd of it.Then more"
    cuts = [text[:o] for o, _ in S.boundaries(text)]
    assert cuts[0] == "Methods" and cuts[1].endswith("e.g. once.") and cuts[2].endswith("It helped!") and cuts[3].endswith("Still the item.") and cuts[4].endswith("2) Second") and cuts[5].endswith("A\tB\tC")
    assert cuts[6].endswith("End of it.") and cuts[7] == text and len(cuts) == 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Word.", "a,", "\n", "\n\n", "1. x", "Ende.", "é", "--"]), max_size=300), st.integers(8, 40), st.integers(0, 5))
def test_pieces_cover_the_text_within_the_limit(parts, limit, overlap):
    text = " ".join(parts)
    spans = [m.span() for m in TOKEN.finditer(text)]
    out = S.pieces(text, limit, overlap)
    if not spans:
        assert out == []
        return
    assert all(n <= limit and n == len(TOKEN.findall(text[s:e])) for s, e, n in out)
    starts = {s: k for k, (s, _) in enumerate(spans)}
    ends = {e: k for k, (_, e) in enumerate(spans)}
    assert out[0][0] == spans[0][0] and out[-1][1] == spans[-1][1]
    for a, b in zip(out, out[1:]):
        assert ends[a[1]] + 1 - starts[b[0]] == min(overlap, ends[a[1]] + 1)


def test_edge_cases_and_index(spark):
    long = " ".join(["One two three."] * 30)
    rows = [("a", 1, 0, long, 9, "x"), ("a", 1, 0, long, 9, "x"), ("b", 1, 1, "short", 9, "x"), ("c", 1, 2, long + " End", 9, "x"), ("n", 1, 3, None, 9, "x"), ("e", 2, 0, "", 9, "x"), ("w", None, None, "x" * 5000, 9, "x")]
    df = spark.createDataFrame(rows, SHAPE).drop("piece", "cut_at")
    out = S.split_oversized(df, "id", "parent", "pos", "text", 50, 5).orderBy("parent", "new_index").collect()
    assert {r.id for r in out} == {"a", "c"} and [r.new_index for r in out if r.id == "a"] == list(range(sum(r.id == "a" for r in out)))
    assert min(r.new_index for r in out if r.id == "c") == 2 + sum(r.id == "a" for r in out) - 1
    ends = S.unit_ends(spark.createDataFrame(rows, SHAPE), "id", "text", 50)
    assert ends.where("id = 'a'").count() == 30
    assert S.unit_ends(spark.createDataFrame([], SHAPE), "id", "text", 50).count() == 0


def test_tokens_agree_in_both_engines(spark):
    texts = ["", "a_b c-d", "né à 37,5°C … ok", "x y z", "日本語 テスト", "éa", "½ ² x", "a\x1cb", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(token_count(F.col("t"))).collect()]
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


def test_no_two_items_of_a_parent_share_a_place(spark):
    text = lambda n: " ".join(f"Word{i} says so." for i in range(n))
    rows = [("a", 1, 0, text(60)), ("b", 1, 1, text(2)), ("c", 1, 2, text(40)), ("d", 1, 3, None), ("e", 2, 0, text(3)), ("a", 1, 0, text(60))]
    df = spark.createDataFrame(rows, "id string, parent int, pos int, text string")
    cuts = S.split_oversized(df, "id", "parent", "pos", "text", 50, 5).collect()
    whole = {r.id: r.new_index for r in S.new_indexes(df, S.split_oversized(df, "id", "parent", "pos", "text", 50, 5), "id", "parent", "pos").collect()}
    split = {r.id for r in cuts}
    places = [r.new_index for r in cuts] + [n for i, n in whole.items() if i not in split]
    assert set(whole) == {"a", "b", "c", "d"} and split == {"a", "c"} and sorted(places) == list(range(len(places)))
    assert all(r.new_index == whole[r.id] + r.piece for r in cuts)
