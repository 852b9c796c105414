from corvane.operators import chunking as C
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_long_chunk_is_five_segments(spark):
    text = " ".join(f"w{i}" for i in range(600))
    rows = spark.createDataFrame([("chunk-large", text, 600), ("small", "a b", 2), ("blank", "  ", 500), ("null", None, None)], "k string, t string, n int")
    out = C.segments(rows, "k", "t", "n", 128).orderBy("key", "segment_index").collect()
    large = [r for r in out if r.key == "chunk-large"]
    assert [r.segment_key for r in large] == ["chunk-large", *(f"chunk-large-part{i:02d}" for i in range(1, 5))]
    assert all(r.token_count <= 128 and r.segment_count == 5 for r in large) and " ".join(r.text for r in large) == text
    assert [r.text for r in out if r.key != "chunk-large"] == ["  ", None, "a b"]


def test_word_windows(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "i int, t string")
    assert [r.text for r in C.word_windows(rows, "i", "t", 3, 1).orderBy("window").collect()] == ["a b c", "c d e", "e"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(5, 40), st.integers(0, 10))
def test_packing_keeps_every_sentence(sizes, target, overlap):
    parts = [C.Sentence(f"S{i} " + "w " * (n - 1) + ".", "results", None, i, i + 1, n) for i, n in enumerate(sizes)]
    chunks = C.pack_sentences(parts, target, overlap)
    seen = [w for c in chunks for w in c.text.split() if w.startswith("S")]
    assert list(dict.fromkeys(seen)) == [f"S{i}" for i in range(len(sizes))]
    assert all(c.tokens <= max(target, max(sizes, default=0) + overlap) for c in chunks)


def test_sections_and_chunks(spark):
    text = "Cover page\nMethods\nWe did it. Then we did more.\nResults:\nIt worked. See Table 3."
    assert [(k, h) for k, h, _, _ in C.sections_of(text)] == [("methods", "Methods"), ("results", "Results:")]
    df = spark.createDataFrame([("NCT 1/x", text), ("e", ""), ("n", None)], "d string, t string")
    out = C.semantic_chunks(df, "d", "t", 10, 0, 0, 100).orderBy("chunk_index").collect()
    assert {r.d for r in out} == {"NCT 1/x"} and out[0].chunk_id == "NCT-1-x-chunk-0000" and any(r.contains_tables for r in out)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=600))
def test_large_sections_move_on(text):
    spans = list(C.large_sections(text, size=100, back=30, overlap=10, least=5))
    assert all(0 <= s < e <= len(text) and e - s <= 100 for s, e in spans) and len(spans) <= len(text) + 1


def test_page_size(spark):
    sizes = spark.range(1).select(*(C.desired_page_size(F.lit(a), F.lit(b)).alias(f"c{a}") for a, b in ((5, 4), (50, 4), (3, 0)))).first()
    assert tuple(sizes) == (20, 100, 3)
