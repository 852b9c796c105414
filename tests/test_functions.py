import uuid

import numpy as np
import pytest
from corvane.functions import fuzzy, ids
from corvane.functions import text as T
from corvane.functions import vectors as V
from pyspark.sql import functions as F


def one(spark, column, **values):
    shape = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int' if isinstance(v, int) else 'array<float>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], shape).select(column.alias("x")).first().x


@pytest.mark.parametrize(("q", "want"), [
    ("What is niraparib?", "Define niraparib. niraparib mechanism of action. niraparib description. What is niraparib."),
    ("How does niraparib work?", "niraparib mechanism of action. niraparib mode of action. How does niraparib work. niraparib pharmacology."),
    ("What are adverse events with niraparib?", "What are adverse events with niraparib?"),
    ("What is the difference?", "What is the difference?"),
])
def test_rewrite(spark, q, want):
    assert one(spark, T.rewrite_query(F.col("q")), q=q) == want


def test_search_terms(spark):
    q = "What is the effect of Niraparib, on me"
    assert T.search_terms(q) == ["effect", "niraparib"] and one(spark, T.search_terms_column(F.col("q")), q=q) == ["effect", "niraparib"]
    assert T.search_terms("what?") == ["what"]


def test_router(spark):
    def route(q, images=0, **k):
        return one(spark, T.route(F.col("q"), F.lit(images), F.array().cast("array<string>"), **k), q=q)

    assert route("List the drugs").reason == "default_text_query"
    assert route("Compare the arms").model == "gpt-5-mini"
    assert route("x", images=2).reason == "multimodal_query_with_images" and route("x", images=2).estimated_tokens == 2000
    assert route("x", forced="gpt-5-mini").reason == "forced_override" and route("Compare", disabled=True).model == "gpt-4.1"


@pytest.mark.parametrize(("text", "mention", "flag"), [
    ("Patient denies chest pain today.", "chest pain", "is_negated"), ("Prior myocardial infarction in 2010.", "myocardial infarction", "is_historical"),
    ("Monitor if nausea develops.", "nausea", "is_hypothetical"), ("Mother had breast cancer.", "breast cancer", "is_family"), ("Possible infection.", "infection", "is_uncertain"),
])
def test_context_flags(spark, text, mention, flag):
    at = text.index(mention)
    got = one(spark, T.context_flags(F.col("t"), F.lit(at), F.lit(at + len(mention)), F.lit("condition")), t=text)
    assert got[flag] and sum(got) == 1
    assert one(spark, T.context_flags(F.col("t"), F.lit(at), F.lit(at + 3), F.lit("person")), t=text) is None


def test_positions(spark):
    fix = lambda t, m, s, e: one(spark, T.repaired_start(F.col("t"), F.col("m"), F.lit(s), F.lit(e)), t=t, m=m)
    assert fix("the pain", "pain", 4, 8) == 4 and fix("the pain", "pain", 1, 5) == 4 and fix("the Pain", "pain", 0, 4) == 4
    assert fix("x" * 200 + "pain", "pain", 0, 4) == 200 and fix("none", "pain", 0, 4) is None and fix("none", "  ", 0, 2) is None


def test_numbers_and_labels(spark):
    for v, want in (("3.0", 3), ("12", 12), ("", None), ("x", None), ("-2.9", -2)):
        assert one(spark, T.whole_number(F.col("v")), v=v) == want
    assert one(spark, T.type_of_label(F.lit("PERSON"), F.col("v")), v="Imatinib") == "medication"
    assert one(spark, T.section_type(F.col("v")), v="  Inclusion Criteria: ") == "inclusion_criteria"
    assert one(spark, T.strip_fences(F.col("v")), v='```json\n{"a":\n1}\n```') == '{"a": 1}'


def test_uuid5_equals_python(spark):
    for name in ("umls:C0027497", "é", "a" * 200):
        assert one(spark, ids.uuid5(ids.NODE_NAMESPACE, F.col("v")), v=name) == str(uuid.uuid5(ids.NODE_NAMESPACE, name))
    assert one(spark, T.vocabulary_code(F.col("v"), F.lit("umls")), v="UMLS:c0027497") == "C0027497" == one(spark, T.vocabulary_code(F.col("v"), F.lit("umls")), v="C0027497")


def test_quantisers(spark):
    x = [0.125, -0.5, 0.75]
    assert np.allclose(one(spark, V.bfloat16_restore(V.bfloat16_bits(F.col("v"))), v=x), x, atol=1e-2)
    assert np.allclose(one(spark, V.int8_restore(V.int8_quantise(F.col("v"))), v=x), x, atol=0.75 / 127)
    assert one(spark, V.int8_quantise(F.col("v")), v=[0.0, 0.0]).scale == 1.0
    assert one(spark, V.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))), v=[1.0, 2.0]) is None
    e = one(spark, V.hash_embedding(F.col("v")), v="text")
    assert len(e) == 512 and abs(sum(a * a for a in e) - 1) < 1e-9 and set(e[32:]) == {0.0}


def test_fuzzy(spark):
    assert fuzzy.ratio("abcd", "abed") == 75 and fuzzy.token_sort_ratio("mellitus diabetes", "diabetes mellitus") == 100
    assert one(spark, fuzzy.fuzzy_ratio(F.col("v"), F.lit("abed")), v="abcd") == 75
