import pytest
from pyspark.sql import functions as F

from corvane.llm import residue as R
from corvane.llm import vocabulary as V

NODES = [("rx", "1", "metoprolol", ["MTP-1234", "Lopresor"]), ("sn", "2", "acute renal vasculitis", ["renal vasculitis, acute type", "ARVAS"]), ("sn", "3", "chronic renal vasculitis", []), ("lo", "4", "plasma ferritin level", None)]
SHAPE = "vocabulary string, code string, name string, synonyms array<string>, value string"


def _map(spark, values, **limits):
    nodes = spark.createDataFrame([(*n, None) for n in NODES], SHAPE)
    df = spark.createDataFrame([(v, "x") for v in values], "text string, code string")
    return {r.value: r.code for r in V.map_values(df, "text", nodes, ["vocabulary", "code"], "name", "synonyms", **limits).collect()}


CASES = {
    "Metoprolol": "1", "metoprolól": "1", "metoprollol": "1", "metorpolol 50 mg": "1", "metoprolol tablets": "1", "mtp 1234": "1", "MTP-1243": None, "metop-rolol": "1",
    "renal vasculitis, acute": "2", "ac. renal vasculitis": "2", "hx of chronic renal vasculitiss": "3", "renal vasculitis": None, "juvenile renal vasculitis": None, "ARVAS": "2",
    "plasma ferritin level (central lab)": "4", "phlasma ferritin levle": "4", "serum ferritin level": None, "study drug": None, "???": None,
}


@pytest.mark.parametrize("limits", [{}, {"rows_per_task": 1}, {"most_broadcast": 0}])
def test_values(spark, limits):
    got = _map(spark, [*CASES, None, "", "  "], **limits)
    assert got == CASES


def test_mentions_keep_every_id_once(spark):
    nodes = spark.createDataFrame([(*n, None) for n in NODES], SHAPE)
    m = spark.createDataFrame([("a", "metoprolol", 1), ("a", "metoprolol", 1), ("b", None, 2), ("c", " ", 3), ("d", "unknown thing", 4)], "id string, text string, salt int")
    mapped = V.map_values(m, "text", nodes, ["vocabulary", "code"], "name", "synonyms")
    got = {r.id: (r.vocabulary, r.code) for r in V.map_mentions(m, "id", "text", mapped, ["vocabulary", "code"]).collect()}
    assert got == {"a": ("rx", "1"), "b": ("none", "none"), "c": ("none", "none"), "d": ("none", "none")}
    assert V.map_values(m.limit(0), "text", nodes, ["code"], "name", "synonyms").count() == 0
    assert {r.code for r in V.map_values(m, "text", nodes.limit(0), ["code"], "name", "synonyms").collect()} <= {None}


REAL = "The safety board reviewed the results of the study at week 4 and found that the treatment was given to all of the patients."
TEXTS = {
    "slot": ["Sponsor: {{ name }}", REAL + " The dose was ${dose} for all.", "Arms: [arm label: ____]", "Title\tDD-MMM-YYYY", "Centre - ____________", "Protocol [Insert date here]", "__DrugName__ was given", "%SITE_NAME% took part"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "test. test. test. test. test.", "~~~\n- - - -\n.....", "Text to follow."],
    "error": ["404 - the document you asked for does not exist\nSign in again to continue.", "Zugriff verweigert\nVorgangsnummer 12", "Access denied\n\nat handler line 3, module x"],
    "script": ["Please enable JavaScript to view this record.", "Checking your browser before opening the archive.", "Veuillez activer JavaScript pour afficher cette fiche."],
    None: [REAL, REAL + " Site 12 logged error code 404 on the diary.", "The diary application needs JavaScript, so the patients were given handsets at the start of the study.", "Doses were drawn from the set {1, 2, 4} in blocks [A, B] with <LLOQ> values [95% CI 1; 2].", "", "   ", None],
}


REPORTS = [
    "The safety board reviewed the results of the study at week 4 and found that the treatment was given to all of the patients.",
    "Doses were drawn from a set of three strengths and the diary was kept by the patients at each site of the study.",
    "A server error at one site delayed the upload of the diary, so the handsets were given to the patients at the start of the study.",
    "The application for the diary needs scripts on the handsets and the site logged each code that was shown to the patients.",
]
PAGES = [
    "Access denied", "404\nThe record you asked for does not exist", "404 - the page was not found\nSign in again to continue.", "Internal server error\nat handler line 12, module y\nSign in again to continue.", "Zugriff verweigert\nVorgangsnummer 7", "Zugriff verweigert\nVorgangsnummer 9", "Service unavailable\nReturn to the previous page.",
    "Please enable JavaScript to view this page.", "Checking your browser before opening this page.", "Veuillez activer JavaScript dans votre navigateur.", "Accept cookies to continue\nSign in again to continue.",
    "Lorem ipsum dolor sit amet", "Sample text. Text to follow.", "Replace this text with your own.",
]


@pytest.fixture(scope="module")
def model():
    long = [" ".join(REPORTS[(i + j) % 4] for j in range(4)) for i in range(40)]
    return R.learn_evidence([*PAGES * 3, *long])


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in TEXTS.items() for t in ts])
def test_evidence(kind, text, model):
    assert R.evidence(text, model=model)[0] == kind


def test_words_of_error_pages_become_evidence_by_themselves(model):
    alone = "at handler line 31, module q\nSign in again to continue."
    assert R.evidence(alone, model=model)[0] == "error" and R.evidence(alone)[0] is None
    assert R.evidence(" ".join(REPORTS), model=model)[0] is None
    # without real text there is nothing to learn from
    assert R.learn_evidence(PAGES).weights == {} and R.learn_evidence([]).weights == {}


def test_marking_with_and_without_broadcast(spark):
    rows = [(i, "h1", f"Menu | Home {i}\n" + t, 1) for i, t in enumerate([REAL, "Access denied", "{{x}}", REAL])] + [(9, None, None, 1), (10, None, "", 1), (11, "h2", "y " * 200_000, 1)]
    df = spark.createDataFrame(rows, "id long, host string, text string, kind int")
    few = {r.id: r.kind for r in R.mark_residue(df, "id", "host", "text").collect()}
    joined = {r.id: r.kind for r in R.mark_residue(df, "id", "host", "text", most_broadcast=0).collect()}
    assert few == joined == {0: None, 1: "error", 2: "slot", 3: None, 9: None, 10: None, 11: "filler"}
    assert R.mark_residue(df.limit(0), "id", "host", "text").count() == 0


def test_only_the_residual_is_judged(spark):
    # a line that a share of a host's records carry is boilerplate, whatever it says; the same line alone is a record of nothing else
    note = "Enable cookies for the best view"
    rows = [(i, "h", f"{note}\n{REPORTS[i % 2]} {REPORTS[1 - i % 2]}") for i in range(50)] + [(50, "h", note), (51, "other", note + "\n" + REPORTS[0])]
    got = {r.id: r for r in R.mark_residue(spark.createDataFrame(rows, "id long, host string, text string"), "id", "host", "text").collect()}
    assert {r.kind for i, r in got.items() if i < 50} == {None} and got[50].kind == "script"
    assert {r.evidence_words for i, r in got.items() if i < 50} == {0} and got[51].evidence_words == 6


def test_long_lines_and_any_spacing_are_boilerplate(spark):
    # a notice of more than 120 characters, spaced by a space that doesn't break, recurs like any other line
    note = "This archive works best if cookies are enabled in the browser; " * 3 + "see page {} of\u00a0 the guide\u2003to the browser settings"
    keys = spark.createDataFrame([(note.format(31),), (note[-40:],)], "text string").select("text", R.line_key(F.col("text")).alias("k")).collect()
    assert all(r.k == R._key(r.text) for r in keys) and len(keys[0].k) == 32
    rows = [(i, "h", f"{note.format(i)}\n{REPORTS[i % 2]} {chr(97 + i) * 3} {REPORTS[1 - i % 2]}") for i in range(20)] + [(20, "other", note.format(1) + "\n" + REPORTS[0])]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    for most in (50_000, 0):
        got = {r.id: r.evidence_words for r in R.mark_residue(df, "id", "host", "text", most_broadcast=most).collect()}
        assert {n for i, n in got.items() if i < 20} == {0} and got[20] > 0


LONG = "The page could not be found on this server because the address that was typed or followed from another site no longer leads to a record of the archive and the link that led here is out of date"


@pytest.mark.parametrize("text", [LONG, "Die gewünschte Webseite ist nicht verfügbar", "Der Webserver nicht erreichbar"])
def test_long_sentences_and_parts_of_words_are_evidence(text):
    assert R.evidence(text)[0] == "error"


def test_texts_weighed_together_are_weighed_as_alone(model):
    texts = [t or "" for ts in TEXTS.values() for t in ts] + [LONG, REAL * 40, "\n\n", "..... !", "test. test. test. test. test."]
    together = [(r.kind, r.evidence_words, r.real_words) for r in R.weigh(texts, model).itertuples()]
    assert together == [R.evidence(t, model=model) for t in texts]
    assert R.weigh([], model).empty
