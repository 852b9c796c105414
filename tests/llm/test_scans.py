from corvane.llm import scans as S

CLEAN = ["The treatment was followed by the committee at the hospital during the open-label study of patients with headache."] * 30
SHAPE = "doc long, page_id string, pos int, page int, text string, key string"


def _pages(spark):
    rows = []
    for d in range(12):
        for p in range(3):
            body = "The treatrnent was fol-\nlowed by the c0mmittee at the hos-" if p == 0 else "pital during the open-\nlabel study of\npatients wifh headache."
            rows.append((d, f"{d}-{p}", p, p + 1 if d else None, f"Acme Trials  Protocol AB-{d}{d}{d}\n\n{body}\n\nPage {p + 1} of 3", "x"))
    rows += [(50, "50-0", 0, None, None, "x"), (50, "50-1", 1, None, "", "x"), rows[0]]
    return spark.createDataFrame(rows, SHAPE)


def _clean(spark):
    return spark.createDataFrame([(t,) for t in CLEAN], "text string")


def test_lines_and_paragraphs(spark):
    seen = S.inspect_pages(_pages(spark), _clean(spark), "doc", "page_id", "pos", "page", "text")
    kinds = {(r.line_no, r.kind) for r in S.line_kinds(seen).where("id = '3-0'").collect()}
    assert kinds == {(1, "furniture"), (6, "furniture"), (3, "misread"), (3, "split_word"), (4, "misread"), (4, "split_word")}
    second = {(r.line_no, r.kind) for r in S.line_kinds(seen).where("id = '3-1'").collect()}
    assert second == {(1, "furniture"), (7, "furniture"), (5, "misread")}
    text = {r.doc: r.text for r in S.continuous_text(seen).where("first_page = 0 and paragraph = 1").collect()}
    assert text[3].startswith("The treatment was followed by the committee at the hospital during the open-label study of patients with headache.")


def test_no_clean_texts_and_no_pages(spark):
    none = spark.createDataFrame([], "text string")
    assert S.inspect_pages(_pages(spark), none, "doc", "page_id", "pos", "page", "text").count() > 0
    assert S.line_kinds(S.inspect_pages(_pages(spark).limit(0), _clean(spark), "doc", "page_id", "pos", "page", "text")).count() == 0


def test_operations_restore_the_word():
    for seen, meant in (("treatrnent", "treatment"), ("unclcr", "under"), ("vvere", "were"), ("fr0m", "from"), ("pronoiinced", "pronounced")):
        ops = S.operations(seen, meant)
        assert ops and S.apply_operations(seen, ops) == meant
    assert S.operations("house", "mouse") is None


def test_every_confusion_is_undone_beside_any_letter(spark):
    words = ["eligibility", "delay", "below", "telephone", "model", "baseline", "modern", "screening", "unclear", "administered"]
    cases = {(w[:i] + x + w[i + len(y) :], w) for w in words for r in S.LOOKALIKES for y in r for x in r for i in range(len(w)) if x != y and w.startswith(y, i) and x[0].isalpha()}
    cases |= {("clclay", "delay"), ("cligibility", "eligibility"), ("bascline", "baseline")}
    for seen, meant in cases:
        assert S.skeleton(seen) == S.skeleton(meant)
        ops = S.operations(seen, meant)
        assert S.apply_operations(seen, ops) == meant
    cases = {(a, b) for a, b in cases if a not in words}
    found = spark.createDataFrame([(a,) for a, _ in cases], "word string")
    clean = spark.createDataFrame([(w, 50) for w in words], "word string, n long")
    got = {r.word: r.meant for r in S.judge_words(found, clean).collect()}
    assert sum(got[a] == b for a, b in cases) >= 0.99 * len(cases)


def test_editor_on_held_out_words():
    words = ["treatment", "committee", "hospital", "patients", "headache", "received", "followed", "interrupted", "randomised", "protocol", "statistical", "primary", "samples", "planned", "screened"]
    noisy = lambda w: [(w[:i] + "0" + w[i + 1 :], w) for i, c in enumerate(w) if c == "o"] + [(w[:i] + "1" + w[i + 1 :], w) for i, c in enumerate(w) if c == "l"] + [(w[:i] + "rn" + w[i + 1 :], w) for i, c in enumerate(w) if c == "m"]
    train = [p for w in words[:10] for p in noisy(w)]
    editor = S.CharEditor().fit([(a, S.operations(a, b)) for a, b in train] + [(w, ["keep"] * len(w)) for w in words[:10]])
    held = [p for w in words[10:] for p in noisy(w)]
    assert sum(editor.edit(a) == b for a, b in held) / len(held) >= 0.6


def test_insertions_and_proposals():
    # a letter read for two is replaced by the first, the second inserted
    assert S.operations("tum", "turn") == ["keep", "keep", "=r+n"] and S.apply_operations("tum", ["keep", "keep", "=r+n"]) == "turn"
    assert S.apply_operations("abc", ["delete", "+x", "keep"]) == "bxc"
    words = ["turning", "burning", "corner", "morning", "patients", "journal", "return", "modern"]
    noisy = [(w.replace("rn", "m"), w) for w in words if "rn" in w] + [("patienfs", "patients")]
    editor = S.CharEditor().fit([(a, S.operations(a, b)) for a, b in noisy] * 3 + [(w, ["keep"] * len(w)) for w in words])
    assert "attorney" in editor.proposals("attomey") and "" not in editor.proposals("m") and editor.proposals("") == {}


def test_the_bar_tells_repairs_from_chance():
    assert S._bar([], [1.0], 5) == 0.0 and S._bar([3.0, 4.0], [], 10) <= 3.0
    assert 1.0 < S._bar([3.0, 4.0, 5.0], [0.5, 1.0], 10) <= 3.0
    # a clean word that could be repaired counts by its share of all clean words
    assert S._bar([1.0, 4.0, 5.0], [2.0], 1_000) <= 1.0


def test_strange_words_are_repaired_and_others_kept(spark):
    # names that no clean text has stay as they are
    clean = spark.createDataFrame([(w, 50) for w in ("hours", "house", "patients", "visit", "before", "within", "the")], "word string, n long")
    seen = spark.createDataFrame([(w,) for w in ("bours", "wifhin", "patienfs", "xyzzymab", "house", "befoxe")], "word string")
    got = {r.word: r.meant for r in S.judge_words(seen, clean).collect()}
    assert got["bours"] == "hours" and got["wifhin"] == "within" and got["patienfs"] == "patients"
    assert got["xyzzymab"] is None and got["house"] is None


def test_every_word_trains_the_editor(spark):
    # more misread and clean words than a part holds: the parts' weights are averaged, none is left out
    pairs = [(f"{a}{b}m0de{c}", f"{a}{b}mode{c}") for a in "bdfg" for b in "aeu" for c in "lnrst"]
    near = spark.createDataFrame(pairs, "word string, meant string")
    clean = spark.createDataFrame([(b, 50) for _, b in pairs] + [("hat", 50)], "word string, n long")
    rows = near.unionByName(clean.selectExpr("word", "cast(null as string) as meant")).selectExpr("meant is null as c", "xxhash64(word) as h", "word", "meant").collect()
    for part_words, parts in ((20_000, 1), (40, 4)):
        dealt = {k: [(r.word, ["keep"] * len(r.word) if r.c else S.operations(r.word, r.meant)) for r in sorted(rows) if r.h % parts == k] for k in range(parts)}
        assert sum(map(len, dealt.values())) == 121 and all(dealt.values())
        want = S.CharEditor.mean({k: S.CharEditor().fit(x).weights for k, x in dealt.items()})
        got = S.learn_editor(near, clean, part_words)
        assert got.weights == want.weights and got.ops == want.ops == ["=o", "keep"]
    mean = S.CharEditor.mean({0: {("b", "keep"): 1.0}, 1: {("b", "keep"): 3.0, ("b", "=o"): 1.0}})
    assert mean.weights == {("b", "keep"): 2.0, ("b", "=o"): 0.5} and mean.ops == ["=o", "keep"]


def test_the_bar_of_counted_values_is_that_of_the_values():
    good, bad = [3.0, 3.0, 4.0, 5.0, 5.0], [0.5, 1.0, 1.0, 3.5]
    assert S._bar(good, bad, 10) == S._bar([(3.0, 2), (4.0, 1), (5.0, 2)], [(0.5, 1), (1.0, 2), (3.5, 1)], 10)
