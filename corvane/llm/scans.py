"""Noise in text from scanned pages: furniture, broken words and misread letters.

Pages are cut into lines with their places on the page. Page furniture is told by place: lines at the edges
whose wording, numbers and codes apart, recurs at edges of the document's pages or of the collection's and
seldom elsewhere, and page numbers that count with the pages. What is left is text in reading order, where a
line's last word may go on in the next line.

Letters are repaired by an averaged perceptron that edits characters: at every character it scores keep,
replace, delete and insert, at a line's end it scores joining. It is trained on words of the pages that no
clean text has, each aligned with the commonest clean word that looks alike, and on clean words, all of
either, in parts whose weights are averaged. At work it proposes the likeliest edits of every strange word; what they spell is
looked up in the word counts of all clean texts, as is the word that looks alike, and the proposal whose edits and
commonness weigh most is taken if it weighs more than a bar. The bar is learnt, too: between the repairs of the
training words and the best that the editor can make of clean words that need none.

Defined results: null and empty pages have no lines; a blank line is of no kind. A page number may be null, the
order of pages is that of their index. A repeated page counts once. Without clean texts no word is known, so
only signs inside words are misread. Extra columns are not read. Ties go to the commoner, then to the smaller word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut_lineage

# Letters and signs that scanning takes for one another; the first of each row stands for all.
LOOKALIKES = (("m", "rn"), ("n", "ri"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("o", "0"), ("l", "1", "i", "!", "|"), ("s", "5"), ("b", "6", "h"), ("e", "c"), ("t", "f"), ("g", "q", "9"), ("a", "ä", "à", "á", "â"), ("z", "2"))
# Marks at a line's end that aren't part of a word.
SOFT_MARKS = "¬­‐"
# Words that running text can hardly do without; two of them on a line make it text.
TEXT_WORDS = ("the", "of", "and", "to", "in", "a", "was", "were", "by", "with", "at", "for", "on", "that", "from", "or", "as", "der", "die", "und", "mit", "le", "la", "les", "et", "de", "el", "los", "en", "con")
_PAIRS = [(x, r[0]) for r in LOOKALIKES for x in r[1:] if len(x) > 1]
_SINGLES = str.maketrans({x: r[0] for r in LOOKALIKES for x in r[1:] if len(x) == 1})
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,7})"
_PAGE = re.compile(rf"^(?P<mark>page|p\.|pg\.?|seite|pág\.?|página|s\.)?\s*[|:]?\s*(?P<open>[-–—\[(<])?\s*(?P<n>{_NUMBER})\s*[-–—\])>]?(?P<of>\s*(?:/|of|von|de|sur)\s*\d{{1,4}})?$", re.I)
_TAIL = re.compile(rf"\s{{2,}}((?:page|p\.|seite)?\s*[|:]?\s*[-–\[(]?\s*{_NUMBER}\s*[-–\])]?(?:\s*(?:/|of)\s*\d{{1,4}})?)$", re.I)
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'“”‘’.,;:()[]{}?%<>=*•"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
WORDS = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"


def _spelt(c: str) -> str:
    """A character with the pairs that look like it spelt out, each sign by the first of its row."""
    pair = next((x for x, y in _PAIRS if y == c), None)
    return "".join(map(_spelt, pair)) if pair else c.translate(_SINGLES)


_SPELT = str.maketrans({c: _spelt(c) for r in LOOKALIKES for x in r for c in x} | {c: _spelt(c) for c in "abcdefghijklmnopqrstuvwxyz"})


def skeleton(word: str) -> str:
    """A spelling that a word shares with all its misread forms.

    Every character is spelt by itself, letters that look like a pair as that pair, so no confusion hides another one
    beside it: ``bclow`` and ``below`` share theirs, as do ``clclay`` and ``delay``.
    """
    return word.translate(_SPELT)


def _value(number: str) -> int | None:
    if number.isdigit():
        return int(number)
    total, last = 0, 0
    for c in reversed(number.lower()):
        v = _ROMAN[c]
        total, last = (total - v, last) if v < last else (total + v, v)
    return total


def page_lines(text: str) -> list[tuple]:
    """``(line_no, text, place, key, page_no, plain)`` of the lines with content.

    ``place`` is 1, 2 … from the top, -1, -2 … from the bottom for the two outermost lines, 0 inside; ``key`` the wording
    apart from numbers, codes, dates and misread letters; ``page_no`` the number a line consists of, ``plain`` whether it
    stands bare.
    """
    lines = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    out = []
    for k, (i, x) in enumerate(lines):
        place = k + 1 if k < 2 else k - len(lines) if k >= len(lines) - 2 else 0
        m = _PAGE.match(x.strip())
        body = _TAIL.sub("", x.strip())
        body = re.sub(r"\b[A-Z0-9]{2,5}-[A-Z0-9]+(?:-\w+)?\b|(?<![^\W\d_])[0-9][0-9.,/-]*(?![^\W\d_])", "#", body)
        key = skeleton(re.sub(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", "#", body.lower()))
        key = re.sub(r"(?:#[\s,.]*)+", "#", re.sub(r"\s+", " ", key)).strip()
        page_no = _value(m["n"]) if m else None
        plain = bool(m) and not (m["mark"] or m["open"] or m["of"])
        out.append((i, x.strip(), place, key, page_no, plain))
    return out


def read_lines(pages: DataFrame, doc_col: str, id_col: str, order_col: str, page_col: str, text_col: str) -> DataFrame:
    """``(doc, id, page_order, page_number, line_no, text, place, key, page_no, plain)``, one row per line with content."""
    kinds = dict(pages.dtypes)

    def scan(batches):
        for b in batches:
            rows = [(d, i, o, p, *x) for d, i, o, p, t in zip(b["doc"], b["id"], b["page_order"], b["page_number"], b["text"], strict=True) for x in page_lines(t)]
            out = pd.DataFrame(rows, columns=["doc", "id", "page_order", "page_number", "line_no", "text", "place", "key", "page_no", "plain"])
            yield out.astype({"page_no": "Int32", "page_number": "Int32"})

    own = pages.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.select(F.col(doc_col).alias("doc"), F.col(id_col).alias("id"), F.col(order_col).cast("int").alias("page_order"), F.col(page_col).cast("int").alias("page_number"), F.col(text_col).alias("text")).dropDuplicates(["id"])
    return own.mapInPandas(scan, f"doc {kinds[doc_col]}, id {kinds[id_col]}, page_order int, page_number int, line_no int, text string, place int, key string, page_no int, plain boolean")


def mark_furniture(lines: DataFrame, least: int = 2, common: int = 10, inside: float = 0.1) -> DataFrame:
    """``lines`` with ``furniture``: edge lines that recur at edges and hardly inside pages, and page numbers that count along."""
    edge = F.col("place") != 0
    wide = lines.groupBy("key").agg(F.sum(F.when(edge, 1).otherwise(0)).alias("at_edges"), F.sum(F.when(edge, 0).otherwise(1)).alias("inside"))
    wide = wide.where((F.col("at_edges") >= least) & (F.col("inside") <= inside * F.col("at_edges")))
    per_doc = lines.where(edge).groupBy("doc", "key").agg(F.countDistinct("id").alias("doc_pages"))
    numbers = lines.where(edge & F.col("page_no").isNotNull()).select("doc", "id", (F.col("page_no") - F.col("page_order")).alias("ahead")).distinct()
    steps = numbers.groupBy("doc", "ahead").agg(F.count("*").alias("n")).groupBy("doc").agg(F.max_by("ahead", F.struct("n", "ahead")).alias("ahead"), F.max("n").alias("steps"))
    # only edge lines are joined, which are few on a page; the keys of long texts stay out
    edges = lines.where(edge).select("doc", "id", "line_no", "key", "text", "page_no", "plain", "page_order", "page_number")
    j = edges.join(wide, "key", "left").join(per_doc, ["doc", "key"], "left").join(steps, "doc", "left")
    counts_along = (F.col("page_no") - F.col("page_order") == F.col("ahead")) & (F.col("steps") >= 2) | F.coalesce(F.col("page_no") == F.col("page_number"), F.lit(False))
    number = F.col("page_no").isNotNull() & (~F.col("plain") | counts_along)
    # a text filed many times over has its own lines at many edges: those read like text
    texty = F.size(F.array_intersect(F.split(F.lower("text"), r"\s+"), F.array(*map(F.lit, TEXT_WORDS)))) >= 2
    worded = F.col("page_no").isNull() & F.col("at_edges").isNotNull() & ((F.col("doc_pages") >= least) | (F.col("at_edges") >= common) & ~texty)
    worded = worded & ~F.col("text").rlike(r"[a-z]{2}[.,;]$") & ~F.col("text").rlike(f"[a-z][-{SOFT_MARKS}]$") & F.col("text").rlike(r"\p{L}{3}")
    furniture = j.where(F.coalesce(number, F.lit(False)) | F.coalesce(worded, F.lit(False))).select("id", "line_no", F.lit(True).alias("furniture"))
    return lines.join(furniture, ["id", "line_no"], "left").withColumn("furniture", F.coalesce("furniture", F.lit(False)))


def clean_words(texts: DataFrame, text_col: str, least: int = 2) -> DataFrame:
    """``(word, n)``: how often clean texts have a lower-case word, compounds and their parts counted apart."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORDS), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _core(token: str) -> tuple[str, int]:
    """A token without the marks around it, lower-cased, and where it starts in the token."""
    left = len(token) - len(token.lstrip(_EDGE))
    return token.strip(_EDGE + "!").lower() if token.rstrip(_EDGE).endswith("!") and not re.search(r"\w!$", token) else token.strip(_EDGE).lower(), left


def line_words(text: str, first: str | None, before: str | None) -> list[tuple[str, str, int]]:
    """``(role, word, at)`` of a line: words, and at a broken end the joined word, the compound and its two halves.

    ``first`` is the next line's first token, ``before`` the last token of the line before if that is broken. ``at`` is
    where a joined word breaks.
    """
    tokens, out = _TOKEN.findall(text), []
    broken = is_broken(text, first)
    for k, t in enumerate(tokens):
        if k == 0 and before or k == len(tokens) - 1 and broken:
            continue
        w = _core(t)[0]
        if len(w) > 1 and re.search(r"[^\W\d_]", w) and not (re.search(r"\d", w) and re.fullmatch(r"[A-Z0-9-]+", t.strip(_EDGE))):
            out.append(("word", w, 0))
    if broken:
        a, b = _core(tokens[-1][:-1])[0], _core(first)[0]
        out += [("joined", a + b, len(a)), ("compound", f"{a}-{b}", 0), ("left", a.rpartition("-")[2], 0), ("right", b.partition("-")[0], 0)]
    if before and tokens:
        a, b = _core(before[:-1])[0], _core(tokens[0])[0]
        out.append(("tail", a + b, len(a)))
    return out


def is_broken(text: str, first: str | None) -> bool:
    """Whether a line may end in a broken word that the next line, beginning with ``first``, goes on with."""
    return bool(first) and bool(re.search(r"[^\W\d_](?:-|[" + SOFT_MARKS + r"])$", text)) and bool(re.match(r"[\"'(]?[^\W\d_]", first))


def apply_operations(word: str, ops: list[str]) -> str:
    """The word that a list of operations, one a character, spells."""
    out = []
    for c, o in zip(word, ops, strict=True):
        base, _, behind = o.partition("+")
        out.append((c if base in ("keep", "") else "" if base == "delete" else base[1:]) + behind)
    return "".join(out)


class CharEditor:
    """Averaged perceptron over character operations: ``keep``, ``delete``, ``=x`` to replace by x, ``+x`` to insert x behind, ``=x+y`` for both."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}
        self.ops: list[str] = ["keep"]
        self._rows: dict[str, np.ndarray] | None = None

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        p = f"^^{word}$$"
        j = i + 2
        kind = "".join("d" if c.isdigit() else "a" if c.isalpha() else "s" for c in p[j - 1 : j + 2])
        return [f"c{p[j]}", f"p{p[j - 1]}{p[j]}", f"n{p[j]}{p[j + 1]}", f"w{p[j - 1]}{p[j]}{p[j + 1]}", f"l{p[j - 2]}{p[j - 1]}{p[j]}", f"r{p[j]}{p[j + 1]}{p[j + 2]}", f"k{kind}{p[j]}", "b"]

    def score(self, feats: list[str], op: str) -> float:
        return sum(self.weights.get((f, op), 0.0) for f in feats)

    def best(self, word: str, i: int) -> str:
        feats = self.features(word, i)
        return max(self.ops, key=lambda o: (self.score(feats, o), o == "keep"))

    def edit(self, word: str) -> str:
        """The word after the best operation at each character."""
        return apply_operations(word, [self.best(word, i) for i in range(len(word))])

    def proposals(self, word: str, places: int = 4, most: int = 3) -> dict[str, list[str]]:
        """What the likeliest edits spell, with their operations: up to ``most`` of the ``places`` changes that lose least."""
        changes = []
        for i in range(len(word)):
            scores = self._scores(word, i)
            j = max((k for k, o in enumerate(self.ops) if o != "keep"), key=lambda k: scores[k], default=None)
            if j is not None:
                changes.append((scores[j] - scores[self.ops.index("keep")], i, self.ops[j]))
        changes = sorted(changes, reverse=True)[:places]
        out: dict[str, list[str]] = {}
        for n in range(1, most + 1):
            for some in combinations(changes, n):
                ops = ["keep"] * len(word)
                for _, i, o in some:
                    ops[i] = o
                out.setdefault(apply_operations(word, ops), ops)
        out.pop(word, None)
        return out

    def _scores(self, word: str, i: int) -> np.ndarray:
        """The scores of all operations at a character."""
        if self._rows is None:
            self._rows = {}
            for (f, o), w in self.weights.items():
                self._rows.setdefault(f, np.zeros(len(self.ops)))[self.ops.index(o)] = w
        rows = [self._rows[f] for f in self.features(word, i) if f in self._rows]
        return np.sum(rows, axis=0) if rows else np.zeros(len(self.ops))

    def gain(self, word: str, ops: list[str]) -> float:
        """How much better a list of operations scores than leaving the word as it is, per changed character."""
        changed = [i for i, o in enumerate(ops) if o != "keep"]
        if not changed:
            return 0.0
        return sum(self.score(f := self.features(word, i), ops[i]) - self.score(f, "keep") for i in changed) / len(changed)

    def fit(self, pairs: list[tuple[str, list[str]]], rounds: int = 5, seed: int = 17) -> CharEditor:
        """Learn from words and their operations; the result averages the weights of all steps.

        Weights are rows of an array, a feature each, so that all operations are scored at once.
        """
        self.ops, self._rows = sorted({o for _, ops in pairs for o in ops} | {"keep"}), None
        number = {o: k for k, o in enumerate(self.ops)}
        known: dict[str, int] = {}
        cases = [[(np.array([known.setdefault(f, len(known)) for f in self.features(word, i)]), number[op]) for i, op in enumerate(ops)] for word, ops in pairs]
        now, late = np.zeros((len(known), len(self.ops))), np.zeros((len(known), len(self.ops)))
        touched = np.zeros(now.shape, dtype=bool)
        rng, step, keep = np.random.default_rng(seed), 0, number["keep"]
        for _ in range(rounds):
            for k in rng.permutation(len(cases)):
                for rows, op in cases[k]:
                    step += 1
                    scores = now[rows].sum(axis=0)
                    guess = int(scores.argmax())
                    guess = keep if scores[keep] == scores[guess] else guess
                    if guess != op:
                        # a feature that a place has twice counts twice
                        for at, by in ((op, 1.0), (guess, -1.0)):
                            np.add.at(now[:, at], rows, by), np.add.at(late[:, at], rows, by * step)
                            touched[rows, at] = True
        names = list(known)
        self.weights = {(names[f], self.ops[o]): float(step * now[f, o] - late[f, o]) / max(1, step) for f, o in zip(*np.nonzero(touched), strict=True)}
        return self

    @classmethod
    def mean(cls, parts: dict[int, dict[tuple[str, str], float]]) -> CharEditor:
        """The editor that weighs as those of several parts do on average."""
        total: dict[tuple[str, str], float] = defaultdict(float)
        for k in sorted(parts):
            for key, w in parts[k].items():
                total[key] += w / len(parts)
        out = cls()
        out.weights, out.ops = dict(sorted(total.items())), sorted({o for _, o in total} | {"keep"})
        return out


class JoinEditor(CharEditor):
    """The same perceptron at a line's end: join the halves of a word, or keep the mark between them.

    A case is ``left, mark, right, evidence`` in one string, the evidence being what clean texts know: the joined word (j),
    the compound (c), both halves as frequent words (p).
    """

    @staticmethod
    def case(left: str, mark: str, right: str, joined: int, compound: int, halves: int) -> str:
        """A case as a string."""
        seen = ("j" if joined > compound else "c" if compound > joined else "") + ("p" if halves >= 20 else "")
        return "\x1f".join((left, mark, right, seen))

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        left, mark, right, seen = word.split("\x1f")
        return [f"m{mark}", f"e{seen}", f"x{mark}{seen}", f"k{seen[:1]}", f"l{left[-2:]}", f"l{left}", f"r{right[:2]}", f"r{right}", "b"]


def operations(seen: str, meant: str) -> list[str] | None:
    """The operation at each character of a misread word that yields the word meant, or None if they don't look alike.

    Of several ways the one of fewest changes, by dynamic programming over the places in both words.
    """
    if skeleton(seen) != skeleton(meant):
        return None
    # places reached in the word meant, by place in the word seen: (changes, way to here)
    at: list[dict[int, tuple[int, tuple | None]]] = [{} for _ in range(len(seen) + 2)]
    at[0][0] = (0, None)

    def reach(i: int, j: int, cost: int, way: tuple) -> None:
        if j not in at[i] or cost < at[i][j][0]:
            at[i][j] = (cost, way)

    for i in range(len(seen)):
        for j, (cost, way) in at[i].items():
            if j == len(meant):
                continue
            if seen[i] == meant[j]:
                reach(i + 1, j + 1, cost, (way, ("keep",)))
            elif seen[i].translate(_SINGLES) == meant[j].translate(_SINGLES):
                reach(i + 1, j + 1, cost + 1, (way, ("=" + meant[j],)))
            for x, y in _PAIRS:
                if seen.startswith(x, i) and meant[j] == y:
                    reach(i + 2, j + 1, cost + 1, (way, ("=" + y, "delete")))
                if seen[i] == y and meant.startswith(x, j):
                    reach(i + 1, j + 2, cost + 1, (way, (f"={x[0]}+{x[1:]}",)))
    if len(meant) not in at[len(seen)]:
        return None
    way, steps = at[len(seen)][len(meant)][1], []
    while way:
        way, step = way
        steps.append(step)
    return [o for step in reversed(steps) for o in step]


def learn_editor(pairs: DataFrame, clean: DataFrame, part_words: int = 20_000) -> CharEditor:
    """The editor learnt from all misread words ``(word, meant)`` and all clean words ``(word)``.

    More than ``part_words`` words are dealt to parts of about that many, each learnt in a task of its own, and the parts'
    weights are averaged. The driver holds the weights.
    """
    cases = cut_lineage(pairs.select("word", "meant").unionByName(clean.select("word", F.lit(None).cast("string").alias("meant"))))
    parts = max(1, -(-cases.count() // part_words))

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        # misread words first, either kind in the order of a hash
        own = own.assign(clean=own["meant"].isna()).sort_values(["clean", "order", "word"])
        ways = [(w, ["keep"] * len(w) if m is None else operations(w, m)) for w, m in zip(own["word"], own["meant"], strict=True)]
        weights = CharEditor().fit([x for x in ways if x[1]]).weights
        return pd.DataFrame([(int(own["part"].iloc[0]), f, o, w) for (f, o), w in weights.items()], columns=["part", "feature", "op", "weight"])

    order = F.xxhash64("word")
    dealt = cases.select("word", "meant", order.alias("order"), F.pmod(order, F.lit(parts)).cast("int").alias("part"))
    found: dict[int, dict[tuple[str, str], float]] = {k: {} for k in range(parts)}
    for r in dealt.groupBy("part").applyInPandas(learn, "part int, feature string, op string, weight double").toLocalIterator():
        found[r.part][(r.feature, r.op)] = r.weight
    return CharEditor.mean(found)


def judge_words(words: DataFrame, clean: DataFrame, part_words: int = 20_000, common: int = 5) -> DataFrame:
    """``(word, n, meant)`` of distinct words: how often clean texts have it, and the word a misread one means.

    ``meant`` is null for words that aren't misread; for one without a clean likeness it is the editor's own repair. All
    misread and all clean words train the editor and set the bars.
    """
    skel = F.pandas_udf(lambda s: s.map(skeleton), "string")
    own = words.select("word").distinct().join(clean, "word", "left").na.fill(0, ["n"])
    strange = own.where(F.col("n") == 0).withColumn("parts", F.split("word", "['’/-]"))
    likeness = clean.where(F.col("n") >= common).select(F.col("word").alias("meant"), F.col("n").alias("m")).withColumn("skeleton", skel("meant"))
    alike = F.pandas_udf(lambda s, m: pd.Series([operations(a, b) is not None for a, b in zip(s, m, strict=True)], dtype=bool), "boolean")

    def lookalikes(words: DataFrame) -> DataFrame:
        """The commonest other clean word that operations lead to; words that merely share a spelling don't displace it."""
        found = words.select("word").withColumn("skeleton", skel("word")).join(likeness, "skeleton").where("word <> meant").where(alike("word", "meant"))
        return found.groupBy("word").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"), F.max("m").alias("m"))

    near = cut_lineage(lookalikes(strange))
    editor = learn_editor(near, clean, part_words)

    def propose(batches):
        for b in batches:
            rows = [(w, p, editor.gain(w, o)) for w in b["word"] for p, o in editor.proposals(w).items()]
            yield pd.DataFrame(rows, columns=["word", "meant", "gain"])

    def spelt(words: DataFrame) -> DataFrame:
        """Proposals that clean texts have, other than the word itself."""
        made = words.mapInPandas(propose, "word string, meant string, gain double")
        return made.join(clean.where(F.col("n") >= common).select(F.col("word").alias("meant"), F.col("n").alias("m")), "meant")

    gain = F.pandas_udf(lambda s, m: pd.Series([editor.gain(a, operations(a, b)) for a, b in zip(s, m, strict=True)], dtype="float64"), "double")
    worth = (F.col("gain") + F.log("m")).alias("worth")
    # a bar lies where the repairs of strange words and those that could be made of clean words, which need none, are told apart
    # best; a clean word seldom looks like another, so look-alikes have a lower bar than whatever the editor makes of a word
    near = cut_lineage(near.withColumn("gain", gain("word", "meant")).select("word", "meant", worth))
    unhurt = clean.select("word")
    # the driver gets counts by thousandths, not the words; what is good counts down to its thousandth, what is bad up
    counts = lambda df, to: [(r.at, r.k) for r in df.groupBy((to(F.col("worth") * 1000) / 1000).alias("at")).agg(F.count("*").alias("k")).collect()]
    good, total = counts(near, F.floor), unhurt.count()
    made = {"made": spelt(unhurt), "alike": lookalikes(unhurt).withColumn("gain", gain("word", "meant"))}
    bars = {s: _bar(good, counts(df.groupBy("word").agg(F.max(worth).alias("worth")), F.ceil), total) for s, df in made.items()}
    offers = spelt(strange.select("word")).select("word", "meant", worth).where(F.col("worth") >= bars["made"])
    offers = offers.unionByName(near.where(F.col("worth") >= bars["alike"]))
    chosen = offers.groupBy("word").agg(F.max_by("meant", F.struct("worth", "meant")).alias("meant"))

    def decide(word: pd.Series, meant: pd.Series) -> pd.Series:
        out = []
        for w, m in zip(word, meant, strict=True):
            if m is None and re.search(r"[^\W\d_][0-9!|](?=[^\W\d_]|$)|^[0156!|][^\W\d_]{2}", w):
                # signs inside a word are misread whatever it is
                fixed = editor.edit(w)
                m = fixed if fixed != w and fixed.replace("-", "").replace("'", "").isalpha() else None
            out.append(m)
        return pd.Series(out, dtype=object)

    judged = strange.select("word").join(chosen, "word", "left").withColumn("meant", F.pandas_udf(decide, "string")("word", "meant"))
    return own.join(judged, "word", "left")


def _bar(good: list, bad: list, clean: int) -> float:
    """The worth from which a repair is believed: the lowest value that misjudges fewest, halfway to the next worth below it.

    ``bad`` are those of ``clean`` words of which a repair could be made. A share of the strange words counts as much as the
    same share of the clean ones, whatever their numbers. Values may come with their number, as ``(worth, n)``.
    """
    if not good:
        return 0.0

    def ordered(values: list) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the number of values before each place."""
        pairs = sorted(v if isinstance(v, tuple) else (v, 1) for v in values)
        return np.array([v for v, _ in pairs], dtype=np.float64), np.concatenate([[0], np.cumsum([n for _, n in pairs], dtype=np.int64)])

    (good_, before), (bad_, below_bad) = ordered(good), ordered(bad)
    at = np.concatenate([good_, bad_ + 1e-9])
    lost = before[np.searchsorted(good_, at, side="left")] / before[-1]
    wrong = (below_bad[-1] - below_bad[np.searchsorted(bad_, at, side="left")]) / max(1, clean)
    bar = float(at[int(np.lexsort((at, lost + wrong))[0])])
    below = np.concatenate([good_[good_ < bar], bad_[bad_ < bar]])
    return (bar + float(below.max())) / 2 if len(below) else bar - 1e-9


def _place_of_change(word: str, meant: str) -> tuple[int, int]:
    """First and last changed character of a misread word."""
    ops = operations(word, meant)
    if ops is None:
        # what is alike at either end is kept
        left = next((i for i, (a, b) in enumerate(zip(word, meant, strict=False)) if a != b), min(len(word), len(meant)))
        right = next((i for i, (a, b) in enumerate(zip(word[::-1], meant[::-1], strict=False)) if a != b), 0)
        return min(left, len(word) - 1), max(left, len(word) - 1 - right)
    at = [i for i, o in enumerate(ops) if o != "keep"] or [0]
    return at[0], at[-1]


def inspect_pages(pages: DataFrame, clean_texts: DataFrame, doc_col: str, id_col: str, order_col: str, page_col: str, text_col: str, sample_ends: int = 20_000) -> DataFrame:
    """``(doc, id, page_order, line_no, text, furniture, split_word, repairs)`` of every line with content.

    ``repairs`` maps misread words of the line to the words meant; ``split_word`` tells that the last word goes on in the
    next line of text.
    """
    lines = cut_lineage(mark_furniture(cut_lineage(read_lines(pages, doc_col, id_col, order_col, page_col, text_col))))
    reading = Window.partitionBy("doc").orderBy("page_order", "id", "line_no")
    text = lines.where(~F.col("furniture")).select("id", "line_no", "text", F.regexp_extract(F.lead("text").over(reading), r"^\S+", 0).alias("first"), F.lag("text").over(reading).alias("above"))

    def words(batches):
        for b in batches:
            rows = []
            for i, n, t, f, up in zip(b["id"], b["line_no"], b["text"], b["first"], b["above"], strict=True):
                own = t.split()[0]
                before = up.split()[-1] if up and is_broken(up, own) else None
                rows += [(i, n, *x) for x in line_words(t, f, before)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "role", "word", "at"])

    kind = dict(lines.dtypes)["id"]
    found = cut_lineage(text.mapInPandas(words, f"id {kind}, line_no int, role string, word string, at int"))
    verdicts = cut_lineage(judge_words(found, cut_lineage(clean_words(clean_texts, "text"))))
    # a broken end: joined or kept as a compound
    ends = found.where("role <> 'word' and role <> 'tail'").join(verdicts, "word").groupBy("id", "line_no").agg(*(F.max(F.when(F.col("role") == r, F.col("n"))).alias(r) for r in ("joined", "compound", "left", "right")), F.max(F.when((F.col("role") == "joined"), F.col("meant"))).alias("meant"))
    halves = found.where("role in ('left', 'right')").groupBy("id", "line_no").agg(*(F.max(F.when(F.col("role") == r, F.col("word"))).alias(f"{r}_word") for r in ("left", "right")))
    ends = cut_lineage(ends.join(halves, ["id", "line_no"], "left").na.fill("", ["left_word", "right_word"]).na.fill(0, ["joined", "compound", "left", "right"]).join(lines.select("id", "line_no", F.right("text", F.lit(1)).alias("mark")), ["id", "line_no"]))
    keeper = _train_joins(ends, sample_ends)

    def keeps(left: pd.Series, mark: pd.Series, right: pd.Series, joined: pd.Series, compound: pd.Series, common: pd.Series) -> pd.Series:
        return pd.Series([keeper.best(JoinEditor.case(*x), 0) == "keep" for x in zip(left, mark, right, joined, compound, common, strict=True)], dtype=bool)

    compound = F.pandas_udf(keeps, "boolean")("left_word", "mark", "right_word", "joined", "compound", F.least("left", "right"))
    # a misread word that clean texts have when joined is a broken word
    ends = ends.select("id", "line_no", (compound & F.col("meant").isNull()).alias("compound"))
    changed = verdicts.where(F.col("meant").isNotNull()).select("word", "meant").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    split_at = F.pandas_udf(lambda w, m: pd.DataFrame([_place_of_change(a, b) for a, b in zip(w, m, strict=True)], columns=["lo", "hi"]), "lo int, hi int")
    hits = found.where("role in ('word', 'joined', 'tail')").withColumn("salt", F.pmod(F.xxhash64("id", "line_no"), F.lit(8)).cast("int")).join(changed, ["word", "salt"])
    hits = hits.withColumn("c", split_at("word", "meant"))
    mine = (F.col("role") == "word") | (F.col("role") == "joined") & (F.col("c.lo") < F.col("at")) | (F.col("role") == "tail") & (F.col("c.hi") >= F.col("at"))
    repairs = hits.where(mine).groupBy("id", "line_no").agg(F.array_sort(F.collect_set(F.struct("role", "word", "meant"))).alias("repairs"))
    marked = lines.join(ends, ["id", "line_no"], "left").join(repairs, ["id", "line_no"], "left")
    soft = F.col("text").rlike(f"[{SOFT_MARKS}]$")
    split = F.col("compound").isNotNull() & (soft | ~F.col("compound"))
    return marked.select("doc", "id", "page_order", "line_no", "text", "furniture", split.alias("split_word"), F.coalesce("compound", F.lit(False)).alias("compound"), F.coalesce("repairs", F.expr("cast(array() as array<struct<role:string,word:string,meant:string>>)")).alias("repairs"))


def _train_joins(ends: DataFrame, sample_ends: int) -> JoinEditor:
    """A perceptron for line ends from at most ``sample_ends`` of those that clean texts decide, each also without their word."""
    rows = ends.where("joined <> compound").orderBy(F.xxhash64("id", "line_no")).limit(sample_ends).collect()
    cases = []
    for r in rows:
        op = "join" if r.joined > r.compound else "keep"
        common = min(r.left, r.right)
        cases += [(JoinEditor.case(r.left_word, r.mark, r.right_word, j, c, common), [op]) for j, c in ((r.joined, r.compound), (0, 0))]
    # nothing known: what is broken is joined
    return JoinEditor().fit(cases or [(JoinEditor.case("", "-", "", 0, 0, 0), ["join"])])


def line_kinds(inspected: DataFrame) -> DataFrame:
    """``(id, line_no, kind)``: furniture, split_word, misread; other kinds aren't told of furniture."""
    text = ~F.col("furniture")
    kinds = F.array_compact(F.array(F.when(F.col("furniture"), F.lit("furniture")), F.when(text & F.col("split_word"), F.lit("split_word")), F.when(text & (F.size("repairs") > 0), F.lit("misread"))))
    return inspected.select("id", "line_no", F.explode(kinds).alias("kind"))


def _repaired(text: str, repairs: list) -> str:
    """A paragraph with its misread words set right, in the case they were written in."""
    for r in repairs:
        word, meant = r["word"], r["meant"]
        text = re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", lambda m: meant.capitalize() if m.group(0)[:1].isupper() else meant, text, flags=re.I)  # noqa: B023
    return text


def continuous_text(inspected: DataFrame) -> DataFrame:
    """``(doc, paragraph, first_page, text)``: the pages of a document as paragraphs, without furniture, words rejoined and repaired.

    A paragraph ends at a blank line, around table rows and headings, and at a page's end only where a sentence ends and
    the next line begins like one. Paragraphs are numbered from 1 in reading order.
    """
    reading = Window.partitionBy("doc").orderBy("page_order", "id", "line_no")
    t = inspected.where(~F.col("furniture"))
    alone = F.col("text").rlike(r"\S\s{3,}\S") | (F.length("text") <= 40) & F.col("text").rlike(r"^(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?\p{Lu}[\p{L} ]*$") & ~F.col("split_word")
    t = t.withColumn("alone", alone).withColumns({"up": F.lag("text").over(reading), "up_id": F.lag("id").over(reading), "up_no": F.lag("line_no").over(reading), "up_alone": F.lag("alone").over(reading), "up_joined": F.lag(F.col("split_word") | F.col("compound")).over(reading)})
    same = F.col("id") == F.col("up_id")
    ended = F.col("up").rlike(r"[.!?:][\"')\]]*$") & F.col("text").rlike(r"^[\"'(]?[\p{Lu}0-9]")
    fresh = F.col("up").isNull() | ~F.col("up_joined") & (F.col("alone") | F.col("up_alone") | same & (F.col("line_no") - F.col("up_no") > 1) | ~same & ended)
    t = t.withColumn("paragraph", F.sum(fresh.cast("int")).over(reading))
    bare = F.when(F.col("split_word"), F.regexp_replace("text", r".$", "")).otherwise(F.col("text"))
    gap = F.when(F.col("split_word") | F.col("compound"), "").otherwise(" ")
    part = F.struct("page_order", "id", "line_no", F.concat(bare, gap).alias("text"))
    whole = t.groupBy("doc", "paragraph").agg(F.min("page_order").alias("first_page"), F.array_sort(F.collect_list(part)).alias("parts"), F.flatten(F.collect_list("repairs")).alias("repairs"))
    whole = whole.select("doc", "paragraph", "first_page", F.trim(F.array_join("parts.text", "")).alias("text"), "repairs")

    def repair(batches):
        for b in batches:
            yield b[["doc", "paragraph", "first_page"]].assign(text=[_repaired(t, r) for t, r in zip(b["text"], b["repairs"], strict=True)])

    return whole.mapInPandas(repair, f"doc {dict(inspected.dtypes)['doc']}, paragraph long, first_page int, text string")
