"""Template residue, padding, error pages and script notices.

Lines are normalised (case, digits, spacing) and counted by host over all documents; a line that at least a share
``recurrent`` of its host's documents carry is boilerplate and is subtracted. The rest of a record, its residual, is
weighed by sentences: words that tell of error pages, of notices and of placeholder text have learnt weights, words
without running text or said over and over are padding, and an unfilled slot marks a record even amid real text. A
record that consists of boilerplate alone is weighed whole.

Weights are log-odds of words, learnt from a bounded sample of records. The labels are seeds: few
common phrases of each kind, which mark a short record, while long records of running text are real. A record's other
words thereby become evidence of their own, whatever a host's error pages say.

Defined results: a null or empty text, or one of nothing but white space, has no evidence and is kept; marks alone
are padding; a null host is a host of its own. Repeated rows are counted and marked like any others. Very long texts
are read whole. Extra columns, whatever their names, are not read. A collection too small to learn from has no
weights; seeds are then the evidence, as they are wherever the weights don't speak against them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a slot looks like. Each is one way of writing a gap that was to be filled in.
_NAME = r"[^\W\d_][\w' ]*"
_ASK = r"(?:insert|enter|add|fill in|type|your|hier|ins[eé]rer|indiquer|saisir|introducir|insertar|indicar|bitte|name of|date of)"
_LATER = r"(?:to be (?:added|confirmed|determined|completed|defined|inserted)|tbd|tbc|here|à (?:préciser|compléter|insérer|définir)|por (?:definir|completar|confirmar|indicar)|(?:ein(?:setzen|tragen|fügen)|ergänzen|folgt|nachtragen)(?: \w+)?|aquí|ici)"
SLOTS = (
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^{}\n]{1,60}%\}", r"\$\{[^{}\n]{1,60}\}", rf"\{{{_NAME}\}}",
    r"\[\[[^\[\]\n]{1,60}\]\]", rf"(?i:[\[<‹]\s*{_ASK}\b[^\[\]<>\n]{{0,60}}[\]>›])", rf"(?i:[\[<‹][^\[\]<>\n]{{1,60}}\b{_LATER}\s*[\]>›])",
    r"\[[^\[\]\n]{1,60}:\s*_{2,}\s*\]", r"<<[^<>\n]{1,60}>>", r"‹[^‹›\n]{1,60}›",
    r"<(?!(?:p|br|b|i|u|a|em|strong|sub|sup|div|span|table|tr|td|th|ul|ol|li|html|body|head|pre|code)\b)[^\W\d_A-Z][^<>\n=/\d]{2,50}>",
    r"%[^\W\d_](?:[^\W_]|_)*_?(?:[^\W_]|_)*%(?=\W|$)", r"@@[^@\s]{1,60}@@", r"#[^\W\d_a-z](?:[^\W\da-z]|_)+#", r"(?<!\w)__[^\W_]\w*?__(?!\w)", r"(?<!\w)_{4,}(?!\w)",
    r"(?<!\w)X{4,}(?!\w)", r"(?<!\w)(?:DD|TT|JJ|dd|tt|jj)[-./](?:MMM?|mmm?)[-./](?:Y{2,4}|J{2,4}|A{2,4}|y{2,4}|j{2,4}|a{2,4})(?!\w)",
    r"(?<!\w)XX[-./]X{2,3}[-./]X{2,4}(?!\w)", r"\(x{2,}(?: x{2,})+\)", r"(?<![\w.])n{3}(?![\w.])",
)
SLOT = re.compile("|".join(SLOTS))

# Common phrases that label short records for training, in the languages of the collection.
SEEDS = {
    "error": (
        r"\b(?:page|document|file|record)\b.{0,20}\bnot (?:be )?found", r"\b(?:403|404|429|50[0234])\b", r"does not exist", r"access (?:is )?denied", r"internal server error", r"bad gateway", r"time-?out\b", r"unavailable", r"session has (?:expired|ended)", r"down for maintenance",
        r"connection (?:failed|refused)", r"something went wrong", r"error (?:has )?occurred", r"too many requests", r"try again", r"unable to load", r"moved or deleted", r"zugriff verweigert", r"nicht (?:gefunden|verfügbar|erreichbar)", r"serverfehler", r"fehler aufgetreten",
        r"accès refusé", r"introuvable", r"indisponible", r"erreur (?:interne|serveur)", r"session a expiré", r"veuillez réessayer", r"acceso denegado", r"no encontrada", r"no disponible", r"error interno", r"sesión ha (?:caducado|expirado)", r"inténtelo de nuevo", r"en mantenimiento",
        r"sitzung .{0,15}abgelaufen", r"versuchen sie es .{0,30}(?:erneut|wieder|noch einmal)", r"wartungsarbeiten",
    ),
    "script": (r"javascript", r"cookies", r"scripts?\b", r"scripting", r"skripte?", r"\brobot", r"\bbrowser\b", r"navigateur", r"navegador"),
    "filler": (r"lorem ipsum", r"placeholder", r"dummy", r"(?:sample|your) text", r"text (?:to follow|goes here)", r"replace this text", r"coming soon", r"under construction", r"platzhalter", r"blindtext", r"mustertext", r"texte? (?:à venir|d'exemple|fictif)", r"texto (?:de relleno|de ejemplo|provisional)"),
}
KINDS = ("error", "script", "filler")
_SEED = {k: re.compile("|".join(v)) for k, v in SEEDS.items()}
# the same for the scan: any seed at all
_ANY_SEED = "(?i)" + "|".join(chain.from_iterable(SEEDS.values()))
#: Lines longer than this are counted and told to tasks by a digest; they are subtracted, too, unless they are all that a record has.
LONGEST = 120
# Fixed value: what counts as space in a line, for Java and Python alike.
_SPACE = r"[\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Small words that running text in the collection's languages can't do without.
SMALL_WORDS = frozenset(
    "the a an of and to in at on for with by was were is are from that this as or if not had has been be under than which after before who no "
    "der die das und zu in im am den dem des ein eine mit von für auf bei wurde wurden ist sind nach ohne als oder nicht wegen durfte bis nur "
    "le la les l un une des du de d et à en au aux pour par avec sur dans est sont été a ont sans ou pas que qui seulement après "
    "el los las una unos y del al con por para se su en fue fueron es son sin o no que lo solo tras".split()
)
# a word, an end of a sentence, or an end of a line; a line ends a sentence
_TOKEN = re.compile(r"[^\W\d_]+|[.!?]+(?=\s|$)|\n")
_GAP = re.compile(r"[{}\[\]<>‹›@#_]|%[^\W\d_]|XX|xx|nnn|[-./](?:MM|mm)")


def line_key(line: Column) -> Column:
    """A line without what varies from page to page: case, digits and spacing; of a long line its digest."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), _SPACE, " "))
    return F.when(F.length(line) > LONGEST, F.md5(key)).otherwise(key)


def _line_keys(text: str) -> Column:
    """The different keys of a text's lines, one by one."""
    return F.explode(F.array_distinct(F.transform(F.split(text, "\n"), line_key)))


@dataclass(frozen=True)
class EvidenceModel:
    """Log-odds of words by kind against real text, and the least weight of a sentence that is evidence."""

    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)
    least: float = 2.0


def _labels(text: str, short_words: int) -> str | None:
    """A record's label for training: a kind for a short one with a seed, ``real`` for a long one of running text, else None."""
    low = text.lower()
    words = [t for t in _TOKEN.findall(low) if t[0].isalpha()]
    if len(words) > short_words:
        return "real" if sum(w in SMALL_WORDS for w in words) >= 0.12 * len(words) else None
    return next((k for k in KINDS if _SEED[k].search(low)), None)


def learn_evidence(texts: list[str], short_words: int = 60, prior: float = 0.5) -> EvidenceModel:
    """Word weights from labelled residuals: log-odds by smoothed counts of records, a word counted once a record."""
    found: dict[str, Counter] = {k: Counter() for k in (*KINDS, "real")}
    n = Counter()
    for t in texts:
        k = _labels(t, short_words)
        if k is not None:
            n[k] += 1
            found[k].update(w for w in set(_TOKEN.findall(t.lower())) if w[0].isalpha())
    if not n["real"]:
        return EvidenceModel()
    words = set().union(*(found[k] for k in KINDS))
    odds = lambda w, k: math.log((found[k][w] + prior) / (n[k] + 2 * prior)) if n[k] else math.log(prior / (n["real"] + 2 * prior))
    weights = {w: tuple(odds(w, k) - odds(w, "real") for k in KINDS) for w in words}
    # words of real text that no marked record has speak against every kind; they weigh as the rarest of those do
    against = {w: tuple(-math.log((c + prior) / prior) / 2 for _ in KINDS) for w, c in found["real"].items() if w not in weights}
    return EvidenceModel(weights | against)


def _has_slot(text: str) -> bool:
    return _GAP.search(text) is not None and any(_GAP.search(line) and SLOT.search(line) for line in text.split("\n"))


def _seeded(text: str) -> list[int]:
    """For each sentence with a word the kind whose seed it holds, as a number, or -1."""
    low, at, out = text.lower(), 0, []
    for end in [*(m.end() for m in _TOKEN.finditer(low) if not m.group()[0].isalpha()), len(low)]:
        part, at = low[at:end], end
        if any(c.isalpha() for c in part):
            out.append(next((i for i, k in enumerate(KINDS) if _SEED[k].search(part)), -1))
    return out


def _different(group: np.ndarray, codes: np.ndarray, words: int, n: int) -> np.ndarray:
    """How many different words each group has."""
    pairs = np.sort(group.astype(np.int64) * max(1, words) + codes)
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    return np.bincount(pairs[fresh] // max(1, words), minlength=n)


def weigh(texts: list[str], model: EvidenceModel, short_words: int = 60) -> pd.DataFrame:
    """``(kind, evidence_words, real_words)`` of residuals, ``kind`` being slot, filler, error, script or None.

    All sentences of all texts are weighed at once, as runs of one array of words. Seeds are looked for in records of at most
    ``short_words`` words; in longer ones a sentence with a seed is a small part.
    """
    n = len(texts)
    parts = [_TOKEN.findall(t.lower()) for t in texts]
    doc = np.repeat(np.arange(n), [len(p) for p in parts])
    codes, seen = pd.factorize(np.array(list(chain.from_iterable(parts)), dtype=object))
    is_word = np.array([w[0].isalpha() for w in seen], dtype=bool)
    on = is_word[codes] if len(codes) else np.zeros(0, dtype=bool)
    cut = ~on
    cut[1:] |= doc[1:] != doc[:-1]
    sentence = np.cumsum(cut)[on]
    codes, doc = codes[on], doc[on]
    small = np.array([w in SMALL_WORDS for w in seen], dtype=bool)
    drone = np.array([len(w) > 2 and len(set(w)) == 1 for w in seen], dtype=bool)
    weight = np.array([model.weights.get(w, (0.0, 0.0, 0.0)) for w in seen], dtype=np.float64).reshape(-1, len(KINDS))
    fresh = np.ones(len(sentence), dtype=bool)
    fresh[1:] = sentence[1:] != sentence[:-1]
    first, sentence = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    m = len(first)
    words = np.bincount(sentence, minlength=m)
    share = lambda flag: np.bincount(sentence, weights=flag[codes], minlength=m) if m else np.zeros(0)
    different = _different(sentence, codes, len(seen), m)
    odds = np.stack([share(weight[:, k]) for k in range(len(KINDS))], axis=1) if m else np.zeros((0, len(KINDS)))
    told = odds.max(axis=1, initial=-np.inf) >= model.least
    kind_of = odds.argmax(axis=1) if m else np.zeros(0, dtype=np.int64)
    owner = doc[first] if m else np.zeros(0, dtype=np.int64)
    length = np.bincount(doc, minlength=n)
    starts = np.searchsorted(owner, np.arange(n))
    for i in np.flatnonzero((length > 0) & (length <= short_words)):
        for j, k in enumerate(_seeded(texts[i]), starts[i]):
            if k >= 0 and not told[j] and odds[j].max() >= 0:
                told[j], kind_of[j] = True, k
    running = (words >= 5) & (different >= 0.45 * words) & (share(small) >= 0.12 * words)
    stutter = (words >= 4) & (different <= 0.4 * words)
    # a record that says few words over and over, be it in sentences of one word
    droning = (length >= 4) & (_different(doc, codes, len(seen), n) <= 0.25 * length)
    padding = ~told & ~running & (stutter | (words >= 5) | (share(drone) == words) | droning[owner])
    by_doc = lambda flag: np.bincount(owner[flag], weights=words[flag], minlength=n)
    counts = np.stack([by_doc(told & (kind_of == k)) for k in range(len(KINDS))], axis=1).astype(np.float64) if n else np.zeros((0, len(KINDS)))
    counts[:, KINDS.index("filler")] += by_doc(padding)
    # the short sentences of a short record are no real text beside evidence: they say what to do next
    real = by_doc(running & ~told & ((words >= 12) | (length[owner] > short_words)))
    bare = np.array([bool(t.strip()) and not any(c.isalpha() for c in t) for t in texts], dtype=bool)
    counts[bare, KINDS.index("filler")] += 1
    total = counts.sum(axis=1)
    marked = (total > 0) & (real <= 0.35 * (total + real))
    kind = [("slot" if _has_slot(t) else KINDS[k] if hit else None) for t, k, hit in zip(texts, counts.argmax(axis=1), marked, strict=True)] if n else []
    return pd.DataFrame({"kind": pd.Series(kind, dtype=object), "evidence_words": total.astype(np.int32), "real_words": real.astype(np.int32)})


def _key(line: str) -> str:
    """What ``line_key`` makes of a line."""
    key = re.sub(_SPACE, " ", re.sub(r"[0-9]+", "0", line.lower())).strip(" ")
    return hashlib.md5(key.encode("utf-8", "replace")).hexdigest() if len(line) > LONGEST else key


def residual(text: str | None, boilerplate: frozenset[str] | set[str] = frozenset()) -> str:
    """A text without its boilerplate lines; with the long ones where nothing else is in it, and the whole text where there are none."""
    if not text or not boilerplate:
        return text or ""
    lines = text.split("\n")
    other = [_key(x) not in boilerplate for x in lines]
    for kept in ("\n".join(x for x, o in zip(lines, other, strict=True) if o), "\n".join(x for x, o in zip(lines, other, strict=True) if o or len(x) > LONGEST)):
        if kept.strip():
            return kept
    return text


def evidence(text: str | None, boilerplate: frozenset[str] | set[str] = frozenset(), model: EvidenceModel | None = None) -> tuple[str | None, int, int]:
    """``(kind, evidence words, real words)`` of one record."""
    (row,) = weigh([residual(text, boilerplate)], model or EvidenceModel()).itertuples(index=False)
    return row.kind, int(row.evidence_words), int(row.real_words)


def recurrent_lines(docs: DataFrame, host_col: str, text_col: str, recurrent: float, least: int) -> DataFrame:
    """``(host, line)``: normalised lines, long ones as digests, that a share of at least ``recurrent`` of a host's documents carry, of at least ``least``; all documents count."""
    own = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    sizes = own.groupBy("host").agg(F.count("*").alias("docs"))
    lines = own.select("host", _line_keys("text").alias("line"))
    counted = lines.where(F.col("line") != "").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.join(sizes, "host").where(F.col("n") >= recurrent * F.col("docs")).select("host", "line")


def mark_residue(docs: DataFrame, id_col: str, host_col: str, text_col: str, recurrent: float = 0.01, least: int = 3, sample_docs: int = 2_000, scan_docs: int = 100_000, most_broadcast: int = 50_000) -> DataFrame:
    """``(id, kind, evidence_words, real_words)``: every row with what marks it, ``kind`` null where it is kept.

    Weights are learnt from at most ``sample_docs`` short records with a seed, looked for among about ``scan_docs`` records,
    and as many long ones; lines are counted and records judged all. The recurrent lines go to the tasks as a set of at most ``most_broadcast`` lines of at most 120 characters; more
    than that are joined to the lines of each document instead, with the same result.
    """
    lines = recurrent_lines(docs, host_col, text_col, recurrent, least)
    few = lines.limit(most_broadcast + 1).collect()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    shape = f"id {dict(docs.dtypes)[id_col]}, kind string, evidence_words int, real_words int"
    by_host: dict[str, set[str]] = {}
    if len(few) <= most_broadcast:
        for r in few:
            by_host.setdefault(r.host, set()).add(r.line)
        ready = base.withColumn("skip", F.lit(None).cast("array<string>"))
    else:
        own = base.withColumn("row", F.monotonically_increasing_id())
        parts = own.select("row", "host", _line_keys("text").alias("line"))
        salted = parts.withColumn("salt", F.pmod("row", F.lit(16)).cast("int"))
        spread = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        skip = salted.join(spread, ["host", "line", "salt"]).groupBy("row").agg(F.collect_set("line").alias("skip"))
        ready = own.join(skip, "row", "left").select("id", "host", "text", "skip")

    def rest(hosts, texts, skips) -> list[str]:
        return [residual(t, by_host.get(h, frozenset()) if k is None else set(k)) for h, t, k in zip(hosts, texts, skips, strict=True)]

    # the labelled sample: short records with a seed, and long ones; a hash of the text picks the records that are looked at
    order = F.xxhash64("text")
    total = max(1, docs.count())
    among = lambda n: F.pmod(order, F.lit(1_000_003)) < int(math.ceil(min(1.0, n / total) * 1_000_003))
    short = ready.where(among(scan_docs)).where(F.length("text") <= 1_000).where(F.col("text").rlike(_ANY_SEED))
    long = ready.where(among(2 * sample_docs)).where(F.length("text") > 300)
    rows = [r for x in (short, long) for r in x.orderBy(order).limit(sample_docs).collect()]
    model = learn_evidence(rest([r.host for r in rows], [r.text for r in rows], [r.skip for r in rows]))

    def judge(batches):
        for b in batches:
            for lo in range(0, len(b), 2_000):
                part = b.iloc[lo : lo + 2_000]
                yield weigh(rest(part["host"], part["text"], part["skip"]), model).assign(id=part["id"].to_numpy())[["id", "kind", "evidence_words", "real_words"]]

    return ready.mapInPandas(judge, shape).withColumnRenamed("id", id_col)
