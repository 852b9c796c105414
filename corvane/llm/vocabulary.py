"""Mapping free-entered values to a canonical list through a character n-gram inverted index.

Values are deduplicated and normalised (case, accents, spacing, sound-alike spellings, doubled letters, filler
words). The index is a table of n-grams and the names that hold them, each n-gram weighted by its rarity among
all names. A value and a name meet in it only on their rarest n-grams (a prefix of each, just long enough that
no pair of at least ``threshold`` can be missed), are scored by the weighted cosine of all their n-grams, and a
name is accepted when it has the largest cosine and leads the names of all other entries by ``margin``. Edits
decide only between names within the margin. What is to be accepted must also answer to the value word by word,
so that a name which differs in its one telling word isn't taken for its neighbour; a code must agree in every
sign. What fails is reported as having no entry.

Filler words are learnt from the list and the values: words of no name that stand beside the exact names of
several entries. N-grams that no name holds have no weight, so a misspelling costs the n-grams it destroys only.

No block of values meets a block of names: all is joins on n-grams and keys. A list of at most ``most_broadcast``
names is counted first and its index goes to the tasks whole; a longer one is joined by shuffle, with the same result.

Defined results: a null or blank value has no entry; ties between different entries have none, for neither
leads; inactive entries count as entries. Repeated rows count once by key. Extra columns are not read. Without
entries no value has one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage

# Words around a name that don't belong to it, known beforehand.
FILLERS = frozenset("a an the of with and or hx history known suspected possible probable query test tests tablet tablets capsule capsules injection oral sodium salt hydrochloride hcl unit units central local lab laboratory type patient pt".split())
# Spellings that sound alike, applied in this order.
SOUNDS = (("ph", "f"), ("qu", "kw"), ("x", "ks"), ("ck", "k"), ("c", "k"), ("y", "i"))
# Amounts beside a name, and forms of a medicine.
_DOSE = re.compile(r"\b\d[\d.,\- ]*\s?(?:mg|mcg|ug|g|kg|ml|l|iu|u|units?|%)(?:/\w+)?\b|\b(?:caps?|tabs?|amp|vials?)\b\.?")
_ASIDE = re.compile(r"[(\[{][^)\]}]*[)\]}]")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without accents, one blank for each run of white space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())


@lru_cache(maxsize=200_000)
def sound(text: str) -> str:
    """A spelling shared by words that sound alike: sound-alike letters, no doubled letters."""
    for a, b in SOUNDS:
        text = text.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", text)


@lru_cache(maxsize=400_000)
def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours counted once; ``most`` + 1 when it is larger than ``most``.

    The columns of the distance table are kept as the bits of integers, one bit a character of ``a``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b or not a:
        return len(b) if not a else 0
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, diagonal, before, d = full, 0, 0, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = (((here & up) + up) ^ up) | here | down | swap
        rise, fall = down | ~(diagonal | up) & full, diagonal & up
        d += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down, before = (fall | ~(diagonal | rise)) & full, rise & diagonal & full, here
    return min(d, most + 1)


def readings(text: str) -> list[str]:
    """Ways to read a value: as it stands, and the parts around a comma turned round."""
    base = fold(text)
    for aside in (_DOSE, _ASIDE):
        rest = aside.sub(" ", base)
        base = rest if _WORD.search(rest) else base
    parts = [p for p in base.split(",") if _WORD.search(p)]
    out = [" ".join(parts)] + ([" ".join(parts[1:] + parts[:1])] if len(parts) > 1 else [])
    out = [" ".join(re.findall(r"[^\W_]+\.?", re.sub(r"(?<=\w)-(?=\w)", "", x))) for x in out]
    return list(dict.fromkeys(x for x in out if x))


def name_forms(name: str) -> list[str]:
    """The spellings of a canonical name that are indexed."""
    forms = readings(name) if "," in name else [fold(name)]
    return list(dict.fromkeys(x for x in (" ".join(_WORD.findall(f)) for f in forms) if x))


def is_code(name: str) -> bool:
    """Codes and acronyms: short or with digits, where one other letter is another thing."""
    s = "".join(_WORD.findall(fold(name)))
    return any(c.isdigit() for c in s) or len(s) <= 6 or name.upper() == name


def _tight(form: str) -> str:
    return form.replace(" ", "").replace(".", "")


class Fillers:
    """Words that don't belong to a name, also misspelt if long."""

    def __init__(self, words: frozenset[str]):
        self.words, self.long, self.known = words, [w for w in words if len(w) >= 6], {}

    def __contains__(self, word: str) -> bool:
        word = word.rstrip(".")
        if word not in self.known:
            self.known[word] = word in self.words or len(word) >= 6 and any(edits(word, f, 2) <= 2 for f in self.long)
        return self.known[word]

    def without(self, form: str) -> str:
        """A form without its filler words."""
        return " ".join(w for w in form.split() if w not in self)


def agree(form: str, name: str, fillers: Fillers) -> tuple[int, int] | None:
    """Edits in all and in the worst word between a value and a name, or None where the words don't answer to each other.

    A word may be broken in two, and a word with a full stop may be cut short. Edits are counted in the
    spelling or in the sound, whichever has fewer.
    """
    have, total, worst = form.split(), 0, 0
    used = [False] * len(have)
    for w in name.split():
        most = min(3, max(1, len(w) // 3))
        heard, best = sound(w), None
        for i, x in enumerate(have):
            if used[i]:
                continue
            bare = x.rstrip(".")
            if x.endswith(".") and len(bare) >= 2 and w.startswith(bare):
                best = (0, (i,))
                break
            for span in ((i,), (i, i + 1)):
                if span[-1] >= len(have) or used[span[-1]]:
                    continue
                text = _tight("".join(have[j] for j in span))
                d = min(edits(text, w, most), edits(sound(text), heard, most))
                if d <= most and (best is None or d < best[0]):
                    best = (d, span)
        if best is None:
            return None
        total, worst = total + best[0], max(worst, best[0])
        for i in best[1]:
            used[i] = True
    if any(not u and x not in fillers for u, x in zip(used, have, strict=True)):
        return None
    return total, worst


def answers(forms: list[str], name: str, code: bool, cosine: float, sure: float, known: set[str], fillers: Fillers) -> int | None:
    """Edits between a value and a name that it may mean, or None: fewest over the value's forms."""
    tight, best = _tight(name), None
    for form in forms:
        mine = _tight(form)
        if mine == tight:
            return 0
        if code:
            continue
        d = agree(form, name, fillers)
        if d is None:
            e = edits(sound(mine), sound(tight), 2)
            d = (e, e) if e <= 2 and not known & set(form.split()) - set(name.split()) else None
        if d is not None and (d[1] <= 2 or cosine >= sure) and (best is None or d[0] < best):
            best = d[0]
    return best


def _grams(key: Column, n: int) -> Column:
    """The distinct n-grams of a padded key."""
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def _vectors(keys: DataFrame, weights: DataFrame, n: int, threshold: float, parts: int) -> DataFrame:
    """``(id, grams, total, kept, rest)`` of ``(id, key)``: the n-grams that names hold, from rare to common, and their squared weights.

    ``kept`` of them come first, until what is left, ``rest`` of ``total``, can't reach the threshold by itself.
    """
    grams = keys.select("id", F.explode(_grams(F.col("key"), n)).alias("gram")).join(weights, "gram").repartition(parts, "id")
    v = grams.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w2", "gram")), asc=False).alias("grams"))
    add = lambda a, x: a + x["w2"]
    v = v.withColumn("total", F.aggregate("grams", F.lit(0.0), add))
    left = F.aggregate(
        "grams", F.struct(F.col("total").alias("left"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["left"] - x["w2"]).alias("left"), (a["n"] + F.when(a["left"] >= threshold**2 * F.col("total") * (1 - 1e-9), 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    )
    v = v.withColumn("kept", left)
    return v.withColumn("rest", F.aggregate(F.slice("grams", F.col("kept") + 1, F.size("grams")), F.lit(0.0), add))


def learn_fillers(words: DataFrame, names: DataFrame, least_entries: int = 3, share: float = 0.2, most_fillers: int = 2_000) -> frozenset[str]:
    """Words of no name that stand beside the exact names of entries.

    ``words`` is ``(value, known, others)``, the value's words that names have, in order, and those that none has. Without
    the latter a value may be the exact name of an entry; a word counts as a filler when that is so of at least ``share`` of
    its values, of at least ``least_entries`` entries. The model has at most ``most_fillers`` words, those of most entries.
    All values are counted.
    """
    rest = words.where(F.size("others") > 0).select(F.array_join("known", "").alias("tight"), "others")
    exact = names.select(F.translate("name", " ", "").alias("tight"), "entry").groupBy("tight").agg(F.min("entry").alias("entry"))
    credit = rest.join(exact, "tight", "left").select(F.explode("others").alias("word"), "entry")
    # by word and entry first, so that a word of a third of all values is no single group
    counted = credit.groupBy("word", "entry").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("entry").isNotNull(), F.col("n")).otherwise(0)).alias("beside"), F.count("entry").alias("entries"))
    found = counted.where((F.col("entries") >= least_entries) & (F.col("beside") >= share * F.col("n"))).orderBy(F.desc("entries"), "word").limit(most_fillers)
    return frozenset(r.word for r in found.select("word").collect())


def map_values(
    values: DataFrame, value_col: str, entries: DataFrame, entry_cols: list[str], name_col: str, synonyms_col: str,
    threshold: float = 0.3, margin: float = 0.02, sure: float = 0.72, n: int = 3, fillers: frozenset[str] = FILLERS, rows_per_task: int = 4_000, most_broadcast: int = 20_000,
) -> DataFrame:
    """``(value, entry columns, score, edits)``: one row per distinct value, the entry columns null where it has no entry.

    ``threshold`` is the least cosine of a name, ``margin`` what it must lead the names of other entries by, ``sure`` the least
    cosine of one with three edits in a word. ``fillers`` are known beforehand, further ones are learnt.
    """
    keys = [f"e{k}" for k in range(len(entry_cols))]
    spelt = F.array_compact(F.concat(F.array(F.col(name_col)), F.coalesce(F.col(synonyms_col), F.array().cast("array<string>"))))
    listed = entries.select(*(F.col(c).cast("string").alias(k) for k, c in zip(keys, entry_cols, strict=True)), F.explode(spelt).alias("name"))

    def index_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], f, sound(_tight(f)), is_code(r[-1])) for r in b.itertuples(index=False) for f in name_forms(r[-1])]
            yield pd.DataFrame(rows, columns=[*keys, "name", "key", "code"])

    entry_shape = ", ".join(f"{k} string" for k in keys)
    names = listed.mapInPandas(index_names, f"{entry_shape}, name string, key string, code boolean").groupBy(*keys, "name", "key").agg(F.min("code").alias("code"))
    names = cut_lineage(names.withColumn("entry", F.xxhash64(*keys)))

    whole = F.broadcast if names.count() <= most_broadcast else lambda df: df
    own_words = whole(names.select(F.explode(F.split("name", " ")).alias("word")).distinct().withColumn("own", F.lit(True)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ways = [readings(x) for x in b["value"]]
            yield pd.DataFrame({"value": b["value"], "ways": ways, "words": [[w.rstrip(".") for w in x[0].split()] if x else [] for x in ways]})

    distinct = values.select(F.col(value_col).cast("string").alias("value")).where(F.trim("value") != "").distinct()
    told = distinct.mapInPandas(read, "value string, ways array<string>, words array<string>").select("value", "ways", F.posexplode_outer("words").alias("pos", "word"))
    mine = F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("pos", "word"))))
    wanted = told.join(own_words, "word", "left").groupBy("value").agg(F.first("ways").alias("ways"), F.transform(mine, lambda x: x["word"]).alias("known"), F.collect_set(F.when(F.col("own").isNull(), F.col("word"))).alias("others"))
    wanted = cut_lineage(wanted)
    parts = max(8, -(-wanted.count() // rows_per_task))
    learnt = Fillers(fillers | learn_fillers(wanted, names))

    def shape_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for value, ways, known in zip(b["value"], b["ways"], b["known"], strict=True):
                forms = list(dict.fromkeys(x for x in [*ways, *map(learnt.without, ways)] if x))
                rows += [(value, forms, known, k) for k in dict.fromkeys(sound(_tight(f)) for f in forms)]
            yield pd.DataFrame(rows, columns=["value", "forms", "known", "key"])

    forms = wanted.select("value", "ways", "known").repartition(parts).mapInPandas(shape_forms, "value string, forms array<string>, known array<string>, key string")
    forms = cut_lineage(forms.withColumn("id", F.xxhash64("key")))
    name_keys = names.groupBy("key").agg(F.collect_list(F.struct(*keys, "name", "code")).alias("names")).withColumn("id", F.xxhash64("key"))
    total = name_keys.agg(F.count("*").alias("listed"))  # one row
    weights = name_keys.select(F.explode(_grams(F.col("key"), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("held")).crossJoin(F.broadcast(total))
    weights = cut_lineage(weights.select("gram", F.pow(F.log1p(F.col("listed") / F.col("held")), 2).alias("w2")))
    name_side = cut_lineage(_vectors(name_keys, whole(weights), n, threshold, 8).join(whole(name_keys), "id"))
    value_side = cut_lineage(_vectors(forms.select("id", "key").distinct(), whole(weights), n, threshold, parts))
    # who meets on a rare n-gram, and whose cosine what they met on still allows to reach the threshold
    met_on = F.explode(F.slice("grams", F.lit(1), F.col("kept"))).alias("g")
    index = name_side.select(F.col("id").alias("name_id"), F.col("total").alias("name_total"), F.col("rest").alias("name_rest"), met_on).select("name_id", "name_total", "name_rest", F.col("g.gram").alias("gram"))
    met = value_side.repartition(parts, "id").select("id", "total", "rest", met_on).select("id", "total", "rest", "g.gram", "g.w2").join(whole(index), "gram")
    bar = threshold * F.sqrt(F.col("total") * F.col("name_total")) - F.greatest("rest", "name_rest")
    met = met.groupBy("id", "name_id").agg(F.sum("w2").alias("met"), F.max(bar).alias("bar")).where(F.col("met") >= F.col("bar") - 1e-9)
    # the cosine of all n-grams: a value's n-gram is the name's if the name's padded key holds it
    padded = F.concat(F.lit("^"), F.col("name_key"), F.lit("$"))
    dot = F.aggregate(F.filter("grams", lambda x: F.contains(padded, x["gram"])), F.lit(0.0), lambda a, x: a + x["w2"])
    listed_names = name_side.select(F.col("id").alias("name_id"), F.col("key").alias("name_key"), F.col("total").alias("name_total"), "names")
    scored = met.join(value_side.repartition(parts, "id").select("id", "grams", "total"), "id").join(whole(listed_names), "name_id")
    scored = scored.select("id", "names", (dot / F.sqrt(F.col("total") * F.col("name_total"))).alias("cosine")).where(F.col("cosine") >= threshold)
    # a row holds the names that are near to one spelling
    offered = scored.groupBy("id").agg(F.collect_list(F.struct("cosine", "names")).alias("near")).join(forms.drop("key"), "id")
    offered = offered.repartition(parts, "value").sortWithinPartitions("value")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["value"], b["forms"], b["known"], b["near"], strict=True))
        out = []
        for value, readings_ in groupby(rows, key=lambda r: r[0]):
            score: dict[tuple, float] = {}
            for _, forms, known, near in readings_:
                for x in near:
                    for o in x["names"]:
                        named = (tuple(o[k] for k in keys), o["name"], o["code"])
                        score[named] = max(score.get(named, 0.0), x["cosine"])
            best: dict[tuple, tuple[int, float]] = {}
            lead = None
            for (entry, name, code), cosine in sorted(score.items(), key=lambda x: (-x[1], x[0])):
                if lead is not None and cosine < lead - margin:
                    break
                e = answers(list(forms), name, code, cosine, sure, set(known), learnt)
                if e is not None:
                    lead = cosine if lead is None else lead
                    best[entry] = min(best.get(entry, (e, -cosine)), (e, -cosine))
            rank = sorted(best, key=lambda x: (best[x], x))
            if rank and (len(rank) == 1 or best[rank[0]][0] < best[rank[1]][0]):
                out.append((value, *rank[0], -best[rank[0]][1], best[rank[0]][0]))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["value", *keys, "score", "edits"])
                out = []
        yield pd.DataFrame(out, columns=["value", *keys, "score", "edits"])

    found = offered.select("value", "forms", "known", "near").mapInPandas(decide, f"value string, {entry_shape}, score double, edits int")
    mapped = wanted.select("value").join(found, "value", "left")
    return mapped.select("value", *(F.col(k).alias(c) for k, c in zip(keys, entry_cols, strict=True)), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("edits", F.lit(0)).alias("edits"))


def map_mentions(mentions: DataFrame, id_col: str, value_col: str, mapped: DataFrame, entry_cols: list[str], salts: int = 8) -> DataFrame:
    """Give each mention the entry of its value; ``none`` where it has no entry. A frequent value is spread over ``salts`` parts."""
    m = mentions.select(F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("value")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    v = mapped.select("value", *entry_cols).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = m.join(v, ["value", "salt"], "left")
    return joined.select(F.col("id").alias(id_col), *(F.coalesce(F.col(c), F.lit("none")).alias(c) for c in entry_cols)).distinct()
