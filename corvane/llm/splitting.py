"""Splitting oversized items at natural boundaries, by balanced targets.

The least number of pieces is computed, equal-length targets are placed, each is snapped to the strongest
boundary near it, and a piece is added whenever a limit fails. Consecutive pieces share exactly the overlap.

Defined results: a null or empty text, or one within the limit, has no pieces; a text without any boundary is
cut between tokens, and never inside one. A repeated id counts once. Texts are read whole, however long.
Extra columns are not read. The overlap must be smaller than the limit.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import TOKEN, token_count

# Abbreviations that never end a sentence.
NEVER = frozenset("dr prof mr mrs ms st vs cf e.g i.e al approx fig figs no nos eq ref refs resp ca incl excl vol pp sec ch dept jr sr acc ac chr juv refr idiop rec recurr per periph noct abd abdom post exert fac".split())
_LIST = re.compile(r"\s*(?:[-*•‣▪–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_HEADING_NUMBER = re.compile(r"\s*(?:#{1,6}\s|\d{1,2}(?:\.\d{1,2})+\.?\s+[^\W\d_])")
_TABLE = re.compile(r"\t|\s\|\s|;.*;")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s+(\S)|(?=([^\W\d_])))")
_CLAUSE = re.compile(r"[,;:](?=\s)")
_INLINE_ITEM = re.compile(r"\s+(?=(?:[•‣▪]|#{2,6})\s)")


def _ends_sentence(line: str, m: re.Match) -> bool:
    """Whether a full stop ends a sentence, judged by the word before and the character after it."""
    before = line[: m.start()]
    mark = m.group(0)
    word = re.search(r"[^\s(\[{\"“]*$", before).group(0)
    after = m.group(1) or m.group(2)
    if m.group(1) is None and not (after.isupper() and mark[0] in ".!?" and len(word) > 1 and "." not in word.strip("0123456789.")):
        return False
    if not word:
        return False
    if mark == "." and word.lower().lstrip("(") in NEVER:
        return False
    if after.islower():
        return False
    if after.isdigit() and mark == "." and "." in word and not word[0].isdigit():
        return False
    return after.isupper() or after.isdigit() or after in "\"'“‘«#•*-–‣▪¿¡"


def boundaries(text: str) -> list[tuple[int, int]]:
    """``(offset, strength)`` of every end of a sentence, heading line, list item or table row, in order.

    Offsets leave out white space after the unit. Strength 4 ends a paragraph, 3 a line, 2 a sentence; 1 is the end of
    a heading or of a line that introduces a list, after which one would rather not cut.
    """
    out: dict[int, int] = {}
    lines, start = text.split("\n"), 0
    for k, line in enumerate(lines):
        body = line.rstrip()
        if body.strip():
            item = bool(_LIST.match(body)) and not _HEADING_NUMBER.match(body)
            table = bool(_TABLE.search(body)) and len(_END.findall(body)) == 0
            if not item and not table:
                for m in _END.finditer(body):
                    if m.end() < len(body) and _ends_sentence(body, m):
                        out[start + m.end()] = 2
                        if _LIST.match(body[m.end() :]) and (body[m.end() :].lstrip()[0] in "•*‣▪-–"):
                            break
            for m in _INLINE_ITEM.finditer(body):
                if m.start():
                    out.setdefault(start + m.start(), 2)
            blank_next = k + 1 >= len(lines) or not lines[k + 1].strip()
            heading = not item and not table and (body[-1] not in ".!?…\"”)" and len(body) <= 80 or body.endswith(":"))
            out[start + len(body)] = 1 if heading else 4 if blank_next else 3
        start += len(line) + 1
    return sorted(out.items())


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of each piece in characters; one piece for a text within the limit."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(spans[0][0], spans[-1][1], n)] if n else []
    ends = [e for _, e in spans]
    cut_at: dict[int, float] = {}
    weak = [(m.end(), 0.5) for m in _CLAUSE.finditer(text)]
    for offset, strength in [*weak, *boundaries(text)]:
        at = bisect.bisect_right(ends, offset)
        if 0 < at < n and strength > cut_at.get(at, 0):
            cut_at[at] = strength
    places = sorted(cut_at)
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        cuts = _snap(n, count, limit, overlap, places, cut_at)
        if cuts is not None:
            edges = [0, *cuts, n]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                first = max(0, a - overlap) if a else 0
                out.append((spans[first][0], spans[b - 1][1], b - first))
            return out
        count += 1


def _snap(n: int, count: int, limit: int, overlap: int, places: list[int], strength: dict[int, float]) -> list[int] | None:
    """Cuts for ``count`` pieces, or None where a limit fails. A cut moves a third of a piece from its target, further only where no boundary is near."""
    cuts, last = [], 0
    for i in range(1, count):
        target, reach = round(i * n / count), max(1, round(n / count / 3))
        most = last + limit - (overlap if last else 0)
        # what is left must fit into the pieces that are left
        least = max(last + max(1, overlap // 2), n - (count - i) * (limit - overlap))
        lo, hi = max(least, target - reach), min(most, target + reach, n - 1)
        if lo > hi:
            return None
        near = places[bisect.bisect_left(places, lo) : bisect.bisect_right(places, hi)]
        near = near or places[bisect.bisect_left(places, least) : bisect.bisect_right(places, min(most, n - 1))]
        last = max(near, key=lambda p: (strength[p], -abs(p - target))) if near else min(max(target, lo), hi)
        cuts.append(last)
    return cuts if n - last + (overlap if last else 0) <= limit else None


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int, *extra: str) -> DataFrame:
    """Rows over the limit, once per id; tokens are counted JVM-side, and only for texts long enough to exceed it."""
    over = df.where(F.length(text_col) > limit).where(token_count(F.col(text_col)) > limit)
    return over.select(id_col, text_col, *extra).dropDuplicates([id_col])


def unit_ends(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``(id, cut_at)``: the places an oversized text may be cut at without breaking a unit."""

    def scan(batches):
        for b in batches:
            found = [[o for o, _ in boundaries(t)] for t in b[text_col]]
            yield pd.DataFrame({id_col: b[id_col].repeat([len(f) for f in found]), "cut_at": [o for f in found for o in f]})

    over = oversized(df, id_col, text_col, limit)
    return over.mapInPandas(scan, f"{id_col} {dict(df.dtypes)[id_col]}, cut_at int")


def split_oversized(df: DataFrame, id_col: str, parent_col: str, index_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """``(id, parent, index, piece, pieces, start, end, tokens, content)`` of each piece of the oversized texts.

    ``new_index`` goes on from the item's own: pieces of earlier items of the same parent push later ones back. The places
    of the parent's whole items are given by ``new_indexes``.
    """

    def cut(batches):
        for b in batches:
            rows = []
            for i, p, x, t in zip(b[id_col], b[parent_col], b[index_col], b[text_col], strict=True):
                parts = pieces(t, limit, overlap)
                rows += [(i, p, x, k, len(parts), s, e, n, t[s:e]) for k, (s, e, n) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[id_col, parent_col, index_col, "piece", "pieces", "start_char", "end_char", "tokens", "content"])

    kinds = dict(df.dtypes)
    shape = f"{id_col} {kinds[id_col]}, {parent_col} {kinds[parent_col]}, {index_col} {kinds[index_col]}, piece int, pieces int, start_char int, end_char int, tokens int, content string"
    cuts = oversized(df, id_col, text_col, limit, parent_col, index_col).mapInPandas(cut, shape)
    # the extra pieces of an item are counted once, on its first piece
    before = Window.partitionBy(parent_col).orderBy(index_col, id_col, "piece").rowsBetween(Window.unboundedPreceding, -1)
    pushed = F.coalesce(F.sum(F.when(F.col("piece") > 0, 1).otherwise(0)).over(before), F.lit(0)) + F.when(F.col("piece") > 0, 1).otherwise(0)
    return cuts.withColumn("new_index", (F.col(index_col) + pushed).cast("int"))


def new_indexes(df: DataFrame, cuts: DataFrame, id_col: str, parent_col: str, index_col: str) -> DataFrame:
    """``(id, parent, index, new_index)`` of every item of a parent with a split one: where its first or only piece comes.

    ``cuts`` is what ``split_oversized`` gives; its own ``new_index`` goes on from here, so that no two items share a place.
    """
    extra = cuts.groupBy(id_col).agg((F.max("pieces") - 1).alias("_extra"))
    touched = cuts.select(parent_col).distinct()
    own = df.select(id_col, parent_col, index_col).dropDuplicates([id_col]).join(touched, parent_col, "left_semi").join(extra, id_col, "left")
    before = Window.partitionBy(parent_col).orderBy(index_col, id_col).rowsBetween(Window.unboundedPreceding, -1)
    pushed = F.coalesce(F.sum(F.coalesce("_extra", F.lit(0))).over(before), F.lit(0))
    return own.select(id_col, parent_col, index_col, (F.col(index_col) + pushed).cast("int").alias("new_index"))
