"""Cutting texts into chunks, segments and sections.

Word windows and segments are built-in array functions. Packing sentences into chunks is a fold with carry, which
no built-in expresses: it runs in Arrow batches, a text a row, so that nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate, islice, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# Where a section of a large text may end, in order of preference.
SECTION_MARKS = (". ", ".\n", "!\n", "?\n")
_BREAK = re.compile(T.SENTENCE_BREAK)
_HEADERS = [(kind, [re.compile(p) for p in ps]) for kind, ps in T.SECTION_HEADERS.items()]


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """``(id, window, start_word, words, text)``: overlapping windows of words.

    A window starts at every step up to the last word, so the last ones may lie inside their forerunner. Blank and null
    texts have none.
    """
    size = max(1, size)
    step = max(1, size - (min(overlap, size - 1) if size > 1 else 0))
    words = F.filter(F.split(F.trim(text_col), r"\s+"), lambda w: w != "")
    cut = df.select(id_col, words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    out = cut.select(id_col, "w", F.posexplode(starts).alias("window", "start_word"))
    part = F.slice("w", F.col("start_word") + 1, F.lit(size))
    return out.select(id_col, "window", "start_word", F.size(part).alias("words"), F.array_join(part, " ").alias("text"))


def segments(df: DataFrame, key_col: str, text_col: str, tokens_col: str, max_tokens: int) -> DataFrame:
    """``(segment_key, key, segment_index, segment_count, start_word, token_count, char_count, text)``.

    A text of more than ``max_tokens`` becomes ceil(tokens / max) parts of as many words, at most; tokens are estimated from
    the words of a part. A text within the limit, or without words, is one segment with its own text and count.
    """
    words = F.filter(F.split(F.trim(text_col), r"\s+"), lambda w: w != "")
    n, tokens = F.size("w"), F.col("tokens")
    cut = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("whole"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("int").alias("tokens"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    many = (tokens > max_tokens) & (n > 0)
    per = F.greatest(F.lit(1), F.ceil(n / F.ceil(tokens / max_tokens))).cast("int")
    cut = cut.withColumn("many", many).withColumn("per", F.when(many, per).otherwise(F.greatest(F.lit(1), n)))
    out = cut.select("*", F.posexplode(F.when(F.col("many"), F.sequence(F.lit(0), n - 1, F.col("per"))).otherwise(F.array(F.lit(0)))).alias("segment_index", "start_word"))
    part = F.slice("w", F.col("start_word") + 1, F.col("per"))
    size = F.size(part)
    guess = F.bround(size * (tokens / n), 0).cast("int")
    count = F.when(F.col("many"), F.least(F.lit(max_tokens), F.when(guess <= 0, size).otherwise(guess))).otherwise(tokens)
    text = F.when(F.col("many"), F.array_join(part, " ")).otherwise(F.col("whole"))
    total = F.when(F.col("many"), F.ceil(n / F.col("per"))).otherwise(F.lit(1)).cast("int")
    return out.select(T.part_key(F.col("key"), F.col("segment_index")).alias("segment_key"), "key", "segment_index", total.alias("segment_count"), "start_word", count.alias("token_count"), F.length(text).alias("char_count"), text.alias("text"))


def header_of(line: str) -> str:
    """F6 in Python: the section type a line is the header of."""
    low = line.strip().lower()
    return next((kind for kind, ps in _HEADERS if any(p.match(low) for p in ps)), "unknown")


def sections_of(text: str) -> list[tuple[str, str | None, int, int]]:
    """``(type, header, start, end)`` of the sections of a text; one unknown section where it has no header."""
    found, at = [], 0
    for line in text.split("\n"):
        kind = header_of(line) if line.strip() else "unknown"
        if kind != "unknown":
            found.append((kind, line.strip(), at))
        at += len(line) + 1
    ends = [s for _, _, s in found[1:]] + [len(text)]
    return [(k, h, s, e) for (k, h, s), e in zip(found, ends, strict=True)] if found else [("unknown", None, 0, len(text))]


@dataclass
class Sentence:
    """A sentence with the section it stands in."""

    text: str
    section: str
    header: str | None
    start: int
    end: int
    tokens: int


@dataclass
class Chunk:
    """Sentences packed together."""

    text: str
    tokens: int
    section: str
    header: str | None
    sentences: int
    start: int
    end: int
    tables: bool
    figures: bool
    hints: list[str]
    coherence: float
    kinds: list[str] = field(default_factory=list)


def sentences_of(text: str) -> list[Sentence]:
    """the sentences of every section; what stands before the first header belongs to none and is left out."""
    out = []
    for kind, header, start, end in sections_of(text):
        at = start
        for s in _BREAK.split(text[start:end].strip()):
            if s.strip():
                out.append(Sentence(s.strip(), kind, header, at, at + len(s), len(s.split())))
                at += len(s) + 1
    return out


def _chunk(parts: list[Sentence]) -> Chunk:
    text, kinds = " ".join(s.text for s in parts), [s.section for s in parts]
    low = text.lower()
    first = list(dict.fromkeys(kinds))
    # The commonest section type, the first seen of equals
    section = max(first, key=lambda k: (kinds.count(k), -first.index(k)))
    tables = any(re.search(p, s.text.lower()) for s in parts for p in T.TABLE_REFERENCES)
    figures = any(re.search(p, s.text.lower()) for s in parts for p in T.FIGURE_REFERENCES)
    hints = [k for k, p in T.ENTITY_HINTS.items() if re.search(p, low)]
    # M11
    coherence = max(0.0, min(1.0, 1.0 - 0.2 * (len(first) - 1)))
    return Chunk(text, sum(s.tokens for s in parts), section, next((s.header for s in parts if s.header), None), len(parts), parts[0].start, parts[-1].end, tables, figures, hints, coherence)


def pack_spans(sizes: list[int], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """N12 over sizes alone: the sentences ``first`` to ``stop`` of each chunk, found by bisection in the running total.

    A chunk reaches as far as ``target`` allows from its first sentence, and at least one sentence beyond its forerunner; it
    begins as far back as ``overlap`` allows, though not before its forerunner's beginning.
    """
    upto = [0, *accumulate(sizes)]
    first = stop = 0
    while stop < len(sizes):
        stop = max(stop + 1, bisect_right(upto, upto[first] + target) - 1)
        yield first, stop
        first = max(first, bisect_left(upto, upto[stop] - overlap)) if overlap > 0 else stop


def pack_sentences(parts: list[Sentence], target: int, overlap: int) -> list[Chunk]:
    """Chunks of at most ``target`` words, each beginning with the last sentences of the one before that fit ``overlap``."""
    return [_chunk(parts[a:b]) for a, b in pack_spans([s.tokens for s in parts], target, overlap)]


def short_pairs(sizes: list[int], least: int, most: int) -> list[int]:
    """Positions of the chunks that take in the next one: under ``least``, both within ``most``, no chunk in two pairs."""
    wish = [a < least and a + b <= most for a, b in pairwise(sizes)]
    # in a run of wishes every second one is granted
    run = accumulate(wish, lambda n, w: n + 1 if w else 0, initial=0)
    return [i for i, n in enumerate(islice(run, 1, None)) if n % 2]


def _joined(c: Chunk, d: Chunk) -> Chunk:
    """Two chunks as one, which keeps the first one's section and header."""
    return replace(c, text=f"{c.text} {d.text}", tokens=c.tokens + d.tokens, sentences=c.sentences + d.sentences, end=d.end, tables=c.tables or d.tables, figures=c.figures or d.figures, hints=list(dict.fromkeys([*c.hints, *d.hints])), coherence=(c.coherence + d.coherence) / 2)


def _halved(c: Chunk) -> list[Chunk]:
    """A chunk cut at the middle one of its full stops with a blank; whole if it has none."""
    stops = [m.start() for m in re.finditer(r"\. ", c.text)]
    if not stops:
        return [c]
    at = stops[(len(stops) + 1) // 2 - 1]
    return [replace(c, text=t, tokens=len(t.split()), sentences=t.count(". ") + 1) for t in (c.text[: at + 1], c.text[at + 2 :])]


def even_out(chunks: list[Chunk], least: int, most: int) -> list[Chunk]:
    """A chunk under ``least`` words joins the next if both fit ``most``; one over ``most`` is cut at its middle ". "."""
    heads = set(short_pairs([c.tokens for c in chunks], least, most))
    kept = (_joined(c, chunks[i + 1]) if i in heads else c for i, c in enumerate(chunks) if i - 1 not in heads)
    # a pair is within the limit already
    return [part for c in kept for part in (_halved(c) if c.tokens > most else [c])]


def semantic_chunks(df: DataFrame, id_col: str, text_col: str, target: int = 1_200, overlap: int = 100, least: int = 200, most: int = 2_000) -> DataFrame:
    """``(id, chunk_index, chunk_id, text, token_count, …)``: sentences packed into chunks by section.

    A null or blank text has no chunks. A sentence longer than the target is a chunk of its own.
    """

    def cut(batches):
        for b in batches:
            rows = []
            for i, t in zip(b[id_col], b[text_col], strict=True):
                if not t or not t.strip():
                    continue
                key = re.sub(r"[^A-Za-z0-9]+", "-", str(i)).strip("-") or "document"
                for k, c in enumerate(even_out(pack_sentences(sentences_of(t), target, overlap), least, most)):
                    rows.append((i, k, f"{key}-chunk-{k:04d}", c.text, c.tokens, len(c.text), c.section, c.header, c.sentences, c.start, c.end, c.tables, c.figures, c.hints, c.coherence))
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "chunk_id", "text", "token_count", "char_count", "section_type", "section_header", "sentence_count", "start_char", "end_char", "contains_tables", "contains_figures", "entity_hints", "coherence"])

    shape = f"{id_col} {dict(df.dtypes)[id_col]}, chunk_index int, chunk_id string, text string, token_count int, char_count int, section_type string, section_header string, sentence_count int, start_char int, end_char int, contains_tables boolean, contains_figures boolean, entity_hints array<string>, coherence double"
    return df.select(id_col, text_col).mapInPandas(cut, shape)


def large_sections(text: str, size: int = 40_000, back: int = 2_000, overlap: int = 1_000, least: int = 100) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of overlapping sections of a large text, ended at the last sentence end near the limit.

    The places of every kind of sentence end are listed once; a section's end is then found by bisection, the kinds in the
    order of ``SECTION_MARKS``. A section of fewer than ``least`` characters is skipped and has nothing to overlap with.
    """
    stops = [[m.end() for m in re.finditer(re.escape(mark), text)] for mark in SECTION_MARKS]

    def end_of(start: int) -> int:
        limit = start + size
        if limit >= len(text):
            return len(text)
        last = (at[k - 1] for at in stops if (k := bisect_right(at, limit)))
        return next((e for e in last if e >= max(start, limit - back) + 2), limit)

    start = 0
    while start < len(text):
        end = end_of(start)
        worth = len(text[start:end].strip()) >= least
        if worth:
            yield start, end
        start = len(text) if end == len(text) else max(end - overlap, start + 1) if worth else end


def section_windows(df: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    """``(id, section, start_char, end_char, text)`` of texts too large to be worked on at once."""

    def cut(batches):
        for b in batches:
            rows = [(i, k, s, e, t[s:e].strip()) for i, t in zip(b[id_col], b[text_col], strict=True) if t for k, (s, e) in enumerate(large_sections(t, **limits))]
            yield pd.DataFrame(rows, columns=[id_col, "section", "start_char", "end_char", "text"])

    return df.select(id_col, text_col).mapInPandas(cut, f"{id_col} {dict(df.dtypes)[id_col]}, section int, start_char int, end_char int, text string")


def desired_page_size(wanted: Column, multiplier: Column) -> Column:
    """Rows to ask for, between what is wanted and 100."""
    return F.least(F.lit(100), F.greatest(wanted, wanted * multiplier))


def segment_words(words: int, tokens: int, max_tokens: int) -> tuple[int, int]:
    """M12 in Python: parts wanted and words in each."""
    parts = max(1, math.ceil(tokens / max_tokens))
    return parts, max(1, math.ceil(words / parts))
