"""Scalar functions over text, as columns that stay inside the JVM unless their docstring says otherwise.

"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOP_WORDS = ("and", "or", "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "by", "what", "is", "are", "how", "when", "where", "why")

# Section types and the header patterns of each, tried in this order.
SECTION_HEADERS = {
    "abstract": (r"^abstract\s*:?\s*$", r"^summary\s*:?\s*$", r"^\d+\.\s*abstract\s*$"),
    "background": (r"^background\s*:?\s*$", r"^introduction\s*:?\s*$", r"^\d+\.\s*background\s*$", r"^\d+\.\s*introduction\s*$"),
    "methods": (r"^methods?\s*:?\s*$", r"^methodology\s*:?\s*$", r"^study\s+design\s*:?\s*$", r"^\d+\.\s*methods?\s*$"),
    "results": (r"^results?\s*:?\s*$", r"^findings?\s*:?\s*$", r"^\d+\.\s*results?\s*$"),
    "discussion": (r"^discussion\s*:?\s*$", r"^\d+\.\s*discussion\s*$"),
    "conclusion": (r"^conclusions?\s*:?\s*$", r"^summary\s+and\s+conclusions?\s*:?\s*$", r"^\d+\.\s*conclusions?\s*$"),
    "inclusion_criteria": (r"^inclusion\s+criteria\s*:?\s*$", r"^participant\s+inclusion\s*:?\s*$", r"^\d+\.\d+\s*inclusion\s+criteria\s*$"),
    "exclusion_criteria": (r"^exclusion\s+criteria\s*:?\s*$", r"^participant\s+exclusion\s*:?\s*$", r"^\d+\.\d+\s*exclusion\s+criteria\s*$"),
    "primary_endpoint": (r"^primary\s+endpoint\s*:?\s*$", r"^primary\s+outcome\s*:?\s*$", r"^\d+\.\d+\s*primary\s+endpoint\s*$"),
    "secondary_endpoint": (r"^secondary\s+endpoint\s*:?\s*$", r"^secondary\s+outcome\s*:?\s*$", r"^\d+\.\d+\s*secondary\s+endpoint\s*$"),
    "adverse_events": (r"^adverse\s+events?\s*:?\s*$", r"^safety\s+events?\s*:?\s*$", r"^side\s+effects?\s*:?\s*$", r"^\d+\.\d+\s*adverse\s+events?\s*$"),
    "demographics": (r"^demographics?\s*:?\s*$", r"^baseline\s+characteristics?\s*:?\s*$", r"^patient\s+characteristics?\s*:?\s*$"),
    "statistical_analysis": (r"^statistical\s+analysis\s*:?\s*$", r"^statistical\s+methods?\s*:?\s*$", r"^data\s+analysis\s*:?\s*$"),
}
# What hints at a kind of entity.
ENTITY_HINTS = {
    "drug": r"\b(?:mg|mcg|units?|tablets?|capsules?|injection|infusion)\b",
    "disease": r"\b(?:cancer|diabetes|hypertension|infection|syndrome|disorder)\b",
    "symptom": r"\b(?:pain|nausea|fatigue|fever|headache|dizziness)\b",
    "measurement": r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|ml|units?|%|mmhg)\b",
    "temporal": r"\b(?:daily|weekly|monthly|baseline|week\s+\d+|day\s+\d+)\b",
}
TABLE_REFERENCES = (r"\btable\s+\d+\b", r"\|.*\|.*\|", r"\t.*\t.*\t")
FIGURE_REFERENCES = (r"\bfigure\s+\d+\b", r"\bfig\.?\s+\d+\b", r"\bchart\s+\d+\b")
# Words near a mention that flag its context.
CONTEXT_WORDS = {
    "is_negated": ("denies", "no ", "not ", "negative", "absent", "without", "ruled out", "no evidence of", "no signs of", "no symptoms of", "unremarkable"),
    "is_uncertain": ("possible", "likely", "probable", "maybe", "uncertain", "questionable", "suggestive of", "consistent with", "suspicious for", "rule out"),
    "is_historical": ("history", "previous", "prior", "past", "formerly", "previously", "h/o", "hx of", "old ", "chronic"),
    "is_hypothetical": ("if ", "should", "would", "could", "may ", "might", "potential", "risk of", "risk for", "prophylaxis"),
    "is_family": ("family", "familial", "hereditary", "genetic", "mother", "father", "sibling", "parent", "relative"),
}
CONTEXT_IMMUNE_TYPES = ("population", "person", "organization", "location")
# Words that send a question to the reasoning model, and those that speak of pictures.
REASONING_WORDS = (
    "analyze", "compare", "reasoning", "step by step", "explain why", "justify", "rationale", "evidence", "statistics", "stats", "statistical", "observed",
    "calculate", "compute", "derive", "interpret", "efficacy", "safety", "outcomes", "results", "correlation", "significance", "p-value", "confidence interval",
)
VISUAL_WORDS = ("figure", "chart", "diagram", "image", "graph", "plot", "table", "visualization", "flowchart", "schematic", "efficacy curve", "survival curve", "kaplan-meier")
# Words of questions that compare things.
COMPARISON_WORDS = ("relationship", "difference", "between", "compared to")
# Models a question may be sent to, and their context windows in tokens.
CONTEXT_WINDOWS = {"gpt-4.1": 1_047_576, "gpt-5-mini": 400_000}
DEFAULT_MODEL, REASONING_MODEL = "gpt-4.1", "gpt-5-mini"
IMAGE_TOKENS = 1_000
# Labels of a general tagger and the clinical types they stand for.
LABEL_TYPES = {
    "DISEASE": "condition", "SYMPTOM": "condition", "CHEMICAL": "medication", "DRUG": "medication", "MEDICATION": "medication", "TREATMENT": "procedure", "TEST": "procedure",
    "ORG": "organization", "PERSON": "other", "DATE": "timepoint", "CARDINAL": "measurement", "QUANTITY": "measurement", "PERCENT": "statistic",
}
# Own choice: endings of medicine names, after the public naming stems.
DRUG_SUFFIXES = ("mab", "nib", "parib", "ciclib", "tinib", "zumab", "ximab", "statin", "pril", "sartan", "olol", "azole", "mycin", "cillin", "vir")
# Texts that make a table cell a measurement, and those that make it a point in time.
MEASURE_MARKS = ("mg", "ml", "kg", "%", "mcg", "iu", "mmol")
TIME_MARKS = ("day", "week", "month", "year", "hour", "minute")
# Fixed value: where a sentence ends.
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"


def any_contains(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a text contains any of the words; false for an empty list."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def any_rlike(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether a text matches any of the patterns (F8)."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def search_terms(query: str) -> list[str]:
    """Words of a question without stop-words and words of one or two letters, then without punctuation.

    Stop-words and short words are dropped first, so "what?" stays as "what".
    """
    kept = [w for w in query.lower().split() if w not in STOP_WORDS and len(w) > 2]
    return [t for t in (re.sub(r"[^\w\s]", "", w) for w in kept) if t]


def search_terms_column(query: Column) -> Column:
    """P18 for a column of questions: an array of terms."""
    words = F.split(F.trim(F.lower(query)), r"\s+")
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))
    return F.filter(F.transform(kept, lambda w: F.regexp_replace(w, r"[^\w\s]", "")), lambda w: w != "")


def rewrite_query(query: Column) -> Column:
    """short "What is X?" and "How does X work?" questions become four phrasings."""
    q = F.trim(query)
    what, how = r"(?i)^what\s+(is|are)\s+(.+?)(?:\?|$)", r"(?i)^how\s+does\s+(.+?)\s+work(?:\?|$)"
    verb, thing, mechanism = F.regexp_extract(q, what, 1), F.regexp_extract(q, what, 2), F.regexp_extract(q, how, 1)
    short = lambda x: word_count(x) <= 3
    define = F.concat(F.lit("Define "), thing, F.lit(". "), thing, F.lit(" mechanism of action. "), thing, F.lit(" description. What "), verb, F.lit(" "), thing, F.lit("."))
    explain = F.concat(mechanism, F.lit(" mechanism of action. "), mechanism, F.lit(" mode of action. How does "), mechanism, F.lit(" work. "), mechanism, F.lit(" pharmacology."))
    return F.when(q.rlike(what) & short(thing) & ~any_contains(F.lower(thing), COMPARISON_WORDS), define).when(q.rlike(how) & short(mechanism), explain).otherwise(query)


def explain_rewrite(original: Column, rewritten: Column) -> Column:
    """why a question was rewritten; null where it wasn't."""
    return F.when(original != rewritten, F.concat(F.lit("Query expanded for better results. Original: '"), original, F.lit("'. Expanded: '"), rewritten, F.lit("'. Reason: short definitional queries benefit from multiple phrasings.")))


def section_type(line: Column) -> Column:
    """the section type that a line is the header of, ``unknown`` for other lines. The first pattern that matches decides."""
    low = F.lower(F.trim(line))
    return F.coalesce(*(F.when(any_rlike(low, ps), F.lit(kind)) for kind, ps in SECTION_HEADERS.items()), F.lit("unknown"))


def sentences(text: Column) -> Column:
    """sentences, split at white space between a full stop and a capital; empty ones dropped."""
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def refers_to_table(text: Column) -> Column:
    """F8."""
    return any_rlike(F.lower(text), TABLE_REFERENCES)


def refers_to_figure(text: Column) -> Column:
    """F8."""
    return any_rlike(F.lower(text), FIGURE_REFERENCES)


def entity_hints(text: Column) -> Column:
    """kinds of entities a text hints at, in fixed order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(kind)) for kind, p in ENTITY_HINTS.items())))


def safe_id(value: Column, fallback: str = "document") -> Column:
    """letters and digits joined by single hyphens; ``fallback`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def safe_name(value: Column) -> Column:
    """a file name of letters, digits, dots, underscores and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def chunk_key(document: Column, index: Column) -> Column:
    """``{document}-chunk-0001``."""
    return F.concat(safe_id(document), F.lit("-chunk-"), F.lpad(index.cast("string"), 4, "0"))


def part_key(base: Column, part: Column) -> Column:
    """the base for the first part (0), then ``-part01`` and so on."""
    return F.when(part == 0, base).otherwise(F.concat(base, F.lit("-part"), F.lpad(part.cast("string"), 2, "0")))


def chunk_prefix(key: Column) -> Column:
    """the document part of a chunk key."""
    head = F.element_at(F.split(key, r"-chunk-|_chunk_", 2), 1)
    return F.when(head == "", safe_id(key)).otherwise(head)


def word_count(text: Column) -> Column:
    """words between white space; 0 for a blank text."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """a token for every four characters; 0 for null."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def message_tokens(messages: Column) -> Column:
    """tokens of an array of ``struct<role, content, images>``: text, 4 a message, 1000 an image, 2 for the reply."""
    one = lambda m: F.lit(4) + token_estimate(m["role"]) + token_estimate(m["content"]) + F.coalesce(m["images"], F.lit(0)) * IMAGE_TOKENS
    total = F.aggregate(messages, F.lit(2).cast("long"), lambda a, m: (a + one(m)).cast("long"))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.lit(0).cast("long")).otherwise(total)


def context_tokens(query: Column, documents: Column, images: Column, system: Column) -> Column:
    """the breakdown of a context's size, with 10 tokens of overhead."""
    docs = F.aggregate(F.coalesce(documents, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, d: a + token_estimate(d))
    pictures = (F.coalesce(images, F.lit(0)) * IMAGE_TOKENS).cast("long")
    total = token_estimate(query) + token_estimate(system) + docs + pictures + 10
    return F.struct(total.alias("total_tokens"), token_estimate(query).alias("query_tokens"), token_estimate(system).alias("system_tokens"), docs.alias("context_tokens"), pictures.alias("image_tokens"), F.lit(10).alias("overhead_tokens"))


def fits_context(tokens: Column, model: str, reserve: int = 50_000) -> Column:
    """whether tokens fit into a model's window less what is reserved for its answer."""
    return tokens <= CONTEXT_WINDOWS[model] - reserve


def route(query: Column, images: Column, documents: Column, forced: str | None = None, disabled: bool = False) -> Column:
    """``struct<model, reason, estimated_tokens, has_images>`` for a question."""
    tokens = token_estimate(query) + F.coalesce(images, F.lit(0)).cast("long") * IMAGE_TOKENS + F.aggregate(F.coalesce(documents, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, d: a + token_estimate(d))
    pictured = F.coalesce(images, F.lit(0)) > 0
    if disabled:
        model, reason = F.lit(DEFAULT_MODEL), F.lit("routing_disabled_fallback")
    elif forced:
        model, reason = F.lit(forced), F.lit("forced_override")
    else:
        reasoning = any_contains(F.lower(query), REASONING_WORDS)
        model = F.when(pictured | reasoning, REASONING_MODEL).otherwise(DEFAULT_MODEL)
        reason = F.when(pictured, "multimodal_query_with_images").when(reasoning, "advanced_reasoning_query").otherwise("default_text_query")
    return F.struct(model.alias("model"), reason.alias("reason"), tokens.alias("estimated_tokens"), pictured.alias("has_images"))


def speaks_of_pictures(query: Column) -> Column:
    """Whether a question speaks of pictures; a column of its own, the router doesn't use it."""
    return any_contains(F.lower(query), VISUAL_WORDS)


def context_window(text: Column, start: Column, end: Column, reach: int = 30) -> Column:
    """The lower-cased text around a mention."""
    lo = F.greatest(F.lit(0), start - reach)
    return F.lower(F.substring(text, lo + 1, F.greatest(F.lit(0), F.least(F.length(text), end + reach) - lo)))


def context_flags(text: Column, start: Column, end: Column, entity_type: Column, reach: int = 30) -> Column:
    """F16: five flags from words near a mention; null for actors and where text or place is unknown."""
    window = context_window(text, start, end, reach)
    flags = F.struct(*(any_contains(window, words).alias(name) for name, words in CONTEXT_WORDS.items()))
    return F.when(window.isNotNull() & ~F.lower(F.coalesce(entity_type, F.lit(""))).isin(*CONTEXT_IMMUNE_TYPES), flags)


def type_of_label(label: Column, text: Column) -> Column:
    """the clinical type of a tagger's label; a person whose name ends like a drug's is a medication."""
    kinds = F.create_map(*(F.lit(x) for pair in LABEL_TYPES.items() for x in pair))
    drug = F.lower(text).rlike(f"(?:{'|'.join(DRUG_SUFFIXES)})$")
    return F.when((label == "PERSON") & drug, "medication").otherwise(F.coalesce(F.try_element_at(kinds, label), F.lit("other")))


def cell_type(cell: Column) -> Column:
    """the type of a table cell; units are tried before times, those before digits."""
    low = F.lower(cell)
    return F.when(any_contains(low, MEASURE_MARKS), "measurement").when(any_contains(low, TIME_MARKS), "timepoint").when(cell.rlike("[0-9]"), "measurement").when(cell.rlike("^(?:NCT|PROTO|STUDY)"), "protocol").otherwise("table_data")


def strip_fences(answer: Column) -> Column:
    """a model's JSON without code fences and with line ends as blanks."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.trim(F.regexp_replace(bare, r"[\r\n]+", " "))


def vocabulary_code(normalized_id: Column, vocabulary: Column) -> Column:
    """a concept id without its vocabulary prefix, upper-cased where it has letters; null if nothing is left."""
    code = F.trim(F.regexp_replace(F.trim(normalized_id), r"^[A-Za-z0-9_]+:", ""))
    return F.when(vocabulary.isNotNull() & (code != ""), F.when(code.rlike("[A-Za-z]"), F.upper(code)).otherwise(code))


def data_uri(uri: Column) -> Column:
    """``struct<mime, extension, data>`` of a base64 data URI; null where it is none."""
    shape = r"(?s)^data:([a-zA-Z0-9.+-]+/[a-zA-Z0-9.+-]+);base64,(.*)$"
    mime = F.lower(F.regexp_extract(uri, shape, 1))
    known = F.create_map(*(F.lit(x) for x in ("image/png", ".png", "image/jpeg", ".jpg", "image/jpg", ".jpg", "image/gif", ".gif", "image/webp", ".webp", "image/svg+xml", ".svg", "image/tiff", ".tiff")))
    return F.when(uri.rlike(shape), F.struct(mime.alias("mime"), F.coalesce(F.try_element_at(known, mime), F.lit(".bin")).alias("extension"), F.try_to_binary(F.regexp_extract(uri, shape, 2), F.lit("base64")).alias("data")))


def preview(text: Column, mark: str = "[SEMANTIC] ", size: int = 100) -> Column:
    """the beginning of a text, marked and followed by three dots."""
    return F.concat(F.lit(mark), F.substring(text, 1, size), F.lit("..."))


def whole_number(value: Column) -> Column:
    """An int from a number's spelling, fractions cut off; null for blanks and other text."""
    return value.cast("string").try_cast("double").try_cast("int")


def repaired_start(text: Column, mention: Column, start: Column, end: Column) -> Column:
    """Where a mention really starts: as given, else within 10, within 50, else anywhere if it is short.

    In each window the exact spelling goes before any spelling; null where it isn't found.
    """
    clean, n = F.trim(mention), F.length(text)
    given = (start >= 0) & (start < end) & (end <= n) & (F.trim(F.substring(text, start + 1, end - start)) == clean)

    def within(lo: Column, hi: Column) -> Column:
        exact = F.call_function("locate", clean, text, (lo + 1).cast("int")) - 1
        loose = F.call_function("locate", F.lower(clean), F.lower(F.substring(text, lo + 1, F.greatest(F.lit(0), hi - lo))), F.lit(1)) - 1
        return F.coalesce(F.when((exact >= lo) & (exact < hi), exact), F.when(loose >= 0, lo + loose))

    near = lambda by: within(F.greatest(F.lit(0), start - by), F.least(n, end + by))
    anywhere = F.when(F.length(clean) < 100, within(F.lit(0), n)).otherwise(within(F.greatest(F.lit(0), start), F.least(n, end)))
    return F.when(clean != "", F.coalesce(F.when(given, start), near(10), near(50), anywhere)).cast("int")
