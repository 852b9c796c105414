"""Filters, joins, aggregations, ranking and set operations as functions of DataFrames (P, J, A, N, O, U rows)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import cut_lineage

# ---- filters -------------------------------------------------------------------------------------------------


def search_filter(df: DataFrame, columns: list[str], terms: list[str], mode: str = "contains") -> DataFrame:
    """Rows with any of the terms in any of the columns, whatever the case. No terms, no restriction.

    ``contains`` takes terms literally; ``like`` reads % and _ in them as wildcards, as the reference does (T18).
    """
    if not terms:
        return df
    low = lambda c: F.lower(F.col(c))
    one = (lambda c, t: F.contains(low(c), F.lit(t.lower()))) if mode == "contains" else (lambda c, t: low(c).like(f"%{t.lower()}%"))
    return df.where(reduce(lambda a, b: a | b, [one(c, t) for c in columns for t in terms]))


def optional_equals(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on the columns whose argument is given."""
    for c, v in wanted.items():
        df = df if v is None else df.where(F.col(c) == F.lit(v))
    return df


def in_list(df: DataFrame, column: str, values: list | DataFrame, few: int = 1_000) -> DataFrame:
    """Rows whose value is listed: a predicate for a short list, a semi-join for a long one or a table."""
    if isinstance(values, list) and len(values) <= few:
        return df.where(F.col(column).cast("string").isin([str(v) for v in values]))
    right = values if isinstance(values, DataFrame) else df.sparkSession.createDataFrame([(str(v),) for v in values], "v string")
    right = right.select(F.col(right.columns[0]).cast("string").alias("_v")).distinct()
    return df.join(right, df[column].cast("string") == F.col("_v"), "left_semi")


def guarded_long(column: Column) -> Column:
    """The number a text of digits stands for; null for blank and other texts."""
    clean = F.nullif(F.trim(column), F.lit(""))
    return F.when(clean.rlike(r"^[0-9]+$"), clean.try_cast("long"))


def ad_hoc(spark: SparkSession, query: str, limit: int = 10) -> DataFrame:
    """A SQL query, cut to ``limit`` rows unless it speaks of a limit itself."""
    text = query.strip().rstrip(";")
    return spark.sql(text) if re.search(r"\blimit\b", text, re.I) else spark.sql(text).limit(limit)


def valid_relations(relations: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """P20: relations whose ends are known and whose evidence lies in the text.

    ``relations`` has subject_entity_id, object_entity_id, chunk_id, evidence_start and evidence_end; ``entities`` entity_id;
    ``texts`` one (chunk_id, text) each.
    """
    known = entities.select(F.col("entity_id").alias("_e")).distinct()
    ends = relations.join(known, relations["subject_entity_id"] == F.col("_e"), "left_semi")
    ends = ends.join(known, ends["object_entity_id"] == F.col("_e"), "left_semi")
    size = texts.groupBy("chunk_id").agg(F.max(F.length("text")).alias("_n"))
    return ends.join(size, "chunk_id").where((F.col("evidence_start") >= 0) & (F.col("evidence_start") < F.col("evidence_end")) & (F.col("evidence_end") <= F.col("_n"))).drop("_n")


# ---- joins ---------------------------------------------------------------------------------------------------


def endpoints(relations: DataFrame, *keep: str) -> DataFrame:
    """Each relation once for every end, a loop once: ``(entity_id, other_id, relation_id, keep…)``."""
    s, o = F.col("subject_entity_id"), F.col("object_entity_id")
    both = F.array(F.struct(s.alias("e"), o.alias("t")), F.struct(o.alias("e"), s.alias("t")))
    ends = F.when(s == o, F.slice(both, 1, 1)).otherwise(both)
    return relations.select("relation_id", *keep, F.explode(ends).alias("x")).select(F.col("x.e").alias("entity_id"), F.col("x.t").alias("other_id"), "relation_id", *keep)


def relation_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``entities`` with ``relation_count``, the relations that touch each; 0 for none.

    The join on either end becomes an equi-join: relations are counted by end first, which leaves one row per entity.
    ``relations`` may be what ``end_counts`` gives.
    """
    n = relations if "relation_count" in relations.columns else end_counts(relations)
    return entities.join(n, "entity_id", "left").na.fill(0, ["relation_count"])


def end_counts(relations: DataFrame) -> DataFrame:
    """``(entity_id, relation_count)`` of entities that a relation touches."""
    return endpoints(relations).where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.count("relation_id").alias("relation_count"))


def related_entities(entities: DataFrame, relations: DataFrame, text: str, entity_type: str | None = None) -> DataFrame:
    """Distinct ``(entity_text, entity_type, predicate, confidence, evidence_span, chunk_id)`` one relation away from mentions with the text."""
    target = search_filter(entities, ["entity_text"], [text]).select("entity_id", "chunk_id")
    ends = endpoints(relations, "predicate", "confidence", "evidence_span")
    other = entities.select(F.col("entity_id").alias("other_id"), "entity_text", "entity_type")
    out = target.join(ends, "entity_id").join(optional_equals(other, entity_type=entity_type), "other_id")
    return out.select("entity_text", "entity_type", "predicate", "confidence", "evidence_span", "chunk_id").distinct()


# Fixed value: a set of which there are more combinations is joined by its rarest items.
_MOST_COMBINATIONS = 1_000


def overlap_classes(df: DataFrame, id_col: str, item_col: str, least: int, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, c)`` of sets that can share ``least`` items, and their classes ``(c, items, n)``: sets of the same items are one class.

    Items that one set holds are left out: nothing shares them. The others are numbers, the rarest first. Numbers are made
    once: ``keep`` stores a table under a name, by default it is written to the checkpoint folder. Sets are made once, too.
    Repeated rows go to their set to be folded there, for counting; for the sets themselves they are folded as these are gathered.
    """
    keep = keep or (lambda _, build: cut_lineage(build()))
    items = df.select(F.col(id_col).alias("id"), F.col(item_col).alias("item")).where(F.col("id").isNotNull() & F.col("item").isNotNull())
    number = F.monotonically_increasing_id()
    known = keep("overlap_items", lambda: items.repartition("id").distinct().groupBy("item").agg(F.count("*").alias("n")).where("n > 1").withColumn("i", number))
    held = lambda: items.join(known, "item").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("n", "i"))).alias("s")).where(F.size("s") >= least).select("id", F.col("s.i").alias("items"))
    sets = keep("overlap_held", held)
    classes = keep("overlap_classes", lambda: sets.groupBy("items").agg(F.count("*").alias("n")).withColumn("c", number))
    return keep("overlap_sets", lambda: sets.join(classes.select("items", "c"), "items").select("id", "c")), classes


def _most_items(least: int) -> int:
    """The size up to which a class counts as one of few combinations of ``least`` items."""
    most = least
    while math.comb(most + 1, least) <= _MOST_COMBINATIONS:
        most += 1
    return most


def _by_size(classes: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Classes of few combinations of ``least`` items, and the others, None where there are none."""
    most = _most_items(least)
    large = classes.where(F.size("items") > most)
    return classes.where(F.size("items") <= most), large if large.limit(1).count() else None


def _combinations(classes: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """``(c, k0, k1, …)`` with a row for every combination of ``least`` items of a class, in the order of its items, and the names of the items' columns.

    A row holds numbers only, so that combinations are shuffled in few bytes.
    """
    out = classes.select("c", F.array().cast("array<bigint>").alias("key"), F.col("items").alias("_rest"))
    for left in range(least, 0, -1):
        out = out.select("c", "key", "_rest", F.posexplode(F.slice("_rest", F.lit(1), F.size("_rest") - (left - 1))).alias("_p", "_x"))
        out = out.select("c", F.array_append("key", F.col("_x")).alias("key"), F.slice("_rest", F.col("_p") + 2, F.size("_rest")).alias("_rest"))
    keys = [f"k{k}" for k in range(least)]
    return out.select("c", *(F.col("key")[k].alias(x) for k, x in enumerate(keys))), keys


def _large_pairs(classes: DataFrame, large: DataFrame, least: int) -> DataFrame:
    """``(c_a, n_a, c_b, n_b, shared)`` of overlapping classes of which one has many combinations.

    Two sets that share k items share one of their size - k + 1 rarest. A pair is kept where its rarest shared item joins it.
    """
    rare = lambda x: x.withColumn("item", F.explode(F.slice("items", F.lit(1), F.size("items") - (least - 1))))
    a, few = rare(large).alias("a"), F.size("items") <= _most_items(least)
    # only what a large class holds can meet it
    b = rare(classes).join(rare(large).select("item").distinct(), "item", "left_semi").withColumn("few", few).alias("b")
    j = a.join(b, F.col("a.item") == F.col("b.item")).where("a.c <> b.c and (b.few or a.c < b.c)").withColumn("both", F.array_intersect("a.items", "b.items"))
    return j.where((F.size("both") >= least) & (F.col("both")[0] == F.col("a.item"))).select(F.col("a.c").alias("c_a"), F.col("a.n").alias("n_a"), F.col("b.c").alias("c_b"), F.col("b.n").alias("n_b"), F.size("both").alias("shared"))


def class_overlaps(classes: DataFrame, least: int) -> DataFrame:
    """``(c_a, n_a, c_b, n_b, shared)`` of the pairs of classes that share at least ``least`` items, each once.

    Classes are joined on combinations of ``least`` items, so that whatever meets is a pair; it is kept where its first shared
    combination joins it. Most combinations are held by one class: those go before items are put beside the others. Pairs
    aren't written or shuffled.
    """
    small, large = _by_size(classes, least)
    one, keys = _combinations(small, least)
    met = one.withColumn("_m", F.count("*").over(Window.partitionBy(*keys))).where("_m > 1").drop("_m").join(small.select("c", "n", "items"), "c")
    a, b = met.alias("a"), met.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    j = a.join(b, same).where("a.c < b.c").withColumn("both", F.array_intersect("a.items", "b.items"))
    pairs = j.where(F.slice("both", 1, least) == F.array(*(F.col(f"a.{k}") for k in keys))).select(F.col("a.c").alias("c_a"), F.col("a.n").alias("n_a"), F.col("b.c").alias("c_b"), F.col("b.n").alias("n_b"), F.size("both").alias("shared"))
    return pairs if large is None else pairs.unionByName(_large_pairs(classes, large, least))


def class_links(classes: DataFrame, least: int) -> DataFrame:
    """``(src, dst)``: links that connect the same classes as ``class_overlaps``: of all that hold a combination to the first of them."""
    small, large = _by_size(classes, least)
    one, keys = _combinations(small, least)
    links = one.select(F.col("c").alias("src"), F.min("c").over(Window.partitionBy(*keys)).alias("dst")).where("src <> dst")
    return (links if large is None else links.unionByName(_large_pairs(classes, large, least).select(F.col("c_a").alias("src"), F.col("c_b").alias("dst")))).distinct()


def class_sums(classes: DataFrame, least: int) -> DataFrame:
    """``(c, n_edges, weight)``: the number of overlapping pairs of sets and the items they share, each pair told to one of its classes."""
    between = class_overlaps(classes, least).select(F.col("c_a").alias("c"), (F.col("n_a") * F.col("n_b")).alias("k"), "shared")
    within = classes.where("n > 1").select("c", F.expr("n * (n - 1) div 2").alias("k"), F.size("items").alias("shared"))
    return between.unionByName(within).groupBy("c").agg(F.sum("k").alias("n_edges"), F.sum(F.col("k") * F.col("shared")).alias("weight"))


def class_members_overlap(members: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``(id_a, id_b, shared)`` of the pairs of sets that share at least ``least`` items, smaller first, from sets and classes as ``overlap_classes`` gives them."""
    left, right = members.select(F.col("id").alias("x"), F.col("c").alias("c_a")), members.select(F.col("id").alias("y"), F.col("c").alias("c_b"))
    between = class_overlaps(classes, least).join(left, "c_a").join(right, "c_b").select("x", "y", "shared")
    equal = classes.where("n > 1").select(F.col("c").alias("c_a"), F.col("c").alias("c_b"), F.size("items").alias("shared"))
    within = equal.join(left, "c_a").join(right, "c_b").where("x < y").select("x", "y", "shared")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "shared")


def set_overlap(df: DataFrame, id_col: str, item_col: str, least: int) -> DataFrame:
    """``(id_a, id_b, shared)`` of the pairs of ids that share at least ``least`` distinct items, smaller first.

    Equal sets are compared once and told apart at the end; what is found is counted exactly.
    """
    return class_members_overlap(*overlap_classes(df, id_col, item_col, least), least)


def lateral_first(left: DataFrame, right: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Each row of ``left`` with the first ``n`` rows of ``right`` of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    return left.join(right.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"), key)


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def resolve_by_text(relations: DataFrame, entities: DataFrame, exact: bool = False) -> DataFrame:
    """Relations given by ``(chunk_id, subject, object, …)`` texts with the ids of the first mentions of those texts.

    ``entities`` has chunk_id, entity_id, entity_text and start_char. A relation with an end that isn't found is dropped.
    """
    norm = (lambda c: F.trim(c)) if exact else (lambda c: F.lower(F.trim(c)))
    first = entities.groupBy("chunk_id", norm(F.col("entity_text")).alias("_t")).agg(F.min_by("entity_id", F.struct(F.coalesce("start_char", F.lit(2**31 - 1)), "entity_id")).alias("_e"))
    out = relations
    for side in ("subject", "object"):
        ids = first.select(F.col("chunk_id").alias("_c"), F.col("_t"), F.col("_e").alias(f"{side}_entity_id"))
        out = out.join(ids, (out["chunk_id"] == F.col("_c")) & (norm(out[side]) == F.col("_t"))).drop("_c", "_t")
    return out


def mention_key(text: Column, start: Column, end: Column) -> Column:
    """``text|start|end`` of a mention in lower case."""
    return F.concat(F.lower(F.trim(text)), F.lit("|"), start.cast("string"), F.lit("|"), end.cast("string"))


def best_overlaps(mentions: DataFrame, spans: DataFrame, group: str, bucket: int = 256) -> DataFrame:
    """Each mention with the span of its group that covers it most: at least half of it, and holding its text.

    Both have group, text, start_char and end_char, spans also span_id. A range join by buckets of characters: a mention
    meets only spans that touch a bucket it touches. Ties go to the first span.
    """
    buckets = lambda: F.explode(F.sequence(F.floor(F.col("start_char") / bucket), F.floor(F.greatest(F.col("start_char"), F.col("end_char") - 1) / bucket)))
    m = mentions.where("start_char < end_char").withColumn("_m", F.struct(*mentions.columns)).withColumn("_b", buckets())
    s = spans.where("start_char < end_char").select(F.col(group).alias("_g"), "span_id", F.col("text").alias("_t"), F.col("start_char").alias("_s"), F.col("end_char").alias("_e"), buckets().alias("_b"))
    j = m.join(s, (m[group] == F.col("_g")) & (m["_b"] == s["_b"]))
    size = F.least("end_char", "_e") - F.greatest("start_char", "_s")
    j = j.withColumn("overlap", size).where((F.col("overlap") >= 0.5 * (F.col("end_char") - F.col("start_char"))) & F.contains(F.lower("_t"), F.lower("text")))
    best = j.groupBy("_m").agg(F.min_by(F.struct("span_id", "overlap"), F.struct(-F.col("overlap"), F.col("_s"), F.col("span_id"))).alias("_x"))
    return best.select("_m.*", F.col("_x.span_id").alias("span_id"), F.col("_x.overlap").alias("overlap"))


def exact_matches(values: DataFrame, value: str, nodes: DataFrame) -> DataFrame:
    """Values with the active entries whose name or code they equal in lower case; matched by name before code."""
    v = values.select(F.col(value).alias("value"), F.lower(F.trim(value)).alias("_k")).where("_k <> ''").distinct()
    active = nodes.where("is_active")
    by = lambda c, how: active.select(F.lower(c).alias("_k"), "vocabulary", "code", "display_name", F.lit(how).alias("matched_by"))
    both = by("display_name", "name").unionByName(by("code", "code"))
    w = Window.partitionBy("value", "vocabulary", "code").orderBy(F.desc("matched_by"))
    return v.join(both, "_k").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")


def fuzzy_matches(values: DataFrame, value: str, nodes: DataFrame, least: float = 70.0, block: int = 2_000) -> DataFrame:
    """Values with the most similar active entry of each vocabulary, at least ``least`` of 100.

    Every value is scored against every name, without candidates: typos, qualifiers and another order of words can leave
    a pair above the limit that shares no rare trigram, or none. Values and names meet block by block, ``block`` of each in
    a task, so the work grows with values x names and no task holds more than two blocks. Blank values and names match nothing.
    """
    from corvane.functions import fuzzy

    v = cut_lineage(values.select(F.col(value).alias("value"), F.lower(F.trim(value)).alias("key")).where("key <> ''").distinct())
    n = cut_lineage(nodes.where("is_active and trim(display_name) <> ''").select("vocabulary", "code", "display_name", F.lower("display_name").alias("name")).distinct())
    v_blocks, n_blocks = (max(1, -(-df.count() // block)) for df in (v, n))
    # each value goes to every block of names, and each name to every block of values
    mine = lambda blocks, *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = v.select("value", "key", mine(v_blocks, "key").alias("vb"), every(n_blocks).alias("nb"))
    right = n.select("*", mine(n_blocks, *n.columns).alias("nb"), every(v_blocks).alias("vb"))

    def best(some: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        names = names.sort_values(["vocabulary", "code", "display_name"], ignore_index=True)
        table, out = fuzzy.NameTable(names["name"].tolist()), []
        first = names["vocabulary"].ne(names["vocabulary"].shift()).to_numpy().nonzero()[0]
        ends = [*first[1:], len(names)]
        for key, same in some.groupby("key")["value"]:
            score = table.scores(key)
            for lo, hi in zip(first, ends, strict=True):
                k = lo + int(score[lo:hi].argmax())  # the first of equals
                if score[k] >= least:
                    out += [(x, *names.loc[k, ["vocabulary", "code", "display_name"]], float(score[k])) for x in same]
        return pd.DataFrame(out, columns=["value", "vocabulary", "code", "display_name", "score"])

    kinds = dict(n.dtypes)
    shape = f"value {dict(v.dtypes)['value']}, vocabulary {kinds['vocabulary']}, code {kinds['code']}, display_name {kinds['display_name']}, score double"
    scored = left.groupBy("vb", "nb").cogroup(right.groupBy("vb", "nb")).applyInPandas(best, shape)
    return first_by(scored, ["value", "vocabulary"], [F.desc("score"), F.col("code"), F.col("display_name")]).select("value", "vocabulary", "code", "display_name", F.round(F.col("score") / 100, 6).alias("confidence"))


# ---- aggregation ---------------------------------------------------------------------------------------------


def top_counts(df: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """A2, A3: rows by group, the largest first; ``n`` keeps that many, ties decided by the group itself."""
    out = df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *(F.asc_nulls_first(c) for c in by))
    return out.limit(n) if n else out


def table_counts(**tables: DataFrame) -> DataFrame:
    """``(name, n)`` of several tables, one scan of metadata each."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``total`` and the non-null values of each column, in one row."""
    return df.agg(F.count("*").alias("total"), *(F.count(c).alias(f"{c}_filled") for c in columns))


def distinct_text(column: str, separator: str = ", ") -> Column:
    """A10: the distinct values of a group in order, as one text."""
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def first_sorted(column: str, n: int) -> Column:
    """The first ``n`` values of a group in order. Groups are bounded by what a chunk or document holds."""
    return F.slice(F.sort_array(F.collect_list(column)), 1, n)


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their percentage of all, against a total of one row."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percentage", F.col(n) / F.col("_total") * 100).drop("_total")


def worst_status(df: DataFrame, status: str, order: list[str]) -> DataFrame:
    """Counts by status and the worst of them, ``order`` going from best to worst."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return df.agg(*(F.count_if(F.col(status) == s).alias(s) for s in order), F.max_by(status, rank).alias("overall"))


# ---- ranking and order ---------------------------------------------------------------------------------------


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Give an order without ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def preferred_vocabulary(matches: DataFrame, key: str, type_col: str) -> DataFrame:
    """The match of each value in the vocabulary fit for its type: rxnorm for medicines, snomed then umls for findings."""
    kind, v = F.lower(F.col(type_col)), F.col("vocabulary")
    rank = F.when(kind.isin("medication", "drug", "dosage"), F.when(v == "rxnorm", 0).otherwise(2)).when(kind.isin("condition", "disease", "adverse_event"), F.when(v == "snomed", 0).when(v == "umls", 1).otherwise(2)).otherwise(F.lit(2))
    return first_by(matches, [key, type_col], [rank, v, F.col("code")])


def running_index(df: DataFrame, partition: list[str], order: list[Column], name: str = "index") -> DataFrame:
    """A number from 0 in each partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows in order, numbered from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


# ---- sets ----------------------------------------------------------------------------------------------------


def distinct_ends(relations: DataFrame) -> DataFrame:
    """The entities that are an end of a relation."""
    return relations.select(F.col("subject_entity_id").alias("entity_id")).union(relations.select("object_entity_id")).where("entity_id is not null").distinct()


def concat_results(*parts: DataFrame) -> DataFrame:
    """Rows of several results, columns that one lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_non_empty(*parts: DataFrame) -> DataFrame:
    """The rows of the first part that has any, the others left out; columns of all parts must agree."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(k)) for k, p in enumerate(parts)])
    best = ranked.agg(F.min("_p").alias("_b"))
    return ranked.crossJoin(F.broadcast(best)).where("_p = _b").drop("_p", "_b")
