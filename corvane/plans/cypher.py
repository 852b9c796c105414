"""The subset of graph patterns that is in use, as DataFrame plans.

Understood are ``MATCH (a[:Label] [{key: 'value'}])[-[r[:TYPE][*lo..hi]]->(b[:Label])] [WHERE …] RETURN … [ORDER BY …]
[LIMIT n]`` with returned items ``x.property``, ``count(x)``, ``count(*)``, ``type(r)``, ``labels(x)[0]`` and
``length(path)``. Anything else raises ``ValueError``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE = r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)"
_EDGE = r"-\s*\[\s*(\w+)?\s*(?::\s*(\w+))?\s*(\*\s*(\d+)?\s*\.\.\s*(\d+))?\s*\]\s*->"
_MATCH = re.compile(rf"^\s*MATCH\s+(?:(\w+)\s*=\s*)?{_NODE}(?:\s*{_EDGE}\s*{_NODE})?\s*(?:WHERE\s+(.+?)\s+)?RETURN\s+(.+?)(?:\s+ORDER\s+BY\s+(.+?))?(?:\s+LIMIT\s+(\d+))?\s*;?\s*$", re.I | re.S)
_PART = re.compile(r"^\s*(\w+)\.(\w+)\s*(=|<>|>=|<=|>|<|CONTAINS|STARTS WITH|IN)\s*(.+?)\s*$", re.I | re.S)


def _literal(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_literal(x) for x in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\s\[\]]+", text[1:-1])]
    if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+", text):
        return float(text)
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    raise ValueError(f"not understood: {text}")


def run_pattern(query: str, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Run a pattern on ``vertices (id, label, …)`` and ``edges (edge_id, src, dst, predicate, …)``."""
    m = _MATCH.match(query)
    if not m:
        raise ValueError(f"pattern not understood: {query}")
    path, a, a_label, a_props, r, r_type, span, lo, hi, b, b_label, b_props, where, returns, order, limit = m.groups()
    a, b, r = a or "_a", b or "_b", r or "_r"
    has_edge = m.group(5) is not None or m.group(6) is not None or m.group(7) is not None or m.group(10) is not None or "->" in query

    def side(name, label, props):
        v = vertices.select(*(F.col(c).alias(f"{name}__{c}") for c in vertices.columns))
        v = v.where(F.col(f"{name}__label") == label) if label else v
        for k, x in re.findall(r"(\w+)\s*:\s*('[^']*'|\"[^\"]*\"|[\d.]+)", props or ""):
            v = v.where(F.col(f"{name}__{k}") == _literal(x))
        return v

    df = side(a, a_label, a_props)
    if has_edge:
        e = edges.where(F.lower("predicate") == r_type.lower()) if r_type and r_type.upper() not in ("RELATES_TO", "RELATED_TO") else edges
        if span:
            from corvane.operators.graph import directed_paths

            start = side(a, a_label, a_props)
            start = start.where(_condition(where, {a})) if where and _names(where) == {a} else start
            found = directed_paths(e, start.select(F.col(f"{a}__id").alias("id")), int(hi)).where(F.col("hops") >= int(lo or 1))
            df = df.join(found.select(F.col("seed").alias(f"{a}__id"), F.col("id").alias(f"{b}__id"), F.col("hops").alias("_length"), F.col("predicates").alias(f"{r}__predicates")), f"{a}__id")
        else:
            own = e.select(*(F.col(c).alias(f"{r}__{c}") for c in e.columns))
            df = df.join(own, F.col(f"{a}__id") == F.col(f"{r}__src")).withColumn(f"{b}__id", F.col(f"{r}__dst")).withColumn("_length", F.lit(1))
        right = side(b, b_label, b_props)
        df = df.join(right, f"{b}__id")
    if where:
        df = df.where(_condition(where, {a, b, r}))
    plain, counts = [], []
    for item in re.split(r",(?![^()\[\]]*[)\]])", returns):
        text, _, name = re.sub(r"\s+as\s+", "\0", item.strip(), flags=re.I).partition("\0")
        name = name.strip() or re.sub(r"\W+", "_", text).strip("_").lower()
        text = text.strip()
        if c := re.fullmatch(r"count\s*\(\s*(?:\*|\w+(?:\.\w+)?)\s*\)", text, re.I):
            counts.append(F.count("*").alias(name))
        elif t := re.fullmatch(r"type\s*\(\s*(\w+)\s*\)", text, re.I):
            plain.append(F.col(f"{t[1]}__predicate").alias(name))
        elif t := re.fullmatch(r"labels\s*\(\s*(\w+)\s*\)\s*\[\s*0\s*\]", text, re.I):
            plain.append(F.col(f"{t[1]}__label").alias(name))
        elif path and re.fullmatch(rf"length\s*\(\s*{path}\s*\)", text, re.I):
            plain.append(F.col("_length").alias(name))
        elif t := re.fullmatch(r"(\w+)\.(\w+)", text):
            plain.append(F.col(f"{t[1]}__{'id' if t[2] == 'entity_id' and f'{t[1]}__entity_id' not in df.columns else t[2]}").alias(name))
        else:
            raise ValueError(f"not understood: {item}")
        _ = c
    out = df.groupBy(*plain).agg(*counts) if counts and plain else df.agg(*counts) if counts else df.select(*plain)
    if order:
        keys = []
        for k in order.split(","):
            name, _, way = k.strip().partition(" ")
            name = re.sub(r"\W+", "_", name).strip("_").lower()
            keys.append(F.desc(name) if way.strip().lower() == "desc" else F.asc(name))
        out = out.orderBy(*keys, *(c for c in out.columns))
    return out.limit(int(limit)) if limit else out


def _names(where: str) -> set[str]:
    return {p.split(".")[0].strip() for p in re.findall(r"\w+\.\w+", re.sub(r"'[^']*'", "", where))}


def _condition(where: str, names: set[str]):
    cond = None
    for part in re.split(r"\s+AND\s+", where, flags=re.I):
        m = _PART.match(part)
        if not m or m[1] not in names:
            raise ValueError(f"condition not understood: {part}")
        key = "id" if m[2] == "entity_id" else m[2]
        col, value, op = F.col(f"{m[1]}__{key}"), _literal(m[4]), m[3].upper()
        one = {"=": lambda: col == value, "<>": lambda: col != value, ">": lambda: col > value, "<": lambda: col < value, ">=": lambda: col >= value, "<=": lambda: col <= value, "CONTAINS": lambda: F.contains(col, F.lit(value)), "STARTS WITH": lambda: F.startswith(col, F.lit(value)), "IN": lambda: col.isin(value)}[op]()  # noqa: B023
        cond = one if cond is None else cond & one
    return cond
