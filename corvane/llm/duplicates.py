"""Near-duplicate texts: groups of records that share most of their word runs.

Each text becomes the set of hashes of its runs of words. Texts with equal sets are one class and are worked
on once. A class gets MinHash values; bands of them name the shards in which near-duplicates meet, and one
further bit of each value makes an integer fingerprint whose Hamming distance follows the share of common
runs. In every shard a BK-tree holds the fingerprints, children keyed by their distance to the parent, and a
search follows only the edges within the radius. What the trees find is checked exactly on the runs.

A tree over the whole collection can't do this: at a share of 0.6 the radius is so near the distance of
unrelated texts that hardly an edge is left out, and the trees of all shards can't be broadcast without
sending every fingerprint everywhere. Shards by band keep the trees small, and they travel by shuffle. A shard
of more than ``block`` classes is searched in blocks: every block's tree is asked by every block, as tasks of
their own, so no partner is left out and no task holds the whole shard.

Defined results: null texts and texts of fewer words than a run has no part. Repeated ids count once. Texts
are read whole. Extra columns are not read. Equal texts under different ids are pairs with share 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage

WORD = re.compile(r"[^\W_]+")


class BKTree:
    """Integer fingerprints under Hamming distance; children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, list[int], dict[int, int]]] = []

    def add(self, print_: int, item: int) -> None:
        """Insert an item; equal fingerprints share a node."""
        if not self.nodes:
            self.nodes.append((print_, [item], {}))
            return
        at = 0
        while True:
            here, items, children = self.nodes[at]
            d = (here ^ print_).bit_count()
            if d == 0:
                items.append(item)
                return
            if d not in children:
                children[d] = len(self.nodes)
                self.nodes.append((print_, [item], {}))
                return
            at = children[d]

    def within(self, print_: int, radius: int) -> list[int]:
        """Items at most ``radius`` away; only edges from d - radius to d + radius are followed."""
        out, todo = [], [0] if self.nodes else []
        while todo:
            here, items, children = self.nodes[todo.pop()]
            d = (here ^ print_).bit_count()
            if d <= radius:
                out += items
            todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known: dict[str, int] = {}


def _word_hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        h = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(_known) < 1_000_000:  # a store of answers only; it changes no result
            _known[word] = h
    return h


def run_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """For each text the distinct hashes of its runs of words, ascending; all texts are hashed as one array."""
    parts = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    codes, seen = pd.factorize(np.array(list(chain.from_iterable(parts)), dtype=object))
    h = np.fromiter(map(_word_hash, seen), dtype=np.uint64, count=len(seen))[codes]
    n = len(h) - words + 1
    if n < 1:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    run = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        # places count: every word of a run has a multiplier of its own
        run = run * np.uint64(0x9E3779B97F4A7C15) + _mix(h[i : i + n])
    doc = np.repeat(np.arange(len(texts)), sizes)
    # a run lies in one text
    inside = doc[:n] == doc[words - 1 :]
    run, doc = _mix(run[inside]), doc[:n][inside]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    first = np.ones(len(run), dtype=bool)
    first[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    run, doc = run[first], doc[first]
    return np.split(run, np.searchsorted(doc, np.arange(1, len(texts))))


def run_hashes(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's runs of words, ascending."""
    return run_sets([text], words)[0]


def _slices(texts: list[str], characters: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in turn, so many at a time that their words fit in memory."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > characters:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class Signer:
    """MinHash values of run sets: ``bands`` x ``rows`` of them, and one bit of each as the fingerprint."""

    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a = rng.integers(0, 1 << 32, size=n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size=n, dtype=np.uint32)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """The band hashes, a row for each set of runs, and the fingerprints."""
        low = np.full((len(sets), len(self.a)), np.uint32(0xFFFFFFFF), dtype=np.uint32)
        for row, runs in zip(low, sets, strict=True):
            # runs are scrambled already: half of their bits are a hash of 32 bits, of which a multiplier makes another
            x = (runs >> np.uint64(32)).astype(np.uint32)
            for lo in range(0, len(x), 4_096):
                np.minimum(row, (x[None, lo : lo + 4_096] * self.a[:, None] + self.b[:, None]).min(axis=1), out=row)
        part = low.reshape(len(sets), self.bands, self.rows).astype(np.uint64)
        key = np.zeros((len(sets), self.bands), dtype=np.uint64)
        for i in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i] + np.uint64(1))
        key = _mix(key + np.arange(self.bands, dtype=np.uint64))
        bits = _mix(low.astype(np.uint64) + np.arange(low.shape[1], dtype=np.uint64)) & np.uint64(1)
        prints = [int.from_bytes(x.tobytes(), "big") for x in np.packbits(bits.astype(np.uint8), axis=1)]
        return key.view(np.int64), prints


def radius_for(bits: int, share: float, sigmas: float = 4.0) -> int:
    """The Hamming distance that pairs of at least ``share`` exceed by chance only beyond ``sigmas`` deviations."""
    p = (1 - share) / 2
    return min(bits, int(np.ceil(bits * p + sigmas * np.sqrt(bits * p * (1 - p)))))


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``(id, class, print, keys)``, the class being a hash of the set of runs.

    A task names the shards of a class once: later copies have no keys, so that a text copied a million times is sent
    about as often as there are tasks. What a task remembers for that is bounded.
    """
    signer = Signer(bands, rows)

    def sign(batches):
        seen: set[int] = set()
        for b in batches:
            out, at = [], 0
            for part in _slices(b["text"].tolist()):
                sets = run_sets(part, words)
                own = b["id"].iloc[at : at + len(part)]
                at += len(part)
                keys, prints = signer.sign(sets)
                for i, runs, key, print_ in zip(own, sets, keys, prints, strict=True):
                    if not len(runs):
                        continue
                    cls = int.from_bytes(blake2b(runs.tobytes(), digest_size=8).digest(), "little", signed=True)
                    out.append((i, cls, print_.to_bytes(-(-bands * rows // 8), "big"), [] if cls in seen else key))
                    if len(seen) < 1_000_000:
                        seen.add(cls)
            yield pd.DataFrame(out, columns=["id", "class", "print", "keys"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return texts.mapInPandas(sign, f"id {dict(df.dtypes)[id_col]}, class long, print binary, keys array<long>")


def candidate_classes(signed: DataFrame, bands: int, bits: int, share: float, block: int = 512) -> DataFrame:
    """``(class_a, class_b)``: classes whose fingerprints the BK-trees of a common shard find within the radius."""
    radius = radius_for(bits, share)
    # one exchange by shard serves the copies, the sizes and the join
    keyed = signed.select("class", F.explode("keys").alias("shard")).repartition("shard").dropDuplicates(["shard", "class"])
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    prints = signed.groupBy("class").agg(F.first("print").alias("print"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = keyed.join(sizes, "shard").join(prints, "class").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # the tree of block i is asked by block i itself and by every block after it
    tree = F.expr("transform(sequence(own, blocks - 1), o -> struct(own as own, o as other, false as asks))")
    ask = F.expr("transform(filter(sequence(0, own), o -> o < own), o -> struct(o as own, own as other, true as asks))")
    sent = own.select("shard", "class", "print", "blocks", F.explode(F.concat(tree, ask)).alias("at")).select("shard", "class", "print", "blocks", "at.*")
    # small shards share a task's group, each block pair of a large one is a group of its own
    groups = max(8, signed.count() * bands // 100_000)
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("shard"), F.lit(groups))).otherwise(F.xxhash64("shard", "own", "other"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted(_search_shards(rows, radius)), columns=["class_a", "class_b"], dtype="int64")

    return sent.withColumn("part", part).groupBy("part").applyInPandas(search, "class_a long, class_b long").distinct()


def _search_shards(rows: pd.DataFrame, radius: int) -> set[tuple[int, int]]:
    """Pairs within the radius in each (shard, block of the tree, block that asks) of the rows."""
    found: set[tuple[int, int]] = set()
    ordered = sorted(zip(rows["shard"].tolist(), rows["own"].tolist(), rows["other"].tolist(), rows["asks"].tolist(), rows["class"].tolist(), rows["print"].tolist(), strict=True))
    for _, group in groupby(ordered, key=lambda r: r[:3]):
        members = list(group)
        own_block, tree, classes = not members[-1][3], BKTree(), [m[4] for m in members]
        for k, (_, _, _, asks, mine, print_) in enumerate(members):
            p = int.from_bytes(print_, "big")
            if asks or own_block:
                found.update((min(a, mine), max(a, mine)) for a in (classes[j] for j in tree.within(p, radius)) if a != mine)
            if not asks:
                tree.add(p, k)
    return found


def exact_shares(pairs: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """The pairs ``(id_a, id_b)`` whose texts share at least ``share`` of their runs: runs in both by runs in either."""

    def measure(batches):
        for b in batches:
            out = []
            sets = [chain.from_iterable(run_sets(part, words) for part in _slices(b[c].tolist())) for c in ("text_a", "text_b")]
            for p, q in zip(*sets, strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / (len(p) + len(q) - both))
            yield b[["id_a", "id_b"]].assign(share=out)

    need = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    own = texts.join(need, "id", "left_semi").dropDuplicates(["id"])
    a, b = (own.select(F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    kind = dict(texts.dtypes)["id"]
    return pairs.join(a, "id_a").join(b, "id_b").mapInPandas(measure, f"id_a {kind}, id_b {kind}, share double").where(F.col("share") >= share)


def similar_texts(df: DataFrame, id_col: str, text_col: str, share: float, words: int = 5, bands: int = 32, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``(id, class)`` of every text with a run, and ``(class_a, class_b, share)`` between classes.

    The bands leave out a pair of exactly 0.6 with probability 0.01, of 0.7 with 0.0002; 32 bands of 4 are a choice for 0.6
    and above.
    """
    signed = cut_lineage(signatures(df, id_col, text_col, words, bands, rows))
    named = signed.groupBy("class").agg(F.min("id").alias("id"))
    found = candidate_classes(signed, bands, bands * rows, share)
    ids = found.join(named.select(F.col("class").alias("class_a"), F.col("id").alias("id_a")), "class_a").join(named.select(F.col("class").alias("class_b"), F.col("id").alias("id_b")), "class_b")
    ids = cut_lineage(ids)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sure = exact_shares(ids.select("id_a", "id_b"), texts, words, share)
    links = ids.join(sure, ["id_a", "id_b"]).select("class_a", "class_b", "share")
    return signed.select("id", "class").distinct(), links


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, class_id, copies, links)``: one row per id, its class of equal run sets named by the smallest id, the class's size, and the other classes linked to it.

    This and ``links`` say all that ``duplicate_pairs`` writes out, without a row for every pair of copies.
    """
    sizes = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    ends = links.select("class_a").union(links.select("class_b")).groupBy(F.col("class_a").alias("class")).agg(F.count("*").alias("links"))
    named = sizes.join(ends, "class", "left").na.fill(0, ["links"])
    return members.join(named, "class").select("id", "class_id", "copies", "links")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, smaller first: the links with classes written out as their members, and the pairs inside classes."""
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("class").alias(f"class_{x}")) for x in "ab")
    across = links.join(a, "class_a").join(b, "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    many = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    inside = members.join(many, "class", "left_semi")
    x, y = (inside.select(F.col("id").alias(f"id_{k}"), "class") for k in "ab")
    within = x.join(y, "class").where("id_a < id_b").select("id_a", "id_b")
    return across.where("id_a <> id_b").unionByName(within).distinct()


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, group_id)``: one row per id; classes linked to each other, however remotely, are one group, named by its smallest id."""
    from corvane.operators.graph import connected_components

    parts = connected_components(links.select("class_a", "class_b"), members.select("class").distinct()).select(F.col("id").alias("class"), "component")
    own = members.join(parts, "class")
    names = own.groupBy("component").agg(F.min("id").alias("group_id"))
    return own.join(names, "component").select("id", "group_id")
