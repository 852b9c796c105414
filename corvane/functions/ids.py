"""Keys and checksums as columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of this engine's name-based ids; every function takes another.
NODE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "corvane/vocabulary/node")
EDGE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "corvane/vocabulary/edge")
CHUNK_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "corvane/chunk")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID of version 5, equal to Python's ``uuid.uuid5``."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def node_id(vocabulary: Column, code: Column, namespace: uuid.UUID = NODE_NAMESPACE) -> Column:
    """V5: the id of a vocabulary entry."""
    return uuid5(namespace, F.concat_ws(":", vocabulary, code))


def edge_id(vocabulary: Column, source: Column, predicate: Column, target: Column, namespace: uuid.UUID = EDGE_NAMESPACE) -> Column:
    """V5: the id of a vocabulary edge."""
    return uuid5(namespace, F.concat_ws(":", vocabulary, source, predicate, target))


def stable_chunk_uuid(chunk: Column, namespace: uuid.UUID = CHUNK_NAMESPACE) -> Column:
    """A chunk id that is a UUID already as it is in lower case, else a name-based one."""
    return F.when(chunk.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(chunk)).otherwise(uuid5(namespace, chunk))


def cache_key(text: Column, vocabulary: Column, entity_type: Column) -> Column:
    """The md5 key of a normalisation: text and type in lower case."""
    return F.md5(F.concat_ws(":", F.lower(text), vocabulary, F.lower(entity_type)))


def row_checksum(*columns: Column, bits: int = 256) -> Column:
    """V5: the checksum of columns as JSON with the keys in order."""
    return F.sha2(F.to_json(F.struct(*columns)), bits)


def release_checksum(names_and_sums: Column) -> Column:
    """V6: the checksum of a release: sha256 over its sorted ``name=sum`` lines (an array column)."""
    return F.sha2(F.array_join(F.sort_array(names_and_sums), ""), 256)
