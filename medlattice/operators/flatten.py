"""Nested resource bundles into flat tables that keep parent-child links.

The bytes of a batch of bodies become arrays of JSON values (:mod:`jsonnodes`); no body is parsed by itself.  All tables
come from there by offsets: the members of a list are a range of its values, their positions the distance to the range's
first, and keys reach a child row by one vectorised take per level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jsonnodes
from .jsonnodes import ARRAY, NULL, OBJECT, Nodes

#: The plain text fields of a name and of an address, and the list fields below them.
TEXTS = ("use", "text", "family", "city", "district", "state", "postalCode", "country")
LISTS = ("given", "prefix", "suffix", "line")
#: Bytes of bodies that are read together; a longer body is read by itself.
TOGETHER = 2_000_000

RESOURCES = "record_id long, entry_no int, resource_type string, resource_id string"
CONTACTS = "record_id long, entry_no int, resource_id string, contact_no int, relationship string"
ITEM_KEY = "record_id long, entry_no int, resource_id string, owner string, owner_no int, kind string, item_no int"
ITEMS = ITEM_KEY + ", is_object boolean, filled boolean, " + ", ".join(f"{t} string" for t in TEXTS) + ", period_start string, period_end string"
PARTS = ITEM_KEY + ", part string, part_no int, value string"
LEAVES = "record_id long, entry_no int, resource_id string, path string, places string, value string"
SCHEMAS = {"resources": RESOURCES, "contacts": CONTACTS, "items": ITEMS, "parts": PARTS, "leaves": LEAVES}


def _named(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])


def _take(values: pa.Array, index: np.ndarray) -> pa.Array:
    return values.take(pa.array(index, pa.int64()))


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype("int32"), pa.int32())


def _of_kind(nodes: Nodes, at: np.ndarray, kind: int) -> np.ndarray:
    """The values where they are of a kind, else -1."""
    return np.where((at >= 0) & (nodes.kind[np.maximum(at, 0)] == kind), at, -1) if len(nodes) else at


def entries(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """(resources, their positions): those of bundles, and single resources at position 0."""
    root = np.flatnonzero((nodes.parent == -1) & (nodes.kind == OBJECT))
    entry = nodes.member(root, "entry")
    kind = nodes.texts(nodes.member(root, "resourceType"))
    bundled = pc.fill_null(pc.equal(kind, "Bundle"), False).to_numpy(zero_copy_only=False) | (entry >= 0)
    member, _, place = nodes.members(_missing_if_null(nodes, entry))
    resource = _of_kind(nodes, nodes.member(_of_kind(nodes, member, OBJECT), "resource"), OBJECT)
    single = root[~bundled]
    at, number = np.concatenate([resource[resource >= 0], single]), np.concatenate([place[resource >= 0], np.zeros(len(single), np.int64)])
    order = np.argsort(at, kind="stable")
    return at[order], number[order]


def _missing_if_null(nodes: Nodes, at: np.ndarray) -> np.ndarray:
    return np.where((at >= 0) & (nodes.kind[np.maximum(at, 0)] == NULL), -1, at) if len(nodes) else at


def _relationships(nodes: Nodes, contact: np.ndarray) -> pa.Array:
    """The first code or text of each contact's relationship."""
    concept, whose, concept_no = nodes.members(nodes.member(contact, "relationship"))
    concept = _of_kind(nodes, concept, OBJECT)
    coding, under, coding_no = nodes.members(nodes.member(concept, "coding"))
    code = nodes.member(_of_kind(nodes, coding, OBJECT), "code")
    said = nodes.member(concept, "text")
    value = np.concatenate([code, said])
    owner = np.concatenate([whose[under], whose])
    first, then = np.concatenate([concept_no[under], concept_no]), np.concatenate([coding_no, np.full(len(said), 1 << 40)])
    texts = nodes.texts(value)
    good = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    order = np.lexsort((then, first, owner))
    order = order[good[order]]
    head = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])[: len(order)]
    place = np.full(len(contact), -1)
    place[owner[order][head]] = order[head]
    return texts.take(pa.array(place, pa.int64(), mask=place < 0))


def _leaves(nodes: Nodes, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(leaves, index into ``entry``, path, positions in the lists along it) of all values that hold no others."""
    level, owner = entry, np.arange(len(entry))
    path, places = pa.repeat("", len(entry)), pa.repeat("", len(entry))
    made: list[tuple] = []
    while len(level):
        inner = (nodes.kind[level] == OBJECT) | (nodes.kind[level] == ARRAY)
        leaf = np.flatnonzero(~inner)
        made.append((level[leaf], owner[leaf], _take(path, leaf), _take(places, leaf)))
        first = np.searchsorted(nodes._parents, level, side="left")
        size = np.searchsorted(nodes._parents, level, side="right") - first
        above = np.repeat(np.arange(len(level)), size)
        place = np.arange(len(above)) - np.repeat(np.cumsum(size) - size, size)
        below = nodes._by_parent[first[above] + place]
        in_list = nodes.kind[level][above] == ARRAY
        key = jsonnodes.unescaped(nodes.strings(nodes.key_start[below], nodes.key_stop[below]), ~in_list)
        step = pc.if_else(pa.array(in_list), "[]", pc.binary_join_element_wise(pc.if_else(pc.equal(_take(path, above), ""), "", "."), pc.fill_null(key, ""), ""))
        step_no = pc.if_else(pa.array(in_list), pc.binary_join_element_wise(pc.if_else(pc.equal(_take(places, above), ""), "", "."), pa.array(place).cast(pa.string()), ""), "")
        path, places = pc.binary_join_element_wise(_take(path, above), step, ""), pc.binary_join_element_wise(_take(places, above), step_no, "")
        level, owner = below, owner[above]
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), pa.array([], pa.string())
    return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), pa.chunked_array([m[2] for m in made]).combine_chunks(), pa.chunked_array([m[3] for m in made]).combine_chunks()


def flatten_nodes(record_ids: pa.Array, nodes: Nodes, what: str) -> list[pa.RecordBatch]:
    """The rows of table ``what`` for the records whose bodies hold ``nodes``."""
    entry, entry_no = entries(nodes)
    rid, number = _take(record_ids, nodes.text[entry]), _ints(entry_no)
    ident = nodes.texts(nodes.member(entry, "id"))
    if what == "resources":
        return [_named(RESOURCES, [rid, number, nodes.texts(nodes.member(entry, "resourceType")), ident])]
    if what == "leaves":
        leaf, at, path, places = _leaves(nodes, entry)
        return [_named(LEAVES, [_take(rid, at), _take(number, at), _take(ident, at), path, places, nodes.texts(leaf)])]
    contact, holder, contact_no = nodes.members(nodes.member(entry, "contact"))
    is_contact = _of_kind(nodes, contact, OBJECT) >= 0
    contact, holder, contact_no = contact[is_contact], holder[is_contact], contact_no[is_contact]
    if what == "contacts":
        return [_named(CONTACTS, [_take(rid, holder), _take(number, holder), _take(ident, holder), _ints(contact_no), _relationships(nodes, contact)])]
    made = []
    for owner, source, above, owner_no in (("resource", entry, np.arange(len(entry)), np.zeros(len(entry), int)), ("contact", contact, holder, contact_no)):
        for kind in ("name", "address"):
            item, parent, item_no = nodes.members(nodes.member(source, kind))
            there = _missing_if_null(nodes, item) >= 0
            item, parent, item_no = item[there], parent[there], item_no[there]
            at, n = above[parent], len(item)
            key = [_take(rid, at), _take(number, at), _take(ident, at), pa.repeat(owner, n), _ints(owner_no[parent]), pa.repeat(kind, n), _ints(item_no)]
            thing = _of_kind(nodes, item, OBJECT)
            is_object = thing >= 0
            if what == "items":
                filled = nodes.filled()[item] & is_object if n else is_object
                texts = {t: nodes.texts(nodes.member(thing, t)) for t in TEXTS}
                texts["text"] = pc.if_else(pa.array(is_object), texts["text"], nodes.texts(item))
                period = _of_kind(nodes, nodes.member(thing, "period"), OBJECT)
                ends = [nodes.texts(nodes.member(period, e)) for e in ("start", "end")]
                made.append(_named(ITEMS, [*key, pa.array(is_object), pa.array(filled), *[texts[t] for t in TEXTS], *ends]))
                continue
            for part in LISTS:
                value, under, part_no = nodes.members(nodes.member(thing, part))
                there = _missing_if_null(nodes, value) >= 0
                value, under, part_no = value[there], under[there], part_no[there]
                made.append(_named(PARTS, [*[_take(k, under) for k in key], pa.repeat(part, len(value)), _ints(part_no), nodes.texts(value)]))
    return made


def _slices(bodies: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bodies are read together."""
    size = pc.fill_null(pc.binary_length(bodies), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TOGETHER, side="right")))
        yield start, stop
        start = stop


def flatten(records: DataFrame, what: str, record_id: str = "record_id", body: str = "body") -> DataFrame:
    """One flat table of the bundles: ``resources``, ``contacts``, ``items`` (names and addresses), ``parts`` or ``leaves``.

    Every row names its parent: record_id and entry_no the resource, owner and owner_no the resource itself or one of
    its contacts, kind and item_no the name or address, part and part_no the given name, prefix or line.  ``leaves`` has
    every value of every resource that holds no others, nulls included, by its path and its positions in the lists along
    it, so no field is lost.  Positions count null and hollow members; null members give no row in the other tables,
    plain text in place of an object a row with ``is_object`` false, a value that is no text its JSON as written.  Null,
    empty and damaged bodies give no rows, repeated bodies rows of their own.
    """
    schema = SCHEMAS[what]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield from flatten_nodes(part.column(0), jsonnodes.read(jsonnodes.unwrapped(part.column(1))), what)

    return records.select(F.col(record_id).cast("long").alias("record_id"), F.col(body).cast("string").alias("body")).mapInArrow(work, schema)


def objects(items: DataFrame) -> DataFrame:
    """The positions of all names and addresses that are objects with content."""
    return items.where("is_object and filled").select("record_id", "entry_no", "owner", "owner_no", "kind", "item_no")
