"""JSON values found in bulk, against the standard parser."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medlattice.operators import flatten, jsonnodes

from .conftest import rows

DAMAGED = "ERROR"


def parsed(text):
    try:
        return repr(json.loads(text))
    except ValueError:
        return DAMAGED


def rebuilt(nodes, row):
    """The value of a row, put together from its nodes."""
    values, top = {}, DAMAGED
    texts = nodes.texts(np.arange(len(nodes))).to_pylist()
    for i in np.flatnonzero(nodes.text == row).tolist():
        kind = nodes.kind[i]
        value = {} if kind == jsonnodes.OBJECT else [] if kind == jsonnodes.ARRAY else texts[i] if kind == jsonnodes.STRING else json.loads(bytes(nodes.data[nodes.start[i] : nodes.stop[i]]))
        values[i], parent = value, nodes.parent[i]
        if parent < 0:
            top = None
            root = i
        elif isinstance(values[parent], list):
            assert nodes.place[i] == len(values[parent])
            values[parent].append(value)
        else:
            values[parent][json.loads(b'"' + bytes(nodes.data[nodes.key_start[i] : nodes.key_stop[i]]) + b'"')] = value
    return DAMAGED if top == DAMAGED else repr(values[root])


VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(st.characters(exclude_categories=["Cs"]), max_size=6)),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text('ab"\\{,é', max_size=3), inner, max_size=4)),
    max_leaves=15,
)
ODD = ["", " ", '"a', "[1 2]", '{"a" 1}', '{"a":1,}', "[1,]", "{,}", "[,1]", '{"a":1 "b":2}', "1 2", "{}{}", "[}", "{]", "nullx", "01", "-", "1.", "+1", "NaN", "-Infinity", '"\\u12"', '"\\u00e9"', '"\\x"', '"\t"', '{"a":1,"a":2}', ":", '"a":1', '{"a"}', '{"a":}', "{1:2}", "[[[]]]", "\\", '"\\', "]", "}{"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(VALUES, st.sampled_from([None, 1]), st.booleans(), st.integers(0, 60), st.sampled_from([None, "", '"', "{", "}", "[", "]", ":", ",", "\\", "x", " "])), max_size=5))
def test_values_of_any_texts(made):
    texts = []
    for value, indent, ascii_only, at, odd in made:
        t = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
        texts.append(t if odd is None else t[:at] + odd + t[at + 1 :])
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    nodes = jsonnodes.read(pa.array([None, *texts], pa.string()))
    assert [rebuilt(nodes, i + 1) for i in range(len(texts))] == [parsed(t) for t in texts]


def test_damaged_texts():
    mixed = [t for o in ODD for t in (o, '{"id": "x"}')]
    nodes = jsonnodes.read(pa.array(mixed))
    assert [rebuilt(nodes, i) for i in range(len(mixed))] == [parsed(t) for t in mixed]
    assert len(jsonnodes.read(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("size", [1, 700, 10**9])
def test_slices_do_not_matter(spark, monkeypatch, size):
    random.seed(5)
    bodies = [json.dumps({"resourceType": "Patient", "id": str(i), "telecom": [{"value": "1"}, None, {"rank": i}], "contact": {"relationship": {"text": "kin"}, "name": "N"}, "name": [{"given": ["A"] * (i % 3)}] * (i % 4)}) for i in range(40)]
    column = pa.array(bodies)
    monkeypatch.setattr(flatten, "TOGETHER", size)
    for what in flatten.SCHEMAS:
        whole = flatten.flatten_nodes(pa.array(range(40)), jsonnodes.read(column), what)
        parts = [b for a, z in flatten._slices(column) for b in flatten.flatten_nodes(pa.array(range(a, z)), jsonnodes.read(column[a:z]), what)]
        flat = lambda batches: sorted((r for b in batches for r in map(repr, b.to_pylist())))
        assert flat(whole) == flat(parts) and flat(whole)


def test_leaves_keep_every_field(spark):
    body = {"resourceType": "Patient", "id": "p", "telecom": [{"value": "1", "rank": 2}, None], "extension": [{"extension": [{"url": "u"}]}], "x": {}, "é\n": ""}
    df = spark.createDataFrame([(7, json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"id": "q"}}, {"resource": body}]}))], "record_id long, body string")
    got = rows(flatten.flatten(df, "leaves").where("entry_no = 1").select("path", "places", "value"))
    want = [("resourceType", "", "Patient"), ("id", "", "p"), ("telecom[].value", "0", "1"), ("telecom[].rank", "0", "2"), ("telecom[]", "1", None), ("extension[].extension[].url", "0.0", "u"), ("é\n", "", "")]
    assert got == sorted(want, key=repr)
