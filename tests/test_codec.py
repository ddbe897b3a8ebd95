from __future__ import annotations

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators import codec

PATHS = ["a/b.py", "a/c.py", "d.py"]
leaf = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False), st.sampled_from([*PATHS, "x", "@", "-"]))
tree = st.recursive(leaf, lambda t: st.one_of(st.lists(t, max_size=4), st.dictionaries(st.sampled_from(["@", "-", "v", "e", "name", "file", "k"]), t, max_size=3)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(tree)
def test_documents_come_back(doc):
    assert codec.decode_document(json.loads(json.dumps(codec.encode_document(doc, PATHS))), PATHS) == doc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["id", "kind", "n", "parse_status"]), tree, max_size=4), max_size=5))
def test_records_come_back(records):
    packed = json.loads(json.dumps(codec.compress_records(records, {"kind": ["import", "x"], "parse_status": codec.PARSE_STATUS}, ("id",))))
    assert codec.decode_records(packed) == records


def test_bundles_come_back_with_negative_numbers():
    nodes = [{"id": p, "file": p, "imports": PATHS, "parse_status": "ok", "tc_inflation": -1, "facts": {"@": 2, "deep": [None]}} for p in PATHS] + [{"id": "z.py"}]
    bundle = {"nodes": nodes, "edges": [{"src": PATHS[0], "dst": PATHS[1], "kind": "weird"}, {"src": PATHS[0], "dst": "ext::x", "kind": "import", "weight": None}], "summary": {"top": PATHS, "n": -2, "name": "d.py"}}
    packed = json.loads(json.dumps(codec.compress_bundle(bundle)))
    assert codec.decode_bundle(packed) == bundle
    assert packed["body"]["summary"]["name"] == "d.py"
    big = {"nodes": [{"id": f"some/long/folder/name/file_{i}.py", "file": f"some/long/folder/name/file_{i}.py", "parse_status": "ok", "imports": [f"some/long/folder/name/file_{i // 2}.py"]} for i in range(300)], "edges": []}
    assert len(json.dumps(codec.compress_bundle(big, guide=False))) < 0.5 * len(json.dumps(big))


def test_dense_ids_over_many_partitions(spark):
    words = [f"w{random.Random(i).randrange(10**6)}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string").repartition(5)
    got = {r.w: r.code for r in codec.dense_ids(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}
    assert codec.dense_ids(df.limit(0), "w").count() == 0


def test_rows_decode(spark):
    df = spark.createDataFrame([("a", "ok", 1, [1, None]), ("b", "odd", None, None)], "id string, parse_status string, n int, v array<int>")
    head, rows = codec.row_lines(df, {"parse_status": codec.PARSE_STATUS})
    back = codec.decode_rows(head, [json.loads(r.value) for r in rows.collect()])
    assert back == [{"id": "a", "parse_status": "ok", "n": 1, "v": [1, None]}, {"id": "b", "parse_status": "odd"}]


def test_short_names_differ():
    names = codec.short_names(["a_b", "ab", "a_bee", "aa_bb", "b", "a_b_c"])
    assert len(set(names.values())) == 6
