import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions.documents import canonical_json, content_hash, json_equal, row_hash, with_ordered_maps
from tidemark.operators import documents as O


def pairs(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, current string, desired string")


ORDER = '{"order":7,"lines":[{"part":3,"rush":%s},{"part":4,"rush":false}],"customer":{"name":"ann","notes":{}}}'

# name, current, desired, included (None: an error)
CASES = [
    ("same order spaced apart", '{"order":1,"state":"F"}', '{ "state" : "F",\n "order" : 1 }', True),
    ("order with a rush line", ORDER % "true", '{"lines":[{"part":3,"rush":true}]}', True),
    ("order without that rush line", ORDER % "false", ORDER % "true", False),
    ("order lacks the wanted discount", ORDER % "true", '{"order":7,"discount":0.05}', False),
    ("one field of the customer", ORDER % "true", '{"customer":{"name":"ann"}}', True),
    ("customer without phone", ORDER % "true", '{"customer":{"phone":null}}', False),
    ("list in another order", '{"a":[1,2,3]}', '{"a":[3,1]}', True),
    ("wanted ship mode is not on the order", '{"order":7,"modes":["RAIL","AIR"]}', '{"modes":["TRUCK","AIR"]}', False),
    ("list members are compared whole", '{"a":[{"x":1,"y":2}]}', '{"a":[{"x":1}]}', False),
    ("order cut off in the middle", ORDER[:40], '{"order":7}', None),
    ("wanted part cut off", ORDER % "true", '{"customer":{"name"', None),
    ("no map", "[1]", '{"a":1}', None),
    ("scalar", '{"a":1}', "1", None),
    ("sql null", None, '{"a":1}', None),
    ("constant that is not JSON", '{"a":NaN}', '{"a":1}', None),
    ("number out of range", '{"a":1e999}', '{"a":1}', None),
    ("null current", "null", '{"a":1}', False),
    ("null desired", '{"a":1}', "null", True),
    ("both null", "null", "null", True),
    ("empty desired", '{"a":1}', "{}", True),
    ("missing key wanted null", "{}", '{"a":null}', False),
    ("null for null", '{"a":null}', '{"a":null}', True),
    ("empty map wants a map", '{"a":1}', '{"a":{}}', False),
    ("empty map in a map", '{"a":{"b":1}}', '{"a":{}}', True),
    ("empty list wants a list", '{"a":{}}', '{"a":[]}', False),
    ("empty list in a list", '{"a":[1]}', '{"a":[]}', True),
    ("number spelled apart", '{"a":100,"b":[1.0]}', '{"a":1e2,"b":[1]}', True),
    ("doubles of long numbers", '{"a":9007199254740993}', '{"a":9007199254740992}', True),
    ("true is not one", '{"a":1}', '{"a":true}', False),
    ("false is not zero in a list", '{"a":[0]}', '{"a":[false]}', False),
    ("text is not a number", '{"a":"1"}', '{"a":1}', False),
    ("minus zero", '{"a":-0.0}', '{"a":0}', True),
    ("last of repeated keys", '{"a":1,"a":2}', '{"a":2}', True),
]


def test_includes(spark):
    df = O.compare_includes(pairs(spark, [c[1:3] for c in CASES]), "current", "desired").orderBy("i")
    got = [(c[0], r["included"], r["error"] is not None) for c, r in zip(CASES, df.collect())]
    assert got == [(name, want, want is None) for name, _, _, want in CASES]


def test_deep_documents(spark):
    deep = "{}"
    other = '{"x":1}'
    for _ in range(200):
        deep, other = '{"a":%s,"b":1}' % deep, '{"a":%s}' % other
    df = O.compare_includes(pairs(spark, [(deep, deep), (deep, other), (other, deep)]), "current", "desired")
    assert [r["included"] for r in df.orderBy("i").collect()] == [True, False, False]


def test_equal(spark):
    rows = [
        ('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1.0}', True),
        ('{"a":[1,2]}', '{"a":[2,1]}', False),
        ("1e2", "100", True),
        ("true", "1", False),
        ("[true]", "[1]", False),
        ("null", "null", True),
        ("null", "{}", False),
        ("{", "{}", None),
        (None, "{}", None),
    ]
    df = pairs(spark, [r[:2] for r in rows]).withColumn("e", json_equal(F.col("current"), F.col("desired"))).orderBy("i")
    assert [r["e"] for r in df.collect()] == [r[2] for r in rows]


def test_drift(spark):
    current = '{"a":1,"b":{"c":{"d":1}},"l":[1,2],"same":"x"}'
    desired = '{"a":2,"b":{"c":{"d":1,"e":null}},"l":[2,3],"m":{"n":1},"same":"x","k\\"q":0}'
    df = O.json_drift(pairs(spark, [(current, desired), (current, current), ("{", desired)]), "i", "current", "desired")
    assert sorted(tuple(r) for r in df.collect()) == [
        (0, '["a"]', "differs", "2"),
        (0, '["b"]["c"]["e"]', "missing", "null"),
        (0, '["k\\"q"]', "missing", "0"),
        (0, '["l"]', "differs", "[2,3]"),
        (0, '["m"]', "missing", '{"n":1}'),
        (2, None, "error", None),
    ]


scalars = st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", "a", "1"]) | st.sampled_from([0.5, 1.0])
documents = st.recursive(
    scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=12
)
maps = st.dictionaries(st.sampled_from("abc"), documents, max_size=3)


@settings(max_examples=300, deadline=None)
@given(maps, maps)
def test_inclusion_laws(a, b):
    read = D._Reader()

    def included(x, y):
        return D._included(read.map_pair(json.dumps(x), json.dumps(y)))

    assert included(a, a) and included(a, {})
    # adding keys to current never breaks what held
    if included(a, b):
        assert included({**a, "z": 1}, b)
        # a wanted key must be there, and no scalar may differ
        for key, node in b.items():
            assert key in a
            if not isinstance(node, (dict, list)):
                assert json.dumps(float(node) if isinstance(node, int) and not isinstance(node, bool) else node) == json.dumps(
                    float(a[key]) if isinstance(a[key], int) and not isinstance(a[key], bool) else a[key]
                )
    # no drift exactly if included
    assert included(a, b) == (not D._drift_rows(read.map_pair(json.dumps(a), json.dumps(b))))


def test_resolve_and_datasource(spark):
    good = '{"spec":{"dataSchema":{"dataSource":"pages"}}}'
    order, customer = '{"lines":[1,2],"order":7}', ' {"segment" : "BUILDING",\n"name":"ann"} '
    rows = [
        (order, customer, order, None),
        (None, customer, '{"name":"ann","segment":"BUILDING"}', None),
        ("", order, order, None),
        (good, None, good, None),
        ('{"a":1,"b":{"c":1,"c":2},"a":3}', None, '{"a":3,"b":{"c":2}}', None),
        ("", "", None, "no valid ingestion spec provided"),
        (None, None, None, "no valid ingestion spec provided"),
        (None, customer[:12], None, "error unmarshalling Spec"),
        (order[:9], good, None, "error unmarshalling nativeSpec"),
        ("[1]", None, None, "error unmarshalling nativeSpec"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, native string, text string")
    got = O.resolve_spec(df).orderBy("i").collect()
    assert [(r["spec"], r["error"]) for r in got] == [r[2:] for r in rows]

    specs = [
        (good, "pages"),
        ('{"spec":{"dataSchema":{}}}', None),
        ('{"spec":{"dataSchema":{"dataSource":123}}}', None),
        ('{"other":{}}', None),
        ('{"spec":[]}', None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(specs)], "i int, spec string")
    got = O.extract_datasource(df).orderBy("i").collect()
    assert [(r["dataSource"], r["error"] is None) for r in got] == [(n, n is not None) for _, n in specs]


def test_compaction(spark):
    good = '{"spec":{"dataSchema":{"dataSource":"pages"}}}'
    rows = [
        (None, good, "{}", False),
        ("", "{}", "{}", False),
        ('{"metric":"a","b":{"c":[1]}}', good, '{"b":{"c":[1]},"dataSource":"pages","metric":"a"}', False),
        ('{"dataSource":"old"}', good, '{"dataSource":"pages"}', False),
        ("null", good, '{"dataSource":"pages"}', False),
        ('{"metric":"a"}', "{}", None, True),
        ("{", good, None, True),
        ("[]", good, None, True),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, compaction string, spec string")
    got = O.enrich_compaction(df).orderBy("i").collect()
    assert [(r["document"], r["error"] is not None) for r in got] == [r[2:] for r in rows]


def test_task_id(spark):
    rows = [
        ('{"task":"t","id":"i"}', "t"),
        ('{"task":"","id":"i"}', "i"),
        ('{"id":"i"}', "i"),
        ('{"task":null,"id":"i"}', "i"),
        ("{}", None),
        ("null", None),
        ('{"task":1}', None),
        ("x", None),
        ('{"ID":"x"}', "x"),
        ('{"Task":"a","id":"i","TASK":"b"}', "b"),
        ('{"id":"a","id":"b"}', "b"),
        ('{"id":"a","ID":2}', None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, response string")
    got = O.extract_task_id(df).orderBy("i").collect()
    assert [(r["task_id"], r["error"] is None) for r in got] == [(w, w is not None) for _, w in rows]


def test_rules(spark):
    rules = '[{"type":"load","tieredReplicants":{"hot":2}},{"type":"drop","interval":"2012-01-01/2013-01-01"}, 5]'
    df = spark.createDataFrame([(1, rules), (2, "[]"), (3, None)], "i int, rules string")
    got = [tuple(r) for r in O.rules_to_rows(df, "i").orderBy("position").collect()]
    assert got == [
        (1, 0, "load", '{"tieredReplicants":{"hot":2},"type":"load"}', None),
        (1, 1, "drop", '{"interval":"2012-01-01/2013-01-01","type":"drop"}', None),
        (1, 2, None, "5", "error unmarshalling rule"),
    ]
    texts = [r[0] for r in df.orderBy("i").select(O.rules_text(F.col("rules"))).collect()]
    assert texts[0].startswith('[{"tieredReplicants"') and texts[1:] == ["null", "null"]


def test_broken_rules_are_no_empty_list(spark):
    texts = ['[{"type":"load"', '{"type":"load"}', "null", " ", '["x"]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, rules string")
    got = [(r["i"], r["position"], r["error"] is None) for r in O.rules_to_rows(df, "i").orderBy("i").collect()]
    assert got == [(0, None, False), (1, None, False), (4, 0, False)]
    assert [r[0] for r in df.orderBy("i").select(O.rules_text(F.col("rules"))).collect()] == [None, None, "null", "null", '["x"]']


def test_hash_ignores_the_order_of_map_entries(spark):
    df = spark.sql("""SELECT map('a', 1, 'b', 2) AS m, array(map('x', map('k', 1, 'j', 2))) AS deep
        UNION ALL SELECT map('b', 2, 'a', 1), array(map('x', map('j', 2, 'k', 1)))
        UNION ALL SELECT null, null""")
    hashes = [r[0] for r in df.select(content_hash(*with_ordered_maps(df, ["m", "deep"]))).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    assert [r[0] for r in df.select(row_hash(df, df.columns)).collect()] == hashes


def test_canonical_and_hash(spark):
    df = spark.createDataFrame([('{"b":1,"a":[1, 2.50]}', "x")], "d string, s string")
    row = df.select(canonical_json(F.col("d")).alias("c"), content_hash("s").alias("h")).first()
    assert row["c"] == '{"a":[1,2.5],"b":1}'
    import base64
    import hashlib

    assert row["h"] == base64.b64encode(hashlib.sha1(b'{"s":"x"}').digest()).decode()


def test_whole_texts_are_read(spark):
    """A difference at the end of a long document counts."""
    rnd = random.Random(1)
    body = {f"k{i}": rnd.random() for i in range(20000)}
    a, b = json.dumps({**body, "z": 1}), json.dumps({**body, "z": 2})
    df = O.json_drift(pairs(spark, [(a, b)]), "i", "current", "desired")
    assert [tuple(r) for r in df.collect()] == [(0, '["z"]', "differs", "2")]


@pytest.mark.parametrize("text", ['{"a":"\\u00e9\\n"}', '{"é":"x"}'])
def test_text_round_trip(text):
    ok, doc = D._Reader().read(text)
    assert ok and doc == json.loads(text)
