"""Nested records: paths of keys and strings, canonical form and hashes against plain Python."""

import hashlib
import json
import random
import struct

from corrob.operators import quality as Q
from corrob.operators import records as R

RECORDS = [
    '{"a":{"email":"x"},"b":[{"k":1}]}', '{"E-Mail":[{"Phone Number":1,"z":null}],"ok":[[["deep"]]]}', "[1,{\"Date_Of.Birth\":\"1\"},[]]", "no json", None, '"text"', "{}", "[]", "7",
    '{"a":' * 40 + '{"wallet":"w"}' + "}" * 40,
]


def table(spark, records):
    return spark.createDataFrame(list(enumerate(records)), "id long, record string")


def walk(x, path=(), name=None):
    if path:
        yield ".".join(path), name, x
    for k, v in x.items() if isinstance(x, dict) else ():
        yield from walk(v, (*path, k), k)
    for i, v in enumerate(x) if isinstance(x, list) else ():
        yield from walk(v, (*path, str(i)))


def test_nodes_are_found_at_any_depth(spark):
    got = sorted((r["id"], r["path"], r["name"] or "", r["kind"]) for r in R.nodes(table(spark, RECORDS), "id", "record").collect())
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    want = []
    for i, text in enumerate(RECORDS):
        if text and text != "no json":
            want += [(i, p, n or "", kinds[type(v)]) for p, n, v in walk(json.loads(text))]
    assert got == sorted(want)


def test_forbidden_keys_and_strings_with_paths(spark):
    found = R.nodes(table(spark, RECORDS), "id", "record")
    assert sorted(map(tuple, R.forbidden_keys(found, (*R.PERSONAL_KEYS, "k")).collect())) == [
        (0, "a.email"), (0, "b.0.k"), (1, "E-Mail"), (1, "E-Mail.0.Phone Number"), (2, "1.Date_Of.Birth"), (9, ".".join(["a"] * 40 + ["wallet"])),
    ]
    assert {(r["id"], r["text"]) for r in R.strings(found).collect()} == {(0, "x"), (1, "deep"), (2, "1"), (9, "w")}
    hits = Q.rule_scan(R.strings(found), ["id", "path"], ["text"], [("^d", "starts"), ("w", "has")]).collect()
    assert {(r["id"], r["path"], r["rule"]) for r in hits} == {(1, "ok.0.0.0", "starts"), (9, ".".join(["a"] * 40 + ["wallet"]), "has")}


def test_no_records(spark):
    assert R.nodes(table(spark, RECORDS).limit(0), "id", "record").count() == 0


def test_numbers_as_scripts_write_them():
    known = {"0": 0.0, "-1": -1.0, "1.5": 1.5, "1e+21": 1e21, "100000000000000000000": 1e20, "123456789012345680000": 123456789012345678901.0, "0.000001": 1e-6, "1e-7": 1e-7, "1.5e-7": 1.5e-7, "-2.5e+30": -2.5e30, "5e-324": 5e-324, "1.7976931348623157e+308": 1.7976931348623157e308, "0.1": 0.1, "1234.5678": 1234.5678, "0.00001234": 1.234e-05}
    assert {k: R.script_number(x) for k, x in known.items()} == {k: k for k in known}
    rng = random.Random(1)
    for _ in range(3000):
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if x == x and abs(x) != float("inf"):
            assert float(R.script_number(x)) == x


def test_canonical_form():
    same = ['{"b":[1.0,{"y":null,"x":"é\\u001f\\n"}],"a":{"10":1,"9":2,"z":true,"Z":0,"-1":3,"01":4}}', ' { "a" : {"01":4,"Z":0e5,"z":true,"-1":3,"9":2.00,"10":1e0}, "b":[1,{"x":"\\u00e9\\u001F\\u000a","y":null}] } ']
    assert R.canonical(same[0]) == R.canonical(same[1]) == '{"a":{"9":2,"10":1,"-1":3,"01":4,"Z":0,"z":true},"b":[1,{"x":"é\\u001f\\n","y":null}]}'
    assert R.canonical('{"a":null}') != R.canonical("{}") and R.canonical('{"a":1,"a":2}') == '{"a":2}'
    assert R.canonical('{"￿":1,"\U00010000":2}') == '{"\U00010000":2,"￿":1}'  # code units, not code points
    assert R.canonical('"\\ud800"') == '"\\ud800"' and R.canonical("1e999") == "null"
    assert [R.canonical(x) for x in ("", "{", "NaN", None, "[1,]")] == [None] * 5
    assert R.canonical('{"h":1,"a":{"h":2}}', "h") == '{"a":{"h":2}}'


def test_hashes_tell_null_from_absent_and_are_verified(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = df.select("a", R.row_json("b", "a").alias("j"), R.content_hash(R.row_json("b", "a")).alias("h")).orderBy("a").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [r["h"] for r in rows] == [sha('{"a":1,"b":null}'), sha('{"a":2,"b":"x"}')]
    good = '{"v":[{"b":1,"a":2.0}],"contentHash":"' + sha('{"v":[{"a":2,"b":1}]}') + '"}'
    records = [good, good.replace("2.0", "3"), good.replace("2.0", "2"), '{"v":1}', "no json", None, '{"contentHash":"' + sha("{}") + '"}']
    got = R.verify_hashes(table(spark, records), "record").orderBy("id").collect()
    assert [r["verified"] for r in got] == [True, False, True, False, False, False, True]
