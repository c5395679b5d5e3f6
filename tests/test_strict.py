"""Strict JSON: what VARIANT takes and the format doesn't."""

import json

from pyspark.sql import functions as F

from weftline.functions.strict import core_numbers, json_fault

CASES = [
    ('{"a":1}', None), ("[]", None), ("{}", None), (' {"a" : [1, {"b":"x"}]} ', None), ('"s"', None), ("1", None), ("null", None), ('"a\\"b,{["', None), ('{"a\\\\":"\\\\ud800"}', None), ('"\\ud83d\\ude00"', None), ("[1e308,-1.5E-400]", None),
    (None, "SYNTAX"), ("", "SYNTAX"), ("{'a':1}", "SYNTAX"), ('{"a":1,"a":2}', "SYNTAX"), ("﻿{}", "SYNTAX"), ("[1,]", "SYNTAX"), ("01", "SYNTAX"), ("[NaN]", "SYNTAX"), ('"\t"', "SYNTAX"),
    ('"\\ud800"', "SURROGATE"), ('"\\ude00\\ud83d"', "SURROGATE"), ('"\\ud83d\\ud83d\\ude00\\ude00"', "SURROGATE"), ('"\\\\\\uDC00"', "SURROGATE"), ("[1e309]", "NUMBER"), ('{"a":-1E+999}', "NUMBER"), ("9" * 400, "NUMBER"), ("9" * 250 + "e99", "NUMBER"),
    ("[" * 32 + "]" * 32, None), ("[" * 33 + "]" * 33, "DEPTH"), ('{"a":' * 33 + "1" + "}" * 33, "DEPTH"), ("[" * 31 + "{},[[]]" + "]" * 31, "DEPTH"), ("[" * 400 + "]" * 400, "DEPTH"),
    ('{"a":1} x', "TRAILING"), ("{}{}", "TRAILING"), ("[] []", "TRAILING"), ("1 2", "TRAILING"), ('"a" "b"', "TRAILING"), ("{},", "TRAILING"), ("1 ]", "TRAILING"),
    (json.dumps({str(i): [i] for i in range(1024)}), None), (json.dumps({str(i): [i] for i in range(1025)}), "MEMBERS"), (json.dumps([{"a": i} for i in range(4096)]), None), (json.dumps([{"x": list(range(4097))}]), "ELEMENTS"),
    (json.dumps(["\\" * 3 + '"' * 5] * 50 + ["x" * 300_000 + '\\"' * 50_000]), None),
]


def test_faults(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    got = {r.i: r.fault for r in df.select("i", json_fault("raw").alias("fault")).collect()}
    for i, (raw, fault) in enumerate(CASES):
        assert got[i] == fault, ((raw or "")[:60], got[i], fault)


def test_core_numbers(spark):
    cases = [("[0, 1, 9007199254740991]", True), ('{"-5": "-1.5"}', True), ("1e3", True), ("1.0", True), ("9007199254740992", False), ("-1", False), ("[-0]", False), ("0.5", False), ("1e-3", False), ("10e-1", True), ("[1, -2]", False), ("[]", True)]
    df = spark.createDataFrame(cases, "raw string, ok boolean")
    assert df.where(core_numbers("raw") != F.col("ok")).collect() == []
