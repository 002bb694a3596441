"""Python-style JSON text (K2) equals json.dumps on awkward strings."""

import json

from pyspark.sql import functions as F

from crawlframe.functions.jsonfmt import json_number, json_object, json_string

VALS = ["plain", 'q"u\\o', "für", "tab\there\nnl\x01", "emoji \U0001F600", "\x7f del", "", None, "/path?a=1&b=2"]


def test_json_string(spark):
    df = spark.createDataFrame([(v,) for v in VALS], "s string")
    assert [r[0] for r in df.select(json_string("s")).collect()] == [json.dumps(v) for v in VALS]


def test_json_object(spark):
    df = spark.createDataFrame([("für", 200, None)], "u string, n int, m string")
    got = df.select(json_object([("url", json_string("u")), ("status_code", json_number("n")),
                                 ("mimetype", json_string("m"))])).first()[0]
    assert got == json.dumps({"url": "für", "status_code": 200, "mimetype": None})
