"""Crawl-log goldens: digests, lines, fetch times, error classes, parsing, A2."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlframe.functions.digest import content_digest
from crawlframe.functions.timefmt import format_fetch_time
from crawlframe.operators import crawllog as C
from crawlframe.operators import discovery as D

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def test_digests(spark):
    df = spark.createDataFrame([(b"",), (b"abc",), (b"<html></html>",)], "b binary")
    assert [r[0] for r in df.select(content_digest("b")).collect()] == [
        "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", "SQPPW43I4RVSPOJX2NFQP7CNIHNADMAC"]


def test_fetch_time(spark):
    df = spark.createDataFrame([(T0, 2500.0), (T0, 12.5)], "s timestamp_ntz, d double")
    got = df.select(format_fetch_time("s", "d").alias("a"), format_fetch_time("s", "d", compat=True).alias("b")).collect()
    assert got[0].a == "20240101000000000000+2500.0" and got[0].b == "20240101000000000000+500.0"
    assert got[1].a == "20240101000000000000+12.5"


def _responses(spark):
    rows = [("http://h.org/", 200, "text/html; charset=utf-8", b"abc", T0, 1000.0, None, None, None,
             "http://h.org/", None)]
    return spark.createDataFrame(rows, "url string, status_code int, content_type string, body binary, "
                                       "fetch_start timestamp_ntz, duration_ms double, hop_path string, hop string, "
                                       "via string, source string, redirect_urls array<string>")


def test_success_line(spark):
    log = C.to_crawl_log(D.extend_hop_path(_responses(spark)))
    line = C.to_h3_line(log).first().line
    assert line == ("2024-01-01T00:00:01.000000 200 3 http://h.org/  - text/html - 20240101000000000000+1000.0 "
                    "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5 http://h.org/ -")
    assert len(line.split(" ")) == 12
    legacy = C.to_h3_line(log, legacy=True).first().line
    assert legacy == "2024-01-01T00:00:01.000000 200 http://h.org/  - text/html - - - - -"


def test_error_line_and_quarantine(spark):
    rows = [("http://h.org/humans.txt", "IgnoreRequest", T1, "", "I", "http://h.org/", "http://h.org/")
            for T1 in [dt.datetime(2024, 1, 1, 0, 0, 1)]]
    rows.append(("http://x/", "KeyError", T0, None, None, None, None))
    err = spark.createDataFrame(rows, "url string, exception_class string, fetch_start timestamp_ntz, "
                                      "hop_path string, hop string, via string, source string")
    log, bad = C.errors_to_crawl_log(D.extend_hop_path(err))
    assert C.to_h3_line(log).first().line == ("2024-01-01T00:00:01.000000 -9998 0 http://h.org/humans.txt I "
                                               "http://h.org/ - - 20240101000001000000 - http://h.org/ -")
    assert [r.exception_class for r in bad.collect()] == ["KeyError"]
    with pytest.raises(Exception):
        C.classify_errors(err, strict=True)[0].collect()


@pytest.mark.parametrize("exc,code", C.ERROR_STATUS)
def test_error_codes(spark, exc, code):
    df = spark.createDataFrame([(exc,)], "exception_class string")
    assert C.classify_errors(df)[0].first().status_code == code


def test_parse_roundtrip(spark):
    log = C.to_crawl_log(D.extend_hop_path(_responses(spark)))
    good, bad = C.parse_h3_line(C.to_h3_line(log))
    g = good.first()
    assert bad.count() == 0 and g.hop_path == "" and g.status_code == 200 and g.content_digest.startswith("VGMT")
    odd = spark.createDataFrame([("a b c",)], "line string")
    assert C.parse_h3_line(odd)[1].count() == 1


def test_response_digest_any_order(spark):
    ch = spark.createDataFrame([(1, 2, b"c"), (1, 0, b"a"), (1, 1, b"b")], "request_id long, seq int, data binary")
    r = C.response_digest(ch).first()
    assert r.response_bytes == 3 and r.response_digest == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"


def test_all_outcomes_items(spark):
    log = C.to_crawl_log(_responses(spark).withColumn("status_code", F.lit(404)))
    assert C.items_feed(log).count() == 0 and C.all_outcomes(log, log).count() == 2


def test_response_digest_of_any_size(spark):
    import base64
    import hashlib
    ch = [(1, 0, b"ab"), (1, 1, b"c"), (2, 0, None), (None, 1, b"y"), (None, 0, b"x")]
    ch += [(3, k, bytes([k % 251]) * 100_000) for k in range(120)]  # 12 MB in one response
    df = spark.createDataFrame(ch, "request_id long, seq int, data binary").repartition(7)
    got = {r.request_id: (r.response_bytes, r.response_digest) for r in C.response_digest(df).collect()}
    b32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    big = b"".join(d for k, _, d in ch if k == 3)
    assert got == {1: (3, "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"), 2: (0, b32(b"")), None: (2, b32(b"xy")), 3: (len(big), b32(big))}


def test_parse_h3_keeps_bad_rows_apart(spark):
    line = "{} {} {} http://h/ L - text/html - - - s -"
    rows = [line.format("2024-01-01T00:00:01.000002", 200, 3), line.format("2024-01-01T00:00:01", "-", 0), line.format("-", -1, "-"),
            line.format("2024-13-01T00:00:01", 200, 3), line.format("2024-01-01T00:00:01", "2x0", 3), line.format("yesterday", 200, 3),
            line.format("2024-01-01T00:00:01", 99999999999, 3), "too few", None]
    good, bad = C.parse_h3_line(spark.createDataFrame([(r,) for r in rows], "line string"))
    assert [(str(r.timestamp), r.status_code) for r in good.collect()] == [("2024-01-01 00:00:01.000002", 200), ("2024-01-01 00:00:01", None), ("None", -1)]
    assert sorted(map(str, (r.line for r in bad.collect()))) == sorted(map(str, rows[3:]))


def test_items_json_line(spark):
    import json
    from crawlframe.sinks.files import items_json
    log = C.to_crawl_log(D.extend_hop_path(_responses(spark).withColumn("url", F.lit("http://h.org/für"))))
    line = log.select(items_json(log)).first()[0]
    want = {"url": "http://h.org/für", "timestamp": "2024-01-01T00:00:01.000000", "status_code": 200,
            "content_length": 3, "mimetype": "text/html; charset=utf-8", "hop_path": "", "seed": "http://h.org/",
            "via": "-", "thread": "-", "start_time_plus_duration": "20240101000000000000+1000.0",
            "content_digest": "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", "annotations": "-"}
    assert line == json.dumps(want)
