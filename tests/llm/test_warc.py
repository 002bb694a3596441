import base64
import glob
import gzip
import hashlib
import io
import random

import pytest

from crawlframe.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def made():
    rnd = random.Random(2)
    bodies = ["", "<p>é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "same", None]
    return [(k, f"http://h{k % 7}/p\n{k}" if k % 5 else None, rnd.choice(bodies) if k % 3 else f"own {k}") for k in range(120)]


def expected(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = first[h or ""] != i and len(b) >= min_bytes
        out.append((i, len(b), digest(b), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out)


def read(spark, manifest, **kw):
    return [r.asDict() for r in warc.read_archives(spark, manifest, **kw).collect()]


def page(x):
    return int(x.removeprefix("<urn:page:").removesuffix(">")) if x else None


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int").repartition(5)
    manifest = warc.write_archives(df, warc.archive_folder(spark), min_bytes=min_bytes, file_bytes=2_000)
    assert manifest.count() > 5  # files are closed at their size
    got = read(spark, manifest)
    assert sorted((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got) == expected(rows, min_bytes)
    bodies = {page(r["record_id"]): r["payload"] for r in got if r["record_type"] == "response"}
    assert all(bodies[i] == (h or "").encode() for i, _, h in rows if i in bodies)
    for path in manifest.toPandas()["path"]:  # whole files are ordinary multi-member gzip
        assert gzip.decompress(open(path.removeprefix("file:"), "rb").read()).count(b"\r\nWARC-Record-ID: ") > 0


def test_odd_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, "a"), (3, "u", "a"), (3, "u", "a"), (5, "u", "a"), (None, None, None)], "page_id long, url string, html string")
    got = read(spark, warc.write_archives(df, warc.archive_folder(spark)))
    assert sorted((r["record_id"], r["record_type"]) for r in got) == [
        ("<urn:page:3>", "response"), ("<urn:page:3>", "response"), ("<urn:page:5>", "revisit"), ("<urn:page:>", "response"), ("<urn:page:>", "revisit")]
    assert read(spark, warc.write_archives(df.limit(0), warc.archive_folder(spark))) == []


def test_members_are_read_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    records = [warc.record([("WARC-Type", "metadata"), ("WARC-Block-Digest", f"sha1:{digest(b)}")], b) for b in (b"", b"one", b"\r\n\r\n" * 999)]
    found = list(warc.members(io.BytesIO(b"".join(records))))
    assert [p for p, _ in found] == [0, len(records[0]), len(records[0]) + len(records[1])]
    assert [warc.parse(c)[1] for _, c in found] == [b"", b"one", b"\r\n\r\n" * 999]


@pytest.mark.parametrize("damage", [
    lambda b: b[:-9], lambda b: b[:40] + bytes([b[40] ^ 255]) + b[41:], lambda b: b"plain text",
    lambda b: warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:AAAA")], b"x"),
    lambda b: gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"),
    lambda b: gzip.compress(b"WARC/1.1\r\nContent-Length: -1\r\n\r\n\r\n\r\n"), lambda b: gzip.compress(b"no header")])
def test_damage_is_found(spark, damage, tmp_path):
    good = warc.record([("WARC-Type", "metadata")], b"good " * 50)
    path = str(tmp_path / "x.warc.gz")
    open(path, "wb").write(good + damage(good))
    files = spark.createDataFrame([(path,)], "path string")
    rows = read(spark, files, strict=False)
    assert rows[0]["payload"] == b"good " * 50 and rows[-1]["error"]
    with pytest.raises(Exception, match="Damaged"):
        read(spark, files)
