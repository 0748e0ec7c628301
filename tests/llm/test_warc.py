"""Round trips through WARC files, and revisits against a plain search."""

import datetime as dt
import gzip
import hashlib

import pytest

from lakeload.llm import warc as w

SECOND = dt.timedelta(seconds=1)
START = dt.datetime(2024, 1, 1)


def record(n, kind, uri, at, headers, payload=None, status=None, profile=None):
    payload = payload.encode() if isinstance(payload, str) else payload
    profile = profile or (w.REVISIT if kind == "revisit" else None)
    date = None if at is None else START + at * SECOND
    return (f"urn:{n}", kind, uri, date, status or (304 if kind == "revisit" else 200), headers, payload, profile)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    rows = [
        record(1, "response", "http://a.net/", 1, {"etag": '"1"', "x": "a: b"}, "<p>é日\r\n\r\nWARC/\r\n\r\n\r\n end</p>"),
        record(2, "response", "http://a.net/2", 2, {}, ""), record(3, "revisit", "http://a.net/", 3, {"etag": '"1"'}),
        record(4, "response", "http://a.net/3", 4, {"date": "x"}, "y" * 100_000, 404), record(5, "response", "http://a.net/4", 5, {}, "\r\n\r\n"),
    ]
    df = spark.createDataFrame(rows, w.RECORD).repartition(2)
    w.write_warc(df, str(tmp_path / "w"), compression)
    got = w.read_warc(spark, str(tmp_path / "w"))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


def test_records_that_are_cut_off_or_odd(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{n}>\r\nwarc-target-uri:http://a.net/\r\nWARC-Date: {d}\r\nContent-Length: {k}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nETag: one\r\netag: two\r\nbad line\r\n\r\nbody"
    text = head.format(n=1, d="2024-01-01T00:00:00Z", k=len(http)) + http + "\r\n\r\n"
    inner = http + "\r\n\r\nWARC/1.1\r\nin a body"
    text += head.format(n=3, d="2024-01-01T00:00:00Z", k=len(inner)) + inner + "\r\n\r\n"
    text += head.format(n=2, d="never", k=len(http) + 50) + http
    (tmp_path / "x.warc").write_bytes(text.encode())
    rows = w.read_warc(spark, str(tmp_path / "x.warc")).collect()
    got = {r.record_id: r for r in rows}
    assert len(rows) == 4 and got["urn:3"].kind == got[None].kind == "broken"  # a body that looks like a record's start
    assert got["urn:1"].headers == {"etag": "two"} and got["urn:1"].payload == b"body" and got["urn:1"].date == START
    assert got["urn:2"].kind == "broken" and got["urn:2"].date is None and got["urn:2"].payload is None
    assert got["urn:1"].uri == "http://a.net/" and got["urn:1"].status == 200


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_bodies_of_any_bytes_stay_as_they_are(spark, tmp_path, compression):
    latin = bytes.fromhex("636166E9206372E86D65")
    bodies = [latin, gzip.compress(b"page" * 999), bytes(range(256)) * 40, b"\xff\xd8\xff\xe0 image \x00\xff", b"\xf0\x9f", b"\r\n\r\n\xe9"]
    rows = [record(i, "response", f"http://a.net/{i}", i, {"etag": f'"{i}"'}, b) for i, b in enumerate(bodies)]
    rows += [record(100 + i, "revisit", f"http://a.net/{i}", 50, {"etag": f'"{i}"'}) for i in range(len(bodies))]
    w.write_warc(spark.createDataFrame(rows, w.RECORD).repartition(2), str(tmp_path / "w"), compression)
    records = w.read_warc(spark, str(tmp_path / "w"))
    got = {r.record_id: bytes(r.payload) for r in records.where("kind = 'response'").collect()}
    assert got == {f"urn:{i}": b for i, b in enumerate(bodies)}
    resolved = {r.record_id: (r.outcome, r.digest, r.n_bytes) for r in w.resolve_revisits(records).collect()}
    expected = {f"urn:{100 + i}": ("resolved", hashlib.md5(b).hexdigest(), len(b)) for i, b in enumerate(bodies)}
    assert resolved == expected


def test_all_header_lines_are_read(spark, tmp_path):
    headers = {f"x-{i:05}": str(i) for i in range(12_000)}
    rows = [record(1, "response", "http://a.net/", 1, headers | {"etag": "1"}, "b")]
    w.write_warc(spark.createDataFrame(rows, w.RECORD), str(tmp_path / "w"))
    assert w.read_warc(spark, str(tmp_path / "w")).first().headers == headers | {"etag": "1"}


def test_profiles_are_told_apart(spark):
    same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    tag = {"etag": "1"}
    rows = [
        record("f", "response", "http://a.net/", 1, tag, "b"),
        record("digest", "revisit", "http://a.net/", 2, tag, None, 200, same),
        record("older", "revisit", "http://a.net/", 2, tag, None, 304, w.REVISIT.replace("1.1", "1.0")),
        record("none", "revisit", "http://a.net/", 2, tag)[:-1] + (None,),
        record("odd", "revisit", "http://a.net/", 2, tag, None, 200)[:-1] + (None,),
    ]
    got = {r.record_id: (r.outcome, r.base_id) for r in w.resolve_revisits(spark.createDataFrame(rows, w.RECORD)).collect()}
    assert got == {
        "urn:digest": ("other_profile", None), "urn:older": ("resolved", "urn:f"),
        "urn:none": ("resolved", "urn:f"), "urn:odd": ("other_profile", None),
    }


RECORDS = [
    record("f1", "response", "http://a.net/x", 10, {"etag": '"1"', "content-type": "t", "date": "d1", "server": "s1"}, "one"),
    record("f2", "response", "https://www.a.net/x/#z", 20, {"etag": 'W/"2"', "content-type": "t"}, "two"),
    record("e", "response", "http://a.net/x", 25, {"etag": '"9"'}, "error", 500),
    record("r0", "revisit", "http://a.net/x", 10, {"etag": '"1"'}),
    record("r1", "revisit", "http://a.net/x", 15, {"etag": 'W/"1"', "date": "d2", "content-type": "no", "server": "no"}),
    record("r2", "revisit", "http://m.a.net/x.html", 30, {"etag": '"2"', "vary": "v"}),
    record("r3", "revisit", "http://a.net/x", 30, {"etag": '"1"'}),
    record("r4", "revisit", "http://a.net/x", 31, {}),
    record("g", "response", "http://b.net/", 1, {"last-modified": "m"}, None),
    record("r5", "revisit", "http://b.net/", 2, {"last-modified": "m", "etag": '"5"', "expires": "e"}),
    record("r6", "revisit", "http://b.net/", 2, {"last-modified": "n"}),
    record("r7", "revisit", "http://b.net/", None, {"last-modified": "m"}),
    record("r8", "revisit", None, 5, {"last-modified": "m"}),
    record("n", "response", None, 1, {"last-modified": "m"}, "nowhere"),
    record("h1", "response", "http://c.net/", 1, {"etag": "1"}, "a"), record("h2", "response", "http://c.net/", 1, {"etag": "2"}, "b"),
    record("r9", "revisit", "http://c.net/", 2, {"etag": "2"}),
    record("i", "request", "http://c.net/", 1, {}, "q"),
]


def test_revisits_are_resolved_as_of_their_date(spark):
    df = spark.createDataFrame([(*r, 1) for r in RECORDS + RECORDS[4:5]], w.RECORD + ", base int").repartition(3)
    rows = w.resolve_revisits(df).collect()
    got = {r.record_id[4:]: (r.outcome, r.base_id and r.base_id[4:], r.headers, r.n_bytes) for r in rows}
    none = (None, None, None)
    assert got == {
        "r0": ("no_base", *none), "r3": ("changed", *none), "r4": ("unverified", *none), "r6": ("changed", *none),
        "r7": ("no_base", *none), "r8": ("no_base", *none),
        "r1": ("resolved", "f1", {"etag": 'W/"1"', "content-type": "t", "date": "d2", "server": "s1"}, 3),
        "r2": ("resolved", "f2", {"etag": '"2"', "content-type": "t", "vary": "v"}, 3),
        "r5": ("resolved", "g", {"last-modified": "m", "etag": '"5"', "expires": "e"}, 0),
        "r9": ("resolved", "h2", {"etag": "2"}, 1),
    }
    assert sum(r.record_id == "urn:r1" for r in rows) == 2
    bodies = {r.record_id: r.payload for r in w.with_payload(w.resolve_revisits(df), df).collect()}
    assert bodies["urn:r1"] == b"one" and bodies["urn:r3"] is None


def test_an_address_with_most_records(spark):
    rows = []
    for n in range(600):
        kind = "response" if n % 7 == 0 else "revisit"
        rows.append(record(n, kind, "http://hot.net/", n, {"etag": str(n // 14)}, f"b{n}" if kind == "response" else None))
    got = w.resolve_revisits(spark.createDataFrame(rows, w.RECORD).repartition(5)).collect()
    assert len(got) == sum(r[1] == "revisit" for r in rows)
    for r in got:
        n = int(r.record_id[4:])
        base = n // 7 * 7
        assert (r.outcome, r.base_id) == (("resolved", f"urn:{base}") if base // 14 == n // 14 else ("changed", None))


def test_nothing_to_resolve(spark):
    assert w.resolve_revisits(spark.createDataFrame([], w.RECORD)).count() == 0
