"""WARC records as tables, and not-modified revisits resolved to the response they repeat.

A revisit record of profile server-not-modified has the headers of a 304 answer and no body. It is joined as of its date to
the latest earlier full response of the same canonical address; if the validators agree, the response's headers with the
permitted ones of the 304 laid over them and the response's body are what the visit would have fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import ordered, table
from lakeload.llm.url_filter import canonical
from lakeload.workspace import new_folder, stage

CRLF, END = "\r\n", "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers of a 304 answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: A record; the body is bytes, whatever they mean. ``profile`` of a revisit says what it repeats.
RECORD = (
    "record_id string, kind string, uri string, date timestamp, status int, headers map<string,string>, payload binary, "
    "profile string"
)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Writes ``records`` (RECORD, payload null for a revisit) as WARC files, one record after the other, without a shuffle.

    Uncompressed files stay splittable for ``read_warc``; gzip gives one member a file.
    """
    names = F.sort_array(F.map_keys("headers"))
    lines = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k))), CRLF)
    reason = F.when(F.col("status") == 304, "Not Modified").when(F.col("status") == 200, "OK").otherwise("-")
    start = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" "), reason, F.lit(CRLF))
    body = F.concat(start, F.when(lines != "", F.concat(lines, F.lit(CRLF))).otherwise(""), F.lit(CRLF))
    body = F.concat(body, F.coalesce(F.col("payload").cast("string"), F.lit("")))  # the bytes as they are
    fields = [
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Profile", F.when(F.col("kind") == "revisit", F.coalesce("profile", F.lit(REVISIT)))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("body").cast("string")),
    ]
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields))
    text = records.withColumn("body", body).select(F.concat(head, F.lit(END), "body").alias("value"))
    text.write.option("lineSep", END).option("compression", compression).text(path)


def _fields(head: Column) -> Column:
    """The named fields of a head, below its first line, by name in lower case; of equal names the last counts."""
    lines = F.filter(F.split(head, CRLF), lambda x, i: (i > 0) & (F.instr(x, ":") > 1))
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.substr(x, F.instr(x, ":") + 1), F.lit(" \t"))
    named = F.transform(lines, lambda x, i: F.struct(name(x).alias("k"), i.alias("i"), value(x).alias("v")))
    named = F.array_sort(named)  # equal names stand together, the last of them behind the others
    last = lambda n: F.filter(n, lambda x, i: F.coalesce(x["k"] != F.get(n, i + 1)["k"], F.lit(True)))
    kept = F.get(F.transform(F.array(named), last), F.lit(0))  # as a variable, the sorted array is made once
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def _binary_before(text: str) -> Column:
    """Size in bytes of what lies before the first empty line."""
    return F.octet_length(F.substring_index(text, END, 1))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) of WARC files, plain or gzip. A record is one row at any time, never a whole file.

    Records are cut at the empty line and version line between them; the stated length cuts the block, and a record whose
    block is shorter than stated (cut off, or broken up by its own content) has kind ``broken``. Everything is cut by sizes in
    bytes, so a body of any encoding, or of none, comes out as it went in. All lines of a head are read; header names are in
    lower case, and of equal ones the last counts. A field that is absent or empty is null. No record gives no row.
    """
    rows = spark.read.option("lineSep", f"{END}WARC/1.").text(path)
    # of the version line, all but the first record of a file have only its end
    rows = rows.withColumn("size_of_head", _binary_before("value"))
    rows = rows.withColumn("fields", _fields(F.substring_index("value", END, 1)))
    field = lambda name: F.nullif(F.col("fields")[name], F.lit(""))
    size = F.expr("try_cast(fields['content-length'] AS INT)")
    block = F.expr("substring(CAST(value AS BINARY), size_of_head + 5, size)")
    rows = rows.withColumn("size", size).withColumn("block", block).drop("value")
    rows = rows.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    kind = F.when(F.octet_length("block") == F.col("size"), field("warc-type"))
    rows = rows.withColumns({"kind": F.coalesce(kind, F.lit("broken")), "headers": _fields(F.col("http"))})
    body = F.expr("substring(block, octet_length(http) + 5)")
    first_line = F.substring_index("http", CRLF, 1)
    return rows.select(
        F.translate(field("warc-record-id"), "<>", "").alias("record_id"),
        "kind",
        field("warc-target-uri").alias("uri"),
        F.try_to_timestamp(field("warc-date"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("date"),
        F.regexp_extract(first_line, r"\AHTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int").alias("status"),
        F.col("headers").cast("map<string,string>").alias("headers"),
        F.when(F.col("kind") == "response", body).alias("payload"),
        field("warc-profile").alias("profile"),
    )


def _validators_agree(mine: Column, base: Column) -> Column:
    """Null if there is nothing to compare: both etags if both have one (weak or not), else both dates of last change."""
    tag = lambda m: F.regexp_replace(m["etag"], r"\AW/", "")
    changed = lambda m: m["last-modified"]
    return F.coalesce(tag(mine) == tag(base), changed(mine) == changed(base))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (RECORD): record_id, uri, date, outcome, base_id, headers, digest, n_bytes.

    outcome: ``other_profile`` if the revisit does not say that the server answered not modified (its WARC-Profile names
    something else, such as an identical digest, or it has none and its status is not 304); ``resolved``; ``no_base`` without an earlier full response (status 200, strictly earlier date, of two at one
    date the one with the greater record_id); ``changed`` if the validators differ; ``unverified`` if there are none to
    compare. Only a resolved one has base_id, merged headers, and the md5 and size of the body that it stands for. A revisit
    without date or address is ``no_base``. Repeated records give repeated rows. Bodies aren't shuffled: only addresses,
    headers and digests are, dealt by range, so that an address with a third of all records spreads over tasks.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    modified_not = F.coalesce(F.col("profile").endswith("/server-not-modified"), F.col("status") == 304, F.lit(False))
    body = F.coalesce("payload", F.lit("").cast("binary"))
    known = F.struct(
        "record_id", "headers", F.md5(body).alias("digest"),
        F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    narrow = records.where(full | (F.col("kind") == "revisit")).select(
        F.when(F.col("uri").contains("://"), canonical(F.col("uri"))).otherwise(F.col("uri")).alias("address"), "date", full.alias("full"), "record_id", "kind", "uri",
        F.when(F.col("kind") == "revisit", F.col("headers")).alias("mine"), modified_not.alias("modified_not"),
        F.when(full & F.col("date").isNotNull(), known).alias("base"),
    )
    narrow = stage(narrow, "warc-narrow")  # dealing by range reads it twice
    asof = ordered(narrow, ["address"], ["date", "full", "record_id"], "warc-asof", last="base")
    visits = asof.where(F.col("kind") == "revisit")
    named = F.col("address").isNotNull() & F.col("date").isNotNull()
    base = F.when(named, F.col("_last"))
    agree = _validators_agree(F.col("mine"), base["headers"])
    outcome = (
        F.when(~F.col("modified_not"), "other_profile")
        .when(base.isNull(), "no_base")
        .when(agree, "resolved")
        .when(agree.isNull(), "unverified")
        .otherwise("changed")
    )
    visits = visits.withColumns({"_base": base, "outcome": outcome})
    base = F.when(F.col("outcome") == "resolved", F.col("_base"))
    over = F.map_filter("mine", lambda k, _: k.isin(*PERMITTED))
    rest = F.map_filter(base["headers"], lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return visits.select(
        "record_id", "uri", "date", "outcome", base["record_id"].alias("base_id"),
        F.when(base.isNotNull(), F.map_concat(rest, over)).alias("headers"),
        base["digest"].alias("digest"), base["n_bytes"].alias("n_bytes"),
    )


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """``resolved`` with the body of its base; AQE splits the visits of a base that very many refer to."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("base_id"), "payload")
    return resolved.join(bodies.dropDuplicates(["base_id"]), "base_id", "left")


# How visits are derived from pages, in seconds.
FIRST, SPREAD, LATER, SOONER = "2024-01-01 00:00:00", 1_000_003, 500_000, 250_000


def visits_of(pages: DataFrame) -> DataFrame:
    """Records derived from ``pages``: each page is fetched once and visited unchanged twice, once before and once after."""
    at = F.col("page_id") * 7919 % SPREAD
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    made = F.explode(
        F.array(
            *(
                F.struct(F.lit(n).alias("n"), F.lit(k).alias("kind"), F.lit(s).alias("status"), F.lit(d).alias("delay"))
                for n, k, s, d in (("f", "response", 200, 0), ("r", "revisit", 304, LATER), ("s", "revisit", 304, -SOONER))
            )
        )
    )
    rows = pages.select("page_id", "url", "html", tag.alias("tag"), at.alias("at"), made.alias("m"))
    seconds = F.unix_timestamp(F.lit(FIRST).cast("timestamp")) + F.col("at") + F.col("m.delay")
    date = F.timestamp_seconds(seconds)
    stated = F.date_format(date, "yyyy-MM-dd HH:mm:ss")
    fetched = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("date"), stated, F.lit("etag"), F.col("tag"),
        F.lit("server"), F.lit("first"),
    )
    unchanged = F.create_map(
        F.lit("date"), stated, F.lit("etag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("server"), F.lit("second"),
    )
    return rows.select(
        F.concat(F.lit("urn:page:"), F.col("page_id").cast("string"), F.lit(":"), F.col("m.n")).alias("record_id"),
        F.col("m.kind").alias("kind"), F.col("url").alias("uri"), date.alias("date"), F.col("m.status").alias("status"),
        F.when(F.col("m.status") == 200, fetched).otherwise(unchanged).alias("headers"),
        F.when(F.col("m.status") == 200, F.coalesce("html", F.lit("")).cast("binary")).alias("payload"),
        F.when(F.col("m.kind") == "revisit", REVISIT).alias("profile"),
    )


def op4_revisits(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_warc(visits_of(table(spark, sf, "pages")), folder, "gzip")
    resolved = resolve_revisits(read_warc(spark, folder))
    names = F.sort_array(F.map_keys("headers"))
    lines = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), ";")
    return resolved.select(
        "record_id", "outcome", "base_id", lines.alias("headers"), "digest", "n_bytes",
    )


SQL4 = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, '"' || md5(coalesce(html, '')) || '"' AS tag,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 7919 % 1000003) AS seen,
    '//' || regexp_replace(coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '\A(www|m)\.', '') ||
    regexp_replace(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '(?s)(/index)?(\.html?|/)\z', '') ||
    coalesce((SELECT '?' || string_agg(q, '&' ORDER BY q) FROM unnest(string_split(
        regexp_extract(url, '(?s)\A[^?#]*\?([^#]*)', 1), '&')) AS t(q)
        WHERE q <> '' AND NOT regexp_matches(q, '\A(utm_[a-z]+|gclid|fbclid|ref|source)(=|\z)')), '') AS address
    FROM pages),
visits AS (SELECT 'urn:page:' || page_id || ':r' AS record_id, address, tag, seen + to_seconds(500000) AS seen FROM p
    UNION ALL SELECT 'urn:page:' || page_id || ':s', address, tag, seen - to_seconds(250000) FROM p),
based AS (SELECT v.*, 'urn:page:' || p.page_id || ':f' AS base_id, p.tag AS base_tag, p.html, row_number() OVER (
    PARTITION BY v.record_id ORDER BY p.seen DESC, 'urn:page:' || p.page_id || ':f' DESC) AS nth
    FROM visits v LEFT JOIN p ON p.address = v.address AND p.seen < v.seen),
judged AS (SELECT *, CASE WHEN base_tag IS NULL THEN 'no_base' WHEN base_tag = tag THEN 'resolved' ELSE 'changed' END
    AS outcome FROM based WHERE nth = 1)
SELECT record_id, outcome, CASE WHEN outcome = 'resolved' THEN base_id END AS base_id,
    CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || strftime(seen, '%Y-%m-%d %H:%M:%S') || ';etag=W/'
        || tag || ';server=first' END AS headers,
    CASE WHEN outcome = 'resolved' THEN md5(html) END AS digest,
    CASE WHEN outcome = 'resolved' THEN CAST(octet_length(encode(html)) AS BIGINT) END AS n_bytes FROM judged
"""
