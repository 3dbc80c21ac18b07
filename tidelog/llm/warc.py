"""Resolution of not-modified revisits in web archives.

A revisit (HTTP 304) stands for the latest earlier full response of the same canonical
URL.  The as-of join runs in two steps, so that a URL that holds a third of all captures is spread
over many tasks: the latest response within a slice of time, and the latest of the slices before.
Its validators are checked, and the headers that a 304 may update are merged into the response's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response updates; all others keep the stored value.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Time units of a slice.
SLICE = 4096


def canonical_url(url: F.Column) -> F.Column:
    """Lower-case scheme and host, no default port, fragment, trailing slash or ``utm_`` parameter,
    other parameters in order.  Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([^/?]*(?://[^/?]*)?)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    rest = F.regexp_extract(bare, r"^[^/?]*(?://[^/?]*)?([^?]*)", 1)
    path = F.regexp_replace(rest, "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(head, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _strong(etag: F.Column) -> F.Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, width: int = SLICE) -> DataFrame:
    """One row for each record of kind ``revisit``.

    ``records``: ``record_id long, url string, ts long, kind string`` (``response`` or
    ``revisit``; others are passed over), ``etag, last_modified string, headers
    map<string,string>`` (names in lower case); further columns are not read.  Returns ``record_id,
    canonical_url, ts, resolved_id, resolved_ts, status, headers_json``.  ``status``:

    * ``no_earlier_response``: none of that URL is strictly earlier; also for null URL or time;
    * ``validator_mismatch``: entity tags (weak comparison) differ, or dates where a side has no tag;
    * ``unvalidated``: no validator in common; ``resolved``: validators agree.

    ``headers_json`` (merged headers by name, without null ones) is null unless resolved or unvalidated.  Of
    responses at one time the greatest record_id counts; repeated records give repeated rows.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "headers")
    lost = r.where("kind = 'revisit' and (canonical_url is null or ts is null)")
    r = r.where("kind in ('response', 'revisit') and canonical_url is not null and ts is not null").withColumn("slice", F.floor(F.col("ts") / width))
    # Maps can't be compared; the headers go along as sorted entries.
    said = F.map_filter(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, v: v.isNotNull())
    entries = F.array_sort(F.map_entries(said))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", entries.alias("entries")))
    r = r.withColumn("full", full)
    within = Window.partitionBy("canonical_url", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    local = r.withColumn("near", F.max("full").over(within)).where("kind = 'revisit'")
    slices = r.groupBy("canonical_url", "slice").agg(F.max("full").alias("last"))
    before = slices.withColumn("far", F.max("last").over(Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "slice", "far")
    joined = local.join(before, ["canonical_url", "slice"]).withColumn("base", F.coalesce("near", "far"))
    tags = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    status = (
        F.when(F.col("base").isNull(), "no_earlier_response")
        .when(tags, F.when(_strong(F.col("etag")) == _strong(F.col("base.etag")), "resolved").otherwise("validator_mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("base.last_modified"), "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    new = F.map_filter(said, lambda name, _: name.isin(*PERMITTED))
    old = F.map_from_entries(F.col("base.entries"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    merged_json = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))
    out = joined.withColumn("status", status)
    done = out.select(
        "record_id", "canonical_url", "ts", F.col("base.record_id").alias("resolved_id"), F.col("base.ts").alias("resolved_ts"), "status",
        F.when(F.col("status").isin("resolved", "unvalidated"), merged_json).alias("headers_json"),
    )
    none = lost.select("record_id", "canonical_url", "ts", F.lit(None).cast("long").alias("resolved_id"), F.lit(None).cast("long").alias("resolved_ts"), F.lit("no_earlier_response").alias("status"), F.lit(None).cast("string").alias("headers_json"))
    return done.union(none)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Four captures of each page, as the table has none of its own; k is page_id, record_id 4k + the row's number.

    ==  ======  ======================================================================================
    0   8k      the page in full; entity tag if k % 4 is 0 or 1, date of change if it is 0 or 2
    1   8k - 1  revisit with the validators of 0: it can only resolve to an earlier page of its URL
    2   8k + 2  revisit with a weak tag (none if k % 7 is 0) and a date; both changed if k % 5 is 0
    3   8k + 4  ``/style.css`` of the page's host, which changes every 256 pages: in full if k div 7 is
                a multiple of 3, else a revisit with a date and, if k is even, a tag; pages of a host share it
    ==  ======  ======================================================================================

    A null page_id or url stays null in its captures; a null html counts as empty.
    """
    k, html, none = F.col("page_id"), F.coalesce(F.col("html"), F.lit("")), F.lit(None).cast("string")
    tag, day = F.md5(html.cast("binary")), F.concat(F.lit("day "), k.cast("string"))
    version, fetched = F.floor(k / 256).cast("string"), F.floor(k / 7) % 3 == 0
    changed = lambda value: F.when(k % 5 == 0, F.concat(value, F.lit("x"))).otherwise(value)
    sheet = F.concat(F.regexp_extract(F.trim(F.col("url")), "^([^/?#]*(?://[^/?#]*)?)", 1), F.lit("/style.css"))

    def capture(i: int, url: F.Column, after: int, full: F.Column, etag: F.Column, date: F.Column, kind: str, size: F.Column) -> F.Column:
        at = k * 8 + after
        fields = {"content-type": F.when(full, F.lit(kind)), "content-length": F.when(full, size.cast("string")).otherwise("0"), "etag": etag, "last-modified": date, "date": at.cast("string"), "x-served-by": F.when(~full, "edge")}
        headers = F.map_filter(F.create_map(*(x for name, value in fields.items() for x in (F.lit(name), value))), lambda _, v: v.isNotNull())
        return F.struct((k * 4 + i).alias("record_id"), url.alias("url"), at.alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"), etag.alias("etag"), date.alias("last_modified"), headers.alias("headers"))

    yes, no, size = F.lit(True), F.lit(False), F.octet_length(html)
    own = (F.when(k % 4 < 2, tag), F.when(k % 2 == 0, day))
    weak = F.when(k % 7 != 0, F.concat(F.lit("W/"), changed(tag)))
    four = F.array(
        capture(0, F.col("url"), 0, yes, *own, "text/html", size),
        capture(1, F.col("url"), -1, no, *own, "text/html", size),
        capture(2, F.col("url"), 2, no, weak, changed(day), "text/html", size),
        capture(3, sheet, 4, fetched, F.when((k % 2 == 0) | fetched, F.concat(F.lit("v"), version)).otherwise(none), version, "text/css", F.lit(100)),
    )
    return pages.select(F.explode(four).alias("c")).select("c.*")
