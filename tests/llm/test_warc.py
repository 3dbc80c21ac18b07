import json
import random

from tidelog.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, status string, full string, slice int"


def resolve(spark, rows, **options):
    return {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA), **options).collect()}


def test_validators_and_headers(spark):
    out = resolve(
        spark,
        [
            (1, "HTTP://Ex.org:80/a/?b=2&a=1&utm_x=3#f", 10, "response", '"v1"', None, {"etag": '"v1"', "date": "d1", "content-type": "t"}),
            (2, "http://ex.org/a?a=1&b=2", 20, "revisit", 'W/"v1"', None, {"date": "d2", "content-length": "0", "expires": None}),
            (3, "http://ex.org/a?a=1&b=2", 30, "revisit", '"v2"', None, None),
            (4, "http://ex.org/a?a=1&b=2", 10, "revisit", '"v1"', None, {}),
            (5, "http://ex.org/b", 5, "response", None, "monday", None),
            (6, "http://ex.org/b/", 6, "revisit", None, "monday", {"server": "s"}),
            (7, "http://ex.org/b", 7, "revisit", None, None, {}),
            (8, None, 7, "revisit", None, None, {}),
            (9, "http://ex.org/b", None, "revisit", None, None, {}),
            (10, "http://ex.org/c", 7, "metadata", None, None, {}),
            (11, "http://ex.org/b", 5, "response", None, "tuesday", {}),
        ],
    )
    assert set(out) == {2, 3, 4, 6, 7, 8, 9}
    assert out[2]["status"] == "resolved" and json.loads(out[2]["headers_json"]) == {"content-type": "t", "date": "d2", "etag": '"v1"'}
    assert out[3]["status"] == "validator_mismatch" and out[3]["headers_json"] is None and out[3]["resolved_id"] == 1
    assert out[4]["status"] == "no_earlier_response"  # the same time is not earlier
    assert out[6]["status"] == "validator_mismatch" and out[6]["resolved_id"] == 11  # of two at a time the greater id
    assert out[7]["status"] == "unvalidated" and out[7]["headers_json"] == "{}"
    assert out[8]["status"] == out[9]["status"] == "no_earlier_response"
    assert resolve(spark, []) == {}


def test_as_of_across_slices(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{rng.choice('aab')}", rng.randrange(5000), rng.choice(["response", "revisit", "revisit"]), "e", None, {}) for i in range(600)]
    out = resolve(spark, rows, width=64)
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, u, t, k, *_ in rows if k == "response" and u == url and t < ts]
            assert out[i]["resolved_id"] == (max(earlier)[1] if earlier else None)


def test_repeated_records_give_repeated_rows(spark):
    page, again = (1, "http://h/a", 1, "response", "e", None, {"etag": "e", "age": None}), (2, "http://h/a", 9, "revisit", "e", None, None)
    records = spark.createDataFrame([(*r, "x", "y", 1) for r in (page, page, again, again, again)], SCHEMA)
    got = [(r["record_id"], r["resolved_id"], r["headers_json"]) for r in warc.resolve_revisits(records).collect()]
    assert got == [(2, 1, '{"etag":"e"}')] * 3


def test_captures_of_pages(spark):
    """The derived captures against a plain scan: every status comes up, and pages of a host meet."""
    rng = random.Random(2)
    pages = [(i, f"https://{rng.choice('abc')}.org/{i % 40}", rng.choice(["", "x", None])) for i in range(400)]
    records = warc.records_of_pages(spark.createDataFrame([*pages, (None, "http://n/1", "x"), (900, None, "x")], "page_id long, url string, html string"))
    rows = records.withColumn("name", warc.canonical_url(records["url"])).collect()
    out = {r["record_id"]: r for r in warc.resolve_revisits(records).collect()}
    weak = lambda tag: tag.removeprefix("W/")
    seen, strangers = set(), 0
    for r in (x for x in rows if x["kind"] == "revisit" and x["ts"] is not None and x["name"] is not None):
        earlier = [x for x in rows if x["kind"] == "response" and x["name"] == r["name"] and x["ts"] is not None and x["ts"] < r["ts"]]
        base, got = max(earlier, key=lambda x: (x["ts"], x["record_id"]), default=None), out[r["record_id"]]
        if base is None:
            status = "no_earlier_response"
        elif r["etag"] is not None and base["etag"] is not None:
            status = "resolved" if weak(r["etag"]) == weak(base["etag"]) else "validator_mismatch"
        elif r["last_modified"] is not None and base["last_modified"] is not None:
            status = "resolved" if r["last_modified"] == base["last_modified"] else "validator_mismatch"
        else:
            status = "unvalidated"
        headers = {**base["headers"], **{k: v for k, v in r["headers"].items() if k in warc.PERMITTED}} if status in ("resolved", "unvalidated") else None
        assert (got["status"], got["resolved_id"]) == (status, base and base["record_id"])
        assert (json.loads(got["headers_json"]) if got["headers_json"] else None) == headers
        seen.add((status, r["record_id"] % 4))
        strangers += status == "resolved" and base["record_id"] // 4 != r["record_id"] // 4
    assert {s for s, _ in seen} == {"resolved", "unvalidated", "validator_mismatch", "no_earlier_response"} and strangers > 100
