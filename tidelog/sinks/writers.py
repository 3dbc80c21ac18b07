"""Writers of encoded rows.

They run per partition, in bounded requests, and retry only what may be retried.  What they are given names a
key once, so neither the order of tasks nor a second sending changes the outcome.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.apply import last_writes, split_key_changes
from ..operators.encode import bulk_item, bulk_lines, last_operations, load_label, load_outcome, retryable, split_bulk, write_statements


class DeliveryError(RuntimeError):
    """A sink refused rows for good, or attempts ran out."""


def write_lines(rows: DataFrame, path: str) -> None:
    """One line per row of ``value``, as text files."""
    rows.select("value").write.mode("append").text(path)


def print_lines(rows: DataFrame) -> int:
    """Lines on standard output, fetched a partition at a time; returns their number."""
    n = 0
    for row in rows.select("value").toLocalIterator(prefetchPartitions=False):
        print(row["value"])
        n += 1
    return n


def write_kafka(records: DataFrame, brokers: Iterable[str], client_id: str = "", batch_bytes: int = 10 << 20, flush_timeout: float = 30.0, format: str = "kafka", more: dict[str, str] | None = None) -> None:
    """``topic, key, value`` to Kafka, acknowledged by all replicas.  Needs the Kafka package.

    Records of a key meet in one task, in order of their sequence.
    """
    if "seq" in records.columns:
        records = records.repartition("topic", "key").sortWithinPartitions("seq")
    writer = records.select("topic", "key", "value").write.format(format).option("kafka.bootstrap.servers", ",".join(brokers))
    options = {"kafka.acks": "all", "kafka.max.request.size": batch_bytes, "kafka.delivery.timeout.ms": int(flush_timeout * 1000), "kafka.request.timeout.ms": int(flush_timeout * 500)}
    if client_id:
        options["kafka.client.id"] = client_id
    for k, v in (options | (more or {})).items():
        writer = writer.option(k, str(v))
    writer.mode("append").save()


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    batch: list = []
    for row in rows:
        batch.append(row)
        if len(batch) >= size:
            yield batch
            batch = []
    if batch:
        yield batch


def reduced(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``row, deleted``: the last write of each key of a batch; without keys every row, and a delete raises."""
    if keys:
        return last_writes(split_key_changes(log, keys), keys)
    bad = F.when(F.col("op") == "d", F.raise_error(F.lit("a table without keys has no key for delete")))
    return log.where(F.col("op").isin("r", "c", "u") | bad.isNotNull()).select(F.col("after").alias("row"), F.lit(False).alias("deleted"))


def write_log(log: DataFrame, connect: Callable[[], Any], dialect: str, database: str, table: str, keys: tuple[str, ...], batch_size: int = 1000, max_retries: int = 3, place: str = "?") -> None:
    """A batch's events over a DB-API connection: the last write of each key, a statement a key."""
    write_sql(write_statements(reduced(log, keys), dialect, database, table, keys), connect, dialect, batch_size, max_retries, place)


def placed(sql: str, place: str) -> str:
    """The statement with a driver's place holders (``?`` or ``%s``); names and texts keep what they hold."""
    out, mark, i = [], "", 0
    while i < len(sql):
        c = sql[i]
        if mark:
            mark = "" if c == mark else mark
        elif c in "\"'`":
            mark = c
        elif c == "?" or c == "$" and sql[i + 1 : i + 2].isdigit():
            out.append(place)
            i += 1
            while c == "$" and i < len(sql) and sql[i].isdigit():
                i += 1
            continue
        out.append("%%" if c == "%" and place == "%s" else c)
        i += 1
    return "".join(out)


def write_sql(statements: DataFrame, connect: Callable[[], Any], dialect: str, batch_size: int = 1000, max_retries: int = 3, place: str = "?") -> None:
    """``sql, args`` over a DB-API connection, a transaction per batch.  Statements of one key must not be two.

    ``connect`` makes a connection on the worker.  A batch whose COMMIT failed is never sent again.
    """

    def send(rows: Iterator) -> None:
        connection, known = None, {}
        try:
            for batch in chunks(rows, batch_size):
                for attempt in range(max_retries + 1):
                    committing = False
                    try:
                        connection = connection or connect()
                        cursor = connection.cursor()
                        for row in batch:
                            if row["sql"] not in known:
                                known[row["sql"]] = placed(row["sql"], place)
                            cursor.execute(known[row["sql"]], list(row["args"]))
                        committing = True
                        connection.commit()
                        break
                    except Exception as e:
                        state = str(getattr(e, "sqlstate", "") or getattr(e, "pgcode", "") or "")
                        if connection is not None:
                            try:
                                connection.rollback()
                            except Exception:  # the connection is gone, and a new one is made
                                connection = None
                        if attempt == max_retries or not retryable(dialect, state, committing):
                            raise DeliveryError(f"{dialect}: {e}") from e
                        time.sleep(min(2.0, 0.1 * (attempt + 1)))
        finally:
            if connection is not None:
                connection.close()

    statements.foreachPartition(send)


Post = Callable[[str, bytes, dict], tuple[int, dict]]


def http_post(url: str, body: bytes, headers: dict, method: str = "POST", timeout: float = 30.0) -> tuple[int, dict]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, json.loads(answer.read() or b"{}")
    except urllib.error.HTTPError as e:
        raw = e.read()
        try:
            return e.code, json.loads(raw or b"{}")
        except ValueError:
            return e.code, {"error": raw[:500].decode("utf-8", "replace")}


def write_bulk(operations: DataFrame, url: str, headers: dict, most_bytes: int = 5 << 20, max_retries: int = 3, post: Post = http_post, wait: float = 0.2) -> None:
    """Operations in bulk requests; only items that may succeed later go again.

    A document has its last operation only, so no request names one twice, and requests may go in any order.
    """

    def send(rows: Iterator) -> None:
        for batch in chunks((r["lines"] for r in rows), 5000):
            for body in split_bulk(batch, most_bytes):
                pending = body
                for attempt in range(max_retries + 1):
                    status, answer = post(f"{url}/_bulk", pending.encode(), {"Content-Type": "application/x-ndjson"} | headers)
                    pending = left_over(pending, status, answer)
                    if not pending:
                        break
                    if attempt == max_retries:
                        raise DeliveryError(f"bulk: gave up after {attempt + 1} attempts, status {status}")
                    time.sleep(wait * 2**attempt)

    bulk_lines(last_operations(operations)).select("lines").foreachPartition(send)


def bulk_items(body: str) -> list[tuple[str, str]]:
    """(action, lines) of a request body."""
    out, lines = [], iter(body.splitlines(keepends=True))
    for head in lines:
        action = next(iter(json.loads(head)))
        out.append((action, head if action == "delete" else head + next(lines)))
    return out


def left_over(body: str, status: int, answer: dict) -> str:
    """What of a request goes again; raises where an item is refused for good."""
    if status in (429, 500, 502, 503, 504):
        return body
    if not 200 <= status < 300:
        raise DeliveryError(f"bulk: status {status}: {answer}")
    again = []
    for (action, lines), item in zip(bulk_items(body), answer.get("items", []), strict=True):
        verdict = bulk_item(action, item[action]["status"])
        if verdict == "fail":
            raise DeliveryError(f"bulk: item refused: {item}")
        if verdict == "retry":
            again.append(lines)
    return "".join(again)


#: Rows and bytes of one load.
LOAD_ROWS, LOAD_BYTES = 100_000, 64 << 20


def loads(lines: Iterable[str], most_rows: int = LOAD_ROWS, most_bytes: int = LOAD_BYTES) -> Iterator[tuple[str, int]]:
    """(body, rows) of each load; a single longer line is a load of its own."""
    body, size = [], 0
    for line in lines:
        n = len(line.encode()) + 1
        if body and (len(body) >= most_rows or size + n > most_bytes):
            yield "\n".join(body), len(body)
            body, size = [], 0
        body.append(line)
        size += n
    if body:
        yield "\n".join(body), len(body)


def write_stream_load(rows: DataFrame, database: str, table: str, nonce: str, batch: int, put: Callable[[str, bytes], dict], max_retries: int = 3, state: Callable[[str], str] = lambda label: "UNAVAILABLE", wait: float = 0.1, most_rows: int = LOAD_ROWS, most_bytes: int = LOAD_BYTES, parts: int = 32) -> None:
    """JSON lines of ``value`` in bounded loads, under labels made of the batch and the load's content.

    Rows are dealt into ``parts`` by their content and ordered, so a replay makes the same loads under the same
    labels, however its input was partitioned.  A task holds one load at a time.  An unknown outcome is looked up by its label before anything is sent again.
    """

    def send(part: Iterator) -> None:
        for body, n in loads((r["value"] for r in part), most_rows, most_bytes):
            raw = body.encode()
            label = f"{load_label(f'{database}.{table}', nonce, batch)}_{hashlib.sha256(raw).hexdigest()[:16]}"
            for attempt in range(max_retries + 1):
                outcome = load_outcome(put(label, raw), label, n)
                if outcome in ("unknown", "label-exists"):
                    outcome = {"FINISHED": "success", "CANCELLED": "fatal"}.get(state(label), "retryable")
                if outcome == "success":
                    break
                if outcome == "fatal" or attempt == max_retries:
                    raise DeliveryError(f"load {label}: {outcome}")
                time.sleep(min(2.0, wait * (attempt + 1)))

    rows.select("value").repartition(parts, "value").sortWithinPartitions("value").foreachPartition(send)
