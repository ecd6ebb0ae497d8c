"""Keyed state that depends on event order: ledgers, leases, audit chains, job states.

Per key only a few scalars are kept between batches. Rows of one key inside one micro-batch
are ordered before they are applied, so the trigger size bounds the memory of a task.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.operators.audit_chain import GENESIS


def deduplicate(events: DataFrame, keys: list[str], event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """First event per key. With a horizon the state is dropped once the watermark passes it;
    without one the keys are remembered forever."""
    if event_time and horizon:
        return events.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def _ordered(frames: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def leases(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Decide lease requests per issue: granted when no unexpired lease is held.

    ``requests`` has ``issue, owner, at`` (seconds) and ``seq``.
    """
    output = "issue string, owner string, at double, granted boolean, expires double"

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expires = state.get[0] if state.exists else float("-inf")
        rows = []
        for row in _ordered(frames, ["at", "seq"]).itertuples():
            granted = row.at >= expires
            expires = row.at + ttl_seconds if granted else expires
            rows.append((key[0], row.owner, row.at, granted, expires))
        state.update((expires,))
        yield pd.DataFrame(rows, columns=["issue", "owner", "at", "granted", "expires"])

    return requests.groupBy("issue").applyInPandasWithState(decide, output, "expires double", "append", GroupStateTimeout.NoTimeout)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def audit_chain(records: DataFrame) -> DataFrame:
    """Append records to their chain; each carries the digest of its predecessor.

    ``records`` has ``chain, seq, action, correlation_id, fields`` (canonical JSON text).
    """
    output = "chain string, seq long, action string, correlation_id string, fields string, previous_hash string, record_hash string"

    def link(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else GENESIS
        rows = []
        for row in _ordered(frames, ["seq"]).itertuples():
            body = {"action": row.action, "correlation_id": row.correlation_id, "fields": json.loads(row.fields), "previous_hash": previous}
            digest = hashlib.sha256(canonical(body).encode()).hexdigest()
            rows.append((key[0], row.seq, row.action, row.correlation_id, row.fields, previous, digest))
            previous = digest
        state.update((previous,))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in output.split(", ")])

    return records.groupBy("chain").applyInPandasWithState(link, output, "previous string", "append", GroupStateTimeout.NoTimeout)


def retries(failures: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Number failed attempts per job and decide between retry and quarantine.

    ``failures`` has ``job_id, seq, retryable``.
    """
    output = "job_id string, seq long, attempt long, outcome string"

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        rows = _ordered(frames, ["seq"])
        attempt = range(done + 1, done + 1 + len(rows))
        outcome = ["retry" if again and n < max_attempts else "quarantined" for again, n in zip(rows["retryable"], attempt)]
        state.update((done + len(rows),))
        yield pd.DataFrame({"job_id": key[0], "seq": rows["seq"].to_numpy(), "attempt": list(attempt), "outcome": outcome})

    return failures.groupBy("job_id").applyInPandasWithState(decide, output, "attempts long", "append", GroupStateTimeout.NoTimeout)


def with_backoff(action: Callable[[], object], attempts: int = 3, initial: float = 0.25, ceiling: float = 2.0, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)):
    """Run an action, waiting twice as long after each transient failure."""
    for attempt in range(attempts):
        try:
            return action()
        except transient:
            if attempt + 1 == attempts:
                raise
            time.sleep(min(ceiling, initial * 2**attempt))


def paged_source(name: str, schema: str, fetch_page: Callable[[str | None, int], tuple[list[tuple], str | None]], limit: int = 50) -> type[DataSource]:
    """A streaming source over a cursor-paged pull interface.

    One page is read per micro-batch; the cursor is the offset, so a restart continues after
    the last committed page. Register the returned class with ``spark.dataSource.register``.
    """

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": None, "rows": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            if start.get("done"):
                return iter([]), start
            rows, cursor = with_backoff(lambda: fetch_page(start["cursor"], limit))
            last = not rows or (cursor is None and len(rows) < limit)
            return iter(rows), {"cursor": cursor or start["cursor"], "rows": start["rows"] + len(rows), **({"done": True} if last else {})}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            if start == end:
                return iter([])
            return iter(with_backoff(lambda: fetch_page(start["cursor"], limit))[0])

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema: object) -> Reader:
            return Reader()

    return PagedSource
