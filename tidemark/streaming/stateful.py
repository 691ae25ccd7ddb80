"""Streams with state of their own, and the same steps over tables.

Each operator is a step function over the rows of one key in order. The stream keeps the step's state by
key between batches; the table form groups by key and starts from none. Rows of a key are taken in the
order of arrival, and within a batch in the order of their times: a late fact is applied when it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.vector_index import matrix

Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def over_stream(rows: DataFrame, keys: list[str], step: Step, schema: str, state: str) -> DataFrame:
    """What step gives out for each batch of a stream, with its state kept by key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        before = kept.get if kept.exists else None
        after, out = step(before, pd.concat(list(batches)))
        kept.update(after)
        yield out

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def over_table(rows: DataFrame, keys: list[str], step: Step, schema: str) -> DataFrame:
    """The same over a whole table."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: step(None, pdf)[1], schema)


BREAKER = "webhook_id long, delivery_id long, decision string, state string"
BREAKER_STATE = "failures int, state string, opened_micros long"


def breaker_step(threshold: int, cooldown_s: float) -> Step:
    """Deliveries of one webhook: sent or rejected, and the breaker's state after each.

    threshold failures in a row open it; while it is open all is rejected; after the cooldown one trial goes out, which closes it or opens
    it anew.
    """

    def step(before: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        failures, state, opened = before or (0, "closed", 0)
        out = []
        for r in rows.sort_values(["created_at", "delivery_id"]).itertuples(index=False):
            now = int(r.created_at.value // 1000)
            if state == "open" and now < opened + cooldown_s * 1e6:
                out.append((r.webhook_id, r.delivery_id, "rejected", state))
                continue
            failures = 0 if r.delivered else failures + 1
            if r.delivered:
                state = "closed"
            elif state == "open" or failures >= threshold:
                state, opened = "open", now
            out.append((r.webhook_id, r.delivery_id, "sent", state))
        return (failures, state, opened), pd.DataFrame(out, columns=["webhook_id", "delivery_id", "decision", "state"])

    return step


def circuit_breaker(deliveries: DataFrame, threshold: int = 5, cooldown_s: float = 60) -> DataFrame:
    """A stream or a table of deliveries (webhook_id, delivery_id, delivered, created_at) through a breaker for each webhook."""
    step = breaker_step(threshold, cooldown_s)
    return over_stream(deliveries, ["webhook_id"], step, BREAKER, BREAKER_STATE) if deliveries.isStreaming else over_table(deliveries, ["webhook_id"], step, BREAKER)


ADAPTERS = "user_id long, agent string, updates long, norm double, a array<double>, b array<double>"
RANK, LIMIT, STEP = 8, 10.0, 0.005
#: A stream's batch brings Python the rows of so many buckets of keys at most, not of each key, since a call costs more than its rows.
BUCKETS = 1024
#: Of a key (user, agent): its updates, dimensions, and B, or None while it is zero. A is drawn from the key anew.
Adapters = dict[tuple[int, str], tuple[int, int, np.ndarray | None]]


def _drawn(key: tuple[int, str], dims: int) -> np.ndarray:
    """A of a key: user and agent set the seed."""
    return np.random.default_rng([int(key[0]), *str(key[1]).encode()]).standard_normal((RANK, dims)) / np.sqrt(dims)


def _fold(a: np.ndarray, b: np.ndarray, key: np.ndarray, query: np.ndarray, item: np.ndarray, rating: np.ndarray) -> np.ndarray:
    """B of each key after its rows (key: number of a row's key, ascending), in their order: first all keys take their first row at once, then their second."""
    count = np.bincount(key, minlength=len(b))
    start, order = np.cumsum(count) - count, np.argsort(-count, kind="stable")
    a, b, start, count = a[order], b[order], start[order], count[order]
    for number in range(count[0] if len(count) else 0):
        n = int(np.searchsorted(-count, -number))  # keys that have so many rows come first
        row = start[:n] + number
        low = (a[:n] @ item[row, :, None])[:, :, 0]
        gap = np.sign(rating[row])[:, None] * (query[row] - (item[row] + (b[:n] @ low[:, :, None])[:, :, 0] / RANK))
        b[:n] += (np.abs(rating[row]) * STEP)[:, None, None] * gap[:, :, None] * low[:, None, :]
        norm = np.sqrt(np.einsum("kdr,kdr->k", b[:n], b[:n]))
        far = np.flatnonzero(norm > LIMIT)
        b[far] *= (LIMIT / norm[far])[:, None, None]
    out = np.empty_like(b)
    out[order] = b
    return out


def adapters_after(known: Adapters, rows: pa.Table) -> Adapters:
    """Adapters of the keys of rows (user_id, agent, query, item, rating; of each key together and in order) after them."""
    names = list(zip(rows.column("user_id").to_pylist(), rows.column("agent").to_pylist(), strict=True))
    first = np.array([i == 0 or names[i] != names[i - 1] for i in range(len(names))], dtype=bool)
    number, keys = np.cumsum(first) - 1, [names[i] for i in np.flatnonzero(first)]
    dims = pc.list_value_length(rows.column("query")).take(pa.array(np.flatnonzero(first))).to_numpy()
    rating = rows.column("rating").to_numpy()
    after = {k: known.get(k, (0, int(d), None)) for k, d in zip(keys, dims, strict=True)}
    for size in np.unique(dims):
        at = np.flatnonzero((dims[number] == size) & (rating != 0))
        moved, key = np.unique(number[at], return_inverse=True)
        if not len(moved):
            continue
        whose, some = [keys[i] for i in moved], rows.take(pa.array(at))
        a, none = np.stack([_drawn(k, size) for k in whose]), np.zeros((size, RANK))
        b = np.stack([none if (held := after[k][2]) is None else held for k in whose])
        b = _fold(a, b, key, matrix(some.column("query")), matrix(some.column("item")), rating[at])
        after |= {k: (after[k][0] + int(n), int(size), one) for k, n, one in zip(whose, np.bincount(key), b, strict=True)}
    return after


def _listed(adapters: Adapters, matrices: bool) -> pa.Table:
    norm = [0.0 if b is None else round(float(np.linalg.norm(b)), 6) for _, _, b in adapters.values()]
    out = {"user_id": pa.array([k[0] for k in adapters], pa.int64()), "agent": pa.array([k[1] for k in adapters], pa.string()), "updates": pa.array([n for n, _, _ in adapters.values()], pa.int64()), "norm": pa.array(norm, pa.float64())}
    if matrices:
        out["a"] = pa.array([_drawn(k, dims).ravel() for k, (_, dims, _) in adapters.items()], pa.list_(pa.float64()))
        out["b"] = pa.array([np.zeros(dims * RANK) if b is None else b.ravel() for _, dims, b in adapters.values()], pa.list_(pa.float64()))
    return pa.table(out)


def _stored(adapters: Adapters) -> bytes:
    """Adapters as Arrow's bytes; a B of zeros takes no room."""
    columns = [[k[0] for k in adapters], [k[1] for k in adapters], *zip(*((n, dims, b"" if b is None else b.tobytes()) for n, dims, b in adapters.values()), strict=True)]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    table = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["user_id", "agent", "updates", "dims", "b"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _restored(stored: bytes) -> Adapters:
    columns = pa.ipc.open_stream(stored).read_all().to_pydict()
    return {(u, g): (n, dims, np.frombuffer(b).reshape(dims, RANK) if b else None) for u, g, n, dims, b in zip(*columns.values(), strict=True)}


def adapter_step(before: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Low-rank adapters of one (user, agent) after each row's feedback, in order: B += |r| * STEP * outer(sign(r) * (q - adapted item), A item).

    A is drawn from a seed that user and agent set, B starts at zero; B's Frobenius norm stays under LIMIT; a rating of 0 changes nothing.
    """
    rows = rows.sort_values(["at", "event_id"])
    key, dims = (int(rows["user_id"].iloc[0]), str(rows["agent"].iloc[0])), len(rows["query"].iloc[0])
    known = {} if before is None else {key: (before[0], dims, np.array(before[2]).reshape(dims, RANK))}
    out = _listed(adapters_after(known, pa.Table.from_pandas(rows[_TAKEN], preserve_index=False)), True).to_pandas()
    return (int(out["updates"][0]), out["a"][0].tolist(), out["b"][0].tolist()), out


_TAKEN = ["user_id", "agent", "query", "item", "rating"]
_ORDER = ["user_id", "agent", "at", "event_id"]


def _of_sorted(matrices: bool):
    """Adapters of a partition whose rows are in _ORDER; the last key of a batch may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Adapters = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            known, after = last, adapters_after(last, pa.Table.from_batches([batch]))
            name = list(after)[-1]
            last = {name: after.pop(name)}
            yield from _listed({k: v for k, v in known.items() if k not in after and k not in last} | after, matrices).to_batches()
        yield from _listed(last, matrices).to_batches()

    return run


def _of_bucket(matrices: bool):
    """Adapters of a bucket's keys that a stream's batch has, with those of all its keys as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        known = _restored(kept.get[0]) if kept.exists else {}
        rows = pd.concat(list(batches), ignore_index=True).sort_values(_ORDER)
        after = adapters_after(known, pa.Table.from_pandas(rows[_TAKEN], preserve_index=False))
        kept.update((_stored(known | after),))
        yield _listed(after, matrices).to_pandas()

    return run


def train_adapters(feedback: DataFrame, matrices: bool = True) -> DataFrame:
    """Adapters (see adapter_step) from feedback (user_id, agent, event_id, at, query, item, rating): of a table once, of a stream after each batch.

    matrices: with A and B as columns a and b. Many keys' rows are folded at once.
    """
    schema = ADAPTERS if matrices else ADAPTERS.split(", a ")[0]
    if feedback.isStreaming:
        rows = feedback.withColumn("bucket", F.pmod(F.xxhash64("user_id", "agent"), F.lit(BUCKETS)))
        return rows.groupBy("bucket").applyInPandasWithState(_of_bucket(matrices), schema, "rows binary", "append", GroupStateTimeout.NoTimeout)
    return feedback.repartition("user_id", "agent").sortWithinPartitions(*_ORDER).select(*_TAKEN).mapInArrow(_of_sorted(matrices), schema)
