"""Online state of a training run, by key: running mean with the time that is left, and a pool of pairs in the order of events.

Both give the same whether the rows come in one batch or in many. The mean's state is sums, which don't depend on order. The pool waits with each row
until the watermark has passed its time, then takes rows by (time, key): a row that is later than the watermark allows is dropped by Spark,
and rows behind the last watermark stay in the state for the next run. State lies in RocksDB on the executors, with its log in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds whose waiting rows are taken together, most rows of a block of state, and rows of a key that are sorted at once.
SPAN, BLOCK, AT_ONCE = 3_600_000_000, 20_000, 500_000


def use_state(rows: DataFrame) -> None:
    """Typed state needs this provider; a session that has one of its own choice keeps it."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Mean(StatefulProcessor):
    def __init__(self, total: int):
        self.total = total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, total double, first double, last double, best double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, first, last, best = self.sums.get() if self.sums.exists() else (0, 0.0, float("inf"), float("-inf"), float("-inf"))
        for batch in rows:
            n += len(batch)
            total += float(batch["value"].sum())
            first, last = min(first, float(batch["at"].min())), max(last, float(batch["at"].max()))
            best = max(best, float(batch["value"].max()))
        self.sums.update((n, total, first, last, best))
        left = (last - first) / n * max(self.total - n, 0)
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [total / n], "best": [best], "eta": [left]})

    def close(self) -> None:
        pass


def running_means(events: DataFrame, key: str, value: str, at: str, total: int) -> DataFrame:
    """key, n, mean, best, eta after each batch that has rows of the key: eta is the mean time a row times the rows that are left of `total`,
    in seconds. Rows without a value or a time are left out. The row with the largest n is the latest."""
    use_state(events)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))
    rows = rows.where("value is not null and at is not null and key is not null")
    return rows.groupBy("key").transformWithStateInPandas(_Mean(total), "key string, n long, mean double, best double, eta double", "Update", "None")


class _Pool(StatefulProcessor):
    """Waiting rows lie in state as sorted blocks of arrays, one or more an hour of their time, so state is read and written by block, not by row,
    and an hour's rows are what a task holds at once."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "span long, block long", "at array<long>, item array<long>")
        self.held = handle.getMapState("held", "slot int", "item long")
        self.seen = handle.getValueState("seen", "n long, upto long, blocks long")

    def _progress(self) -> tuple[int, int, int]:
        return self.seen.get() if self.seen.exists() else (0, -1, 0)

    def _put(self, at: np.ndarray, item: np.ndarray, block: int) -> int:
        """Store rows by span, BLOCK at most in a block; the next block's number."""
        order = np.lexsort((item, at))
        at, item = at[order], item[order]
        ends = np.flatnonzero(np.diff(at // SPAN)) + 1
        for a, b in zip([0, *ends], [*ends, len(at)], strict=True):
            for k in range(a, b, BLOCK):
                part = slice(k, min(k + BLOCK, b))
                self.blocks.updateValue((int(at[k]) // SPAN, block), (at[part].tolist(), item[part].tolist()))
                block += 1
        # fires once the watermark is past the first row's time
        self.handle.registerTimer(int(at[0]) // 1000)
        return block

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, upto, block = self._progress()
        some, count = [], 0
        for batch in rows:
            some.append((batch["us"].to_numpy(np.int64), batch["item"].to_numpy(np.int64)))
            count += len(batch)
            if count >= AT_ONCE:
                block, some, count = self._put(*map(np.concatenate, zip(*some, strict=True)), block), [], 0
        if count:
            block = self._put(*map(np.concatenate, zip(*some, strict=True)), block)
        self.seen.update((n, upto, block))
        yield pd.DataFrame({"shard": [], "item": [], "after": []})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, upto, block = self._progress()
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        if limit == upto:  # the first timer of a batch takes all rows that are due
            return
        held = np.full(self.size, -1, np.int64)
        for (slot,), (item,) in self.held.iterator():
            held[slot] = item
        waiting: dict[int, list[int]] = {}
        for span, number in self.blocks.keys():
            waiting.setdefault(span, []).append(number)
        left = None
        for span in sorted(waiting):
            if span * SPAN >= limit:
                left = span
                break
            parts = [self.blocks.getValue((span, number)) for number in waiting[span]]
            at, item = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in (0, 1))
            for number in waiting[span]:
                self.blocks.removeKey((span, number))
            order = np.lexsort((item, at))
            at, item = at[order], item[order]
            new = np.append(True, (np.diff(at) != 0) | (np.diff(item) != 0))  # a row that repeats counts once
            at, item = at[new], item[new]
            due = int(np.searchsorted(at, limit))
            if due < len(at):
                block = self._put(at[due:], item[due:], block)
            yield self._taken(key[0], item[:due], held, seen)
            seen += due
        if left is not None:
            self.handle.registerTimer(min(min(self.blocks.getValue((left, number))[0]) for number in waiting[left]) // 1000)
        for slot in range(min(seen, self.size)):
            self.held.updateValue((slot,), (int(held[slot]),))
        self.seen.update((seen, limit, block))

    def _taken(self, shard: int, item: np.ndarray, held: np.ndarray, seen: int) -> pd.DataFrame:
        """What leaves as items come in turn; held is brought up to date. Who leaves a place is who came to it last."""
        import xxhash

        n = np.arange(seen, seen + len(item))
        slot = np.array([k if k < self.size else xxhash.xxh64_intdigest(f"{x}:{self.seed}") % self.size for k, x in zip(n.tolist(), item.tolist(), strict=True)], np.int64)
        order = np.argsort(slot, kind="stable")
        by_slot, came = slot[order], item[order]
        first = np.append(True, np.diff(by_slot) != 0)[: len(by_slot)]
        gone = np.empty_like(item)
        gone[order] = np.where(first, held[by_slot], np.roll(came, 1))
        last = np.roll(first, -1)
        held[by_slot[last]] = came[last]
        full = n >= self.size
        return pd.DataFrame({"shard": shard, "item": gone[full], "after": n[full] + 1})

    def close(self) -> None:
        pass


def ordered_pool(events: DataFrame, item: str, at: str, late: str, shards: int, size: int, seed: int) -> DataFrame:
    """shard, item, after: each shard fills a pool of `size` items; from then on every further one, by (time, item), takes a place that a hash
    picks, and the item that was there leaves after as many were seen. Repeated rows of the same time count once. `shards` grows with
    the rate of rows: a shard's pool is one key of state."""
    use_state(events)
    # times are whole milliseconds for timers, microseconds for order
    stamp = F.col(at).cast("timestamp")
    rows = events.where(stamp.isNotNull() & F.col(item).isNotNull()).select(stamp.alias("__ts"), F.unix_micros(stamp).alias("us"), F.col(item).cast("long").alias("item"), F.pmod(F.xxhash64(F.col(item).cast("long"), F.lit(seed)), F.lit(shards)).alias("shard"))
    timed = rows.withWatermark("__ts", late).groupBy("shard")
    return timed.transformWithStateInPandas(_Pool(size, seed), "shard long, item long, after long", "Append", "EventTime")
