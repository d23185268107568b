"""Liquidity levels as a stream of bars: pivots, levels and what becomes of them, with nothing but live state kept.

State of a series: the bars that a pivot still needs, the leg, and a map of the
levels that are not resolved.  A micro-batch takes the levels out of the map by
price, so a bar touches only those that it sweeps and those that are already swept;
what changed goes back, and a resolved level leaves the state.  Any split of the bars
into micro-batches gives the same rows, and a restarted query goes on where it was.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LEVEL = "type string, created long, price double, swept long, outside int"
_COLUMNS = ["series_id", "level_id", "type", "created_idx", "price", "swept_idx", "resolved_idx", "class", "state", "told"]


class Levels(StatefulProcessor):
    """Rows (series_id, bar_idx, high, low, close) of a series to a row per change of a level: creation, sweep, resolution."""

    def __init__(self, size: int, run_bars: int):
        self.size, self.run_bars = size, max(run_bars, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shape = handle.getValueState("shape", "next long, leg int, made long, highs array<double>, lows array<double>")
        self.live = handle.getMapState("live", "level_id long", _LEVEL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = pd.concat(list(rows)).sort_values("bar_idx")
        told = self.shape.get() if self.shape.exists() else (0, 0, 0, [], [])
        upcoming, leg, made, highs, lows = told[0], told[1], told[2], list(told[3]), list(told[4])
        levels = {k[0]: list(v) for k, v in self.live.iterator()} if self.live.exists() else {}
        changed: set[int] = set()
        gone: set[int] = set()
        # What is not swept yet, by how soon a bar reaches it; what is swept and not resolved.
        waits: dict[str, list[tuple[float, int]]] = {"BSL": [], "SSL": []}
        swept: list[int] = []
        for n, (kind, _, price, at, _) in levels.items():
            if at is None:
                waits[kind].append((price if kind == "BSL" else -price, n))
            else:
                swept.append(n)
        for own in waits.values():
            own.sort()
        out: list[tuple] = []
        told_no = 0

        def tell(n: int, resolved: int | None, name: str, state: str) -> None:
            nonlocal told_no
            kind, created, price, at, _ = levels[n]
            out.append((key[0], n, kind, created, price, at, resolved, name, state, told_no))
            told_no += 1

        for i, high, low, close in zip(bars["bar_idx"].tolist(), bars["high"].tolist(), bars["low"].tolist(), bars["close"].tolist(), strict=True):
            if i < upcoming:
                continue  # seen before
            for kind, reach in (("BSL", high), ("SSL", -low)):
                own = waits[kind]
                cut = 0
                while cut < len(own) and own[cut][0] < reach:
                    n = own[cut][1]
                    levels[n][3], levels[n][4] = i, 0
                    swept.append(n)
                    changed.add(n)
                    tell(n, None, "NONE", "Swept")
                    cut += 1
                del own[:cut]
            still = []
            for n in sorted(swept):
                kind, _, price, at, outside = levels[n]
                way = 1 if kind == "BSL" else -1
                if way * close < way * price:
                    tell(n, i, "SWEEP" if at == i else "GRAB", "Resolved")
                else:
                    outside = outside + 1 if way * close > way * price else 0
                    levels[n][4] = outside
                    changed.add(n)
                    if outside < self.run_bars:
                        still.append(n)
                        continue
                    tell(n, i, "RUN", "Resolved")
                gone.add(n)
            swept = still
            highs, lows = [*highs, high][-self.size - 1 :], [*lows, low][-self.size - 1 :]
            if len(highs) == self.size + 1:
                turn = 0 if highs[0] > max(highs[1:]) else 1 if lows[0] < min(lows[1:]) else leg
                if turn != leg:
                    leg, made = turn, made + 1
                    kind, price = ("SSL", lows[0]) if leg else ("BSL", highs[0])
                    levels[made] = [kind, i, price, None, 0]
                    insort(waits[kind], (price if kind == "BSL" else -price, made))
                    changed.add(made)
                    tell(made, None, "NONE", "Detected")
            upcoming = i + 1
        for n in gone:
            if self.live.containsKey((n,)):
                self.live.removeKey((n,))
        for n in changed - gone:
            self.live.updateValue((n,), tuple(levels[n]))
        self.shape.update((upcoming, leg, made, highs, lows))
        if out:
            frame = pd.DataFrame(out, columns=_COLUMNS)
            yield frame.astype({"swept_idx": "Int64", "resolved_idx": "Int64"})

    def close(self) -> None:
        pass


def liquidity_changes(bars: DataFrame, *, size: int = 5, run_bars: int = 3) -> DataFrame:
    """Changes of the levels at the leg pivots of a stream of bars; the last one of a level (by bar, then `told`) is what structure.liquidity() gives.

    Bars of a series must arrive in order of bar_idx; within a micro-batch they are
    sorted, and bars that were there before are left out.  Needs the RocksDB state store.
    """
    kind = "series_id string, level_id long, type string, created_idx long, price double, swept_idx long, resolved_idx long, class string, state string, told long"
    rows = bars.select("series_id", "bar_idx", "high", "low", "close").where("bar_idx is not null and high is not null and low is not null and close is not null")
    return rows.groupBy("series_id").transformWithStateInPandas(Levels(size, run_bars), kind, "append", "None")


def last_change(changes: DataFrame) -> DataFrame:
    """The rows of structure.liquidity() from written changes with their batch."""
    row = F.struct("type", "created_idx", "price", "swept_idx", "class", "resolved_idx", "state")
    return changes.groupBy("series_id", "level_id").agg(F.max_by(row, F.struct("batch", "told")).alias("row")).select("series_id", "level_id", "row.*")
