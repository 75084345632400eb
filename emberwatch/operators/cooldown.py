"""Alert cooldown: a row is kept only when ``seconds`` have passed since the last kept
row of its key.

Whether a row is kept depends on every earlier row of the key, yet one key may hold a
large share of all rows.  So the time axis of each key is cut into chunks:

1. rows with equal key and time collapse to one slot (only one of them can be kept);
2. a chunk whose first slot lies a full cooldown after the slot before it starts fresh,
   whatever happened earlier; only runs of chunks without such a break depend on order;
3. for a chunk inside a run, a step function tells for every possible entry time when its
   last kept slot would be; entry times fall within one cooldown of the first slot, so the
   function is small;
4. the step functions of a run are chained, which fixes the entry time of each chunk;
5. every chunk then marks its kept slots on its own.

Steps 3 and 5 run per (key, chunk), in parallel over a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.session import written

CHUNK_COOLDOWNS = 64


def _chunk_tools(wait: int):
    """Helpers for the task side, closed over by the functions shipped to workers."""

    def whole_groups(batches, names):
        """Regroup sorted Arrow batches so that no (key, chunk) group is cut in two."""
        import numpy as np
        import pandas as pd

        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            differs = np.zeros(len(pdf), dtype=bool)
            for name in names:
                column = pdf[name].to_numpy()
                differs[1:] |= column[1:] != column[:-1]
            opens = np.flatnonzero(differs)
            if len(opens):
                held.append(pdf.iloc[: opens[-1]])
                yield pd.concat(held, ignore_index=True)
                held = [pdf.iloc[opens[-1] :]]
            else:
                if held and (held[-1][names].iloc[-1] != pdf[names].iloc[0]).any():
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(pdf)
        if held:
            yield pd.concat(held, ignore_index=True)

    def bounds(pdf, names):
        """Start and end row of each group."""
        import numpy as np

        differs = np.ones(len(pdf), dtype=bool)
        differs[1:] = False
        for name in names:
            column = pdf[name].to_numpy()
            differs[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(differs)
        return starts, np.r_[starts[1:], len(pdf)]

    def axis(t, starts, ends):
        """All groups on one time axis, far enough apart not to touch.

        Returns positions, the step between groups and, per row, the first row of the same
        group at least one cooldown later (the group's end when there is none).
        """
        import numpy as np

        group = np.repeat(np.arange(len(starts)), ends - starts)
        since = t - t[starts][group]
        step = int(since.max()) + 2 * wait + 2
        if step * len(starts) >= 1 << 62:
            raise OverflowError("cooldown chunk too long for one batch")
        place = group * step + since
        return group, place, step, np.searchsorted(place, place + wait, side="left")

    return whole_groups, bounds, axis


def _exit_steps(wait: int):
    whole_groups, bounds, axis = _chunk_tools(wait)

    def steps(batches):
        import numpy as np
        import pandas as pd

        for pdf in whole_groups(batches, ["_key", "_chunk"]):
            starts, ends = bounds(pdf, ["_key", "_chunk"])
            t = pdf["_t"].to_numpy()
            _, _, _, follow = axis(t, starts, ends)
            # an entry falls at or before the first slot one cooldown after the first slot
            upto = np.minimum(follow[starts], ends - 1)
            sizes = upto - starts + 1
            owner = np.repeat(np.arange(len(starts)), sizes)
            first = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
            at, end = first.copy(), ends[owner]
            moving = follow[at] < end
            while moving.any():
                at[moving] = follow[at[moving]]
                moving = follow[at] < end
            # one piece per run of entries with the same last kept slot, named by its upper end
            last = np.r_[(at[1:] != at[:-1]) | (owner[1:] != owner[:-1]), True]
            rows = first[last]
            yield pd.DataFrame(
                {
                    "_key": pdf["_key"].to_numpy()[rows],
                    "_run": pdf["_run"].to_numpy()[rows],
                    "_chunk": pdf["_chunk"].to_numpy()[rows],
                    "_until": t[rows],
                    "_exit": t[at[last]],
                }
            )

    return steps


def _chain(wait: int):
    whole_groups, bounds, _ = _chunk_tools(wait)

    def chain(batches):
        import bisect

        import pandas as pd

        for pdf in whole_groups(batches, ["_key", "_run"]):
            key, run = pdf["_key"].to_numpy(), pdf["_run"].to_numpy()
            chunk, until = pdf["_chunk"].to_numpy(), pdf["_until"].to_numpy().tolist()
            leave = pdf["_exit"].to_numpy().tolist()
            out, before = [], None
            for lo, hi in zip(*bounds(pdf, ["_key", "_run", "_chunk"])):
                if before != (key[lo], run[lo]):
                    # a run opens fresh: its first slot is always kept
                    before, entry = (key[lo], run[lo]), -(1 << 62)
                out.append((key[lo], chunk[lo], entry))
                i = bisect.bisect_left(until, entry, lo, hi)
                if i < hi:
                    entry = leave[i] + wait
            yield pd.DataFrame(out, columns=["_key", "_chunk", "_entry"])

    return chain


def _marks(wait: int):
    whole_groups, bounds, axis = _chunk_tools(wait)

    def marks(batches):
        import numpy as np
        import pandas as pd

        for pdf in whole_groups(batches, ["_key", "_chunk"]):
            starts, ends = bounds(pdf, ["_key", "_chunk"])
            t = pdf["_t"].to_numpy()
            _, place, step, follow = axis(t, starts, ends)
            entry = pdf["_entry"].to_numpy()[starts]
            offset = np.clip(entry, t[starts], t[ends - 1] + 1) - t[starts]
            at = np.searchsorted(place, np.arange(len(starts)) * step + offset, side="left")
            kept = []
            live = np.flatnonzero(at < ends)
            while len(live):
                kept.append(at[live])
                at[live] = follow[at[live]]
                live = live[at[live] < ends[live]]
            rows = np.concatenate(kept) if kept else np.empty(0, dtype="int64")
            yield pdf.iloc[rows][["_key", "_t"]]

    return marks


def _sorted_tasks(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of a group together and in order; the sort spills, no group is collected."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def kept_times(slots: DataFrame, wait: int, chunk_cooldowns: int = CHUNK_COOLDOWNS) -> DataFrame:
    """(_key, _t) of the slots that pass the cooldown; ``slots`` holds distinct pairs."""
    cut = slots.withColumn("_chunk", F.floor(F.col("_t") / F.lit(wait * chunk_cooldowns)))
    by_key = Window.partitionBy("_key").orderBy("_chunk")
    spans = (
        cut.groupBy("_key", "_chunk")
        .agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_prev", F.lag("_last").over(by_key))
        .withColumn("_fresh", F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") >= wait))
        .withColumn("_run", F.sum(F.col("_fresh").cast("bigint")).over(by_key))
        .withColumn("_follows", F.coalesce(~F.lead("_fresh").over(by_key), F.lit(False)))
    )
    # one row per key and chunk, written once because three branches read it
    spans = written(spans, "cooldown-spans")
    # a fresh chunk with one slot needs no further work
    single = F.col("_fresh") & (F.col("_n") == 1)
    alone = spans.filter(single).select("_key", F.col("_first").alias("_t"))
    linked = spans.filter(~F.col("_fresh") | F.col("_follows")).select("_key", "_chunk", "_run")
    steps = _sorted_tasks(cut.join(linked, ["_key", "_chunk"]), ["_key", "_chunk"], "_t").mapInPandas(
        _exit_steps(wait), "_key string, _run bigint, _chunk bigint, _until bigint, _exit bigint"
    )
    entries = _sorted_tasks(steps, ["_key", "_run"], "_chunk", "_until").mapInPandas(
        _chain(wait), "_key string, _chunk bigint, _entry bigint"
    )
    starts = (
        spans.filter(~single)
        .select("_key", "_chunk", "_first")
        .join(entries, ["_key", "_chunk"], "left")
        .select("_key", "_chunk", F.coalesce("_entry", "_first").alias("_entry"))
    )
    marked = _sorted_tasks(cut.join(starts, ["_key", "_chunk"]), ["_key", "_chunk"], "_t").mapInPandas(
        _marks(wait), "_key string, _t bigint"
    )
    return marked.unionByName(alone)


def key_name(key: Column) -> Column:
    """Text of a key that is never null, so joins on it keep null keys."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def cooldown(
    df: DataFrame,
    key: Column | str,
    ts: str,
    seconds: float,
    tie: str,
    seed: DataFrame | None = None,
    chunk_cooldowns: int = CHUNK_COOLDOWNS,
) -> DataFrame:
    """Rows of ``df`` that pass the cooldown of their key.

    ``tie`` orders rows with the same key and time.  ``seed`` (columns key, last_at) holds
    the last kept time per key from earlier runs; rows at or before it are suppressed.
    Rows without a time cannot be compared and all pass; a null key is a key of its own.
    The chunk table is computed by the call, the rest is lazy; ``df`` is read several
    times, so pass a written table when it is expensive to compute.
    """
    wait = int(round(seconds * 1_000_000))
    named = F.col(key) if isinstance(key, str) else key
    timed = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"_key": key_name(named), "_t": timed}).filter(F.col("_t").isNotNull())
    pairs = rows.select("_key", "_t")
    if seed is not None:
        known = seed.select(
            key_name(F.col("key")).alias("_key"),
            F.unix_micros(F.col("last_at").cast("timestamp")).alias("_seed"),
        ).filter(F.col("_seed").isNotNull())
        rows = (
            rows.join(known, "_key", "left")
            .filter(F.col("_seed").isNull() | (F.col("_t") > F.col("_seed")))
        )
        pairs = rows.select("_key", "_t").unionByName(known.select("_key", F.col("_seed").alias("_t")))
    slots = pairs.groupBy("_key", "_t").agg(F.count(F.lit(1)).alias("_same")).select("_key", "_t")
    # the first row of a slot stands for it; taken by aggregate, so equal times combine early
    plain = [c for c in rows.columns if c not in ("_key", "_t", "_seed")]
    first = rows.groupBy("_key", "_t").agg(
        F.min_by(F.struct(*plain), F.struct(F.col(tie).isNull(), F.col(tie))).alias("_row")
    )
    kept = first.join(kept_times(slots, wait, chunk_cooldowns), ["_key", "_t"], "left_semi").select("_row.*")
    return kept.unionByName(df.filter(timed.isNull()))
