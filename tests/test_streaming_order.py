"""Stateful streams against batch results, with events shuffled over batches."""

import random

from tracelake.streaming import state


def expected(rows, seconds, gap_s):
    out, by = [], {}
    for e, us in rows:
        by.setdefault(e, []).append(us)
    for e, times in by.items():
        times.sort()
        for i, us in enumerate(times):
            gap = us - times[i - 1] if i else 0
            out.append((e, us, gap, "ACTIVITY_GAP" if gap > gap_s * 1_000_000 else None, sum(us - seconds * 1_000_000 <= x for x in times[: i + 1]), 0))
    return sorted(out, key=str)


def test_shuffled_batches_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(0, 4000) * 1_000_000) for _ in range(120)]
    rows += [("a", 100_000_000_000)] * 1  # far ahead: lets all others out
    before = spark.conf.get(state.STATE_STORE[0], None)
    spark.conf.set(*state.STATE_STORE)
    try:
        shuffled = rows[:-1]
        rng.shuffle(shuffled)
        parts = [shuffled[i::4] for i in range(4)] + [rows[-1:], [("b", 100_000_000_000)]]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, "entity string, us long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("entity string, us long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = state.ordered_activity(stream, 60, 100, "2 hours")
        q = got.writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        seen = sorted(map(tuple, spark.table("ordered").collect()), key=str)
        assert seen == expected(rows[:-1], 60, 100)
        assert all(o.numRowsDroppedByWatermark == 0 for p in q.recentProgress for o in p.stateOperators)
    finally:
        spark.conf.unset(state.STATE_STORE[0]) if before is None else spark.conf.set(state.STATE_STORE[0], before)
