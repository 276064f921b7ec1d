"""Rounds of a replayed stream against the same rules over all events at once."""

import random
import time

from nimbora.streaming.rounds import outcomes

LIMIT = 45_000


def batch(events, watermark):
    """(player, round, guess, answered, seconds) of the rounds that are closed by ``watermark``."""
    by, out = {}, []
    for p, i, kind, ms in sorted(events, key=lambda e: (e[0], e[3], e[1])):
        by.setdefault(p, []).append((i, kind, ms))
    for p, rows in by.items():
        for (i, kind, ms), after in zip(rows, [*rows[1:], None], strict=True):
            if kind != "open" or (after is None and ms + LIMIT >= watermark):
                continue
            hit = after is not None and after[1] == "guess" and after[2] <= ms + LIMIT
            out.append((p, i, after[0] if hit else None, hit, (after[2] - ms) / 1000 if hit else None))
    return sorted(out, key=str)


def replay(spark, folder, slices):
    """Each slice is a file and a micro-batch of its own."""
    for k, rows in enumerate(slices):
        frame = spark.createDataFrame(rows, "player long, event_id long, kind string, ms long").selectExpr("player", "event_id", "kind", "timestamp_millis(ms) as ts")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1 if k < len(slices) - 1 else 0)
    stream = spark.readStream.schema("player long, event_id long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = outcomes(stream, 45.0, "0 seconds").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination(170)
    return sorted(((r.player, r.round_id, r.guess_id, r.answered, r.seconds) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_replay_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    events, now = [], 1_700_000_000_000
    for i in range(240):
        now += rng.choice([1_000, 20_000, 45_000, 90_000])
        events.append((rng.randrange(5), i, rng.choice(["open", "guess", "other"]), now))
    events.append((99, 999, "guess", now + 500))
    played = [e for e in events if e[2] != "other"]
    got = replay(spark, str(tmp_path), [events[:80], events[80:160], events[160:]])
    assert got == batch(played, now + 500) and len({r[3] for r in got}) == 2


def test_limits_and_ties(spark, tmp_path):
    t = 1_700_000_000_000
    events = [(1, 1, "open", t), (1, 2, "guess", t + LIMIT), (2, 3, "open", t), (2, 4, "guess", t + LIMIT + 1), (3, 5, "guess", t), (3, 6, "open", t), (3, 7, "guess", t), (4, 8, "open", t), (4, 9, "open", t + 5), (9, 10, "guess", t + 10 * LIMIT)]
    got = replay(spark, str(tmp_path), [events])
    assert got == batch(events, t + 10 * LIMIT) and (1, 1, 2, True, 45.0) in got and (4, 9, None, False, None) in got
