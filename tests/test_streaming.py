"""Replay of logs: a stream of late, repeated and shuffled events, restarted once, against the table of them."""

import random
from datetime import datetime, timedelta

from askgrid.streaming import replay

SCHEMA = "session string, at timestamp, event string, role string, text string"


def told(rng, n):
    """Events of four sessions with pauses, runs of one role, equal neighbours and equal times."""
    rows = []
    for s in ("a", "b", "c", None):
        at = datetime(2024, 5, 1, 8) + timedelta(minutes=rng.randrange(60))
        for k in range(n):
            at += timedelta(seconds=rng.choice([0, 20, 200, 1500, 4000]))
            rows.append((s, at, f"{k:03}", rng.choice(["user", "assistant"]), rng.choice(["yes", "no", None, "a longer text"])))
    return sorted(rows, key=lambda r: r[1])


def rows_of(df):
    return sorted((r.session, r.began, r.place, r.current_message, tuple((m.role, m.content) for m in r.conversation_history)) for r in df.collect())


def by_hand(rows, gap=timedelta(minutes=30)):
    out = []
    for s in "abc":
        own, turns, last, began = sorted({(at, e, r, t or "") for x, at, e, r, t in rows if x == s}), [], None, None
        talks = []
        for at, _, role, text in own:
            if last is None or at - last >= gap:
                turns, began, prior = [], at, None
                talks.append((began, turns))
            if turns and turns[-1][0] == role:
                if prior != text:
                    turns[-1] = (role, turns[-1][1] + "\n" + text)
            else:
                turns.append((role, text))
            last, prior = at, text
        out += [(s, began, k + 1, t, tuple(turns[:k])) for began, turns in talks for k, (r, t) in enumerate(turns) if r == "user"]
    return sorted(out)


def test_a_table_of_events(spark):
    rows = told(random.Random(1), 30)
    table = spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(3)
    wanted = by_hand(rows)
    assert len(wanted) > 20 and rows_of(replay.samples(table)) == wanted
    assert rows_of(replay.samples(table.limit(0))) == []


def test_a_stream_equals_the_table_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = told(rng, 14)
    end = [("z", rows[-1][1] + timedelta(hours=k), str(k), "assistant", "the end") for k in (30, 60, 90)]
    # In order but for ten minutes, each file shuffled, some rows in two files.
    jittered = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(300)))
    parts = [jittered[k : k + 20] for k in range(0, len(jittered), 20)]
    parts = [p + rng.sample(p, 3) for p in parts] + [[e] for e in end]
    for p in parts:
        rng.shuffle(p)

    def put(k, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03}"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = replay.samples(stream, late="2 hours")
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    half = len(parts) // 2
    for k, part in enumerate(parts[:half]):
        put(k, part)
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    for k, part in enumerate(parts[half:], half):
        put(k, part)
    run()
    got = rows_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == by_hand(rows) == rows_of(replay.samples(spark.createDataFrame(rows, SCHEMA))) and 0 < first < len(got)
