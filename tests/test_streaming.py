"""Live operators against simulations, and stream against table."""

import random

import numpy as np
from pyspark.sql import functions as F

from utterlake.operators import segment
from utterlake.streaming import frames, router, vad


def live(df, tmp_path, name, make):
    """All rows that ``make`` gives of ``df``, sent file by file."""
    rows = sorted(df.collect(), key=lambda x: (x["seq_no"], x["key"]))
    for i in range(3):
        part = rows[len(rows) * i // 3 : len(rows) * (i + 1) // 3]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    s = df.sparkSession.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def plain_segments(p, on, min_silence):
    """Frame by frame, from the description."""
    out, begun, quiet = [], None, None
    for i, x in enumerate(p, 1):
        if x >= on:
            begun, quiet = (i if begun is None else begun), None
        elif x < on - 0.15 and begun is not None:
            quiet = i if quiet is None else quiet
            if (i - quiet) * 512 >= min_silence:
                out.append((len(out) + 1, max(0, begun * 512 - 2112), quiet * 512 + 1088))
                begun = quiet = None
    return out, None if begun is None else (len(out) + 1, max(0, begun * 512 - 2112))


def test_segments_of_parts():
    r = random.Random(5)
    for _ in range(200):
        p = np.array([r.choice([0.1, 0.3, 0.56, 0.6, 0.7, 0.9]) for _ in range(r.randrange(0, 60))])
        silence = r.choice([0, 512, 1024, 2048])
        state, got, at = vad.Open(), [], 0
        while at < len(p):
            n = r.randrange(1, 12)
            state, out = vad.advance(state, p[at : at + n], 0.7, silence)
            got += out
            at += n
        assert (got, vad.speaking(state)) == plain_segments(p, 0.7, silence)


def test_frames_carry_over(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, i, [r.random() for _ in range(r.randrange(0, 9))] if r.random() < 0.9 else None) for k in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "key string, seq_no bigint, pcm array<float>")
    batch = {(x["key"], x["frame"]): x["pcm"] for x in segment.frames(df, "key", ["seq_no"], "pcm", 16).collect()}
    for k in ("a", "b"):
        whole = np.concatenate([np.float32(x) for kk, _, x in rows if kk == k and x])
        assert {f: p for (kk, f), p in batch.items() if kk == k} == {i: whole[i * 16 : i * 16 + 16].tolist() for i in range(len(whole) // 16)}
    got = live(df, tmp_path, "frames_out", lambda s: frames.reframe(s, 16))
    assert {(x["key"], x["frame"]): x["pcm"] for x in got.collect()} == batch


def test_route():
    lim = router.Limits(keep=10, infer_above=25, least_speech=0)

    def run(calls, limits=lim):
        s, out = router.Held(), []
        for n, start, end, last in calls:
            s, a = router.route(s, n, start, end, last, limits)
            out += a
        return out, s

    # silence keeps the last ten; a padded start reaches back into them, speech goes on, an end finishes
    out, s = run([(20, None, None, False), (20, 33, None, False), (20, None, None, False), (20, None, 65, False)])
    assert out == [("open", 33, 33), ("send", 33, 40), ("send", 40, 60), ("infer", 60, 60), ("send", 60, 65), ("finish", 80, 80)]
    assert s == router.Held(80, 80)
    # a start before what is held begins there; start and end in one call
    assert run([(40, None, None, False), (20, 5, None, False)])[0][:2] == [("open", 30, 30), ("send", 30, 60)]
    assert run([(40, 8, 30, False)])[0] == [("open", 8, 8), ("send", 8, 30), ("finish", 40, 40)]
    # nothing spoken: what is held is sent at the end; too little speech is skipped
    assert run([(40, None, None, False), (0, None, None, True)])[0] == [("open", 30, 30), ("send", 30, 40), ("finish", 40, 40)]
    assert run([(40, 30, 35, False)], lim._replace(least_speech=6))[0] == [("open", 30, 30), ("send", 30, 35), ("skip", 40, 40)]
    # exactly the limit waits on
    assert run([(25, 0, None, False), (1, None, None, False)])[0] == [("open", 0, 0), ("send", 0, 25), ("send", 25, 26), ("infer", 26, 26)]
    assert run([(0, None, None, True)])[0] == [("finish", 0, 0)]


def test_routes_never_send_twice(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for k in range(5):
        at = 0
        for i in range(40):
            n = r.choice([0, 5, 10, 20])
            start = r.randrange(max(0, at - 5), at + n + 1) if r.random() < 0.2 else None
            end = r.randrange(start or at, at + n + 1) if r.random() < 0.2 else None
            rows.append((str(k), i, n, start, end, i == 39))
            at += n
    df = spark.createDataFrame(rows, "key string, seq_no bigint, samples bigint, start bigint, end bigint, last boolean")
    lim = router.Limits(keep=12, infer_above=30)
    batch = [tuple(x) for x in router.routed_table(df, lim).collect()]
    for k in range(5):
        upto = 0
        for _, _, action, a, b in [x for x in batch if x[0] == str(k)]:
            if action == "send":
                assert upto <= a < b
                upto = b
    assert sorted(tuple(x) for x in live(df, tmp_path, "routes_out", lambda s: router.routed(s, lim)).collect()) == sorted(batch)
    assert router.routed_table(df.limit(0)).count() == 0


def test_trigger_flush(spark):
    df = spark.createDataFrame([(k, i, n) for k, ns in ((1, [5, 5, 5, 5]), (2, [11]), (3, [None, 3])) for i, n in enumerate(ns)], "k int, i int, n int")
    at = lambda flush: sorted((x["k"], x["chunk"], x["waiting"]) for x in segment.trigger_cadence(df, "k", ["i"], "n", 10, flush).collect())
    assert at(False) == [(1, 2, 15), (2, 0, 11)]
    assert at(True) == [(1, 2, 15), (1, 3, 5), (2, 0, 11), (3, 1, 3)]
    assert segment.accumulated(df.select("k", "i", F.array("n").alias("p")), ["k"], ["i"], "p").count() == 3
