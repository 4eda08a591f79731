"""Segmentation, beams, samples and data sets against simulations."""

import random

import numpy as np
from pyspark.sql import functions as F

from utterlake.functions import pcm
from utterlake.functions.metrics import prefix_end
from utterlake.operators import beam, dataset, segment, synthesis
from utterlake.streaming import vad


def frames(seed):
    r = random.Random(seed)
    p = 0.5
    out = []
    for _ in range(300):
        p = min(1.0, max(0.0, p + r.uniform(-0.3, 0.3)))
        out.append(round(p, 3))
    return out


def test_segments_match_the_stream_rule(spark):
    rows, want = [], set()
    for key in range(12):
        p = frames(key)
        rows += [(key, i, x) for i, x in enumerate(p)]
        state, closed = vad.advance(vad.Open(), np.array(p), 0.7, 2048)
        want |= {(key, *x) for x in closed}
        if vad.speaking(state):
            want.add((key, *vad.speaking(state), None))
    df = spark.createDataFrame(rows, "k int, i int, p double")
    got = {tuple(r) for r in segment.speech_segments(df, "k", ["i"], min_silence=2048).collect()}
    assert got == want
    assert segment.speech_segments(df.limit(0), "k", ["i"]).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(k), i, p) for k in range(4) for i, p in enumerate(frames(k + 50))]
    df = spark.createDataFrame(rows, "key string, seq_no bigint, p double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = vad.segments(stream, min_silence=2048).writeStream.format("memory").queryName("vad_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = segment.speech_segments(df, "key", ["seq_no"], min_silence=2048).where("end_sample is not null")
    assert {tuple(r) for r in spark.table("vad_out").collect()} == {tuple(r) for r in batch.collect()}


def test_trigger_and_gate(spark):
    df = spark.createDataFrame([(1, i, 8000) for i in range(10)], "k int, i int, n int")
    assert sorted(r["chunk"] for r in segment.trigger_cadence(df, "k", ["i"], "n", 8000).collect()) == [1, 3, 5, 7, 9]
    g = spark.createDataFrame([(1, i, 6000) for i in range(5)], "k int, i int, n int")
    assert [r["gate"] for r in segment.initial_buffer(g, "k", ["i"], "n").orderBy("i").collect()] == ["wait", "wait", "first", "next", "next"]


def test_chunks(spark):
    df = spark.createDataFrame([("a", 1.2), ("b", 1.0), ("c", 0.0), ("d", None)], "f string, s double")
    assert [tuple(r)[1:] for r in segment.chunks(df, "f", "s", 0.5).where("f = 'a'").orderBy("chunk").collect()] == [(0, 0.0, 0.5), (1, 0.5, 1.0), (2, 1.0, 1.2)]
    assert segment.chunks(df, "f", "s", 0.5).where("f <> 'a'").count() == 2


def expanded(beams, stop, k):
    out = []
    for b, (cum, toks, positions) in enumerate(beams):
        if not positions:
            out.append((cum, toks, True))
            continue
        run, path = cum, []
        ended = False
        for greedy, alts in positions:
            lp = dict(alts).get(greedy, 0.0)
            for t, x in alts:
                if t != greedy:
                    out.append((run + x, toks + path + [t], t in stop))
            run, path = run + lp, path + [greedy]
            if greedy in stop:
                ended = True
                break
        out.append((run, toks + path, ended))
    score = lambda x: x[0] / max(1, len(x[1]) - (bool(x[1]) and x[1][-1] in stop))
    return [(round(c, 9), t) for c, t, _ in sorted(out, key=score, reverse=True)[:k]]


def test_beam_block(spark):
    r = random.Random(9)
    for _ in range(5):
        beams = []
        for _ in range(3):
            pos = [(r.randrange(5), [(t, -r.random() * 3) for t in r.sample(range(5), 3)]) for _ in range(r.randrange(0, 4))]
            beams.append((-r.random(), [r.randrange(5) for _ in range(r.randrange(1, 3))], pos))
        rows = [(0, i, c, t, [(g, a) for g, a in p]) for i, (c, t, p) in enumerate(beams)]
        df = spark.createDataFrame(rows, "g int, beam int, cum double, tokens array<int>, positions array<struct<greedy:int,alts:array<struct<token:int,lp:double>>>>")
        got = [(round(x["cum"], 9), x["tokens"]) for x in beam.expand(df, "g", [4], 4).orderBy("rank").collect()]
        assert got == expanded(beams, {4}, 4)


def canon(s):
    return "".join(c for c in s.lower() if c.isalnum())


def test_synthesis(spark):
    r = random.Random(3)
    rows, want = [], set()
    for f in range(30):
        ref = "".join(r.choice("abcd") for _ in range(r.randrange(0, 30)))
        hist, t = [], 0.0
        for i in range(r.randrange(0, 5)):
            t = round(t + r.choice([0.25, 0.5, 1.0, 1.5]), 2)
            prev = ref[: r.randrange(0, len(ref) + 1)]
            top = [ref[: len(prev) + r.randrange(0, 6)], "x,y" if r.random() < 0.5 else ""]
            hist.append((t, prev, top if r.random() < 0.9 else [], "finish"))
        rows.append((f"f{f}", ref, hist))
        last = 0.0
        for i, (end, prev, top, _) in enumerate(hist):
            d, last = end - last, end
            best = [canon(x) for x in top[:4] if canon(x)]
            at = prefix_end(canon(prev), canon(ref))
            if not canon(ref) or not best or at >= len(canon(ref)):
                continue
            if d < (1.0 if i == 0 else 0.5):
                rest = canon(ref)[at:]
            elif len(best[0]) > len(canon(prev)):
                rest = canon(ref)[at : at + len(best[0]) - len(canon(prev))]
            else:
                continue
            want.add((f"f{f}", end, rest, tuple(best)))
    df = spark.createDataFrame(rows, "audio_path string, final_text string, history array<struct<end_time:double,previous_transcript:string,topk:array<string>,source:string>>")
    got = {(x["audio_path"], x["timestamp"], x["continuation_transcript"], tuple(x["k_best_candidates"])) for x in synthesis.synthesize(df).collect()}
    assert got == want


def test_datasets(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 0)], "i int, w int")
    assert sorted((r["i"], r["copy"]) for r in dataset.replicate(df, "w").collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    big = spark.range(2000)
    share = dataset.split(big, 0.1, 42, "id").where("part = 'validation'").count() / 2000
    assert 0.07 < share < 0.13
    assert dataset.sample(big, 10, 21, "id").count() == 10
    assert dataset.sample(big, 10, 21, "id").collect() == dataset.sample(big.repartition(7), 10, 21, "id").collect()
    done = spark.createDataFrame([(1,), (1,)], "id bigint")
    assert dataset.unprocessed(big, done, "id").count() == 1999


def test_prompt(spark):
    df = spark.createDataFrame([(["a", None, "b"], "p"), (["a"], None)], "c array<string>, p string")
    first, second = [r[0] for r in df.select(dataset.prompt(F.col("c"), F.col("p"), 3)).collect()]
    assert "  1. a\n  2. b\n" in first and first.endswith('after "p"?') and 'transcript: ""' in second


def test_prompt_without_audio(spark):
    df = spark.createDataFrame([(["a"], "p")], "c array<string>, p string")
    assert df.select(dataset.prompt(F.col("c"), F.col("p"), 3, audio=False)).first()[0].startswith("Given the following ASR")


def test_pcm(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(pcm.cut(F.col("x"), F.lit(0.2), F.lit(0.55), 10)).collect()] == [[2.0, 3.0, 4.0], []]
    assert df.select(pcm.resample(F.col("x"), 10, 20)).first()[0][:4] == [0.0, 0.5, 1.0, 1.5]
    assert df.select(pcm.label_mask(F.transform("x", lambda v: v.cast("int")), F.lit(2))).first()[0][:3] == [-100, -100, 2]
