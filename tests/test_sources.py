"""Readers and writers on small files."""

import json
import wave

import numpy as np
import pytest

from utterlake.plans import evaluate
from utterlake.sources import readers, writers


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k_best_candidates": ["a"], "continuation_transcript": "b"}\n\nnot json\n{"k_best_candidates": []}\n')
    rows, bad = readers.json_lines(spark, str(p))
    assert rows.count() == 2 and [r["value"] for r in bad.collect()] == ["not json"]
    assert readers.is_correction_format(spark, str(p), audio=False) and not readers.is_correction_format(spark, str(p))


def pairs(df):
    return {r["file"]: r["text"] for r in df.collect()}


def test_references(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"audio_path": "/x/a.wav", "text_zh": "对"}, {"audio_path": "/x/b.wav", "text_zh": ""}, {"audio_path": "/x/c.wav", "text": "t"}, {"audio_path": "/y/a.wav", "text_zh": "后", "text_yue": "後"}]))
    assert pairs(readers.references(spark, str(tmp_path / "r.json"), "zh")) == {"a.wav": "后", "a": "后"}
    assert pairs(readers.references(spark, str(tmp_path / "r.json"), "zh", {"/r.json": "yue"})) == {"a.wav": "後", "a": "後"}
    (tmp_path / "list.json").write_text(json.dumps([{"audio_path": "/x/a.b.wav", "text_zh": "", "text": "t"}, {"audio_path": "/x/c.wav", "text": "u"}, {"audio_path": "/x/d.wav"}]))
    assert pairs(readers.flat_references(spark, str(tmp_path / "list.json"))) == {"a": "", "c": "u", "d": ""}
    (tmp_path / "flat.json").write_text(json.dumps({"a": "x", "b": ""}))
    assert pairs(readers.flat_references(spark, str(tmp_path / "flat.json"))) == {"a": "x", "b": ""}


def test_evaluation_from_files(spark, tmp_path):
    refs, logs = tmp_path / "r.json", tmp_path / "logs"
    logs.mkdir()
    refs.write_text(json.dumps([{"audio_path": "/d/one.wav", "text_zh": "对不对？"}, {"audio_path": "/d/two.wav", "text_zh": "你好"}]))
    with pytest.raises(ValueError):
        readers.transcripts(spark, str(logs))
    (logs / "one_transcription.txt").write_text(" 知道 \n")
    assert pairs(readers.transcripts(spark, str(logs))) == {"one": "知道", "one.wav": "知道"}
    (logs / "batch_transcriptions.json").write_text(json.dumps({"total_files": 1, "results": [{"file": "one.wav", "duration": 1.0, "transcription": "知道"}, {"file": "three.wav", "transcription": None}]}))
    said = readers.transcripts(spark, str(logs))
    assert pairs(said) == {"one": "知道", "one.wav": "知道", "three": "", "three.wav": ""}
    e = evaluate.evaluation(readers.references(spark, str(refs), "zh"), said, "zh")
    writers.evaluation_summary(e, str(tmp_path / "out"))
    r = spark.read.schema(readers.EVALUATION).json(str(tmp_path / "out")).first()
    assert (r["total_files"], r["matched_files"], r["unmatched_files"], r["average_cer"], r["average_mer"]) == (4, 2, 2, 1.0, 1.0)
    assert [tuple(x) for x in r["per_file_results"]] == [(f, "对不对", "知道", 1.0, 1.0, 3, 2) for f in ("one", "one.wav")]


def test_single_file_outputs(spark, tmp_path):
    # the published result of one utterance
    want = {"file": "13202e1ede2b4ad497a35b714916fd64.wav", "reference": "对不对？", "generated": "知道", "cer": 1.0, "mer": 1.0, "ref_length": 4, "gen_length": 2, "first_token_latency_ms": 186.06829643249512, "last_token_latency_ms": 186.1569881439209}
    segments = {"audio_file": "/d/13202e1ede2b4ad497a35b714916fd64.wav", "duration": 0.94, "segments": [{"emission_time": 0.94, "start": 0.38, "end": 0.38, "text": "知道"}]}
    df = spark.createDataFrame([(want["file"], want["reference"], want["generated"], "zh", want["first_token_latency_ms"], want["last_token_latency_ms"])], "file string, reference string, generated string, lang string, first_token_latency_ms double, last_token_latency_ms double")
    result = spark.createDataFrame([(segments["audio_file"], segments["duration"], [tuple(x[k] for k in ("emission_time", "start", "end", "text")) for x in segments["segments"]], want["generated"])], "audio_file string, duration double, segments array<struct<emission_time: double, start: double, end: double, text: string>>, final_text string")
    writers.single_file(result, str(tmp_path / "out"), evaluate.per_file(df))
    part = lambda name: next((tmp_path / "out" / name).glob("part-*")).read_text(encoding="utf-8")
    assert json.loads(part("evaluation_result.json")) == want
    assert json.loads(part("segments_with_timing.json")) == segments and part("final_transcription.txt") == want["generated"] + "\n"


def test_listing(spark, tmp_path):
    for name in ("b.wav", "a.WAV", "c.txt", "sub/d.wav", "sub/deep/e.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda **o: [r["path"].rsplit("/", 1)[1] for r in readers.audio_files(spark, str(tmp_path), **o).collect()]
    assert names() == ["a.WAV", "b.wav", "d.wav", "e.flac"]
    assert names(depth=0) == ["a.WAV", "b.wav"] and names(depth=1, extensions=("wav",), any_case=False) == ["b.wav", "d.wav"]
    with pytest.raises(ValueError):
        readers.audio_files(spark, str(tmp_path / "c.txt"))


def test_rows_without_files(spark):
    df = readers.in_memory(spark, [[0.5], []], ["a", "b"], ["x", "y"])
    assert [tuple(r) for r in df.collect()] == [([0.5], "a", "x"), ([], "b", "y")]
    with pytest.raises(ValueError):
        readers.in_memory(spark, [[0.5]], [], [])
    rows = readers.dummy(spark, samples=20).collect()
    assert len(rows) == 4 and len({tuple(r["audio"]) for r in rows}) == 1 and len(rows[0]["audio"]) == 20 and all(-1 <= x <= 1 for x in rows[0]["audio"])
    d = readers.with_defaults(spark.createDataFrame([(["a", "b"], None, None), (["a"], 3, "p")], "k_best_candidates array<string>, num_candidates int, previous_transcript string"))
    assert [(r["num_candidates"], r["previous_transcript"]) for r in d.collect()] == [(2, ""), (3, "p")]


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 16384]] * 800, "<i2").tobytes())
    (tmp_path / "broken.wav").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r["pcm"] for r in readers.audio(spark, str(tmp_path)).collect()}
    assert got["broken.wav"] is None and len(got["a.wav"]) == 1600 and got["a.wav"][5] == 0.25
    assert readers.audio_files(spark, str(tmp_path)).count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", 1.0, "x", 5.0, 0.0), ("b.wav", 2.0, "y", 7.0, None)], "file string, duration double, transcription string, first_token_latency_ms double, last_token_latency_ms double")
    writers.batch_summary(df, str(tmp_path / "s"))
    s = spark.read.json(str(tmp_path / "s")).first()
    assert s["average_first_token_latency_ms"] == 6.0 and len(s["results"]) == 2
    for _ in range(2):
        writers.append_json_lines(df, str(tmp_path / "j"))
        writers.append_lines(df, "file", str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4 and spark.read.text(str(tmp_path / "l")).count() == 4
    writers.per_key_json(df, "file", str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).count() == 2


def test_transcripts_and_tables(spark, tmp_path):
    (tmp_path / "a_transcription.txt").write_text(" hello \n")
    assert pairs(readers.transcript_files(spark, str(tmp_path))) == {"a": "hello", "a.wav": "hello"}
    (tmp_path / "t.csv").write_text("audio,response\nx,y\n")
    assert readers.tabular(spark, str(tmp_path / "t.csv"), {"audio": "audio_path"}).columns == ["audio_path", "response"]
