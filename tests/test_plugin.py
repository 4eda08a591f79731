"""Injected callables and settings."""

import pytest

from utterlake import config
from utterlake.operators import plugin


def test_plugin(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert plugin.apply(df, None, "") is df
    with pytest.raises(ValueError):
        plugin.apply(df, "nothing", "i int")


def test_plugin_runs_a_factory(spark, tmp_path, monkeypatch):
    (tmp_path / "own_model.py").write_text("def make(suffix):\n    return lambda b: b.assign(s=b.s + suffix)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "own_model.py"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert sorted(r["s"] for r in plugin.apply(df, "own_model:make", "i int, s string", suffix="!").collect()) == ["a!", "b!"]


MODELS = """
class Backend:
    def __init__(self): self.warm = False
    def warmup(self, audio, init_prompt=""): self.warm = True
    def transcribe(self, audio, init_prompt=""):
        assert self.warm
        return None if len(audio) == 0 else f"{init_prompt}{len(audio)}"
class Online:
    def __init__(self): self.n = 0
    def insert_audio_chunk(self, audio): self.n += len(audio)
    def process_iter(self, start_time=None): return self.n if self.n > 2 else None
    def finish(self): return f"end {self.n}"
def corrector():
    def one(candidates, previous, audio):
        if candidates[0] == "bad": raise RuntimeError("no")
        return None if candidates[0] == "none" else "+" + candidates[-1]
    return one
"""


def test_injected_models(spark, tmp_path):
    (tmp_path / "own_models.py").write_text(MODELS)
    spark.sparkContext.addPyFile(str(tmp_path / "own_models.py"))
    df = spark.createDataFrame([("a", 0, [1.0, 2.0], "p"), ("a", 1, [3.0], None), ("b", 0, [], ""), ("c", 0, None, "")], "k string, i int, pcm array<float>, said string")
    got = {(r["k"], r["i"]): r["text"] for r in plugin.transcribe(df, "own_models:Backend", prompt="said").collect()}
    assert got == {("a", 0): "p2", ("a", 1): "1", ("b", 0): None, ("c", 0): None}
    assert sorted((r["k"], r["seq"], r["text"]) for r in plugin.online(df, "own_models:Online", "k", "i").collect() if r["seq"] is not None) == [("a", 1, "3")]
    assert sorted((r["k"], r["text"]) for r in plugin.online(df, "own_models:Online", "k", "i").collect() if r["seq"] is None) == [("a", "end 3"), ("b", "end 0"), ("c", "end 0")]
    c = spark.createDataFrame([(1, ["x", "y\ufffd", " "], "p"), (2, ["none"], "p"), (3, ["bad"], None), (4, [], "p"), (5, [None, "  "], "p"), (6, None, "p")], "i int, topk array<string>, previous_transcript string")
    got = {r["i"]: (r["corrected"], r["corrected_by"]) for r in plugin.correct(c, "own_models:corrector").collect()}
    assert got == {1: ("p+y", "model"), 2: ("none", "top1"), 3: ("bad", "top1"), 4: ("", "top1"), 5: ("", "top1"), 6: ("", "top1")}
    assert [r["corrected"] for r in plugin.correct(c, None).orderBy("i").collect()] == ["x", "none", "bad", "", "", ""]


def test_settings_from_a_file(tmp_path):
    (tmp_path / "s.yaml").write_text("candidates: 3\nchunk_ms: 250\n")
    assert config.load_file(str(tmp_path / "s.yaml")) == config.SynthesisConfig(candidates=3, chunk_ms=250)
    (tmp_path / "e.yaml").write_text("")
    assert config.load_file(str(tmp_path / "e.yaml")) == config.SynthesisConfig()


def test_config():
    c = config.load({"chunk_ms": 1000})
    assert config.with_arguments(c, ["--chunk-ms", "250", "--initial-s", "2"]) == config.SynthesisConfig(chunk_ms=250, initial_s=2.0)
    with pytest.raises(TypeError):
        config.load({"unknown": 1})
