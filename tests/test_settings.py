"""Settings by file, environment and session; embedders by name."""

import pytest
from pyspark.sql import functions as F

from chronovec import settings
from chronovec.functions.binary import hashed_vector
from chronovec.operators import recommend
from chronovec.settings import Settings
from chronovec.sources import shared


def test_layers(spark, tmp_path):
    file = tmp_path / "own.toml"
    file.write_text('[scoring]\nhigh = 1\nlow = "0.2"\nsmooth_window = 5\nother = 3\n[sync]\nprune = true\n[unknown]\nx = 1\n[library]\npath = "/lib"\n')
    assert Settings.load(tmp_path / "none.toml", {}) == Settings() == Settings.load(environment={})
    own = Settings.load(file, {})
    assert (own.scoring.high, own.scoring.low, own.scoring.smooth_window, own.sync.prune, own.library.path, own.scoring.pad) == (1.0, 0.2, 5, True, "/lib", 0.5)
    env = {"CHRONOVEC_SCORING_HIGH": "0.7", "CHRONOVEC_SYNC_PRUNE": "off", "CHRONOVEC_SAMPLING_MODE": "keyframes"}
    own = Settings.load(file, env)
    assert (own.scoring.high, own.sync.prune, own.sampling.mode) == (0.7, False, "keyframes")
    spark.conf.set("chronovec.scoring.high", "0.8")
    try:
        assert Settings.load(file, env, spark).scoring.high == 0.8
    finally:
        spark.conf.unset("chronovec.scoring.high")
    for yes in (" YES ", "1", "On", "true"):
        assert Settings.load(environment={"CHRONOVEC_SYNC_PRUNE": yes}).sync.prune
    with pytest.raises(ValueError, match="scoring.smooth_window needs a whole number"):
        Settings.load(environment={"CHRONOVEC_SCORING_SMOOTH_WINDOW": "3.5"})


def test_rules_are_keywords_of_the_operators(spark):
    rows = [("a", i, float(i), [1.0, 0.0] if 10 <= i < 30 else [0.0, 1.0]) for i in range(60)]
    frames = spark.createDataFrame(rows, "key string, frame_idx int, time double, vec array<double>")
    rules = Settings.load(environment={"CHRONOVEC_SCORING_MAX_DURATION": "0", "CHRONOVEC_SCORING_SMOOTH_WINDOW": "1"}).scoring.rules()
    found = recommend.score_scenes(frames, frames.where("frame_idx = 12"), **rules).collect()
    assert [(r.start, r.end) for r in found] == [(9.5, 29.5)]


def test_embedders_by_name(spark):
    rows = spark.createDataFrame([(bytearray(b"x"),), (None,)], "content binary")
    got = [r.vec for r in settings.embed(rows, "HASHED", dim=8).collect()]
    assert got[0] == pytest.approx(hashed_vector(b"x", 8).tolist()) and got[1] == pytest.approx(hashed_vector(b"", 8).tolist())
    settings.register_embedder("sizes", lambda: lambda data: F.array(F.octet_length(data).cast("double")))
    assert settings.embed(rows, "sizes").first().vec == [1.0]
    with pytest.raises(ValueError, match="unknown embedder"):
        settings.embedder("none")


def test_scratch_tables_go_with_their_block(spark):
    from pathlib import Path

    with shared.scratch():
        held = shared.written(spark.range(5), "numbers")
        folder = Path(held.inputFiles()[0].removeprefix("file://")).parent
        assert held.count() == 5 and folder.exists()
    assert not folder.exists()
    assert shared.written(spark.range(3), "numbers").count() == 3
