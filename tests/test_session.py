from __future__ import annotations

import os

from sillage.session import scratch, shared_dir, stage, unstage


def _exists(path: str) -> bool:
    return os.path.exists(path.removeprefix("file:"))


def test_scratch_leaves_nothing_behind(spark):
    kept = shared_dir(spark, "kept")
    with scratch(spark):
        inner = stage(spark.range(5), "inner")
        inner.write.parquet(kept)
        assert _exists(inner._staged_path)
    assert not _exists(inner._staged_path) and spark.read.parquet(kept).count() == 5


def test_unstage(spark):
    frame = stage(spark.range(5), "frame")
    assert frame.count() == 5
    unstage(frame)
    assert not _exists(frame._staged_path)
