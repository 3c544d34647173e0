"""What the first review found missing in the workspace queries."""

from __future__ import annotations

from brindle.plans.queries import QUERIES


def test_authorised_requests_of_the_stream_are_files(spark, sf, tmp_path):
    out = QUERIES["authorize_stream"](spark, sf)
    assert out.inputFiles()  # of a memory sink there are none: its rows are in the driver
    assert out.count() == QUERIES["authorize_asof"](spark, sf).where("status = 200").count() > 0
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["authorize_stream"](spark, str(tmp_path)).count() == 0
