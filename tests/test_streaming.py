"""Incremental breakdown equals the batch breakdown."""

from __future__ import annotations

import os

from storeflow.operators import aggregates as A
from storeflow.sources.silver import silver_lines
from storeflow.streaming import incremental as S
from tests.conftest import SF_SMALL


def test_streamed_totals_equal_batch(spark, tmp_path):
    sl = silver_lines(spark, SF_SMALL)
    folder, table = str(tmp_path), str(tmp_path / "region_totals")
    # Two arrivals of order lines (split by year), written as files.
    sl.where("year(order_date) < 1998").write.parquet(os.path.join(folder, "in", "a"))
    sl.where("year(order_date) >= 1998").write.parquet(os.path.join(folder, "in", "b"))
    stream = S.read_lines(spark, os.path.join(folder, "in", "*"), sl, max_files_per_trigger=1)
    q = S.start(S.running_totals(stream, "region"), "region_totals", table,
                checkpoint=os.path.join(folder, "_ckpt"))
    try:
        q.processAllAvailable()
        got = {r["region"]: (r["orders_count"], r["total_sales"]) for r in
               spark.read.parquet(table).collect()}
    finally:
        q.stop()
    want = {r["region"]: (r["orders_count"], r["total_sales"]) for r in
            A.summarize(sl, ["region"], [A.line_count(), A.total_sales()]).collect()}
    assert got == want
