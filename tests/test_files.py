"""Raw CSV source: declared schema, round trip into the cleaning step."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storeflow.operators import clean as C
from storeflow.schema import RAW_SCHEMA
from storeflow.sources.files import read_raw, write_raw_csv
from storeflow.sources.raw import bronze_lines
from storeflow.sources.storage import write_table
from tests.conftest import SF_SMALL, line


def test_csv_round_trip_cleans_to_the_same_lines(spark, tmp_path):
    raw = bronze_lines(spark, SF_SMALL)
    # ids are text in a raw file
    as_text = raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                           for f in RAW_SCHEMA.fields])
    folder = os.path.join(str(tmp_path), "raw")
    write_raw_csv(as_text, folder)
    back = read_raw(spark, folder)
    assert back.schema == RAW_SCHEMA
    a = C.clean(back).exceptAll(C.clean(as_text)).count()
    b = C.clean(as_text).exceptAll(C.clean(back)).count()
    assert a == 0 and b == 0 and back.count() == raw.count()


@pytest.mark.parametrize("bad", ["discount", "short"])
def test_malformed_lines_fail_or_are_kept(spark, tmp_path, bad):
    good = "1,O1,1/5/2016,1/6/2016,S,C1,Anna,Seg,US,X,NY,501,East,P1,Cat,Sub,Desk,10.0,2,0.2,1.0"
    wrong = good.replace(",0.2,", ",abc,") if bad == "discount" else "2,O2,1/5/2016"
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([",".join(f.name for f in RAW_SCHEMA.fields), good, wrong]) + "\n")
    with pytest.raises(Exception):
        read_raw(spark, str(path)).collect()
    kept = {r["_line"]: r["Order ID"] for r in read_raw(spark, str(path), corrupt_col="_line").collect()}
    assert set(kept) == {None, wrong} and kept[None] == "O1"


def test_written_lines_hold_no_dictionary_of_ids_and_no_range_of_texts(spark, tmp_path, lines):
    made = [line(i, customer_name=None if i == 3 else "Anna") for i in range(200)]
    write_table(lines(made), str(tmp_path / "t"))
    assert sorted(r.asDict()["row_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == sorted(
        r["row_id"] for r in made)
    columns = {}
    for file in (tmp_path / "t").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {c.path_in_schema: c for c in map(group.column, range(group.num_columns))}
        dictionaries = {name for name, c in columns.items() if c.has_dictionary_page}
        assert not dictionaries & {"row_id", "order_id", "customer_id", "product_id", "sales", "profit"}
        ranges = {name for name, c in columns.items() if c.statistics and c.statistics.has_min_max}
        assert {"sales", "profit", "quantity", "order_date", "ship_date"} <= ranges
        assert not ranges & {"row_id", "customer_name", "product_name", "segment"}
        assert {c.compression for c in columns.values()} == {"ZSTD"}
    assert columns
