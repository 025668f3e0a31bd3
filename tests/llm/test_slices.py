"""Workers take Arrow batches in slices of bounded size and leave no row out."""

import pyarrow as pa

from tallyglass.llm import common


def test_slices_keep_rows_in_order_and_are_small():
    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "text": ["x" * 1000] * 1000})
    empty = batch.slice(0, 0)
    parts = list(common.slices(iter([empty, batch, batch.slice(0, 1)]), 100_000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(1000), 0]
    assert max(p.nbytes for p in parts) <= 101_000 and len(parts) >= 11
    assert [p.num_rows for p in common.slices([batch.slice(0, 3)], 10)] == [1, 1, 1]          # a row is never cut


def test_map_rows_by_slices(spark):
    df = spark.range(500).selectExpr("id", "repeat('y', 40000) AS text").coalesce(1)
    made = common.map_rows(df, lambda id, text: {"id": id, "rows": [len(id)] * len(id)}, "id bigint, rows bigint").collect()          # noqa: A002
    assert sorted(r["id"] for r in made) == list(range(500)) and max(r["rows"] for r in made) < 200
