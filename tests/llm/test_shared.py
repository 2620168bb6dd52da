import pyarrow as pa

from tidemark.llm import _shared


def test_slices_hold_all_rows_in_order():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 30, "d" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    cut = list(_shared.in_slices(iter([batch, batch.slice(0, 0)]), "text", 50))
    assert [b.num_rows for b in cut] == [2, 1, 2, 1]
    assert [x for b in cut for x in b.column(0).to_pylist()] == texts


def test_hash_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id", "id * 2 AS v")
    some = _shared.hash_sample(df, 100, "id")
    assert some.columns == ["id", "v"]
    first = {r.id for r in some.collect()}
    assert len(first) == 100 and first == {r.id for r in _shared.hash_sample(df.repartition(7), 100, "id").collect()}
    assert _shared.hash_sample(df.limit(30), 100, "id").count() == 30 and _shared.hash_sample(df.limit(0), 100, "id").count() == 0


def test_stored_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "x", [])], "a long, b string, c array<double>")
    back = _shared.stored(df, "test")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
