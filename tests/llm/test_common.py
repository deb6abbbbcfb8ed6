import pyarrow as pa

from korrel.llm.common import BATCH_BYTES, pieces, prepare


def test_batches_get_small_but_a_smaller_setting_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        for given, want in (("64m", f"{BATCH_BYTES}b"), ("2m", "2m"), ("1k", "1k")):
            spark.conf.set(key, given)
            prepare(spark)
            assert spark.conf.get(key).rstrip("b") in (want.rstrip("b"), str({"2m": 2 << 20, "1k": 1 << 10}.get(want)))
    finally:
        spark.conf.set(key, old)


def test_pieces_hold_all_rows_in_order():
    texts = ["x" * n for n in (5, 0, 50, 3, 3, 3, 200)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(pieces(batch, limit=10))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 10 for p in parts)
    assert list(pieces(batch.slice(0, 0))) == []
