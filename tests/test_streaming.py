"""Arriving features against a library."""

from massweave import ColumnMap, Tolerances
from massweave.streaming.arrivals import scored_arrivals, write_arrivals

KIND = "id bigint, mz double, rt double, a double, b double, c double"
MAP = ColumnMap("mz", "rt", ["a", "b", "c"])


def test_stream_gives_the_pairs_of_the_batch(spark, tmp_path):
    library = spark.createDataFrame([(k, 100.0 + k, 50.0 * k, 1.0 + k, 2.0, 3.0) for k in range(30)], KIND)
    rows = [(k, (100.0 + k) * (1 + 3e-6), 50.0 * k + 4, 1.1 + k, 2.1, 2.9) for k in range(0, 30, 2)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, KIND).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        write_arrivals(scored_arrivals(stream, library, MAP, MAP, "id", "id"), out, str(tmp_path / "state")).awaitTermination()
    got = sorted((r.idx_a, r.idx_b, round(r.confidence, 9)) for r in spark.read.parquet(out).collect())
    batch = scored_arrivals(spark.createDataFrame(rows, KIND), library, MAP, MAP, "id", "id")
    assert got == sorted((r.idx_a, r.idx_b, round(r.confidence, 9)) for r in batch.collect()) and len(got) > 5
    wide = Tolerances(mz_ppm=1, mz_da=1.0, rt_seconds=60)
    plain = spark.createDataFrame(rows, KIND)
    near = scored_arrivals(plain, library, MAP, MAP, "id", "id", wide).count()
    assert 0 < near <= sum(abs(a[1] - 100.0 - k) <= max(1.0, a[1] * 1e-6) and abs(a[2] - 50.0 * k) <= 60 for a in rows for k in range(30))
