"""Readers and the query catalogue."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from massweave.sources.readers import needs_row_reader, read_delimited, read_parquet

SMALL = "/root/testdata/sf0.001"


def test_encoding_of_the_row_reader_only(spark, tmp_path):
    plain, mixed = str(tmp_path / "plain.parquet"), str(tmp_path / "mixed")
    pq.write_table(pa.table({"y": [1.5, 2.5]}), plain)
    (tmp_path / "mixed").mkdir()
    pq.write_table(pa.table({"x": [0.5]}), f"{mixed}/a.parquet")
    # Neither the first file nor the first row group shows the encoding.
    writer = pq.ParquetWriter(f"{mixed}/b.parquet", pa.schema({"x": pa.float64()}), use_dictionary=False, column_encoding={"x": "BYTE_STREAM_SPLIT"})
    writer.write_table(pa.table({"x": [1.5, None]}))
    writer.write_table(pa.table({"x": [3.5]}))
    writer.close()
    assert needs_row_reader(spark, mixed) and not needs_row_reader(spark, plain)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        before, encoded = read_parquet(spark, plain), read_parquet(spark, mixed)
        assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"
        assert sorted(r.x for r in encoded.where("x > 0").collect()) == [0.5, 1.5, 3.5]
        assert encoded.join(before, encoded.x == before.y).count() == 1
        assert "Batched: true" in before._jdf.queryExecution().explainString(before._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert not spark.catalog.listTables("global_temp")


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("\tmz\trt\n0\t1.5\t2\n1\t2.5\t3\n")
    df = read_delimited(spark, str(tmp_path / "t.tsv"), "\t", drop_index_column=True)
    assert df.columns == ["mz", "rt"] and df.count() == 2
    assert read_delimited(spark, str(tmp_path / "t.tsv"), "\t").columns == ["_c0", "mz", "rt"]


@pytest.mark.parametrize(
    "name",
    ["p2_found", "p3_found", "candidate_pairs", "candidate_pairs_mz_da", "star_matches", "component_labels", "bipartite_crowded", "specificity", "drift_bounds",
     "spearman_tests_small", "align_matched", "align_crowded", "align_two_samples", "unique_b", "summary_lines", "column_roles", "csv_source"],
)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "peak_segments", "features_a"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    value = lambda v: "" if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    key = lambda df: sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
