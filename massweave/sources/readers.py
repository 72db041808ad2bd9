"""Readers for feature tables: Parquet and delimited text."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_VECTORISED = "spark.sql.parquet.enableVectorizedReader"

#: Encodings that Spark's vectorised reader cannot decode.
_ROW_READER_ONLY = ("BYTE_STREAM_SPLIT",)

#: Footers looked at side by side.
_FOOTERS_AT_ONCE = 16


def _parquet_files(spark: SparkSession, path: str) -> list:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(conf).listFiles(at, True)
    files = []
    while found.hasNext():
        file = found.next().getPath()
        if file.toString() == at.toString() or file.getName().endswith(".parquet"):
            files.append(file)
    return files


def needs_row_reader(spark: SparkSession, path: str) -> bool:
    """Whether any column chunk of any Parquet file under ``path`` is in an encoding of the row-based reader only.

    Footers alone are read, side by side, until one answers yes.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def one(file) -> bool:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
        try:
            chunks = [c for block in reader.getFooter().getBlocks() for c in block.getColumns()]
            return any(e in c.getEncodings().toString() for c in chunks for e in _ROW_READER_ONLY)
        finally:
            reader.close()

    files = _parquet_files(spark, path)
    if not files:
        return False
    if one(files[0]):
        return True
    with ThreadPoolExecutor(_FOOTERS_AT_ONCE) as pool:
        return any(pool.map(one, files[1:]))


def read_parquet(spark: SparkSession, path: str, row_reader: bool | None = None) -> DataFrame:
    """Read Parquet, also in encodings that only the row-based reader knows.

    Which reader a scan uses is a setting of the session that its relation was made in.  A
    table that needs the row-based one is opened in a session of its own, with the settings
    of ``spark`` but for this one, and handed over as a view; so neither the setting of
    ``spark`` nor any other table's reader changes.  ``row_reader`` spares the look at the
    footers where the answer is known.
    """
    if spark.conf.get(_VECTORISED) != "true" or not (needs_row_reader(spark, path) if row_reader is None else row_reader):
        return spark.read.parquet(path)
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_VECTORISED, "false")
    view = f"massweave_{uuid.uuid4().hex}"
    own.read.parquet(path).createGlobalTempView(view)
    try:
        return spark.table(f"global_temp.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", drop_index_column: bool = False, schema: str | None = None
) -> DataFrame:
    """Read a CSV or TSV feature table with a header line.

    ``drop_index_column`` removes a first column without a name, which a data frame's index
    leaves behind and which would pass for a sample.  Without ``schema`` the types are
    inferred, which reads the file twice.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if drop_index_column and df.columns and df.columns[0] in ("_c0", ""):
        df = df.drop(df.columns[0])
    return df
