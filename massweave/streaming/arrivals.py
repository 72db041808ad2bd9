"""Candidate pairs of features that arrive in a stream, against a fixed library table.

Scoring a pair needs nothing but the pair, so it runs on a stream as it is.  The assignment
and the false-discovery control look at all pairs together; they stay batch steps over what
the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from massweave.config import Tolerances
from massweave.operators import band_join, ingest, scoring
from massweave.operators.roles import ColumnMap, shared_samples


def scored_arrivals(
    arrivals: DataFrame, library: DataFrame, map_arrivals: ColumnMap, map_library: ColumnMap, id_arrivals: str, id_library: str, tol: Tolerances | None = None
) -> DataFrame:
    """``(idx_a, idx_b, delta_mz_ppm, delta_rt, intensity_corr, confidence)`` of a stream's rows.

    Both tables need a unique id column: a row's position means nothing in a stream.
    """
    tol = tol or Tolerances()
    samples = shared_samples(map_arrivals, map_library)
    keyed = lambda df, key: df.withColumn("_idx", F.col(f"`{key}`").cast("long"))
    a = ingest.slim(keyed(arrivals, id_arrivals), map_arrivals, samples)
    b = ingest.slim(keyed(library, id_library), map_library, samples)
    pairs = band_join.candidate_pairs(a, b, tol, ("x",), ("x",))
    return scoring.correlation_filter(scoring.scored(pairs, tol), tol, len(samples))


def write_arrivals(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored pairs to Parquet files, each arrival exactly once; ends when all present files are read."""
    return (
        scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
