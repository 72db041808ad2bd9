"""Roles of the columns of a feature table, read from their names."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of each role, in lower case, as patterns.
ROLE_NAMES = {
    "mz": ("mz", "m/z", "mass", "precursor.?mz", "precursor.?mass", "average.?mz", "monoisotopic.?mass", "exact.?mass", "mw"),
    "mz_min": ("mzmin", "mz.?min", "min.?mz", "precursor.?mz.?min"),
    "mz_max": ("mzmax", "mz.?max", "max.?mz", "precursor.?mz.?max"),
    "rt": ("rt", "retention.?time", "rt.?mean", "best.?retention.?time", "average.?rt", "apex.?rt", "peak.?rt", "med.?rt"),
    "rt_min": ("rtmin", "rt.?min", "min.?rt", "start.?rt"),
    "rt_max": ("rtmax", "rt.?max", "max.?rt", "end.?rt"),
    "annotation": (
        "isotopes", "adduct", "pcgroup", "charge", "formula", "annotation", "name", "compound", "id", "feature.?id", "flag", "ms2", "msms",
        "score", "fdr",
    ),
}

#: Prefixes of sample columns, in lower case.
INTENSITY_PREFIXES = ("area_", "height_", "intensity_", "peak_area_", "peakarea_")

_LABELS = {"mz": "m/z", "rt": "RT"}
_BOUNDS = ("mz_min", "mz_max", "rt_min", "rt_max")


def _pattern(role: str) -> re.Pattern:
    return re.compile("|".join(ROLE_NAMES[role]), re.S)


def has_role(column: str, role: str) -> bool:
    """Whether a column's name, without case and blanks around it, is one of the role's."""
    return _pattern(role).fullmatch(column.strip().lower()) is not None


@dataclass(frozen=True)
class ColumnMap:
    """Which column plays which role; annotations are carried along and never compared."""

    mz: str
    rt: str
    intensity_cols: list[str]
    mz_min: str | None = None
    mz_max: str | None = None
    rt_min: str | None = None
    rt_max: str | None = None
    annotation_cols: list[str] = field(default_factory=list)

    def all_known_cols(self) -> list[str]:
        """Every column that has a role."""
        bounds = [getattr(self, b) for b in _BOUNDS]
        return [self.mz, self.rt, *self.intensity_cols, *self.annotation_cols, *(b for b in bounds if b is not None)]

    def validate_against(self, df: DataFrame) -> None:
        """Raise ``ValueError`` if a mapped column is missing; names are compared with case."""
        missing = [c for c in self.all_known_cols() if c not in df.columns]
        if missing:
            raise ValueError(f"mapped columns not found in DataFrame: {missing}; it has {df.columns}")

    def summary(self) -> str:
        """One line for each role."""
        names = ("mz", "rt", *_BOUNDS, "intensity_cols", "annotation_cols")
        return "\n".join(f"  {n:<15}: {getattr(self, n)}" for n in names)


def column(df: DataFrame, name: str):
    """A column by its exact name, whatever signs it holds; the frame's position decides."""
    return df[f"`{name.replace('`', '``')}`"]


def _positional(df: DataFrame) -> DataFrame:
    """The frame with columns ``c0``, ``c1``, ... so that no name needs quoting or is ambiguous."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def column_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column_name, n, lowest, highest)`` of numeric columns, NaN left out, from one aggregate."""
    slim = _positional(df)
    rows = []
    for name in names:
        value = F.col(f"c{df.columns.index(name)}").cast("double")
        value = F.when(~F.isnan(value), value)
        rows.append(F.struct(F.lit(name).alias("column_name"), F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest")))
    return slim.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def sample_columns(df: DataFrame, exclude: set[str]) -> list[str]:
    """Numeric columns that hold intensities.

    Empty columns and columns of nothing but zeros (at least two of them) are left out.  If
    any column that remains has a known prefix, only those with a prefix count.
    """
    kinds = (T.NumericType, T.BooleanType)
    numeric = [f.name for f in df.schema.fields if f.name not in exclude and isinstance(f.dataType, kinds)]
    if not numeric:
        return []
    kept = [r["column_name"] for r in column_stats(df, numeric).collect() if r["n"] and not (r["n"] >= 2 and r["lowest"] == 0 == r["highest"])]
    prefixed = [n for n in kept if n.lower().startswith(INTENSITY_PREFIXES)]
    return prefixed or kept


def infer_column_map(
    df: DataFrame,
    intensity_cols: list[str] | None = None,
    mz_col: str | None = None,
    rt_col: str | None = None,
    mz_min_col: str | None = None,
    mz_max_col: str | None = None,
    rt_min_col: str | None = None,
    rt_max_col: str | None = None,
) -> ColumnMap:
    """Roles from names, where no override is given.

    Of several columns that fit a role the first counts, with a warning.  Missing m/z, RT or
    samples, and overrides that name no column, raise ``ValueError``.
    """
    given = {"mz": mz_col, "rt": rt_col, "mz_min": mz_min_col, "mz_max": mz_max_col, "rt_min": rt_min_col, "rt_max": rt_max_col}
    picked: dict[str, str | None] = {}
    for role, override in given.items():
        if override is not None:
            if override not in df.columns:
                raise ValueError(f"the {role} column {override!r} is not in the DataFrame")
            picked[role] = override
            continue
        fits = [c for c in df.columns if has_role(c, role)]
        if len(fits) > 1:
            warnings.warn(f"columns {fits} all fit the role {role}; {fits[0]!r} is used", stacklevel=2)
        picked[role] = fits[0] if fits else None
        if picked[role] is None and role in _LABELS:
            raise ValueError(f"no {_LABELS[role]} column was found; name it with {role}_col")
    annotations = [c for c in df.columns if has_role(c, "annotation")]
    if intensity_cols is None:
        samples = sample_columns(df, {c for c in picked.values() if c} | set(annotations))
    else:
        samples = list(intensity_cols)
        missing = [c for c in samples if c not in df.columns]
        if missing:
            raise ValueError(f"intensity_cols not found in DataFrame: {missing}")
    if not samples:
        raise ValueError("no intensity columns were found; name them with intensity_cols")
    return ColumnMap(intensity_cols=samples, annotation_cols=annotations, **picked)


def shared_samples(map_a: ColumnMap, map_b: ColumnMap) -> list[str]:
    """Sample columns both tables have by exactly the same name, in the first one's order."""
    other = set(map_b.intensity_cols)
    return [c for c in map_a.intensity_cols if c in other]
