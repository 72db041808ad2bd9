"""Results of a linkage: tables, evidence tiers, reports and files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.sources.xlsx import write_workbook

#: The four tiers, what they are called in tables and in reports.
TIERS = (
    (1, "Tier 1", "High confidence — accepted"),
    (2, "Tier 2", "Accepted — flag for review"),
    (3, "Tier 3", "Borderline — manual review recommended"),
    (4, "Tier 4", "Not FDR-significant — rejected"),
)

#: Sheets of the tiered workbook.
TIER_SHEETS = ("tier1_accepted", "tier2_flag_review", "tier3_borderline", "tier4_rejected")

#: Medians of a tier and the places they are rounded to.
TIER_MEDIANS = (
    ("median_r", "_intensity_corr", 3),
    ("median_qvalue", "_perm_qvalue", 4),
    ("median_specificity", "_specificity", 3),
    ("median_ci_width", "_ci_width", 3),
    ("median_delta_mz_ppm", "_delta_mz_ppm", 3),
    ("median_delta_rt_s", "_delta_rt", 2),
)

#: Lines of the summary: label, aggregate, places.
SUMMARY_QUALITY = (
    ("Median Δm/z in ppm", "median_ppm", 3),
    ("Median |ΔRT| in s", "median_abs_rt", 2),
    ("Median intensity r", "median_r", 3),
    ("Mean confidence", "mean_confidence", 3),
)
SUMMARY_TESTS = (("Median specificity", "median_specificity", 3), ("Median CI width", "median_ci_width", 3))

#: An interval that spans everything, as a bootstrap that tells nothing gives it.
WHOLE_WIDTH = 2.0

_NEEDED = ("_perm_qvalue", "_fdr_significant", "_specificity", "_corr_ci_low", "_corr_ci_high", "_ci_width", "_intensity_corr", "_confidence")


def tier_of(ci_width: float = 0.4, specificity: float = 0.5) -> Column:
    """Evidence tier of a matched pair, 1 to 4; unknown values fall through to the later tiers."""
    width, gap = F.col("_ci_width"), F.col("_specificity")
    wide_positive = (width >= ci_width) & (width < WHOLE_WIDTH) & (F.col("_corr_ci_low") >= 0)
    failed_but_clear = (width == WHOLE_WIDTH) & (gap >= specificity)
    return (
        F.when(~F.coalesce(F.col("_fdr_significant"), F.lit(False)), 4)
        .when((width < ci_width) & (gap >= specificity), 1)
        .when(wide_positive | failed_but_clear, 2)
        .otherwise(3)
    )


def tier_summary(matched: DataFrame, ci_width: float = 0.4, specificity: float = 0.5) -> DataFrame:
    """One row for each of the four tiers: count, share in percent and medians, rounded half to even."""
    medians = [F.median(F.abs(F.col(c)) if c == "_delta_rt" else F.col(c)).alias(n) for n, c, _ in TIER_MEDIANS]
    found = {r["tier"]: r for r in matched.withColumn("tier", tier_of(ci_width, specificity)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), *medians).collect()}
    total = sum(r["n"] for r in found.values())
    rows = []
    for number, name, text in TIERS:
        r = found.get(number)
        values = [None if r is None or r[n] is None else round(r[n], places) for n, _, places in TIER_MEDIANS]
        n = r["n"] if r else 0
        rows.append((name, text, n, round(100 * n / total, 1) if n else 0.0, *values))
    kinds = ", ".join(f"{n} double" for n, _, _ in TIER_MEDIANS)
    return matched.sparkSession.createDataFrame(rows, f"tier string, description string, n bigint, pct double, {kinds}")


def _fixed(value: float | None, places: int) -> str:
    return "nan" if value is None or math.isnan(value) else f"{value:.{places}f}"


def _share(part: int, whole: int) -> str:
    return f"{100 * part / max(whole, 1):.1f}%"


def _listed(block: list[tuple]) -> list[str]:
    return [f"  {label:<26}: {value}" for label, value in block]


def _boxed(title: str, blocks: list[list[str]]) -> str:
    """Blocks of lines under a title, between rules as wide as the widest line."""
    rule = "=" * max(40, *(len(line) for block in blocks for line in block))
    lines = [rule, title, rule]
    for k, block in enumerate(blocks):
        lines += ([""] if k else []) + block
    return "\n".join([*lines, rule])


def _streamed(df: DataFrame) -> tuple[list[str], Iterator]:
    """A table's rows, fetched partition by partition."""
    return df.columns, df.toLocalIterator(prefetchPartitions=True)


@dataclass
class MatchResult:
    """Matched and unmatched rows of both tables, and counts.

    Without any match all tables have their columns all the same, and all reports are empty
    ones.
    """

    matched: DataFrame
    unique_a: DataFrame
    unique_b: DataFrame
    diagnostics: dict = field(default_factory=dict)

    def _require_statistics(self) -> None:
        missing = [c for c in _NEEDED if c not in self.matched.columns]
        if missing:
            raise ValueError(f"Statistical testing columns not found: {missing}")

    def summary_metrics(self) -> DataFrame:
        """One row of counts and medians, from one aggregate; NULL where nothing is known."""
        known = lambda c, kind: F.col(c).cast(kind) if c in self.matched.columns else F.lit(None).cast(kind)
        return self.matched.agg(
            F.count(F.lit(1)).alias("n_matched"),
            F.median("_delta_mz_ppm").alias("median_ppm"),
            F.median(F.abs("_delta_rt")).alias("median_abs_rt"),
            F.median("_intensity_corr").alias("median_r"),
            F.avg("_confidence").alias("mean_confidence"),
            F.count(known("_perm_qvalue", "double")).alias("n_tested"),
            F.count_if(known("_fdr_significant", "boolean")).alias("n_significant"),
            F.median(known("_specificity", "double")).alias("median_specificity"),
            F.median(known("_ci_width", "double")).alias("median_ci_width"),
            F.count_if(F.length(known("_stat_notes", "string")) > 0).alias("n_flagged"),
        )

    def _unmatched(self, side: str) -> int:
        known = self.diagnostics.get(f"n_unique_{side}")
        return (self.unique_a if side == "a" else self.unique_b).count() if known is None else known

    def summary(self) -> str:
        """Counts and medians as text."""
        r = self.summary_metrics().first()
        n = r["n_matched"]
        alone = {side.upper(): self._unmatched(side) for side in "ab"}
        blocks = [[(f"Table {side} features", n + k) for side, k in alone.items()] + [("Matched pairs", n)]]
        blocks[0] += [(f"Unique to {side}", f"{k} ({_share(k, n + k)})") for side, k in alone.items()]
        if n:
            blocks.append([(label, _fixed(r[c], places)) for label, c, places in SUMMARY_QUALITY])
        if r["n_tested"]:
            tests = [("FDR-significant", f"{r['n_significant']} of {n} ({_share(r['n_significant'], n)})")]
            tests += [(label, _fixed(r[c], places)) for label, c, places in SUMMARY_TESTS]
            if r["n_flagged"]:
                tests.append(("Flagged (see _stat_notes)", r["n_flagged"]))
            blocks.append(tests)
        return _boxed("Match summary", [*(_listed(block) for block in blocks)])

    def significant_matches(self, alpha: float = 0.05) -> DataFrame:
        """Matches whose q-value is below ``alpha``."""
        self._require_statistics()
        return self.matched.where(F.col("_perm_qvalue") < F.lit(alpha))

    def suspicious_matches(self) -> DataFrame:
        """Matches with notes."""
        if "_stat_notes" not in self.matched.columns:
            return self.matched.limit(0)
        return self.matched.where(F.length("_stat_notes") > 0)

    def triage(self, fdr_alpha: float = 0.05, ci_width_threshold: float = 0.4, specificity_threshold: float = 0.5) -> dict[str, DataFrame]:
        """``tier1`` to ``tier4`` and ``summary``.

        Significance is the one found with the tests' own level; ``fdr_alpha`` is shown in
        reports and changes nothing.
        """
        self._require_statistics()
        tier = tier_of(ci_width_threshold, specificity_threshold)
        out = {f"tier{k}": self.matched.where(tier == k) for k, _, _ in TIERS}
        return out | {"summary": tier_summary(self.matched, ci_width_threshold, specificity_threshold)}

    def triage_summary(self, fdr_alpha: float = 0.05, ci_width_threshold: float = 0.4, specificity_threshold: float = 0.5) -> str:
        """The tiers as a table of text, printed and returned."""
        self._require_statistics()
        rows = tier_summary(self.matched, ci_width_threshold, specificity_threshold).collect()
        settings = [
            ("Total matched pairs", sum(r["n"] for r in rows)),
            ("FDR alpha", fdr_alpha),
            ("CI width threshold", ci_width_threshold),
            ("Specificity threshold", specificity_threshold),
        ]
        heads = [("n", 7), ("%", 7), *((n.removeprefix("median_"), 20) for n, _, _ in TIER_MEDIANS)]
        table = [f"  {'tier':<8}" + "".join(f"{h:>{w}}" for h, w in heads)]
        for r in rows:
            cells = [str(r["n"]), _fixed(r["pct"], 1), *(_fixed(r[n], places) for n, _, places in TIER_MEDIANS)]
            table.append(f"  {r['tier']:<8}" + "".join(f"{c:>{w}}" for c, (_, w) in zip(cells, heads)))
        meaning = [f"  {name}: {text}" for _, name, text in TIERS]
        text = _boxed("Triage summary", [_listed(settings), table, meaning])
        print(text)
        return text

    def recovery(self) -> dict[str, float]:
        """Share in percent of each table's rows that are matched, and that are in tiers 1 and 2."""
        n = self.matched.count()
        supported = self.matched.where(tier_of().isin(1, 2)).count() if set(_NEEDED) <= set(self.matched.columns) else 0
        out = {}
        for side in "ab":
            total = max(n + self._unmatched(side), 1)
            out |= {f"matched_{side}": 100 * n / total, f"supported_{side}": 100 * supported / total}
        return out

    def to_excel(self, path: str) -> None:
        """One sheet for each table, streamed to the driver; a sheet holds about a million rows."""
        write_workbook(path, {"matched": _streamed(self.matched), "unique_A": _streamed(self.unique_a), "unique_B": _streamed(self.unique_b)})

    def to_excel_tiered(self, path: str, **triage_kwargs) -> None:
        """One sheet for each tier, the unmatched rows, and the summary."""
        t = self.triage(**triage_kwargs)
        sheets = {name: _streamed(t[f"tier{k}"]) for k, name in enumerate(TIER_SHEETS, 1)}
        sheets |= {"unique_A": _streamed(self.unique_a), "unique_B": _streamed(self.unique_b), "triage_summary": _streamed(t["summary"])}
        write_workbook(path, sheets)

    def write(self, directory: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
        """Write the tables side by side, in parallel; for results of any size."""
        for name in ("matched", "unique_a", "unique_b"):
            writer = getattr(self, name).write.mode(mode).format(fmt)
            (writer.option("header", True) if fmt == "csv" else writer).save(f"{directory}/{name}")
