"""SQL with the same results as the queries of the linkage.

The chain of common table expressions follows the definitions, not the operators: the band join
is its plain condition, the assignment is solved exactly by going through the rows of a
connected component one by one and keeping the heaviest choice for each set of partners that
later rows can still want.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from massweave.config import StatTestParams, Tolerances
from massweave.operators import results, significance

SAMPLES = [f"s{k}" for k in range(6)]

#: Shuffles and resamples of six samples, small enough to be written out in SQL.
SHUFFLES = [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 0], [5, 4, 3, 2, 1, 0], [2, 0, 1, 5, 3, 4], [3, 5, 0, 1, 2, 4], [4, 3, 5, 2, 0, 1], [1, 0, 3, 2, 5, 4]]
RESAMPLES = [[0, 0, 1, 2, 3, 5], [5, 4, 4, 2, 1, 0], [3, 3, 3, 1, 0, 5], [2, 1, 0, 0, 4, 4], [0, 1, 2, 3, 4, 5], [5, 5, 2, 2, 1, 3], [1, 3, 4, 4, 5, 0]]


@dataclass(frozen=True)
class Case:
    """A pair of tables and the settings it is linked with."""

    kind: str
    tol: Tolerances = Tolerances()
    drift: bool = False
    samples: int = 6


PLAIN = Case("plain")
RAW = Case("raw")
CROWDED = Case("crowded", Tolerances(min_intensity_corr=0.3))
TWO_SAMPLES = replace(CROWDED, samples=2)


def tables(case: Case) -> str:
    """``fa`` and ``fb``; with drift ``fa`` is moved after a fit over all candidate pairs."""
    crowded, raw = case.kind == "crowded", case.kind == "raw"
    mz = "200 + CAST(p_partkey * 37 % 89 AS DOUBLE) * 0.5 + CAST(p_partkey // 2000 AS DOUBLE) * 50" if crowded else "p_retailprice"
    s5 = "CASE WHEN p_partkey % 50 = 5 THEN s5 * 1e-5 ELSE s5 END AS s5" if raw else "s5"
    bounds = ", rt - CAST(4 + id % 3 AS DOUBLE) AS rtmin, rt + CAST(5 + id % 4 AS DOUBLE) AS rtmax" if crowded else ""
    text = f"""WITH RECURSIVE l AS (
      SELECT l_partkey AS k, l_suppkey % 6 AS s, ROUND(SUM(l_extendedprice), 2) AS v FROM lineitem GROUP BY l_partkey, l_suppkey % 6),
    w AS (SELECT k, {", ".join(f"MAX(v) FILTER (WHERE s = {k}) AS s{k}" for k in range(6))} FROM l GROUP BY k),
    x AS (SELECT p_partkey AS id, {mz} AS mz, CAST(p_size AS DOUBLE) * 20 AS rt, s0, s1, s2, s3, s4, {s5} FROM part JOIN w ON p_partkey = k),
    fa0 AS (SELECT *{bounds} FROM x WHERE id % 10 <> 1),
    fb0 AS (SELECT id, mz * (1 + CAST(id % 7 - 3 AS DOUBLE) * 1e-6) AS mz, rt + CAST(id % 5 - 2 AS DOUBLE) * 3 AS rt,
      {", ".join(f"s{k} * (1 + CAST((id * 31 + {k}) % 11 - 5 AS DOUBLE) / 100) AS s{k}" for k in range(6))} FROM x WHERE id % 10 <> 0),
    fb AS (SELECT *{bounds} FROM fb0)"""
    if not case.drift:
        return f"{text}, fa AS (SELECT * FROM fa0)"
    moved = ["rt"] + (["rtmin", "rtmax"] if crowded else [])
    shift = ", ".join(f"{c} + (i0 + i1 * {c} + i2 * {c} * {c}) AS {c}" for c in moved)
    return f"""{text}, y AS (SELECT a.rt AS x, a.rt * a.rt AS xx, b.rt - a.rt AS y FROM {_joined("fa0", case.tol)}), {_RIDGE},
    fa AS (SELECT * REPLACE ({shift}) FROM fa0, fit)"""


_RIDGE = """mean AS (SELECT AVG(x) AS mx, AVG(xx) AS mxx, AVG(y) AS my FROM y),
    s AS (SELECT SUM((x - mx) * (x - mx)) + 1 AS uu, SUM((x - mx) * (xx - mxx)) AS uv, SUM((xx - mxx) * (xx - mxx)) + 1 AS vv,
      SUM((x - mx) * (y - my)) AS ut, SUM((xx - mxx) * (y - my)) AS vt FROM y, mean),
    slopes AS (SELECT (ut * vv - vt * uv) / (uu * vv - uv * uv) AS i1, (vt * uu - ut * uv) / (uu * vv - uv * uv) AS i2 FROM s),
    fit AS (SELECT my - i1 * mx - i2 * mxx AS i0, i1, i2 FROM slopes, mean)"""


def _joined(left: str, tol: Tolerances) -> str:
    window = f"a.mz * {tol.mz_ppm} / 1e6" if tol.mz_da is None else f"GREATEST(a.mz * {tol.mz_ppm} / 1e6, {tol.mz_da})"
    return f"{left} a JOIN fb b ON ABS(b.mz - a.mz) <= {window} AND ABS(b.rt - a.rt) <= {tol.rt_seconds}"


def pairs(case: Case) -> str:
    """``c``: the candidate pairs."""
    return f"{tables(case)}, c AS (SELECT a.id AS idx_a, b.id AS idx_b FROM {_joined('fa', case.tol)})"


def correlated(case: Case) -> str:
    """``v``: the values of the pairs; ``p``: their correlation where there is one."""
    long = " UNION ALL ".join(f"SELECT c.idx_a, c.idx_b, {k} AS k, fa.s{k} AS va, fb.s{k} AS vb FROM c JOIN fa ON fa.id = idx_a JOIN fb ON fb.id = idx_b" for k in range(case.samples))
    return f"""{pairs(case)}, v AS ({long}),
    ok AS (SELECT * FROM v WHERE va > 0 AND vb > 0),
    usable AS (SELECT idx_a, idx_b FROM ok GROUP BY idx_a, idx_b HAVING COUNT(*) >= 3 AND MIN(va) < MAX(va) AND MIN(vb) < MAX(vb)),
    p AS (SELECT idx_a, idx_b, GREATEST(-1, LEAST(1, CORR(va, vb))) AS r FROM ok SEMI JOIN usable USING (idx_a, idx_b) GROUP BY idx_a, idx_b)"""


def scored(case: Case) -> str:
    """``scored``: the pairs with confidence; ``e``: those that pass the filter."""
    keep = f" WHERE intensity_corr IS NULL OR intensity_corr >= {case.tol.min_intensity_corr}" if case.samples >= 3 else ""
    return f"""{correlated(case)},
    m AS (SELECT c.idx_a, c.idx_b, ABS(fa.mz - fb.mz) / ((fa.mz + fb.mz) / 2) * 1e6 AS delta_mz_ppm, fb.rt - fa.rt AS delta_rt, p.r AS intensity_corr
      FROM c JOIN fa ON fa.id = c.idx_a JOIN fb ON fb.id = c.idx_b LEFT JOIN p ON p.idx_a = c.idx_a AND p.idx_b = c.idx_b),
    g AS (SELECT *, EXP(-0.5 * POW(delta_mz_ppm / 5, 2)) AS gm, EXP(-0.5 * POW(delta_rt / 15, 2)) AS gr FROM m),
    scored AS (SELECT idx_a, idx_b, delta_mz_ppm, delta_rt, intensity_corr,
      GREATEST(0, LEAST(1, CASE WHEN intensity_corr IS NULL THEN 0.525 * gm + 0.475 * gr ELSE 0.35 * gm + 0.30 * gr + 0.35 * (intensity_corr + 1) / 2 END)) AS confidence FROM g),
    e AS MATERIALIZED (SELECT * FROM scored{keep})"""


def graded(case: Case) -> str:
    """``iso``, ``star`` and ``hard``: pairs by what their rows have besides."""
    return f"""{scored(case)},
    d0 AS (SELECT *, COUNT(*) OVER (PARTITION BY idx_a) AS da, COUNT(*) OVER (PARTITION BY idx_b) AS db FROM e),
    d AS (SELECT *, MAX(db) OVER (PARTITION BY idx_a) AS fb_, MAX(da) OVER (PARTITION BY idx_b) AS fa_ FROM d0),
    iso AS (SELECT idx_a, idx_b FROM d WHERE da = 1 AND db = 1),
    star AS (SELECT idx_a, idx_b FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY CASE WHEN da > 1 THEN 'a' ELSE 'b' END, CASE WHEN da > 1 THEN idx_a ELSE idx_b END ORDER BY confidence DESC, idx_a, idx_b) AS k
      FROM d WHERE (da > 1 AND fb_ = 1) OR (db > 1 AND fa_ = 1)) WHERE k = 1),
    hard AS MATERIALIZED (SELECT idx_a, idx_b, GREATEST(confidence, 1e-12) AS w FROM d
      WHERE NOT (da = 1 AND db = 1) AND NOT ((da > 1 AND fb_ = 1) OR (db > 1 AND fa_ = 1)))"""


def grouped(case: Case) -> str:
    """``comp``: the connected component of every row of A with contested pairs."""
    return f"""{graded(case)},
    near AS MATERIALIZED (SELECT DISTINCT h1.idx_a AS y, h2.idx_a AS z FROM hard h1 JOIN hard h2 ON h2.idx_b = h1.idx_b),
    reach(x, y) AS (SELECT DISTINCT idx_a, idx_a FROM hard UNION SELECT reach.x, near.z FROM reach JOIN near ON near.y = reach.y),
    comp AS MATERIALIZED (SELECT x AS idx_a, MIN(y) AS comp FROM reach GROUP BY x)"""


def assigned(case: Case) -> str:
    """``chosen``: the pairs of the assignment of greatest total confidence, with their metrics."""
    return f"""{grouped(case)},
    num AS MATERIALIZED (SELECT idx_a, comp, ROW_NUMBER() OVER (PARTITION BY comp ORDER BY idx_a) AS k FROM comp),
    last AS (SELECT idx_b, MAX(k) AS last_k FROM hard JOIN num USING (idx_a) GROUP BY idx_b),
    opt AS MATERIALIZED (
      SELECT comp, k, [{{'b': idx_b, 'l': last_k}}] AS b, [{{'a': idx_a, 'b': idx_b}}] AS pair, w FROM hard JOIN num USING (idx_a) JOIN last USING (idx_b)
      UNION ALL SELECT comp, k, [], [], 0.0 FROM num),
    dp(comp, k, used, total, path) AS (
      SELECT DISTINCT comp, 0::BIGINT, []::STRUCT(b BIGINT, l BIGINT)[], 0.0::DOUBLE, []::STRUCT(a BIGINT, b BIGINT)[] FROM num
      UNION ALL
      SELECT comp, k, used, MAX(total), ARG_MAX(path, total) FROM (
        SELECT o.comp, o.k, LIST_SORT(LIST_FILTER(LIST_CONCAT(d.used, o.b), lambda x: x.l > o.k)) AS used, d.total + o.w AS total, LIST_CONCAT(d.path, o.pair) AS path
        FROM dp d JOIN opt o ON o.comp = d.comp AND o.k = d.k + 1
        WHERE LEN(o.b) = 0 OR NOT LIST_CONTAINS(d.used, o.b[1])) GROUP BY comp, k, used),
    solved AS (SELECT UNNEST(path, recursive := true) FROM (SELECT ARG_MAX(path, k) AS path FROM dp GROUP BY comp)),
    best AS (SELECT * FROM iso UNION ALL SELECT * FROM star UNION ALL SELECT a, b FROM solved),
    chosen AS MATERIALIZED (SELECT e.* FROM e JOIN best USING (idx_a, idx_b)),
    rival AS (SELECT idx_a, idx_b, MAX(best) AS best FROM (
      SELECT c.idx_a, c.idx_b, e.confidence AS best FROM chosen c JOIN e ON e.idx_a = c.idx_a AND e.idx_b <> c.idx_b
      UNION ALL SELECT c.idx_a, c.idx_b, e.confidence FROM chosen c JOIN e ON e.idx_b = c.idx_b AND e.idx_a <> c.idx_a) GROUP BY idx_a, idx_b),
    gap AS (SELECT c.idx_a, c.idx_b, GREATEST(0, LEAST(1, c.confidence - COALESCE(best, 0))) AS _specificity
      FROM chosen c LEFT JOIN rival r ON r.idx_a = c.idx_a AND r.idx_b = c.idx_b)"""


def _positions(rows) -> str:
    """Index rows as ``i(t, k, j)``."""
    lists = ", ".join("[" + ",".join(str(int(j)) for j in row) + "]" for row in rows)
    return f"""(SELECT t, GENERATE_SUBSCRIPTS(r, 1) - 1 AS k, UNNEST(r) AS j FROM (SELECT GENERATE_SUBSCRIPTS(q, 1) AS t, UNNEST(q) AS r FROM (SELECT [{lists}] AS q)))"""


def tested(case: Case, params: StatTestParams | None, positions: tuple | None = None) -> str:
    """``tests``: p-values and intervals of the chosen pairs; ``stats``: all columns of evidence."""
    params = params or StatTestParams()
    shuffles, resamples = positions or significance.index_matrices(case.samples, params)
    rank = lambda c, keys: f"RANK() OVER (PARTITION BY {keys} ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
    pair, draw = "idx_a, idx_b", "idx_a, idx_b, t"
    spearman = params.corr_method == "spearman"
    shown = f"SELECT idx_a, idx_b, k, n, {rank('va', pair)} AS va, {rank('vb', pair)} AS vb FROM full_" if spearman else "SELECT * FROM full_"
    drawn = f"SELECT idx_a, idx_b, t, {rank('va', draw)} AS va, {rank('vb', draw)} AS vb FROM drawn" if spearman else "SELECT * FROM drawn"
    raw = "(SELECT MAX(x) / MIN(x) >= 1e4 FROM (SELECT va AS x FROM pos UNION ALL SELECT vb FROM pos))" if positions is None else "FALSE"
    return f"""{assigned(case)},
    pos AS MATERIALIZED (SELECT idx_a, idx_b, k, CASE WHEN va > 0 THEN va END AS va, CASE WHEN vb > 0 THEN vb END AS vb FROM v SEMI JOIN chosen USING (idx_a, idx_b)),
    raw_ AS MATERIALIZED (SELECT {raw} AS raw),
    lg AS (SELECT idx_a, idx_b, k, CASE WHEN raw THEN LN(1 + va) ELSE va END AS va, CASE WHEN raw THEN LN(1 + vb) ELSE vb END AS vb FROM pos, raw_),
    full_ AS MATERIALIZED (SELECT idx_a, idx_b, k, COALESCE(va, AVG(va) OVER w, 0) AS va, COALESCE(vb, AVG(vb) OVER w, 0) AS vb,
      COUNT(*) FILTER (WHERE va IS NOT NULL AND vb IS NOT NULL) OVER w AS n FROM lg WINDOW w AS (PARTITION BY idx_a, idx_b)),
    shown AS MATERIALIZED ({shown}),
    o AS (SELECT idx_a, idx_b, CORR(va, vb) AS r FROM shown WHERE n >= 3 GROUP BY idx_a, idx_b HAVING MIN(va) < MAX(va) AND MIN(vb) < MAX(vb)),
    t AS (SELECT f.idx_a, f.idx_b, i.t, CORR(f.va, h.vb) AS r FROM shown f JOIN {_positions(shuffles)} i ON i.k = f.k
      JOIN shown h ON h.idx_a = f.idx_a AND h.idx_b = f.idx_b AND h.k = i.j SEMI JOIN o ON o.idx_a = f.idx_a AND o.idx_b = f.idx_b GROUP BY f.idx_a, f.idx_b, i.t),
    reached AS (SELECT t.idx_a, t.idx_b, COUNT(*) FILTER (WHERE t.r >= o.r - 1e-12) AS n FROM t JOIN o ON o.idx_a = t.idx_a AND o.idx_b = t.idx_b GROUP BY t.idx_a, t.idx_b),
    drawn AS (SELECT f.idx_a, f.idx_b, i.t, f.va, f.vb FROM {_positions(resamples)} i JOIN full_ f ON f.k = i.j WHERE f.n >= 3),
    br AS (SELECT idx_a, idx_b, t, GREATEST(-1, LEAST(1, CORR(va, vb))) AS r FROM ({drawn}) GROUP BY idx_a, idx_b, t HAVING MIN(va) < MAX(va) AND MIN(vb) < MAX(vb)),
    ci AS (SELECT idx_a, idx_b, QUANTILE_CONT(r, 0.025) AS lo, QUANTILE_CONT(r, 0.975) AS hi FROM br GROUP BY idx_a, idx_b),
    valid AS (SELECT idx_a, idx_b, n >= 3 AS valid FROM full_ WHERE k = 0),
    tests AS MATERIALIZED (SELECT c.idx_a, c.idx_b, valid, CASE WHEN valid THEN GREATEST(COALESCE(r.n, 0), 1) / {len(shuffles)}.0 END AS _perm_pvalue, lo AS _corr_ci_low, hi AS _corr_ci_high
      FROM chosen c JOIN valid USING (idx_a, idx_b) LEFT JOIN reached r USING (idx_a, idx_b) LEFT JOIN ci USING (idx_a, idx_b)),
    ranked AS (SELECT *, RANK() OVER (ORDER BY _perm_pvalue) + COUNT(*) OVER (PARTITION BY _perm_pvalue) - 1 AS k, COUNT(*) OVER () AS m FROM tests WHERE _perm_pvalue IS NOT NULL),
    bh AS (SELECT idx_a, idx_b, LEAST(1, MIN(_perm_pvalue * m / k) OVER (ORDER BY _perm_pvalue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM ranked),
    measures AS (SELECT x.*, q AS _perm_qvalue, COALESCE(q < {params.fdr_alpha}, FALSE) AS _fdr_significant, _specificity, _corr_ci_high - _corr_ci_low AS _ci_width
      FROM tests x JOIN gap USING (idx_a, idx_b) LEFT JOIN bh USING (idx_a, idx_b)),
    stats AS MATERIALIZED (SELECT *, CONCAT_WS('|', CASE WHEN raw THEN 'internal_log1p_applied' END, CASE WHEN _ci_width > 0.4 THEN 'wide_ci' END,
      CASE WHEN _specificity < 0.1 THEN 'low_specificity' END, CASE WHEN NOT valid THEN 'insufficient_valid_samples' END) AS _stat_notes FROM measures, raw_)"""


_STATS = ("_perm_pvalue", "_perm_qvalue", "_fdr_significant", "_specificity", "_corr_ci_low", "_corr_ci_high", "_ci_width", "_stat_notes")
_TEXT = ("_fdr_significant", "_stat_notes")


def wide(case: Case, stats: dict[str, str] | None = None) -> str:
    """The final SELECT of matched rows; ``stats`` replaces the columns of evidence."""
    bounds = ["rtmin", "rtmax"] if case.kind == "crowded" else []
    columns = ["id", "mz", "rt", *SAMPLES, *bounds]
    of = lambda t, label: [f"ROUND({t}.{c}, {9 if (c, label) == ('mz', 'B') else 6}) AS {c}_{label}" if c != "id" else f"{t}.id AS id_{label}" for c in columns]
    metrics = [f"ROUND(c.{c}, 6) AS _{c}" for c in ("confidence", "delta_mz_ppm", "delta_rt", "intensity_corr")]
    if stats is None:
        stats, source = {n: f"s.{n}" if n in _TEXT else f"ROUND(s.{n}, 6)" for n in _STATS}, "JOIN stats s USING (idx_a, idx_b)"
    else:
        source = "JOIN gap s USING (idx_a, idx_b)"
    evidence = [f"{stats[n]} AS {n}" for n in _STATS]
    return f"""SELECT {", ".join([*of("fa", "A"), *of("fb", "B"), *metrics, *evidence])} FROM chosen c {source}
      JOIN fa ON fa.id = c.idx_a JOIN fb ON fb.id = c.idx_b"""


_NOTHING = {n: "CAST(NULL AS DOUBLE)" for n in _STATS}
_UNTESTED = _NOTHING | {"_fdr_significant": "FALSE", "_stat_notes": "''"}
_FEW_SAMPLES = _UNTESTED | {"_specificity": "ROUND(s._specificity, 6)", "_stat_notes": "'no_shared_samples'"}

_EVIDENCE = """WITH ev AS (SELECT p_partkey, ROUND(p_partkey * 13 % 1000 / 1000.0, 6) AS _intensity_corr, ROUND(p_partkey * 7 % 1000 / 1000.0, 6) AS _confidence,
  ROUND(p_partkey * 3 % 100 / 10.0, 6) AS _delta_mz_ppm, ROUND((p_partkey * 29 % 600 - 300) / 10.0, 6) AS _delta_rt,
  CASE WHEN p_partkey % 19 <> 0 THEN p_partkey * 37 % 80 / 1000::DOUBLE END AS _perm_qvalue,
  COALESCE(CASE WHEN p_partkey % 19 <> 0 THEN p_partkey * 37 % 80 / 1000::DOUBLE END < 0.05, FALSE) AS _fdr_significant,
  ROUND(p_partkey * 11 % 100 / 100.0, 6) AS _specificity, (p_partkey * 31 % 200 - 60) / 100::DOUBLE AS _corr_ci_low,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 2.0::DOUBLE ELSE p_partkey * 17 % 90 / 100::DOUBLE END AS _ci_width,
  p_partkey % 23 <> 0 AS valid FROM part),
tiered AS (SELECT *, CASE WHEN NOT _fdr_significant THEN 4 WHEN _ci_width < 0.4 AND _specificity >= 0.5 THEN 1
  WHEN (_ci_width >= 0.4 AND _ci_width < 2 AND _corr_ci_low >= 0) OR (_ci_width = 2 AND _specificity >= 0.5) THEN 2 ELSE 3 END AS tier FROM ev),
noted AS (SELECT *, CONCAT_WS('|', CASE WHEN _ci_width > 0.4 THEN 'wide_ci' END, CASE WHEN _specificity < 0.1 THEN 'low_specificity' END,
  CASE WHEN NOT valid THEN 'insufficient_valid_samples' END) AS _stat_notes FROM ev)"""


_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS n, MIN({c}) AS lowest, MAX({c}) AS highest FROM fa" for c in ("mz", "rt", *SAMPLES))

_MEDIANS = ", ".join(
    f"ROUND_EVEN(MEDIAN({'ABS(' + c + ')' if c == '_delta_rt' else c}), {places}) AS {n}" for n, c, places in results.TIER_MEDIANS
)


_TIERS = f"""tier_names(k, tier_name, description) AS (VALUES {", ".join(f"({k}, '{n}', '{d}')" for k, n, d in results.TIERS)}),
      by_tier AS (SELECT tier, COUNT(*) AS n, {_MEDIANS} FROM tiered GROUP BY tier)
      SELECT tier_name AS tier, description, COALESCE(n, 0) AS n, COALESCE(ROUND_EVEN(100.0 * n / SUM(n) OVER (), 1), 0) AS pct,
        {", ".join(n for n, _, _ in results.TIER_MEDIANS)} FROM tier_names LEFT JOIN by_tier ON by_tier.tier = tier_names.k"""

_TIER = """CASE WHEN NOT _fdr_significant THEN 4 WHEN _ci_width < 0.4 AND _specificity >= 0.5 THEN 1
  WHEN (_ci_width >= 0.4 AND _ci_width < 2 AND _corr_ci_low >= 0) OR (_ci_width = 2 AND _specificity >= 0.5) THEN 2 ELSE 3 END AS tier"""

_SMALL = (SHUFFLES, RESAMPLES)
_SPEARMAN = StatTestParams(corr_method="spearman", n_permutations=200, n_bootstrap=100)
_DRIFTED = replace(CROWDED, drift=True)
_DEFAULT = replace(PLAIN, drift=True)

_MET = f"""{tested(CROWDED, None)},
    mm AS (SELECT c.confidence AS _confidence, c.delta_mz_ppm AS _delta_mz_ppm, c.delta_rt AS _delta_rt, c.intensity_corr AS _intensity_corr, s.* FROM chosen c JOIN stats s USING (idx_a, idx_b)),
    tiered AS (SELECT *, {_TIER} FROM mm),
    totals AS (SELECT (SELECT COUNT(*) FROM fa) AS na, (SELECT COUNT(*) FROM fb) AS nb, (SELECT COUNT(*) FROM chosen) AS n),
    summed AS (SELECT COUNT(*) AS n_matched, MEDIAN(_delta_mz_ppm) AS median_ppm, MEDIAN(ABS(_delta_rt)) AS median_abs_rt, MEDIAN(_intensity_corr) AS median_r, AVG(_confidence) AS mean_confidence,
      COUNT(_perm_qvalue) AS n_tested, COUNT(*) FILTER (WHERE _fdr_significant) AS n_significant, MEDIAN(_specificity) AS median_specificity, MEDIAN(_ci_width) AS median_ci_width,
      COUNT(*) FILTER (WHERE LENGTH(_stat_notes) > 0) AS n_flagged FROM mm)"""

_LINE = lambda label, value: f"SELECT '  ' || RPAD('{label}', 26, ' ') || ': ' || {value} AS line FROM totals, summed"
_LONELY = lambda n: f"PRINTF('%d (%.1f%%)', {n} - n, 100.0 * ({n} - n) / {n})"
_PLAIN_SCORED = scored(PLAIN)

SQL = {
    "feature_table_a": f"{tables(PLAIN)} SELECT * FROM fa",
    "feature_table_b": f"{tables(PLAIN)} SELECT id, ROUND(mz, 9) AS mz, rt, {', '.join(f'ROUND({s}, 6) AS {s}' for s in SAMPLES)} FROM fb",
    "role_stats": f"{tables(PLAIN)} {_UNPIVOT}",
    "mz_tolerance": f"{tables(PLAIN)} SELECT id, ROUND(mz * 10 / 1e6, 9) AS tol_ppm, ROUND(GREATEST(mz * 10 / 1e6, 0.0095), 9) AS tol_wider FROM fa",
    "candidate_pairs": f"{pairs(PLAIN)} SELECT * FROM c",
    "candidate_pairs_mz_da": f"{pairs(Case('plain', Tolerances(mz_ppm=5, mz_da=0.15, rt_seconds=10)))} SELECT * FROM c",
    "delta_ppm": f"{_PLAIN_SCORED} SELECT idx_a, idx_b, ROUND(delta_mz_ppm, 6) AS ppm, delta_rt FROM scored",
    "gaussian_similarity": f"{_PLAIN_SCORED} SELECT idx_a, idx_b, ROUND(gr, 6) AS similarity FROM g",
    "pair_corr_pearson": f"{correlated(PLAIN)} SELECT c.idx_a, c.idx_b, ROUND(r, 6) AS r FROM c LEFT JOIN p ON p.idx_a = c.idx_a AND p.idx_b = c.idx_b",
    "pair_corr_spearman": f"""{correlated(PLAIN)}, ranked AS (SELECT idx_a, idx_b,
        RANK() OVER (PARTITION BY idx_a, idx_b ORDER BY va) + (COUNT(*) OVER (PARTITION BY idx_a, idx_b, va) - 1) / 2.0 AS ra,
        RANK() OVER (PARTITION BY idx_a, idx_b ORDER BY vb) + (COUNT(*) OVER (PARTITION BY idx_a, idx_b, vb) - 1) / 2.0 AS rb FROM ok),
      q AS (SELECT idx_a, idx_b, CORR(ra, rb) AS r FROM ranked SEMI JOIN usable USING (idx_a, idx_b) GROUP BY idx_a, idx_b)
      SELECT c.idx_a, c.idx_b, ROUND(q.r, 6) AS r FROM c LEFT JOIN q ON q.idx_a = c.idx_a AND q.idx_b = c.idx_b""",
    "embedding_corr": """WITH e AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS v, GENERATE_SUBSCRIPTS(embedding, 1) AS k FROM embeddings)
      SELECT a.vec_id, ROUND(CORR(a.v, b.v), 6) AS r FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.k = b.k GROUP BY a.vec_id""",
    "confidence_score": f"""{_PLAIN_SCORED} SELECT idx_a, idx_b, ROUND(delta_mz_ppm, 6) AS delta_mz_ppm, delta_rt, ROUND(intensity_corr, 6) AS intensity_corr,
      ROUND(confidence, 6) AS confidence FROM scored""",
    "confidence_null_corr": f"{_PLAIN_SCORED} SELECT idx_a, idx_b, ROUND(delta_mz_ppm, 6) AS delta_mz_ppm, ROUND(0.525 * gm + 0.475 * gr, 6) AS confidence FROM g",
    "corr_filter": f"{_PLAIN_SCORED} SELECT idx_a, idx_b FROM e",
    "drift_linear": f"""{_PLAIN_SCORED}, y AS (SELECT fa.rt AS x, m.delta_rt AS y FROM m JOIN fa ON fa.id = m.idx_a)
      SELECT ROUND(REGR_INTERCEPT(y, x), 5) AS intercept, ROUND(REGR_SLOPE(y, x), 7) AS slope, 0.0::DOUBLE AS curve FROM y""",
    "drift_ridge2": f"{tables(_DEFAULT)} SELECT ROUND(i0, 5) AS intercept, ROUND(i1, 7) AS slope, ROUND(i2, 9) AS curve FROM fit",
    "drift_rejoin": f"{pairs(_DEFAULT)} SELECT idx_a, idx_b, ROUND(fa.rt, 6) AS rt_a FROM c JOIN fa ON fa.id = idx_a",
    "drift_bounds": f"{tables(_DRIFTED)} SELECT id, ROUND(rt, 6) AS rt, ROUND(rtmin, 6) AS rtmin, ROUND(rtmax, 6) AS rtmax FROM fa",
    "isolated_matches": f"{graded(CROWDED)} SELECT * FROM iso",
    "star_matches": f"{graded(CROWDED)} SELECT * FROM star",
    "contested_pairs": f"{graded(CROWDED)} SELECT idx_a, idx_b FROM hard",
    "component_labels": f"{grouped(CROWDED)} SELECT idx_a, idx_b, comp AS component FROM hard JOIN comp USING (idx_a)",
    "bipartite_matches": f"{assigned(PLAIN)} SELECT idx_a, idx_b FROM chosen",
    "bipartite_crowded": f"{assigned(CROWDED)} SELECT idx_a, idx_b FROM chosen",
    "specificity": f"{assigned(CROWDED)} SELECT idx_a, idx_b, ROUND(_specificity, 6) AS _specificity FROM gap",
    "log_detect": " UNION ALL ".join(
        f"""SELECT * FROM ({correlated(case)}, u AS (SELECT va AS x FROM v WHERE va > 0 UNION ALL SELECT vb FROM v WHERE vb > 0)
      SELECT '{case.kind}' AS kind, COUNT(*) AS n, ROUND(MAX(x) / MIN(x), 6) AS span, MAX(x) / MIN(x) >= 1e4 AS raw FROM u)"""
        for case in (PLAIN, RAW)
    ),
    "impute_matrix": f"""{tables(PLAIN)}, r AS ({" UNION ALL ".join(f"SELECT id, {k} AS k, CASE WHEN s{k} > 0 THEN LN(1 + s{k}) END AS v FROM fa" for k in range(6))})
      SELECT id AS idx, k, ROUND(COALESCE(v, AVG(v) OVER (PARTITION BY id), 0), 6) AS v FROM r""",
    "perm_pvalue_small": f"{tested(PLAIN, None, _SMALL)} SELECT idx_a, idx_b, ROUND(_perm_pvalue, 6) AS _perm_pvalue FROM tests",
    "bootstrap_ci_small": f"{tested(PLAIN, None, _SMALL)} SELECT idx_a, idx_b, ROUND(_corr_ci_low, 6) AS _corr_ci_low, ROUND(_corr_ci_high, 6) AS _corr_ci_high FROM tests",
    "spearman_tests_small": f"""{tested(CROWDED, _SPEARMAN, _SMALL)} SELECT idx_a, idx_b, ROUND(_perm_pvalue, 6) AS _perm_pvalue,
      ROUND(_corr_ci_low, 6) AS _corr_ci_low, ROUND(_corr_ci_high, 6) AS _corr_ci_high FROM tests""",
    "bh_fdr": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey * 7919 % 97 + 1) / 100::DOUBLE END AS p FROM part),
      r AS (SELECT *, RANK() OVER (ORDER BY p) + COUNT(*) OVER (PARTITION BY p) - 1 AS k, COUNT(*) OVER () AS m FROM p WHERE p IS NOT NULL),
      s AS (SELECT *, LEAST(1, MIN(p * m / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
      SELECT p.p_partkey, p.p, ROUND(s.q, 6) AS q FROM p LEFT JOIN s USING (p_partkey)""",
    "stat_notes": f"{_EVIDENCE} SELECT p_partkey, _stat_notes FROM noted",
    "triage_tiers": f"{_EVIDENCE} SELECT p_partkey, tier FROM tiered",
    "triage_summary": f"{_EVIDENCE}, {_TIERS}",
    "significant": f"{_EVIDENCE} SELECT p_partkey FROM ev WHERE _perm_qvalue < 0.03",
    "suspicious": f"{_EVIDENCE} SELECT p_partkey FROM noted WHERE LENGTH(_stat_notes) > 0",
    "align_matched": f"{tested(_DEFAULT, None)} {wide(_DEFAULT)}",
    "align_crowded": f"{tested(_DRIFTED, None)} {wide(_DRIFTED)}",
    "align_raw_spearman": f"{tested(RAW, _SPEARMAN)} {wide(RAW)}",
    # Without correlations many assignments are equally good; what they share is compared.
    "align_two_samples": f"""{assigned(TWO_SAMPLES)}, r AS ({wide(TWO_SAMPLES, _FEW_SAMPLES)}) SELECT COUNT(*) AS n, COUNT(DISTINCT "id_A") AS n_a, COUNT(DISTINCT "id_B") AS n_b,
      ROUND(SUM(_confidence), 4) AS total, COUNT(_perm_pvalue) + COUNT(_perm_qvalue) + COUNT(_ci_width) AS n_tested, COUNT(_specificity) AS n_specificity,
      MIN(_stat_notes) AS least_note, MAX(_stat_notes) AS last_note FROM r""",
    "matched_wide": f"{assigned(CROWDED)} {wide(CROWDED, _UNTESTED)}",
    "unique_a": f"{assigned(CROWDED)} SELECT * FROM fa WHERE id NOT IN (SELECT idx_a FROM chosen)",
    "unique_b": f"""{assigned(CROWDED)} SELECT id, ROUND(mz, 9) AS mz, rt, rtmin, rtmax, {", ".join(f"ROUND({s}, 6) AS {s}" for s in SAMPLES)}
      FROM fb WHERE id NOT IN (SELECT idx_b FROM chosen)""",
    "match_summary": f"""{_MET} SELECT n_matched, ROUND(median_ppm, 6) AS median_ppm, ROUND(median_abs_rt, 6) AS median_abs_rt, ROUND(median_r, 6) AS median_r,
      ROUND(mean_confidence, 6) AS mean_confidence, n_tested, n_significant, ROUND(median_specificity, 6) AS median_specificity, ROUND(median_ci_width, 6) AS median_ci_width, n_flagged FROM summed""",
    "summary_lines": _MET + " " + " UNION ALL ".join(
        [
            _LINE("Table A features", "na"), _LINE("Table B features", "nb"), _LINE("Matched pairs", "n"),
            _LINE("Unique to A", _LONELY("na")), _LINE("Unique to B", _LONELY("nb")),
            *[_LINE(label, f"PRINTF('%.{places}f', {c})") for label, c, places in (*results.SUMMARY_QUALITY, *results.SUMMARY_TESTS)],
            _LINE("FDR-significant", "PRINTF('%d of %d (%.1f%%)', n_significant, n, 100.0 * n_significant / n)"),
            _LINE("Flagged (see _stat_notes)", "n_flagged"),
        ]
    ),
    "diagnostics": f"""{_MET} SELECT 'n_features_a' AS name, na AS n FROM totals UNION ALL SELECT 'n_features_b', nb FROM totals UNION ALL SELECT 'n_matched', n FROM totals
      UNION ALL SELECT 'n_unique_a', na - n FROM totals UNION ALL SELECT 'n_unique_b', nb - n FROM totals UNION ALL SELECT 'n_candidates_evaluated', COUNT(*) FROM e
      UNION ALL SELECT 'n_fdr_significant', n_significant FROM summed""",
    "recovery_report": f"""{_MET}, good AS (SELECT COUNT(*) AS k FROM tiered WHERE tier <= 2) SELECT 'matched_a' AS name, ROUND(100.0 * n / na, 6) AS pct FROM totals
      UNION ALL SELECT 'supported_a', ROUND(100.0 * k / na, 6) FROM totals, good UNION ALL SELECT 'matched_b', ROUND(100.0 * n / nb, 6) FROM totals
      UNION ALL SELECT 'supported_b', ROUND(100.0 * k / nb, 6) FROM totals, good""",
    "align_triage": f"{_MET}, {_TIERS}",
    "column_roles": f"""SELECT * FROM (VALUES ('mz', ' Precursor Mz'), ('rt', 'Best Retention Time'), ('mz_min', NULL), ('mz_max', NULL), ('rt_min', 'Start.RT'), ('rt_max', 'end rt'),
      {", ".join(f"('intensity', 'Area_{s}')" for s in SAMPLES)}, ('annotation', 'Feature ID')) t(role, column_name)""",
    "csv_source": f"{assigned(CROWDED)} SELECT id, mz, rt, {', '.join(SAMPLES)} FROM fa WHERE id NOT IN (SELECT idx_a FROM chosen)",
}
