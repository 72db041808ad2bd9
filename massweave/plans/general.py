"""Queries of the general data-processing operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.operators import hotdeck, intervals, schema_drift, units
from massweave.plans.runtime import cut_lineage, query, table

SEGMENT_COLUMNS = ["trace_id", "rtmin", "rtmax", "mzmin", "mzmax"]


def _segments(spark: SparkSession, directory: str) -> DataFrame:
    return intervals.latest_rows(table(spark, directory, "peak_segments"), "segment_id", "loaded_at", SEGMENT_COLUMNS)


@query
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Gaps between the periods of each trace on both axes."""
    return intervals.gaps(_segments(spark, directory), "trace_id")


@query
def p2_periods(spark: SparkSession, directory: str) -> DataFrame:
    """Continuous periods of each trace on both axes."""
    return intervals.periods(_segments(spark, directory), "trace_id")


def _solved(spark: SparkSession, directory: str) -> DataFrame:
    return units.field_seconds(table(spark, directory, "rt_exports"), table(spark, directory, "internal_standards"))


@query
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Fields recorded in anything but plain seconds."""
    return units.not_in_seconds(_solved(spark, directory))


@query
def p4_seconds(spark: SparkSession, directory: str) -> DataFrame:
    """All times in seconds, with the unit found and whether it is the only one possible."""
    return units.to_seconds(_solved(spark, directory))


FILLED_FIELDS = ("BS4_1", "LL_1", "Mix_1")


def _filled(spark: SparkSession, directory: str) -> DataFrame:
    return hotdeck.fill(table(spark, directory, "features_a"), [hotdeck.sample_field(f) for f in FILLED_FIELDS])


@query
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Fields without a real value, as the hot deck marks them."""
    # Written first: the planner would leave the donors out of a plan that shows the marks only.
    return cut_lineage(_filled(spark, directory)).select("feature_id", "field")


@query
def p3_filled(spark: SparkSession, directory: str) -> DataFrame:
    """Filled values with their donors."""
    return _filled(spark, directory)


@query
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Changes between consecutive files of each stream."""
    return schema_drift.changes(table(spark, directory, "export_files"), table(spark, directory, "export_rows"))


@query
def p5_table(spark: SparkSession, directory: str) -> DataFrame:
    """Records of all files in one table."""
    return schema_drift.table_of(table(spark, directory, "export_files"), table(spark, directory, "export_rows"))


@query
def p5_cells(spark: SparkSession, directory: str) -> DataFrame:
    """The table cell by cell, numbers and texts that hold one rounded."""
    t = schema_drift.table_of(table(spark, directory, "export_files"), table(spark, directory, "export_rows"))
    cell = lambda place, number, text: F.struct(place.alias("place"), number.alias("number"), text.alias("text"))
    no_text, key = F.lit(None).cast("string"), lambda e: e["key"]
    own = F.array(*[cell(F.lit(r), F.col(r), no_text) for r in schema_drift.COORDINATES])
    samples = F.transform(F.map_entries("intensities"), lambda e: cell(F.concat(F.lit("sample:"), key(e)), e["value"], no_text))
    others = F.transform(F.map_entries("annotations"), lambda e: cell(F.concat(F.lit("annotation:"), key(e)), e["value"].try_cast("double"), F.when(e["value"].try_cast("double").isNull(), e["value"])))
    cells = t.select("file_id", "row_no", "n_cast", "n_lost", F.inline(F.concat(own, samples, others)))
    rounded = cells.withColumn("number", F.round("number", 6)).where("number IS NOT NULL OR text IS NOT NULL")
    return rounded.groupBy("file_id", "row_no", "place", "number", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("n_cast").alias("n_cast"), F.sum("n_lost").alias("n_lost"))


@query
def p5_versions(spark: SparkSession, directory: str) -> DataFrame:
    """Schemas of each stream by their fingerprints."""
    return schema_drift.versions(table(spark, directory, "export_files"), table(spark, directory, "export_rows"))


_LATEST_SEGMENTS = """
  SELECT * FROM (
    SELECT trace_id, rtmin, rtmax, mzmin, mzmax,
      ROW_NUMBER() OVER (PARTITION BY segment_id ORDER BY loaded_at DESC NULLS LAST, trace_id DESC NULLS LAST, rtmin DESC NULLS LAST,
        rtmax DESC NULLS LAST, mzmin DESC NULLS LAST, mzmax DESC NULLS LAST) AS k
    FROM peak_segments WHERE segment_id IS NOT NULL) WHERE k = 1"""

_SIDES = " UNION ALL ".join(
    f"""SELECT trace_id, '{axis}' AS axis, CAST(ROUND(LEAST({axis}min, {axis}max) * {scale}) AS BIGINT) AS s,
      CAST(ROUND(GREATEST({axis}min, {axis}max) * {scale}) AS BIGINT) AS e
    FROM latest WHERE {axis}min >= 0 AND {axis}max >= 0 AND isfinite({axis}min) AND isfinite({axis}max) AND trace_id IS NOT NULL"""
    for axis, scale in (("rt", 1000), ("mz", 100000))
)

_REACH = f"""WITH latest AS ({_LATEST_SEGMENTS}), sides AS ({_SIDES}),
starts AS (SELECT trace_id, axis, s, MAX(e) AS e FROM sides GROUP BY trace_id, axis, s),
marked AS (SELECT *, MAX(e) OVER (PARTITION BY trace_id, axis ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM starts)"""

_REAL = lambda c: f"CASE WHEN {c} > 0 AND isfinite({c}) THEN {c} END"

_STEP = "CAST(FLOOR(LN(v) / 0.05) AS BIGINT)"
_FIELDS = [hotdeck.sample_field(f) for f in FILLED_FIELDS]
_ALL_SAMPLES = sorted({c for f in _FIELDS for c in (*f.group, *f.companions)})

_MISSING = f"""WITH RECURSIVE latest AS (
    SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY loaded_at DESC) AS k FROM features_a) WHERE k = 1),
  real AS (SELECT feature_id, study, pcgroup, CASE WHEN lower(trim(polarity)) IN ({", ".join(repr(x) for x in hotdeck.POSITIVE)}) THEN 'positive'
    WHEN lower(trim(polarity)) IN ({", ".join(repr(x) for x in hotdeck.NEGATIVE)}) THEN 'negative' END AS ion, {", ".join(f"{_REAL(c)} AS {c}" for c in _ALL_SAMPLES)} FROM latest),
  counted AS (SELECT study, v, COUNT(*) AS n, {_STEP} AS cell FROM (
    {" UNION ALL ".join(f"SELECT study, {f} AS v FROM real WHERE {f} IS NOT NULL" for f in FILLED_FIELDS)}) GROUP BY study, v),
  around AS (SELECT *, SUM(n) OVER (PARTITION BY study, cell) AS everything FROM counted),
  often AS (SELECT study, v FROM around WHERE n >= {hotdeck.LEAST_REPEATS} AND n > {hotdeck.OVER_CHANCE} * (everything - n) * {hotdeck.RESOLUTION} / (EXP(cell * 0.05) * 0.05)),
  kept AS (SELECT feature_id, study, ion, {", ".join(
      f"CASE WHEN NOT EXISTS (SELECT 1 FROM often o WHERE o.study IS NOT DISTINCT FROM r.study AND o.v = r.{f}) THEN {f} END AS {f}" for f in FILLED_FIELDS)},
    {", ".join(c for c in _ALL_SAMPLES if c not in FILLED_FIELDS)} FROM real r),
  has AS (SELECT study, {", ".join(
      f"COUNT({g}_1) + COUNT({g}_2) + COUNT({g}_3) > 0 AS has_{g}_1, QUANTILE_DISC({g}_1, 0.5) AS median_{g}_1" for g in ("BS4", "LL", "Mix"))} FROM kept GROUP BY study)"""

_LONG = " UNION ALL ".join(
    f"""SELECT feature_id, k.study, '{f.name}' AS field, k.{f.name} AS v, COALESCE(ion, '') AS ion, LN(COALESCE({", ".join(f.companions)})) AS level,
      FLOOR(LN(COALESCE({", ".join(f.companions[2:])}))) AS side, median_{f.name} AS median FROM kept k JOIN has h ON h.study IS NOT DISTINCT FROM k.study WHERE k.{f.name} IS NOT NULL OR has_{f.name}"""
    for f in _FIELDS
)

_FILLED = f"""{_MISSING}, long AS MATERIALIZED ({_LONG}),
  near AS (SELECT a.feature_id, a.field, d.feature_id AS donor, d.v, a.ion = d.ion AND a.side IS NOT DISTINCT FROM d.side AS own, ABS(d.level - a.level) AS gap
    FROM long a JOIN long d ON d.field = a.field AND d.study IS NOT DISTINCT FROM a.study AND ABS(d.level - a.level) <= {hotdeck.FARTHEST} WHERE a.v IS NULL AND d.v IS NOT NULL),
  far AS (SELECT *, CASE WHEN own THEN gap ELSE gap + {hotdeck.OTHER_BLOCK} END AS distance FROM near),
  placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id, field ORDER BY distance, donor) AS place FROM far),
  five AS (SELECT *, SUM(1 / (distance + 0.01)) OVER (PARTITION BY feature_id, field ORDER BY v, 1 / (distance + 0.01) ROWS UNBOUNDED PRECEDING) AS upto,
    SUM(1 / (distance + 0.01)) OVER (PARTITION BY feature_id, field) AS total FROM placed WHERE place <= {hotdeck.DONORS}),
  values_ AS (SELECT feature_id, field, MIN(v) FILTER (WHERE upto >= total / 2) AS v, LIST(donor ORDER BY place) AS donors,
    CASE WHEN BOOL_AND(own) THEN 0 WHEN MAX(distance) <= {2 * hotdeck.OTHER_BLOCK} THEN 1 ELSE 2 END AS depth FROM five GROUP BY feature_id, field),
  votes AS (SELECT study, pcgroup, ion, COUNT(*) AS n, MIN(feature_id) AS one FROM real WHERE ion IS NOT NULL GROUP BY ALL),
  by_group AS (SELECT study, pcgroup, ion, one FROM votes QUALIFY ROW_NUMBER() OVER (PARTITION BY study, pcgroup ORDER BY n DESC, one, ion DESC) = 1),
  by_study AS (SELECT study, ion, one FROM (SELECT study, ion, SUM(n) AS n, MIN(one) AS one FROM votes GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY study ORDER BY n DESC, one, ion DESC) = 1),
  modes AS (SELECT r.feature_id, g.ion AS gi, s.ion AS si, g.one AS go, s.one AS so FROM real r LEFT JOIN by_group g ON g.study IS NOT DISTINCT FROM r.study AND g.pcgroup = r.pcgroup
    LEFT JOIN by_study s ON s.study IS NOT DISTINCT FROM r.study WHERE r.ion IS NULL)"""


def _role_sql(name: str) -> str:
    """The role of a column name; the looks of values are left out, no name compared needs them."""
    low = f"lower(trim({name}))"
    bare = f"regexp_replace({low}, '[^a-z0-9]', '', 'g')"
    sample = f"regexp_replace({low}, '{schema_drift.SAMPLE_PREFIX}', '')"
    groups = "|".join(schema_drift.SAMPLE_GROUPS)
    kinds = [*schema_drift.COORDINATES.items(), *((f"annotation:{k}", v) for k, v in schema_drift.ANNOTATIONS.items())]
    whens = " ".join(f"WHEN {bare} IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in kinds)
    return f"""CASE {whens} WHEN regexp_matches({sample}, '^[a-z]+[0-9]*[ _.-][0-9]+$') THEN 'sample:' || regexp_replace({sample}, '[ .-]', '_')
      WHEN regexp_matches({sample}, '^({groups})[0-9]$') THEN 'sample:' || regexp_replace({sample}, '([0-9])$', '_\\1') ELSE 'other:' || {bare} END"""


_DRIFT = f"""WITH r AS (SELECT DISTINCT file_id, row_no, payload FROM export_rows WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  k AS (SELECT file_id, payload, UNNEST(json_keys(payload)) AS name FROM r),
  v AS (SELECT file_id, name, json_type(payload, '$."' || name || '"') AS t FROM k),
  n AS (SELECT file_id, name, COUNT(*) FILTER (WHERE t IN ('DOUBLE', 'UBIGINT', 'BIGINT')) AS num, COUNT(*) FILTER (WHERE t = 'VARCHAR') AS txt,
    COUNT(*) FILTER (WHERE t = 'BOOLEAN') AS boo, COUNT(*) FILTER (WHERE t = 'ARRAY') AS lis FROM v GROUP BY file_id, name),
  c AS (SELECT file_id, name, {_role_sql("name")} AS role, CASE WHEN GREATEST(num, txt, boo, lis) = 0 THEN NULL WHEN num = GREATEST(num, txt, boo, lis) THEN 'number'
    WHEN txt = GREATEST(num, txt, boo, lis) THEN 'text' WHEN boo = GREATEST(num, txt, boo, lis) THEN 'boolean' ELSE 'list' END AS type FROM n),
  f AS (SELECT file_id, MIN(stream) AS stream, MIN(COALESCE(exported_at, received_at)) AS ts FROM export_files GROUP BY file_id),
  p AS (SELECT file_id, LAG(file_id) OVER (PARTITION BY stream ORDER BY ts, file_id) AS before_id FROM f WHERE stream IS NOT NULL AND ts IS NOT NULL),
  o AS (SELECT p.file_id, c.role, c.name, c.type FROM p JOIN c ON c.file_id = p.before_id),
  w AS (SELECT p.file_id, c.role, c.name, c.type FROM p JOIN c ON c.file_id = p.file_id WHERE p.before_id IS NOT NULL),
  b AS (SELECT COALESCE(o.file_id, w.file_id) AS file_id, o.name AS oname, w.name AS wname, o.type AS otype, w.type AS wtype
    FROM o FULL JOIN w ON w.file_id = o.file_id AND w.role = o.role)"""

_BLANK = r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_CLEAN = lambda c: f"TRIM(LOWER(REGEXP_REPLACE({c}, '{_BLANK}', ' ', 'g')))"
_PART = lambda pattern, k: f"NULLIF(REGEXP_EXTRACT(t, '{pattern}', {k}), '')"
_COMMA = lambda c: f"TRY_CAST(REPLACE({c}, ',', '.') AS DOUBLE)"
_MIXED = " ".join(
    f"""WHEN REGEXP_MATCHES(t, '{p}') AND ({_PART(p, 1)} IS NOT NULL OR {_PART(p, 2)} IS NOT NULL)
    THEN COALESCE({_COMMA(_PART(p, 1))}, 0) * 3600 + COALESCE({_COMMA(_PART(p, 2))}, 0) * 60 + COALESCE({_COMMA(_PART(p, 3))}, 0)"""
    for p in units.MIXED_NOTATIONS
)
_UNIT = lambda c: "CASE " + " ".join(
    f"WHEN REPLACE(LOWER(TRIM({c})), '.', '') IN ({', '.join(repr(w) for w in words.split())}) THEN '{unit}'" for unit, words in units.UNIT_WORDS.items()
) + " END"
_AWAY = lambda d: f"CASE WHEN {d} >= 0 THEN {d} ELSE {units.WRONG_ORDER} - ({d}) END"
_RANK = "CASE unit WHEN 's' THEN 0 WHEN 'min' THEN 1 WHEN 'h' THEN 2 WHEN 'ms' THEN 3 ELSE 4 END"

_TIMES = f"""WITH r AS (SELECT DISTINCT ON (record_id) * FROM rt_exports WHERE record_id IS NOT NULL),
  st AS (SELECT * FROM internal_standards WHERE rt_seconds > 0),
  by_mz AS (SELECT record_id, ARG_MIN(rt_seconds, (ABS(r.mz - st.mz), rt_seconds)) AS s FROM r JOIN st ON ABS(r.mz - st.mz) <= st.mz * 20e-6 GROUP BY record_id),
  by_name AS (SELECT {_CLEAN("standard_name")} AS name, MIN(rt_seconds) AS s FROM st GROUP BY 1),
  base AS (SELECT r.*, COALESCE(m.s, n.s, (SELECT EXP(AVG(LN(rt_seconds))) FROM st)) AS nominal FROM r LEFT JOIN by_mz m USING (record_id) LEFT JOIN by_name n ON n.name = {_CLEAN("standard_label")}),
  long AS ({" UNION ALL ".join(f"SELECT record_id, file_name, rt_unit, nominal, '{f}' AS field, {_CLEAN(f)} AS t FROM base" for f in ("rt", "rtmin", "rtmax"))}),
  mixes AS (SELECT *, CASE {_MIXED} END AS mixed, {_PART("^pt([0-9]+(?:[.,][0-9]+)?)s$", 1)} AS iso FROM long),
  nums AS (SELECT *, COALESCE(iso, {_PART(units.WRITTEN_NUMBER, 1)}) AS num, CASE WHEN iso IS NOT NULL THEN 's' ELSE {_UNIT(_PART(units.WRITTEN_NUMBER, 2))} END AS written FROM mixes),
  rd AS (SELECT *,
    CASE WHEN mixed > 0 THEN NULL WHEN num LIKE '%,%' AND num LIKE '%.%' THEN CASE WHEN STRPOS(REVERSE(num), ',') < STRPOS(REVERSE(num), '.') THEN {_COMMA("REPLACE(num, '.', '')")} ELSE TRY_CAST(REPLACE(num, ',', '') AS DOUBLE) END
      WHEN REGEXP_MATCHES(num, '^[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}$') OR REGEXP_MATCHES(num, '{units.TWO_READINGS}') THEN TRY_CAST(REPLACE(num, ',', '') AS DOUBLE)
      WHEN REGEXP_MATCHES(num, '^[0-9]{{1,3}}([.][0-9]{{3}}){{2,}}$') THEN TRY_CAST(REPLACE(num, '.', '') AS DOUBLE) END AS marked_value,
    CASE WHEN mixed > 0 OR (num LIKE '%,%' AND num LIKE '%.%') OR REGEXP_MATCHES(num, '^[0-9]{{1,3}}([,][0-9]{{3}}){{2,}}$') OR REGEXP_MATCHES(num, '^[0-9]{{1,3}}([.][0-9]{{3}}){{2,}}$') THEN NULL
      ELSE {_COMMA("num")} END AS plain_value FROM nums),
  opt AS (SELECT record_id, field, LN(seconds) AS log, unit, marked, seconds FROM (
      SELECT record_id, field, 'mixed' AS unit, FALSE AS marked, mixed AS seconds FROM rd WHERE mixed > 0
      UNION ALL SELECT record_id, field, u.unit, TRUE, marked_value * f FROM rd, (VALUES ('s', 1.0::DOUBLE), ('min', 60), ('h', 3600), ('ms', 0.001)) u(unit, f)
      UNION ALL SELECT record_id, field, u.unit, FALSE, plain_value * f FROM rd, (VALUES ('s', 1.0::DOUBLE), ('min', 60), ('h', 3600), ('ms', 0.001)) u(unit, f))
    WHERE seconds > 0 AND isfinite(seconds)),
  anchor AS (SELECT o.*, LN(nominal) AS target FROM opt o JOIN base USING (record_id) WHERE field = 'rt'
    UNION ALL SELECT record_id, 'rt', LN(nominal), NULL, FALSE, NULL, LN(nominal) FROM base WHERE record_id NOT IN (SELECT record_id FROM opt WHERE field = 'rt')),
  numbered AS (SELECT *, ROW_NUMBER() OVER () AS a FROM anchor),
  off AS (SELECT n.a, n.record_id, o.field, o.log, o.unit, o.marked, o.seconds, {_AWAY("CASE o.field WHEN 'rtmin' THEN n.log - o.log ELSE o.log - n.log END")} AS away
    FROM numbered n JOIN opt o ON o.record_id = n.record_id AND o.field <> 'rt'),
  least AS (SELECT a, field, MIN(away) AS away FROM off GROUP BY a, field),
  total AS (SELECT n.*, ABS(n.log - target) + COALESCE(l.away, 0) + COALESCE(h.away, 0) AS total FROM numbered n
    LEFT JOIN least l ON l.a = n.a AND l.field = 'rtmin' LEFT JOIN least h ON h.a = n.a AND h.field = 'rtmax'),
  near AS (SELECT * FROM total QUALIFY total <= MIN(total) OVER (PARTITION BY record_id) + {units.SAME_SECONDS}),
  close AS (SELECT DISTINCT record_id, field, unit, marked, seconds FROM near WHERE unit IS NOT NULL
    UNION SELECT o.record_id, o.field, o.unit, o.marked, o.seconds FROM near n JOIN off o ON o.a = n.a JOIN least l ON l.a = o.a AND l.field = o.field WHERE o.away <= l.away + {units.SAME_SECONDS}),
  counted_ AS (SELECT *, COUNT(*) OVER (PARTITION BY record_id, field) = 1 AS one FROM close),
  habit AS (SELECT file_name, unit AS usual FROM counted_ JOIN base USING (record_id) WHERE one AND unit <> 'mixed' GROUP BY file_name, unit
    QUALIFY ROW_NUMBER() OVER (PARTITION BY file_name ORDER BY COUNT(*) DESC, unit DESC) = 1),
  settled AS (SELECT rd.record_id, rd.field, c.seconds, c.unit, c.one, COALESCE(written, {_UNIT("rt_unit")}) = c.unit AS agrees FROM rd LEFT JOIN counted_ c USING (record_id, field) LEFT JOIN habit h ON h.file_name = rd.file_name
    QUALIFY ROW_NUMBER() OVER (PARTITION BY rd.record_id, rd.field ORDER BY COALESCE(c.unit <> written, FALSE), COALESCE(c.unit <> usual, FALSE), marked DESC, {_RANK}) = 1)"""

SQL = {
    "p5_found": f"""{_DRIFT} SELECT file_id, 'added' AS change, '' AS old_name, wname AS new_name FROM b WHERE oname IS NULL
      UNION ALL SELECT file_id, 'removed', oname, '' FROM b WHERE wname IS NULL
      UNION ALL SELECT file_id, 'renamed', oname, wname FROM b WHERE oname <> wname
      UNION ALL SELECT file_id, 'retyped', oname, wname FROM b WHERE otype <> wtype""",
    "p2_found": f"{_REACH} SELECT trace_id, axis, reach AS gap_from, s AS gap_to FROM marked WHERE s > reach",
    "p2_periods": f"""{_REACH}, numbered AS (SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
      OVER (PARTITION BY trace_id, axis ORDER BY s ROWS UNBOUNDED PRECEDING) AS n FROM marked)
    SELECT trace_id, axis, CAST(n AS BIGINT) AS period_no, MIN(s) AS period_from, MAX(e) AS period_to, COUNT(*) AS n_starts
    FROM numbered GROUP BY trace_id, axis, n""",
    "p3_found": _MISSING
    + " UNION ALL ".join(
        f" SELECT feature_id, '{f}' AS field FROM kept JOIN has ON kept.study IS NOT DISTINCT FROM has.study WHERE {f} IS NULL AND has_{f}" for f in FILLED_FIELDS
    )
    + " UNION ALL SELECT feature_id, 'polarity' AS field FROM real WHERE ion IS NULL",
    "p3_filled": f"""{_FILLED} SELECT a.feature_id, a.field, COALESCE(x.v, a.median) AS filled_number, CAST(NULL AS VARCHAR) AS filled_text,
      CASE WHEN x.v IS NOT NULL THEN depth WHEN a.median IS NOT NULL THEN 3 END AS depth, COALESCE(donors, []) AS donors
      FROM long a LEFT JOIN values_ x USING (feature_id, field) WHERE a.v IS NULL
      UNION ALL SELECT feature_id, 'polarity', NULL, COALESCE(gi, si), CASE WHEN gi IS NOT NULL THEN 0 WHEN si IS NOT NULL THEN 3 END,
        CASE WHEN COALESCE(go, so) IS NULL THEN [] ELSE [COALESCE(go, so)] END FROM modes""",
    "p4_found": f"{_TIMES} SELECT record_id, field FROM settled WHERE unit <> 's'",
    "p4_seconds": f"{_TIMES} SELECT record_id, " + ", ".join(
        f"MAX({c}) FILTER (WHERE field = '{f}') AS {f}_{n}" for f in ("rt", "rtmin", "rtmax") for c, n in (("seconds", "seconds"), ("unit", "unit"), ("one", "unique"), ("agrees", "label_agrees"))
    ) + " FROM settled GROUP BY record_id",
    "p5_versions": f"""{_DRIFT}, lines AS (SELECT file_id, MD5(STRING_AGG(line, chr(10) ORDER BY line)) AS fingerprint, COUNT(*) AS n FROM (
        SELECT file_id, role || '|' || name || '|' || COALESCE(type, '') AS line FROM c) GROUP BY file_id)
      SELECT stream, fingerprint, COUNT(*) AS n_files, MIN(ts) AS first_file_at, MAX(ts) AS last_file_at, MAX(COALESCE(n, 0))::INT AS n_columns
      FROM f LEFT JOIN lines USING (file_id) WHERE stream IS NOT NULL AND ts IS NOT NULL GROUP BY stream, fingerprint""",
    "p5_cells": f"""{_DRIFT}, cell AS (SELECT r.file_id, r.row_no, r.id, c.role, json_type(payload, '$."' || name || '"') AS t, payload ->> ('$."' || name || '"') AS x
        FROM (SELECT *, ROW_NUMBER() OVER () AS id FROM r) r JOIN c ON c.file_id = r.file_id AND json_exists(payload, '$."' || name || '"')),
      typed AS (SELECT *, NOT STARTS_WITH(role, 'annotation:') AS numeric, CASE WHEN t IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'VARCHAR')
        AND REGEXP_MATCHES(TRIM(x), '^[+-]?[0-9]*[.,]?[0-9]+([eE][+-]?[0-9]+)?$') THEN TRY_CAST(REPLACE(TRIM(x), ',', '.') AS DOUBLE) END AS v FROM cell WHERE t <> 'NULL'),
      counts AS (SELECT *, COUNT(*) FILTER (WHERE numeric AND t = 'VARCHAR' AND v IS NOT NULL) OVER w AS n_cast, COUNT(*) FILTER (WHERE numeric AND v IS NULL AND t <> 'OBJECT') OVER w AS n_lost
        FROM typed WINDOW w AS (PARTITION BY id)),
      out_ AS (SELECT file_id, row_no, role AS place, ROUND(CASE WHEN numeric THEN v ELSE TRY_CAST(x AS DOUBLE) END, 6) AS number,
        CASE WHEN NOT numeric AND TRY_CAST(x AS DOUBLE) IS NULL THEN x END AS text, n_cast, n_lost FROM counts)
      SELECT file_id, row_no, place, number, text, COUNT(*) AS n, SUM(n_cast)::BIGINT AS n_cast, SUM(n_lost)::BIGINT AS n_lost FROM out_ WHERE number IS NOT NULL OR text IS NOT NULL GROUP BY ALL""",
}

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p3_found": p3_found, "p3_filled": p3_filled, "p4_found": p4_found, "p4_seconds": p4_seconds, "p5_found": p5_found, "p5_table": p5_table, "p5_cells": p5_cells, "p5_versions": p5_versions}
