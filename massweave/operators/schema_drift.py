"""Schemas that drift between files: versioned fingerprints, migration steps, one table.

Every file's columns are reduced to ``(role, name, type)``.  The role says what a column
means whatever it is called: a coordinate, a bound, a sample or an annotation.  The sorted
list of a file's columns is its schema; its hash is the schema's fingerprint.  Files follow
each other within a stream, and the steps that lead from one file's schema to the next are
the changes reported: ``added``, ``removed``, ``renamed``, ``retyped``.

Roles come from names, from the looks of values, and from the chain of files: where a name
nobody knows appears in the very file in which a role of the same type and of values of the
same kind goes missing, and no other column fits as well, the name takes over the role; the
vote of all such steps of a stream decides (:func:`learned_roles`).

Each record is routed through the rules of its file's schema: rename (name to role, which is
what the chained renames of the stream come to, since each of them keeps the role), default
(NULL for a role the file lacks) and cast (text that holds a number, also with a decimal
comma, to a number).

Defined results
  * a column exists in a file if any record has its key; its type is the one most of its
    non-NULL values have, in a tie the first of number, text, boolean, list; a column whose
    values are all NULL has no type and is never retyped;
  * records and files delivered again count once; the order of keys is no change;
  * files are ordered by ``exported_at`` (``received_at`` where it is NULL), then by id; a file
    without a stream, or without any time, is not compared;
  * a file listed without records has no columns; records of unlisted files are read into the
    table but not compared;
  * a payload that is NULL or no JSON object has no columns and gives a row of NULLs;
  * two columns of one role in a file are told apart by their order by name; the first plays
    the role in the table, the others stand among the annotations as ``<role>#<number>``;
  * names without a known role keep a role of their own by their letters and digits, unless
    nearly all their values look like isotopes, adducts or formulas, or a role is learned; the
    table keeps them among the annotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.roles import ROLE_NAMES
from massweave.plans.runtime import computed_once, cut_lineage, small_enough, split_hot

_BARE = str.maketrans("", "", ".?/ ")

#: Letters and digits of the names of a coordinate or bound.
COORDINATES = {role: tuple(dict.fromkeys(n.translate(_BARE) for n in names)) for role, names in ROLE_NAMES.items() if role != "annotation"}
COORDINATES = {role: COORDINATES[role] for role in ("mz", "mz_min", "mz_max", "rt", "rt_min", "rt_max")}

#: Names of annotations beyond the role's own, under the one they stand for.
FURTHER_NAMES = {
    "isotopes": ("isotope", "isopattern", "isotopepattern"),
    "adduct": ("adducts", "ionspecies", "iontype"),
    "charge": ("z", "chargestate"),
    "formula": ("molformula", "molecularformula"),
    "name": ("compound", "compoundname"),
    "msms": ("ms2",),
}

_SYNONYMS = {n for names in FURTHER_NAMES.values() for n in names}

#: Letters and digits of the names of an annotation.
ANNOTATIONS = {
    n.replace(".?", "_"): (n.translate(_BARE), *FURTHER_NAMES.get(n, ())) for n in ROLE_NAMES["annotation"] if n.translate(_BARE) not in _SYNONYMS
}

#: Prefixes of sample columns and the sample groups that may stand without a separator.
SAMPLE_PREFIX = r"^(peak[ _.-]?area|area|height|intensity)[ _.-]"
SAMPLE_GROUPS = ("bs80", "bs4", "ll", "lp", "mix", "vn")

#: Texts that give an annotation away, for columns of an unknown name.
_LOOKS = {
    "isotopes": r"^\[\d+\]\[M(\+\d+)?\]\d*[+-]$",
    "adduct": r"^\[\d*M([+-][A-Za-z0-9]+)*\]\d*[+-]$",
    "formula": r"^C\d+H\d+([A-Z][a-z]?\d*)*$",
}

#: Largest number of files whose routes are sent to all executors.
MOST_FILES = 20_000

#: Largest distance of the values of two columns that are taken for one, see :func:`learned_roles`.
ALIKE = 0.6

TYPES = ("number", "text", "boolean", "list")


def column_role(name: Column, groups: tuple[str, ...] = SAMPLE_GROUPS) -> Column:
    """Role of a column name; ``other:<letters and digits>`` where it is unknown.

    ``groups`` are the sample groups whose number may follow without a separator.
    """
    low = F.lower(F.trim(name))
    bare = F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    sample = F.regexp_replace(low, SAMPLE_PREFIX, "")
    parts = r"^(\p{L}+\d*)[ _.-](\d+)$"
    joined = rf"^({'|'.join(groups)})(\d)$"
    of = lambda p: F.concat(F.lit("sample:"), F.regexp_extract(sample, p, 1), F.lit("_"), F.regexp_extract(sample, p, 2))
    role = None
    for kind, names in [*COORDINATES.items(), *((f"annotation:{k}", v) for k, v in ANNOTATIONS.items())]:
        hit = bare.isin(*names)
        role = F.when(hit, F.lit(kind)) if role is None else role.when(hit, F.lit(kind))
    return (
        role.when(sample.rlike(parts), of(parts))
        .when(sample.rlike(joined), of(joined))
        .when(low.rlike(SAMPLE_PREFIX), F.concat(F.lit("sample:"), F.regexp_replace(sample, r"[^\p{L}\p{N}]+", "_")))
        .otherwise(F.concat(F.lit("other:"), F.when(bare != "", bare).otherwise(low)))
    )


def value_type(value: Column) -> Column:
    """``number``, ``text``, ``boolean``, ``list``, or NULL for a JSON null and an object."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit("number"))
        .when(kind == "STRING", F.lit("text"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind.startswith("ARRAY"), F.lit("list"))
    )


def distinct_records(rows: DataFrame) -> DataFrame:
    """Each record once, with its keys and values."""
    once = rows.where("file_id IS NOT NULL").select("file_id", "row_no", "payload").dropDuplicates()
    entries = F.when(F.ltrim("payload").startswith("{"), F.from_json("payload", "map<string,variant>"))
    return once.withColumn("fields", F.map_entries(entries))


def file_columns(records: DataFrame, groups: tuple[str, ...] = SAMPLE_GROUPS) -> DataFrame:
    """``(file_id, role, name, type, center, spread)`` of every column of every file.

    ``center`` and ``spread`` are mean and deviation of the values: logarithms of numbers and
    of the sizes of texts and lists, booleans as 0 and 1.
    """
    text = F.try_variant_get("_f.value", "$", "string")
    kind = value_type(F.col("_f.value"))
    measure = (
        F.when(kind == "number", F.ln(F.abs(F.try_variant_get("_f.value", "$", "double")) + F.lit(1e-9)))
        .when(kind == "text", F.ln(F.length(text) + F.lit(1.0)))
        .when(kind == "boolean", F.try_variant_get("_f.value", "$", "boolean").cast("double"))
        .when(kind == "list", F.ln(F.size(F.try_variant_get("_f.value", "$", "array<variant>")) + F.lit(1.0)))
    )
    cells = computed_once(
        records.select("file_id", F.explode("fields").alias("_f")).select(
            "file_id", F.col("_f.key").alias("name"), kind.alias("type"), F.when(kind == "text", text).alias("text"), measure.alias("measure")
        )
    )
    counted = cells.groupBy("file_id", "name").agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES],
        *[F.count_if(F.col("text").rlike(p)).alias(f"looks_{k}") for k, p in _LOOKS.items()],
        *[F.avg(F.when(F.col("type") == t, F.col("measure"))).alias(f"center_{t}") for t in TYPES],
        *[F.avg(F.when(F.col("type") == t, F.col("measure") * F.col("measure"))).alias(f"square_{t}") for t in TYPES],
    )
    most = F.greatest(*[F.col(f"n_{t}") for t in TYPES])
    first = lambda of: F.coalesce(*[F.when((F.col(f"n_{t}") == most) & (most > 0), of(t)) for t in TYPES])
    look = F.coalesce(*[F.when((F.col(f"looks_{k}") > 0) & (F.col(f"looks_{k}") >= 0.9 * F.col("n_text")), F.lit(f"annotation:{k}")) for k in _LOOKS])
    named = column_role(F.col("name"), groups)
    role = F.when(named.startswith("other:"), F.coalesce(look, named)).otherwise(named)
    center = first(lambda t: F.col(f"center_{t}"))
    spread = F.sqrt(F.greatest(F.lit(0.0), first(lambda t: F.col(f"square_{t}")) - center * center))
    return counted.select("file_id", role.alias("role"), "name", first(F.lit).alias("type"), center.alias("center"), spread.alias("spread"))


def _fingerprint(columns: str) -> Column:
    line = lambda x: F.concat_ws("|", x["role"], x["name"], F.coalesce(x["type"], F.lit("")))
    return F.md5(F.array_join(F.array_sort(F.transform(columns, line)), "\n"))


def file_schemas(columns: DataFrame) -> DataFrame:
    """``(file_id, columns, fingerprint)``: the sorted columns of each file and their hash."""
    same = lambda x, i: F.size(F.filter(F.slice("_all", 1, i), lambda y: y["role"] == x["role"]))
    return (
        columns.groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.struct("role", "name", "type"))).alias("_all"))
        .withColumn("columns", F.transform("_all", lambda x, i: F.struct(x["role"].alias("role"), same(x, i).alias("k"), x["name"].alias("name"), x["type"].alias("type"))))
        .select("file_id", "columns", _fingerprint("_all").alias("fingerprint"))
    )


def _listed(files: DataFrame) -> DataFrame:
    """``(file_id, stream, at)`` of the files that are compared."""
    return (
        files.where("file_id IS NOT NULL")
        .groupBy("file_id")
        .agg(F.min(F.struct("stream", F.coalesce("exported_at", "received_at").alias("at"))).alias("f"))
        .select("file_id", "f.stream", "f.at")
        .where("stream IS NOT NULL AND at IS NOT NULL")
    )


def consecutive(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each compared file with the file before it in its stream.

    ``(stream, file_id, at, columns, fingerprint, before_id, before_columns,
    before_fingerprint)``.  A stream is cut into days, so that no stream is sorted as one
    group: inside a day the file before is the previous row, at the start of a day it is the
    last file of the last day that has any.
    """
    rows = (
        _listed(files).join(schemas, "file_id", "left")
        .withColumn("columns", F.coalesce("columns", F.array().cast(schemas.schema["columns"].dataType)))
        .withColumn("day", F.to_date("at"))
    )
    own = F.struct("file_id", "columns", "fingerprint")
    inside = W.partitionBy("stream", "day").orderBy("at", "file_id")
    days = (
        rows.groupBy("stream", "day")
        .agg(F.max_by(own, F.struct("at", "file_id")).alias("_last"))
        .select("stream", "day", F.lag("_last").over(W.partitionBy("stream").orderBy("day")).alias("_earlier"))
    )
    return (
        rows.withColumn("_before", F.lag(own).over(inside))
        .join(days, ["stream", "day"])
        .withColumn("_before", F.coalesce("_before", "_earlier"))
        .select(
            "stream",
            "file_id",
            "at",
            "columns",
            "fingerprint",
            F.col("_before.file_id").alias("before_id"),
            F.col("_before.columns").alias("before_columns"),
            F.col("_before.fingerprint").alias("before_fingerprint"),
        )
    )


def _steps(pairs: DataFrame) -> DataFrame:
    """``(stream, file_id, before_id, change, old_name, new_name, old_role, new_role, type)`` between consecutive files."""
    key = lambda c: F.struct(c["role"].alias("role"), c["k"].alias("k"))
    as_map = lambda a: F.map_from_entries(F.transform(a, lambda c: F.struct(key(c), c)))
    both = (
        pairs.where("before_id IS NOT NULL")
        .where(~F.col("fingerprint").eqNullSafe(F.col("before_fingerprint")))
        .select("stream", "file_id", "before_id", as_map("before_columns").alias("_old"), as_map("columns").alias("_new"))
        .select("stream", "file_id", "before_id", "_old", "_new", F.explode(F.array_union(F.map_keys("_old"), F.map_keys("_new"))).alias("_k"))
        .select("stream", "file_id", "before_id", F.try_element_at("_old", F.col("_k")).alias("o"), F.try_element_at("_new", F.col("_k")).alias("n"))
    )
    old, new = F.col("o.name"), F.col("n.name")
    step = lambda kind, old, new: F.struct(
        F.lit(kind).alias("change"), old.alias("old_name"), new.alias("new_name"), F.col("o.role").alias("old_role"), F.col("n.role").alias("new_role"),
        F.coalesce("n.type", "o.type").alias("type"),
    )
    steps = F.array_compact(
        F.array(
            F.when(F.col("o").isNull(), step("added", F.lit(""), new)),
            F.when(F.col("n").isNull(), step("removed", old, F.lit(""))),
            F.when(old != new, step("renamed", old, new)),
            F.when(F.col("o.type") != F.col("n.type"), step("retyped", old, new)),
        )
    )
    return both.select("stream", "file_id", "before_id", F.inline(steps))


def migration_steps(pairs: DataFrame) -> DataFrame:
    """``(file_id, change, old_name, new_name)`` between consecutive files."""
    return _steps(pairs).select("file_id", "change", "old_name", "new_name")


def learned_roles(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """``(stream, name, role)`` for names of unknown role that take over a role in the steps of their stream.

    In one step an unknown name and a missing role of its type are compared by the values of
    their columns: the difference of the centers in units of the spreads, and the ratio of
    the spreads.  They belong together if each is the other's closest within
    ``ALIKE`` and the next closest is at least twice as far.
    """
    steps = _steps(pairs).where("change IN ('added', 'removed') AND type IS NOT NULL")
    values = columns.select(F.col("file_id").alias("_file"), F.col("name").alias("_name"), "center", "spread").where("center IS NOT NULL")
    side = lambda df, file, name: df.join(values, (F.col(file) == F.col("_file")) & (F.col(name) == F.col("_name")))
    # Only centers within two units can be alike; half-open cells of that width keep the comparison local.
    cell = F.floor(F.col("center") / 2)
    came = side(steps.where("change = 'added' AND new_role LIKE 'other:%'"), "file_id", "new_name").select(
        "stream", "file_id", "type", F.col("new_name").alias("name"), F.col("center").alias("c1"), F.col("spread").alias("s1"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")
    )
    went = side(steps.where("change = 'removed' AND old_role NOT LIKE 'other:%'"), "before_id", "old_name").select(
        "file_id", "type", F.col("old_role").alias("role"), F.col("center").alias("c2"), F.col("spread").alias("s2"), cell.alias("_cell")
    )
    far = F.abs(F.col("c1") - F.col("c2")) / (F.lit(0.05) + (F.col("s1") + F.col("s2")) / 2) + F.abs(F.ln((F.col("s1") + 0.05) / (F.col("s2") + 0.05)))
    met = came.join(went, ["file_id", "type", "_cell"]).select("stream", "file_id", "name", "role", far.alias("far"))
    by = lambda c, other: W.partitionBy("file_id", c).orderBy("far", other)
    one = (
        met.withColumn("_n", F.row_number().over(by("name", "role")))
        .withColumn("_r", F.row_number().over(by("role", "name")))
        .withColumn("_next", F.least(F.lead("far").over(by("name", "role")), F.lead("far").over(by("role", "name"))))
        .where((F.col("_n") == 1) & (F.col("_r") == 1) & (F.col("far") <= ALIKE))
        .where(F.coalesce(F.col("_next") >= 2 * F.col("far") + 0.1, F.lit(True)))
    )
    votes = one.groupBy("stream", "name", "role").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("stream", "name").agg(F.max_by("role", F.struct("n", "role")).alias("role"))


def with_learned_roles(files: DataFrame, columns: DataFrame) -> DataFrame:
    """``columns`` with the roles learned for unknown names; a file keeps no learned role that another of its columns has."""
    if columns.where(F.col("role").startswith("other:")).isEmpty():
        return columns
    learned = learned_roles(consecutive(files, file_schemas(columns)), columns)
    streams = _listed(files).select("file_id", "stream")
    taught = learned.join(streams, "stream").select("file_id", "name", F.col("role").alias("_learned"))
    taken = W.partitionBy("file_id", "_new")
    return (
        columns.join(taught, ["file_id", "name"], "left")
        .withColumn("_new", F.when(F.col("role").startswith("other:"), F.coalesce("_learned", "role")).otherwise(F.col("role")))
        .withColumn("_many", F.count(F.lit(1)).over(taken))
        .withColumn("role", F.when((F.col("_many") > 1) & F.col("role").startswith("other:"), F.col("role")).otherwise(F.col("_new")))
        .select(*columns.columns)
    )


def schema_versions(pairs: DataFrame) -> DataFrame:
    """``(stream, fingerprint, n_files, first_file_at, last_file_at, n_columns)`` of every schema of a stream."""
    return pairs.groupBy("stream", "fingerprint").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min("at").alias("first_file_at"),
        F.max("at").alias("last_file_at"),
        F.max(F.size("columns")).alias("n_columns"),
    )


def as_number(value: Column) -> Column:
    """Cast rule: a JSON number, or a text that holds one, as a double."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(
        value_type(value).isin("number", "text"),
        F.when(text.rlike(r"^[+-]?\d*[.,]?\d+([eE][+-]?\d+)?$"), F.regexp_replace(text, ",", ".").try_cast("double")),
    )


def file_routes(columns: DataFrame) -> DataFrame:
    """``(file_id, fingerprint, _roles)``: the place of every name of a file in the table, by its schema.

    The first column of a role plays it; further ones and unknown ones get a place of their
    own among the annotations, unknown ones of one file that would share a place under their
    exact names.
    """
    unknown = column_role(F.col("name")).startswith("other:").alias("unknown")
    same = lambda c, i: F.size(F.filter(F.slice("_all", 1, i), lambda d: d["role"] == c["role"]))
    alone = lambda c: F.size(F.filter("_all", lambda d: d["role"] == c["role"])) == 1
    place = lambda c, i: (
        F.when(c["unknown"] & ~alone(c), F.concat(F.lit("other:"), c["name"]))
        .when(same(c, i) > 0, F.concat(c["role"], F.lit("#"), (same(c, i) + 1).cast("string")))
        .otherwise(c["role"])
    )
    return (
        columns.select("file_id", "role", unknown, "name", "type")
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.struct("role", "unknown", "name", "type"))).alias("_all"))
        .select("file_id", _fingerprint("_all").alias("fingerprint"), F.map_from_entries(F.transform("_all", lambda c, i: F.struct(c["name"].alias("name"), place(c, i).alias("role")))).alias("_roles"))
    )


def unified(records: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """All records in one table.

    ``(file_id, row_no, fingerprint, mz, mz_min, mz_max, rt, rt_min, rt_max, intensities, annotations,
    n_cast, n_lost)``: ``fingerprint`` names the schema that routed the record; ``intensities``
    maps samples to numbers, ``annotations`` maps
    annotations to text, columns without a known role under ``other:...``.  ``n_cast`` counts texts read as numbers, ``n_lost`` values that
    are no number where one is needed.  ``columns`` are those of :func:`file_columns`, with learned roles if there are any.
    """
    routes = cut_lineage(file_routes(file_columns(records) if columns is None else columns))
    if small_enough(routes, MOST_FILES):
        routed = records.join(F.broadcast(routes), "file_id", "left")
    else:
        # A file of very many records is dealt out to several tasks.
        many, routes = split_hot(records, routes, ["file_id"], "row_no")
        routed = many.join(routes, ["file_id", "_salt"], "left")
    cells = routed.withColumn(
        "_c",
        F.transform(
            F.coalesce("fields", F.array().cast(records.schema["fields"].dataType)),
            lambda e: F.struct(
                F.try_element_at("_roles", e["key"]).alias("role"),
                value_type(e["value"]).alias("type"),
                as_number(e["value"]).alias("number"),
                F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.when(~F.is_variant_null(e["value"]), F.to_json(e["value"]))).alias("text"),
            ),
        ),
    )
    one = lambda role: F.get(F.filter("_c", lambda c: c["role"] == role), F.lit(0))["number"]
    sample = lambda c: c["role"].startswith("sample:") & ~c["role"].contains("#")
    numeric = lambda c: c["role"].isin(*COORDINATES) | sample(c)
    to_map = lambda keep, start, field: F.map_from_entries(
        F.transform(F.filter("_c", keep), lambda c: F.struct(F.regexp_replace(c["role"], start, ""), c[field]))
    )
    return cells.select(
        "file_id",
        "row_no",
        "fingerprint",
        *[one(r).alias(r) for r in COORDINATES],
        to_map(sample, "^sample:", "number").alias("intensities"),
        to_map(lambda c: ~numeric(c), "^annotation:", "text").alias("annotations"),
        F.size(F.filter("_c", lambda c: numeric(c) & (c["type"] == "text") & c["number"].isNotNull())).alias("n_cast"),
        F.size(F.filter("_c", lambda c: numeric(c) & c["type"].isNotNull() & c["number"].isNull())).alias("n_lost"),
    )


def table_of(files: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`unified` of delivered rows, each file routed by its place in its stream."""
    records = distinct_records(rows)
    return unified(records, with_learned_roles(files, cut_lineage(file_columns(records))))


def versions(files: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`schema_versions` of delivered rows."""
    columns = with_learned_roles(files, cut_lineage(file_columns(distinct_records(rows))))
    return schema_versions(consecutive(files, file_schemas(columns)))


def changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """All changes between consecutive files of the streams."""
    columns = with_learned_roles(files, cut_lineage(file_columns(distinct_records(rows))))
    return migration_steps(consecutive(files, cut_lineage(file_schemas(columns))))
