"""Texts that were cut off, by a field limit of a source or in transfer.

1. *Hidden limits.*  The length of every text is recomputed as it may have been stored:
   characters, bytes, characters or bytes after entity escaping, JSON escaping and newline
   conversion.  Texts are counted by source, way of storing and length; a length at which far
   more texts end than chance allows at the lengths around it, and which fewer texts exceed
   than end there, is a limit of the source.  So each way has few limits: every one holds at
   least half of what is not shorter.  A text at a limit that does not end a line is cut,
   unless it ends the way other open texts of its source end with numbers or hashes.
2. *Endings* of the other texts.  What whole endings look like is learned from the corpus:
   the line before the last one that nearly all texts of a source and a kind of beginning
   share (a signature, say) is their terminator, and a text without it is cut; a last word
   that hardly any whole line ends in, in the same way, is broken off, where the source
   closes its texts by a line end.  Besides, a text is cut inside the public formats of
   diffs, patches, logs and mails if they announce more than follows: a change with fewer
   lines than its heading counts, a heading line as the end, a binary patch without its end,
   a number inside an open bracket.  A mark of omission counts at a limit, or on a text that
   its source reported as longer, since messages may end in dots by nature.

Defined results
  * NULL, empty and blank texts are never cut, nor are texts that are short by nature;
  * the reported length alone proves nothing, it may be off;
  * a text without a source is judged as one of the source that nearly all texts of its
    beginning belong to, if there is one, else by its ending alone; source names are compared
    without case and separators;
  * rows of one id count once (their lines count as often as they are delivered);
  * an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.mix import source_name
from massweave.plans.runtime import broadcast_if_small, cut_lineage, ship_package, split_hot

#: Any character that is no white space of any kind.
NOT_BLANK = r"[^\s\u00A0\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]"

#: A limit: so many times the mean of the lengths so far around, and so many standard deviations above it.
LIMIT_OVER = 6.0
LIMIT_AROUND = 40
LIMIT_DEVIATIONS = 5.0

#: Lengths are looked at in stretches of this width.
_STRETCH = 4096

#: A last word is whole if so many lines of the corpus end in it, at least one of so many.
WHOLE_WORD = 2
WHOLE_SHARE = 1e-6

#: From this share of open endings on, open endings are natural in a source.
NATURALLY_OPEN = 0.25

#: An ending in numbers or hashes is natural if this share of the open texts of the source has it.
NATURAL_ENDING = 0.02

#: A terminator stands in this share of the texts of one source and beginning, which are this share of all at least.
TERMINATED = 0.8
COMMON_START = 0.001

#: A beginning belongs to a source that has this share of its texts.
OWN_START = 0.9

#: Fewest texts that anything is learned from.
LEAST_TEXTS = 20

#: Largest table of limits, or of beginnings, that is sent to all executors.
MOST_LIMITS = 100_000

_MARK = re.compile(r"(?:…|\.\.\.|‥|~|\s?[\[(<](?:cut|truncated|snip(?:ped)?|more|continued)[^\])>]*[\])>])\s*$", re.I)
_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", re.M)
#: How heading lines begin in the public formats of git diffs, git logs, svn diffs and mails.
_HEADINGS = (
    "diff --git a/", "index ", "--- ", "+++ ", "@@ -", "similarity index ", "rename from ", "new file mode ", "deleted file mode ", "old mode ",
    "GIT binary patch", "literal ", "delta ", "commit ", "Author: ", "Date: ", "Merge: ", "Index: ", "=" * 67, "From ", "From: ", "Subject: ",
)

#: Fixed value: what ends a git binary patch.
_BINARY_END = "HcmV?d00001"
_HASH = re.compile(r"[0-9a-f]{7,}")
_TAIL = re.compile(r"(?:[^\p{L}]?\p{L}+|[^\p{L}\p{N}]+)$")


def lengths(text: Column) -> dict[str, Column]:
    """Length of a text in the ways it may have been stored."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    returns = F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    quotes, slashes, tabs, cr = count('"'), count("\\"), count("\t"), count("\r")
    entities = 4 * count("&") + 3 * count("<") + 3 * count(">") + 5 * quotes
    escapes = quotes + slashes + tabs + lines + cr
    chars, size = F.length(text), F.octet_length(text)
    return {
        "chars": chars,
        "bytes": size,
        "entity_chars": chars + entities,
        "entity_bytes": size + entities,
        "json_chars": chars + escapes,
        "json_bytes": size + escapes,
        "crlf_chars": chars + lines - returns,
        "crlf_bytes": size + lines - returns,
    }


def stored_lengths(documents: DataFrame) -> DataFrame:
    """``(source, blank, len_...)`` of every document, each content once for an id."""
    text = F.coalesce("text", F.lit(""))
    ways = [F.coalesce(c, F.lit(0)).alias(f"len_{k}") for k, c in lengths(F.col("text")).items()]
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", source_name(F.col("source")).alias("source"), (~text.rlike(NOT_BLANK)).alias("blank"), *ways)
    return rows.dropDuplicates().drop("doc_id")


def hidden_limits(stored: DataFrame) -> DataFrame:
    """``(source, way, size, texts)``: the limits of each source, from ``stored`` with its lengths.

    Lengths lie in stretches, each of which also sees the lengths next to it, so no source is
    looked at as one group; above the stretches one row stands for each.
    """
    ways = [c for c in stored.columns if c.startswith("len_")]
    counted = (
        stored.where("source IS NOT NULL AND NOT blank")
        .select("source", F.explode(F.create_map(*[x for c in ways for x in (F.lit(c[4:]), F.col(c))])).alias("way", "size"))
        .groupBy("source", "way", "size")
        .agg(F.count(F.lit(1)).alias("texts"))
    )
    stretch = lambda c: F.floor(c / F.lit(_STRETCH))
    own = stretch(F.col("size"))
    seen = F.array_distinct(F.array(own, stretch(F.col("size") - LIMIT_AROUND), stretch(F.col("size") + LIMIT_AROUND)))
    group = ["source", "way", "_stretch"]
    near = W.partitionBy(*group).orderBy("size").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    inside = W.partitionBy(*group, "_own").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("source", "way").orderBy(F.desc("_stretch")).rowsBetween(W.unboundedPreceding, -1)
    above = counted.groupBy("source", "way", own.alias("_stretch")).agg(F.sum("texts").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_above"))
    mean = F.col("around") + F.lit(0.5)
    return (
        counted.withColumn("_stretch", F.explode(seen))
        .withColumn("_own", F.col("_stretch") == own)
        .withColumn("around", (F.sum("texts").over(near) - F.col("texts")) / F.lit(2.0 * LIMIT_AROUND))
        .withColumn("_longer", F.coalesce(F.sum("texts").over(inside), F.lit(0)))
        .where("_own")
        .where((F.col("texts") >= LIMIT_OVER * mean) & (F.col("texts") >= mean + LIMIT_DEVIATIONS * F.sqrt(mean)))
        .join(above, group)
        .where(F.col("_longer") + F.col("_above") <= F.col("texts"))
        .select("source", "way", "size", "texts")
    )


def _short_hunk(text: str) -> bool:
    """Whether the last part of a change has fewer lines than its heading announces."""
    at = text.rfind("\n@@ -")
    heading = _HUNK.match(text, at + 1) if at >= 0 else None
    if not heading:
        return False
    old, new = (int(heading[k]) if heading[k] is not None else 1 for k in (1, 2))
    rest = text[heading.end() :].split("\n")[1:]
    for n, line in enumerate(rest):
        if old <= 0 and new <= 0:
            return False
        if line == "" and n == len(rest) - 1:
            break
        if line.startswith("+"):
            new -= 1
        elif line.startswith("-"):
            old -= 1
        elif line.startswith("\\"):
            continue
        elif line == "" or line.startswith(" "):
            old, new = old - 1, new - 1
        else:
            return False
    return old > 0 or new > 0


def inspect(text: str) -> tuple[bool, bool, str | None, str | None, str | None, str, str | None]:
    """``(open, broken, mark, key, tail, head, close)`` of a text that isn't blank.

    *open*: it ends without a line end.  *broken*: a public format announces more than
    follows.  *key*: the way of ending that lines elsewhere have to show if the text is whole;
    NULL where that says nothing.  *tail*: the shape of a last word with digits.  *head*: the
    shape of the first word.  *close*: the line before the last one.
    """
    open_ = not text.endswith(("\n", "\r"))
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    body = plain.rstrip("\n")
    before, _, last = body.rpartition("\n")
    close = before.rpartition("\n")[2]
    # A mark of omission stands on the last line that isn't blank.
    found = _MARK.search(plain.rstrip().rpartition("\n")[2])
    broken = _short_hunk(plain)
    in_hunk = bool(_HUNK.search(plain)) and last[:1] in (" ", "+", "-", "\\") and not last.startswith(("--- ", "+++ "))
    if open_ and not in_hunk and any(last.startswith(h) or h.startswith(last) for h in _HEADINGS):
        broken = True
    elif open_ and last[-1:].isdigit() and last.count("(") > last.count(")"):
        broken = True
    elif "GIT binary patch" in plain and _BINARY_END not in plain[plain.rindex("GIT binary patch") :]:
        broken = True
    key = ending_key(last) if open_ and not broken else None
    return open_, broken, found[0].strip() if found else None, key, _shape(last.split()[-1:], True), _shape(text.split(None, 1)[:1], False) or "", close or None


def _shape(words: list[str], digits_only: bool) -> str | None:
    """A word with hashes as ``h`` and their length, and numbers as ``#``; with ``digits_only`` NULL for a word without any."""
    if not words or digits_only and not any(c.isdigit() for c in words[0]):
        return None
    hashes = lambda m: f"<h{len(m[0])}>" if any(c.isdigit() for c in m[0]) and not m[0].isdigit() else m[0]
    return re.sub(r"(?<!<h)\d+", "#", _HASH.sub(hashes if digits_only else "<h>", words[0]))


def _kind(c: str) -> str:
    return "" if not c else "a" if c.isalpha() else "9" if c.isnumeric() else "p"


def ending_key(line: str) -> str | None:
    """How a line ends: its last letters or signs, what precedes them, and the kind of the word before.

    NULL for a line that ends in a digit or in a hash, which say nothing.
    """
    line = line.replace("\t", " ").rstrip(" \r")
    before, _, chunk = line.rpartition(" ")
    m = _TAIL.search(chunk)
    if not m or m[0][-1].isalpha() and _HASH.search(chunk[-7:]) and any(c.isdigit() for c in chunk[-7:]):
        return None
    kind = _kind(before.rstrip(" ")[-1:])
    return f"{kind}{' ' if kind else ''}{m[0]}"


_FIELDS = (("is_open", pa.bool_()), ("broken", pa.bool_()), ("mark", pa.string()), ("key", pa.string()), ("tail", pa.string()), ("head", pa.string()), ("close", pa.string()))
_INSPECTED = "is_open boolean, broken boolean, mark string, key string, tail string, head string, close string, lines bigint"


def _inspected(df: DataFrame) -> DataFrame:
    """Rows that end in ``text`` with the fields of :func:`inspect` instead, and rows of ``key`` and ``lines``.

    The latter say how many whole lines of a batch end in the way of ``key``; NULL keys count
    the lines that say nothing.  One pass reads the texts; what is counted leaves it summed up.
    """
    rest = [c for c in df.columns if c != "text"]
    names = [*rest, *[n for n, _ in _FIELDS], "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            out = [inspect(t) if t and t.strip() else (False, False, None, None, None, "", None) for t in texts]
            cols = list(zip(*out)) if out else [[]] * len(_FIELDS)
            fields = [pa.array(list(c), t) for c, (_, t) in zip(cols, _FIELDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *fields, pa.nulls(len(out), pa.int64())], names=names)
            whole: Counter[str] = Counter()
            for t in texts:
                if t:
                    whole.update(t.split("\n")[:-1])
            endings: Counter[str | None] = Counter()
            for line, n in whole.items():
                endings[ending_key(line)] += n
            if endings:
                empty = [pa.nulls(len(endings), c.type) for c in batch.columns[: len(rest)]]
                counted = [pa.array(list(endings), t) if n == "key" else pa.nulls(len(endings), t) for n, t in _FIELDS]
                yield pa.RecordBatch.from_arrays([*empty, *counted, pa.array(list(endings.values()), pa.int64())], names=names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, "text").mapInArrow(run, f"{kinds}, {_INSPECTED}")


def _with_sources(rows: DataFrame) -> DataFrame:
    """Give texts without a source the one that nearly all texts of their beginning belong to."""
    by = rows.where("source IS NOT NULL AND NOT blank").groupBy("head", "source").agg(F.count(F.lit(1)).alias("n"))
    owner = (
        by.groupBy("head")
        .agg(F.max(F.struct("n", "source")).alias("o"), F.sum("n").alias("n"))
        .where((F.col("n") >= LEAST_TEXTS) & (F.col("o.n") >= OWN_START * F.col("n")))
        .select("head", F.col("o.source").alias("_owner"))
    )
    nobody = rows.where("source IS NULL").join(broadcast_if_small(owner, MOST_LIMITS), "head", "left")
    return rows.where("source IS NOT NULL").unionByName(nobody.withColumn("source", F.col("_owner")).select(*rows.columns))


def _terminators(stored: DataFrame) -> DataFrame:
    """``(source, head, _closing)``: the line before the last one that nearly all texts of a source and beginning share."""
    texts = stored.where("source IS NOT NULL AND NOT blank")
    many = F.greatest(F.lit(LEAST_TEXTS), F.lit(COMMON_START) * F.lit(texts.count()))
    by = texts.groupBy("source", "head", "close").agg(F.count(F.lit(1)).alias("n"))
    return (
        by.groupBy("source", "head")
        .agg(F.sum("n").alias("all"), F.max(F.when(F.col("close").isNotNull(), F.struct("n", "close"))).alias("c"))
        .where((F.col("all") >= many) & (F.col("c.n") >= TERMINATED * F.col("all")))
        .select("source", "head", F.col("c.close").alias("_closing"))
    )


def judged(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, cut, reason)`` of every document."""
    ship_package(documents.sparkSession)
    text = F.col("text")
    rows = documents.where("doc_id IS NOT NULL").select(
        "doc_id",
        source_name(F.col("source")).alias("source"),
        "n_chars",
        (~F.coalesce(text, F.lit("")).rlike(NOT_BLANK)).alias("blank"),
        *[F.coalesce(c, F.lit(0)).alias(f"len_{k}") for k, c in lengths(text).items()],
        F.coalesce(text, F.lit("")).endswith("\ufffd").alias("half"),
        "text",
    )
    seen = cut_lineage(_inspected(rows))
    texts = seen.where("doc_id IS NOT NULL").drop("lines")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(*[c for c in texts.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")
    stored = cut_lineage(_with_sources(one))
    limits = hidden_limits(stored)
    # A text is at a limit if any of its lengths is; a character cut in half shifts bytes by up to three.
    ways = [c for c in stored.columns if c.startswith("len_")]
    at = (
        limits.select("source", "way", F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3)).alias("at"), "size")
        .groupBy("source", F.concat_ws(":", "way", "at").alias("place"))
        .agg(F.min(F.abs(F.col("at") - F.col("size"))).alias("off"), F.first("way").alias("way"))
        .where((F.col("off") == 0) | F.col("way").endswith("bytes"))
        .groupBy("source")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "off"))).alias("_at"))
    )
    offs = F.array(*[F.try_element_at("_at", F.concat(F.lit(c[4:] + ":"), F.col(c))) for c in ways])
    near = F.coalesce((F.col("_off") == 0) | (F.col("_off") <= F.when(F.col("half"), 3).otherwise(2)), F.lit(False))
    placed = (
        stored.join(broadcast_if_small(at, MOST_LIMITS), "source", "left")
        .withColumn("_off", F.array_min(offs))
        .withColumn("at_limit", near)
        .select("doc_id", "source", "n_chars", "blank", "half", "is_open", "broken", "mark", "key", "tail", "head", "close", "len_chars", "at_limit")
    )
    placed = cut_lineage(placed.join(broadcast_if_small(_terminators(stored), MOST_LIMITS), ["source", "head"], "left"))
    free = placed.where("source IS NOT NULL AND NOT at_limit AND NOT broken AND NOT blank")
    closed = free.groupBy("source").agg((F.avg(F.col("is_open").cast("double")) < NATURALLY_OPEN).alias("_closed"), F.count_if("is_open").alias("_open"))
    natural = (
        free.where("is_open AND tail IS NOT NULL")
        .groupBy("source", "tail")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(closed, "source")
        .where(F.col("n") >= F.greatest(F.lit(WHOLE_WORD), NATURAL_ENDING * F.col("_open")))
        .select("source", "tail", F.lit(True).alias("_natural"))
    )
    placed = placed.join(broadcast_if_small(closed.drop("_open"), MOST_LIMITS), "source", "left").join(broadcast_if_small(natural, MOST_LIMITS), ["source", "tail"], "left")
    # Only texts with an ending to be judged ask for it; common endings are dealt out to several tasks.
    endings = seen.where("doc_id IS NULL")
    enough = max(WHOLE_WORD, WHOLE_SHARE * (endings.agg(F.sum("lines")).first()[0] or 0))
    whole = endings.where("key IS NOT NULL").groupBy("key").agg(F.sum("lines").alias("lines")).where(F.col("lines") >= enough).drop("lines").withColumn("_whole", F.lit(True))
    asking, whole = split_hot(placed.where("key IS NOT NULL"), whole, ["key"], "doc_id")
    others = placed.where("key IS NULL").withColumn("_whole", F.lit(None).cast("boolean"))
    placed = asking.join(whole, ["key", "_salt"], "left").drop("_salt").unionByName(others)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    longer = F.coalesce(F.col("n_chars") > F.col("len_chars"), F.lit(False))
    reason = (
        F.when(F.col("blank"), F.lit(None))
        .when(F.col("mark").isNotNull() & (F.col("at_limit") | (longer & F.col("is_open"))), "mark")
        .when(F.col("at_limit") & F.col("is_open") & (~yes("_natural") | F.col("half") | F.col("broken") | yes("_closed")), "limit")
        .when(F.col("_closing").isNotNull() & ~F.col("_closing").eqNullSafe(F.col("close")), "terminator")
        .when(F.col("broken"), "format")
        .when(F.col("is_open") & F.col("key").isNotNull() & ~yes("_whole") & F.coalesce("_closed", F.lit(True)), "ending")
    )
    return placed.select("doc_id", "source", reason.isNotNull().alias("cut"), reason.alias("reason"), "at_limit", "is_open", "key", "mark")


def by_source(judgement: DataFrame) -> DataFrame:
    """``(source, n_documents, n_cut, share_cut)`` of every source; NULL is a source of its own."""
    return judgement.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share_cut")
    )
