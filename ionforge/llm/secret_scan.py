"""Operator 12, secret scans by an incremental blob ledger.

A text is a blob, known by its SHA-256.  The ledger is a folder of two tables:
``seen`` has the rules, by name and version, that each blob has been scanned
with, and ``found`` the places.  :func:`update` scans only blobs for rules that
``seen`` lacks, one text of each blob; :func:`findings` joins what the ledger
has back to every row with such a text, whether its blob was scanned now or
years ago.  A rule whose version changes is scanned anew, and only that rule.

Only DataFrame functions are used.  Which row stands for a blob is decided on
ids and digests, and a text is read where it lies, but for rows whose digest
falls in the same of 2**20 buckets as one that need not be read.  A
place is the running sum of the lengths of what ``split`` leaves between the
matches and of the matches, in blocks, so that the work grows with the text
and not with its square.  Found places are joined by digest, and only to rows
whose text has some; a blob that many rows share is a skewed key of that join,
which adaptive execution splits.

Defined results: one row out for each row in, repeated rows included; a null
text counts as an empty one, which holds nothing; null ids are ids like others.
Columns other than id and text are ignored, whatever their names.  An empty
table gives an empty result.  Rows with the id and text of one that stands for a
blob are scanned as well, with one finding kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY_BUCKETS, new_path, rows_with_keys, rows_without_keys, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hints`` are such that every match contains one of them, letters in lower
    case: texts without any are looked at no further.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either_case('api')}_?{_either_case('key')}"

#: In the order in which kinds are listed where they start at one place.
RULES = (
    Rule("assign", rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ("password", "passwd", "secret", "token", "apikey", "api_key"), base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",), base=True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, base=True),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{16,}", 0, 1, ("bearer",)),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{30,}", 0, 1, ("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]+", 0, 1, ("eyj",)),
    Rule("privatekey", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 1, ("private key",)),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@[A-Za-z0-9.-]+", 0, 1, ("://",)),
)

#: Matches whose lengths are summed up at once; the work for n of them is n * BLOCK + (n / BLOCK) ** 2.
BLOCK = 256


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers."""
    add = lambda a, x: F.struct((a.total + x).alias("total"), F.array_append(a.out, a.total + x).alias("out"))
    start = lambda total: F.struct(total.cast("long").alias("total"), F.lit([]).cast("array<long>").alias("out"))

    def of(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK)).cast("int"))
        blocks = F.transform(at, lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

        def joined(b: Column) -> Column:
            sums = F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y))
            before = _bound(sums, lambda s: F.aggregate(s, start(F.lit(0)), add).out)
            return _bound(before, lambda c: F.flatten(F.transform(b, lambda x, k: F.aggregate(x, start(F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(c, k - 1))), add).out)))

        return _bound(blocks, joined)

    return _bound(F.transform(values, lambda x: x.cast("long")), of)


def places(text: Column, small: Column, rule: Rule) -> Column:
    """The rule's matches in a text as array<struct<start, end>>, in code points from 0, the end excluded.

    Matches are the leftmost ones that don't overlap; those that are too short
    are dropped afterwards.  ``small`` is the text in lower case.
    """

    def cut(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
        kept = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
        sizes = F.struct(F.transform(whole, F.length).alias("m"), F.transform(kept, F.length).alias("g"), F.transform(F.split(t, rule.pattern, -1), F.length).alias("p"))
        return _bound(sizes, lambda s: _bound(F.struct(s.m.alias("m"), s.g.alias("g"), running_sums(F.transform(s.m, lambda x, i: x + F.get(s.p, i))).alias("ends")), listed))

    def listed(s: Column) -> Column:
        each = F.transform(s.ends, lambda e, i: F.struct((e - F.get(s.m, i)).alias("start"), e.alias("end"), F.get(s.g, i).alias("n")))
        return F.transform(F.filter(each, lambda x: x.n >= rule.least), lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))

    none = F.lit([]).cast("array<struct<start:long,end:long>>")
    may = F.lit(True)
    if rule.hints:
        may = F.lit(False)
        for h in rule.hints:
            may = may | F.contains(small, F.lit(h))
    # a plain test comes first: few texts hold any match
    return F.when(may & text.rlike(rule.pattern), _bound(text, cut)).otherwise(none)


def _tables(spark: SparkSession, ledger: str) -> tuple[DataFrame, DataFrame]:
    seen = spark.read.schema("blob string, rules array<string>").parquet(f"{ledger}/seen")
    found = spark.read.schema("blob string, rule string, places array<struct<start:long,end:long>>").parquet(f"{ledger}/found")
    return seen, found


def new_ledger(spark: SparkSession, path: str | None = None) -> str:
    """An empty ledger, by default in the shared folder."""
    path = path or new_path(spark, "secret-ledger")
    for name, schema in (("seen", "blob string, rules array<string>"), ("found", "blob string, rule string, places array<struct<start:long,end:long>>")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
    return path


def paths_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob) of every row, written."""
    return written(df.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob")), "secret-paths")


def update(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", paths: DataFrame | None = None) -> None:
    """Scan what the ledger has not seen of the texts of ``df``, and write it down.

    ``found`` is written before ``seen``: should the run end between the two,
    its blobs count as unseen, and findings that stand there twice are one.
    """
    spark = df.sparkSession
    names = [r.name for r in rules]
    paths = paths or paths_of(df, id_col, text_col)
    blobs = paths.groupBy("blob").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = _tables(spark, ledger)[0].groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("rules"))
    none = F.lit([]).cast("array<string>")
    todo = blobs.join(before, "blob", "left").withColumn("todo", F.array_except(F.lit(names), F.coalesce("rules", none)))
    todo = written(todo.select("blob", "first", "n", "todo"), "secret-todo")
    # rows whose text need not be read: those of blobs seen with all rules, and those for which another row stands
    known = paths.join(todo.filter(F.size("todo") == 0).select("blob"), "blob", "left_semi").select("blob", "id")
    copies = paths.join(todo.filter((F.size("todo") > 0) & (F.col("n") > 1)).select("blob", "first"), "blob").filter(~F.col("id").eqNullSafe(F.col("first")))
    skip = written(known.unionByName(copies.select("blob", "id")).distinct(), "secret-skip")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), blob_of(F.col(text_col)).alias("blob"))
    unread = rows_without_keys(rows, skip, ["blob", "id"]).select("blob", "text")
    # few blobs have been scanned with some rules and not with others
    part = written(todo.filter((F.size("todo") > 0) & (F.size("todo") < len(rules))).select("blob", "todo"), "secret-part")
    some = rows_with_keys(unread, part, ["blob"]).join(part, "blob")
    whole = rows_without_keys(unread, part.select("blob"), ["blob"]).withColumn("todo", F.lit(names))
    hits = whole.unionByName(some).withColumn("small", F.lower("text"))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("todo", r.name), places(F.col("text"), F.col("small"), r)).alias("places")) for r in rules))
    hits.select("blob", F.explode(each).alias("x")).select("blob", "x.rule", "x.places").filter(F.size("places") > 0).write.mode("append").parquet(f"{ledger}/found")
    todo.filter(F.size("todo") > 0).select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/seen")


def findings(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", paths: DataFrame | None = None) -> DataFrame:
    """(id, blob, found) of each row; ``found`` is array<struct<start, rank, kind, end>>, sorted.

    ``rank`` is the kind's place among ``rules``.  Rows whose text the ledger
    has not seen have an empty ``found``.
    """
    spark = df.sparkSession
    paths = paths or paths_of(df, id_col, text_col)
    rank, kind = F.lit(0), F.lit("")
    for i, r in enumerate(rules):
        rank = F.when(F.col("rule") == r.name, i).otherwise(rank)
        kind = F.when(F.col("rule") == r.name, r.kind).otherwise(kind)
    found = _tables(spark, ledger)[1].filter(F.col("rule").isin([r.name for r in rules]))
    listed = F.transform("places", lambda x: F.struct(x.start.alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"), x.end.alias("end")))
    by_blob = written(found.withColumns({"rank": rank, "kind": kind}).select("blob", listed.alias("f")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("f"))).alias("found")), "secret-found")
    # rows whose digest falls in no bucket of a blob with findings are not shuffled
    bucket = F.pmod(F.xxhash64("blob"), F.lit(KEY_BUCKETS))
    buckets = F.broadcast(by_blob.select(bucket.alias("bucket")).distinct())
    marked = paths.withColumn("bucket", bucket)
    none = F.lit([]).cast(by_blob.schema["found"].dataType)
    clear = marked.join(buckets, "bucket", "left_anti").withColumn("found", none)
    rest = marked.join(buckets, "bucket", "left_semi").join(by_blob, "blob", "left")
    out = clear.select("id", "blob", "found").unionByName(rest.select("id", "blob", F.coalesce("found", none).alias("found")))
    return out.withColumnRenamed("id", id_col)


def scan(df: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Update the ledger, a new one by default, with the texts of ``df`` and return their :func:`findings`."""
    ledger = ledger or new_ledger(df.sparkSession)
    paths = paths_of(df, id_col, text_col)
    update(df, ledger, rules, id_col, text_col, paths)
    return findings(df, ledger, rules, id_col, text_col, paths)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``found`` as counts, a digest of the base rules' places, and a list of all places."""
    base = [r.kind for r in rules if r.base]
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in base]
    return found.select(
        *(c for c in found.columns if c not in ("found", "blob")),
        *counts,
        F.sha2(text(F.filter("found", lambda x: x.kind.isin(base))), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )
