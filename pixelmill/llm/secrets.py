"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Each kind's matches are cut out with their gaps, so that positions are sums of lengths. Hashes of the candidate
values are aggregated over the corpus by document, repository and owner: a value that many owners have in many
repositories is a widely copied example; one of few owners, or of one repository, is live-looking. Live-looking tokens that no base kind covers become spans
of the kind `live`; the values of base spans get a verdict, which decides what is redacted.

Aggregations combine before they shuffle; the verdicts are written out before they are joined, so that a value that
a third of all documents hold can be split.

Defined results: a null text counts as empty and has no spans; a very long text is searched whole; rows without an id
are told apart by their texts; null repositories and owners are one repository and
one owner; repeated rows (equal id and text) count once in frequencies and each get their result; equal starts are
ordered by kind; an empty table gives an empty table; further columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# The base kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_START = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # the same as runs of any length of which shorter ones are dropped
HEX = "[0-9a-f]{32,}"
#: Runs of token characters with a letter and a digit in them.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Found in a text if any kind has a match: one pass decides for most texts.
ANY = f"{ASSIGN_START}|(?-i:{ACCESS}|{HEX}|{TOKEN})"

REDACTED = "[REDACTED]"


def _key(id_col: str, text: Column) -> Column:
    """Equal for rows of equal id and text."""
    return F.concat_ws(":", F.col(id_col).cast("string"), F.md5(text.cast("binary")))


def _matches(text: Column, kind: int, pattern: str, value: int = 0) -> Column:
    """Array of (kind, i, gap before the match, its length, length and hash of its value)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    worth = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
    gaps = F.split(text, pattern, -1)
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("m"), worth.alias("v")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("value_len"), F.md5(x["v"].cast("binary")).alias("hash")),
    )


def candidates(df: DataFrame, id_col: str, text_col: str, repo_cols: list[str], owner_col: str) -> DataFrame:
    """key, repo, owner, kind, start, stop, hash of each match of each distinct (id, text)."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(_key(id_col, text).alias("key"), text.alias("t"), F.concat_ws("/", *map(own, repo_cols)).alias("repo"), own(owner_col).alias("owner"))
    t = F.col("t")
    kinds = F.concat(_matches(t, 0, ASSIGN, 2), _matches(t, 1, ACCESS), _matches(t, 2, HEX), _matches(t, 3, TOKEN))
    found = docs.where(t.rlike(ANY)).select("key", "repo", "owner", kinds.alias("found"))
    once = found.groupBy("key").agg(F.min("repo").alias("repo"), F.min("owner").alias("owner"), F.first("found").alias("found"))  # repeated rows have the same matches
    rows = once.select("key", "repo", "owner", F.inline("found"))
    before = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("key", "kind").orderBy("i")) - F.col("len")
    rows = rows.withColumn("start", before).where((F.col("kind") != 0) | (F.col("value_len") >= ASSIGN_VALUE))
    return rows.select("key", "repo", "owner", "kind", F.col("start").cast("long"), (F.col("start") + F.col("len")).cast("long").alias("stop"), "hash")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_docs, n_repos, n_owners of each candidate value: the distinct documents, repositories and owners that have it."""
    by_doc = found.groupBy("hash", "owner", "repo", "key").agg(F.lit(1).alias("one"))
    by_place = by_doc.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n_docs"))  # few rows a value, however many documents have it
    return by_place.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: list[str] = ("source", "lang"), owner_col: str = "source", example_owners: int = 3, example_repos: int = 3) -> DataFrame:
    """key and spans: array of (start, kind, stop, example), in order, of each distinct (id, text) that has any.

    example: at least example_owners owners have the value, in at least example_repos repositories. A value in many
    repositories of one owner is that owner's, and one that many owners have in a single shared repository leaked once.
    Spans of the kind `live` are never examples and never meet a base span.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    found = scratch.table(candidates(df, id_col, text_col, list(repo_cols), owner_col), "candidates")
    wide = scratch.table(ownership(found).where((F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)).select("hash"), "examples")
    judged = found.join(wide.withColumn("example", F.lit(True)), "hash", "left").withColumn("example", F.coalesce("example", F.lit(False)))
    spans = judged.where((F.col("kind") < 3) | ~F.col("example")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "example"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    meets = lambda x: F.exists(F.col("base"), lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"]))
    return spans.withColumn("base", base).select("key", F.filter("s", lambda x: (x["kind"] < 3) | ~meets(x)).alias("spans")).where(F.size("spans") > 0)


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts, digest of the base spans, list of all spans and counts by verdict, for each row of df."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = scan(df, id_col, text_col, **options)
    rows = df.select(F.col(id_col), _key(id_col, text).alias("key")).join(found, "key", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        n(3).alias("n_live"), F.size(F.filter("spans", lambda x: x["example"])).cast("long").alias("n_example"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with each run of spans that are no examples replaced by a mark; other rows and columns, whatever their names, stay as they are."""
    found = scan(df, id_col, text_col, **options).select("key", F.filter("spans", lambda x: ~x["example"]).alias("spans")).where(F.size("spans") > 0)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    places = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # no name of df meets one made here
    id_at, text_at = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    t = F.col(text_at)

    def cut(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        gap = F.substring(t, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(state["out"], gap, F.lit(REDACTED))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], x["stop"]).alias("at"))

    done = F.aggregate("spans", start, cut, lambda s: F.concat(s["out"], F.substring(t, (s["at"] + 1).cast("int"), F.length(t))))
    joined = places.withColumn("key", _key(id_at, F.coalesce(t, F.lit("")))).join(found, "key", "left")
    joined = joined.withColumn(text_at, F.when(F.col("spans").isNull(), t).otherwise(done))
    return joined.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))
