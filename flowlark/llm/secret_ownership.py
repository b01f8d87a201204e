"""Secret scan with corpus-wide ownership frequency, in built-in expressions only.

Candidates come from patterns; the digest of each candidate's value is counted
over the whole corpus by distinct repositories (documents) and owners
(sources).  A value that many owners hold is a widely copied example; one that
a single owner holds and that looks random is likely to be live.  Patterns of
weak evidence (``GENERIC``) become spans only when the counts say so.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the
n + 1 pieces and n matches alternate, so running sums of their lengths give
every start in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

# Fixed values of the contract: kinds in their listed order, and least lengths.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": 0, "access": 1, "hex": 2}
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Added by the method.
EXTRA = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
GENERIC = r"[A-Za-z0-9+/_=-]{24,}"
#: A value of this many owners, or repositories, is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 20
_SPAN = "array<struct<before:int,match:string>>"


def _alternating(text: Column, pattern: str, guard: str | Column | None = None) -> Column:
    """Per match the length of the piece before it, and the match."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        matches,
        pieces,
        lambda m, p: F.struct(F.char_length(p).alias("before"), m.alias("match")),
    )
    seen = text.rlike(guard or pattern) if not isinstance(guard, Column) else guard
    # pieces has one element more, which comes last with a null match
    return F.when(seen, F.filter(pairs, lambda x: x["match"].isNotNull())).otherwise(
        F.array().cast(_SPAN)
    )


def candidates(documents: DataFrame) -> DataFrame:
    """``rid, doc_id, owner`` and per kind the matches with the gaps before them."""
    text = F.col("text")
    docs = documents.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    columns = {
        "assign": _alternating(text, ASSIGN),
        "access": _alternating(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        # runs that are too short never match, and a run that is long enough matches whole
        "hex": _alternating(text, HEX[:-1] + "{16,}"),
        "github": _alternating(text, EXTRA["github"], text.rlike("gh[pousr]_")),
        "slack": _alternating(text, EXTRA["slack"], F.contains(text, F.lit("xox"))),
        "jwt": _alternating(text, EXTRA["jwt"], F.contains(text, F.lit("eyJ"))),
        "pem": _alternating(text, EXTRA["pem"], F.contains(text, F.lit("-----BEGIN"))),
        "generic": _alternating(text, GENERIC),
    }
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "owner",
        *[c.alias(k) for k, c in columns.items()],
    )


def _rank(kind: Column) -> Column:
    order = [*BASE, *EXTRA, "generic"]
    return F.array_position(F.array(*[F.lit(k) for k in order]), kind).cast("int")


def _value(kind: Column, match: Column) -> Column:
    """What would be the secret: group 2 of an assignment, else the match."""
    return F.when(kind == "assign", F.regexp_extract(match, ASSIGN, 2)).otherwise(match)


def spans(found: DataFrame) -> DataFrame:
    """``rid, owner, kind, start, end, digest, random`` of every candidate that is long enough."""
    kinds = [*BASE, *EXTRA, "generic"]
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in kinds])
    rows = (
        found.where(F.greatest(*[F.size(k) for k in kinds]) > 0)
        .select("rid", "owner", F.explode(parts).alias("p"))
        .select("rid", "owner", "p.kind", F.posexplode("p.m").alias("at", "x"))
        .select("rid", "owner", "kind", "at", "x.before", "x.match")
    )
    up_to = Window.partitionBy("rid", "kind").orderBy("at")
    rows = rows.withColumn(
        "end", F.sum(F.col("before") + F.char_length("match")).over(up_to)
    ).withColumn("value", _value(F.col("kind"), F.col("match")))
    long_enough = F.lit(True)
    for kind, least in LEAST.items():
        long_enough &= (F.col("kind") != kind) | (F.char_length("value") >= least)
    letters = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    varied = F.size(F.array_distinct(F.split("value", ""))) >= 8
    generic = (F.col("kind") != "generic") | (
        letters & varied & ~F.col("value").rlike("^[0-9a-f]+$")
    )
    return rows.where(long_enough & generic).select(
        "rid",
        "owner",
        "kind",
        (F.col("end") - F.char_length("match")).alias("start"),
        "end",
        F.sha2("value", 256).alias("digest"),
        (letters & varied).alias("random"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_owners, n_repositories`` over the whole corpus.

    Two grouped counts, both combined before they are shuffled, so a value
    held by a third of all rows is a few partial counts per task.
    """
    held = found.select("digest", "owner", "rid").distinct()
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("digest").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Per document row its secret spans and what their ownership says.

    Returns ``doc_id, n_assign, n_access, n_hex, base, spans, n_live,
    n_example``; ``base`` and ``spans`` are the texts ``kind:start:end``
    joined by commas, by start and then kind.  Null and empty texts have no
    spans; a null source counts as one unnamed owner; repeated rows are
    answered one by one and count as repositories of their own; other columns
    are not read.
    """
    scanned = materialize(candidates(documents), "secret-candidates")
    found = materialize(spans(scanned), "secret-spans")
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (
        F.col("n_repositories") >= EXAMPLE_REPOSITORIES
    )
    judged = (
        found.join(ownership(found), "digest")
        .withColumn("verdict", F.when(copied, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unsure"))
        .where((F.col("kind") != "generic") | (F.col("verdict") == "live"))
    )
    one = F.struct(
        "start",
        _rank(F.col("kind")).alias("rank"),
        F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"),
    )
    is_base = F.col("kind").isin(*BASE)
    number = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    text = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["span"]), ",")
    by_row = judged.groupBy("rid").agg(
        *[number(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        number(F.col("verdict") == "live").alias("n_live"),
        number(F.col("verdict") == "example").alias("n_example"),
        text(F.collect_list(F.when(is_base, one))).alias("base"),
        text(F.collect_list(one)).alias("spans"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return scanned.select("rid", "doc_id").join(by_row, "rid", "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), none("base"), none("spans"),
        zero("n_live"), zero("n_example"),
    )
