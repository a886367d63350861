"""Secrets in texts, and how widely each candidate is copied.

Three base patterns find secrets by their form. Further candidates are long
tokens of mixed characters. Every candidate's hash is counted over the distinct
texts of the corpus by distinct repositories and owners: a value that several
owners hold is a copied example, one that a single owner holds in few
repositories looks live. Copied candidates stay findings, marked as not live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.operators.skew import lookup_join
from stayrate.session import settle

# The base patterns, with the group that holds the value and the
# least length of that group.
KINDS = (
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the method: long tokens; those without a digit or letter are dropped.
TOKEN = ("owned", r"[A-Za-z0-9+/_-]{16,}", 0, 16)
#: A value of more owners is a copied example; a live one is in few repositories.
LIVE_OWNERS = 1
LIVE_REPOSITORIES = 3


def _matches(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern: characters before each since the last one, size, value hash.

    The pieces between the matches and the matches themselves alternate. A match
    whose value does not qualify has no hash; its length still counts for places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.arrays_zip(between.alias("skip"), whole.alias("whole"), value.alias("value"))

    def match(row: Column, place: Column) -> Column:
        good = F.length(row["value"]) >= least
        if order == len(KINDS):
            good = good & _live_looking(row["value"])
        return F.struct(
            F.lit(order).alias("ord"),
            place.alias("place"),
            F.length(row["skip"]).alias("skip"),
            F.length(row["whole"]).alias("size"),
            F.when(good, F.sha2(row["value"], 256)).alias("hash"),
        )

    none = F.array().cast("array<struct<ord:int,place:int,skip:int,size:int,hash:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(rows, match)).otherwise(none)


def _live_looking(value: Column) -> Column:
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))


def _spans(scanned: DataFrame) -> DataFrame:
    """``row``, ``ord``, ``start``, ``stop`` and ``hash`` of every finding, by running totals.

    Ends of matches are running sums within a text and pattern. A candidate stays
    if no base span before it reaches into it and none behind it starts in it, so
    the work grows with the matches of a text, not with their square.
    """
    text = Window.partitionBy("row")
    along = Window.partitionBy("row", "ord").orderBy("place")
    before = text.orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    behind = text.orderBy(F.desc("start"), F.desc("ord")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    is_base = F.col("ord") < len(KINDS)
    placed = (
        scanned.select("row", F.inline("matches"))
        .withColumn("stop", F.sum(F.col("skip") + F.col("size")).over(along).cast("int"))
        .withColumn("start", F.col("stop") - F.col("size"))
        .where("hash IS NOT NULL")
        .withColumn("reached", F.max(F.when(is_base, F.col("stop"))).over(before))
        .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(behind))
    )
    apart = (F.coalesce("reached", "start") <= F.col("start")) & (
        F.coalesce("next", "stop") >= F.col("stop")
    )
    return placed.where(is_base | apart).select("row", "ord", "start", "stop", "hash")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Every document, and every finding, both written.

    Documents are ``row``, id, ``repository``, ``owner``, ``text`` (a hash) and
    the raw ``matches``; findings are (row, ord, start, stop, value hash). Those of the last
    ``ord`` are candidates that overlap no base span.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = [*KINDS, TOKEN]
    found = F.concat(*(_matches(text, i, p, g, n) for i, (_, p, g, n) in enumerate(patterns)))
    scanned = settle(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(repository_col).cast("string").alias("repository"),
            F.col(owner_col).cast("string").alias("owner"),
            F.md5(text.cast("binary")).alias("text"),
            found.alias("matches"),
        )
    )
    return scanned, settle(_spans(scanned))


def ownership(scanned: DataFrame, spans: DataFrame) -> DataFrame:
    """``hash``, ``n_spans``, ``n_repositories``, ``n_owners`` and ``live`` of every value.

    Equal texts speak once, for the least of their repositories and owners: a
    document that is copied as a whole does not make its secret an example.
    Distinct texts, repositories and owners are counted in steps that each
    combine before they shuffle, so a value in a third of all documents is no hot
    key.
    """
    holder = F.struct("repository", "owner")
    texts = scanned.where(F.size("matches") > 0).groupBy("text").agg(F.min(holder).alias("holder"))
    counted = spans.groupBy("row", "hash").agg(F.count("*").alias("n"))
    held = scanned.select("row", "text").join(counted, "row")
    held = held.groupBy("hash", "text").agg(F.sum("n").alias("n"))
    values = held.join(texts, "text").select("hash", "holder.*", "n")
    pairs = values.groupBy("hash", "owner", "repository").agg(F.sum("n").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(
        F.sum("n").alias("n"), F.count("*").alias("repositories")
    )
    totals = owners.groupBy("hash").agg(
        F.sum("n").alias("n_spans"),
        F.sum("repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"),
    )
    live = (F.col("n_owners") <= LIVE_OWNERS) & (F.col("n_repositories") <= LIVE_REPOSITORIES)
    return totals.withColumn("live", live)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
) -> DataFrame:
    """One row per document: ``row`` (a number), id, and ``findings``.

    Findings are (start, ord, kind, stop, hash, n_repositories, n_owners, live),
    sorted by start and kind: every base match, and the candidates of kind
    ``owned`` that overlap none; ``live`` tells those of one owner from copied
    examples. Places are code points, ends exclusive. A null text counts as empty;
    null is one repository or owner more, apart from the empty string. A repeated
    row is a document of its own, and equal texts count once for ownership. An
    empty table gives no rows; other columns are not read.
    """
    scanned, spans = scan_secrets(docs, id_col, text_col, repository_col, owner_col)
    owned = settle(ownership(scanned, spans))
    total = owned.agg(F.sum("n_spans")).scalar()
    names = F.array(*(F.lit(kind) for kind, *_ in (*KINDS, TOKEN)))
    judged = lookup_join(spans, owned, ["hash"], "n_spans", total)
    judged = judged.withColumn("kind", F.get(names, F.col("ord")))
    finding = F.struct(
        "start", "ord", "kind", "stop", "hash", "n_repositories", "n_owners", "live"
    )
    lists = judged.groupBy("row").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    empty = F.array().cast(lists.schema["findings"].dataType)
    return (
        scanned.select("row", "id")
        .join(lists, "row", "left")
        .select("row", F.col("id").alias(id_col), F.coalesce("findings", empty).alias("findings"))
    )
