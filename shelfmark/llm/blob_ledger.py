"""Secret scans of every version of every file, by a ledger of scanned blobs; DataFrame functions only."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern without look-around, and how long a match must be.

    ``group`` names the part of the match whose length counts. ``version`` is part of the
    ledger's key: a rule with a new version is run on all blobs again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans that start together are listed. A run of hex digits or of key
#: characters is either long enough as a whole or has no match inside, so the length is in the pattern.
RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = "blob string, rule string, spans " + SPANS


def pieces(text: Column, rule: Rule) -> Column:
    """The text as gaps, each but the last followed by a match: structs (gap, size, counted) of lengths in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = lambda c: F.transform(c, F.length)
    split = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(found).alias("size"), lengths(counted).alias("counted")
    )
    none = F.lit(None).cast("int")
    whole = F.array(F.struct(F.length(text).alias("gap"), none.alias("size"), none.alias("counted")))
    return F.when(text.rlike(rule.pattern), split).otherwise(whole)


def blob_id(text: Column) -> Column:
    """SHA-256 of the content; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) for the pairs of blob and rule version that the ledger lacks.

    ``versions`` holds one text per path and version. Equal texts are one blob and are
    scanned once: the map side keeps one text per blob, so hot blobs do not meet in one task.
    Matches and the gaps between them alternate, so a running sum of their lengths gives
    the places (code points, end exclusive); no row leaves the task of its blob for that.
    Matches are leftmost and do not overlap within a rule; those too short are dropped.
    A blob without findings gets rows with no spans, which is how the ledger knows it.
    Append the rows to the ledger before the next scan.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = versions.select(blob_id(content).alias("blob"), content.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    names = F.array(*(F.lit(rule.key) for rule in rules))
    if ledger is None:
        todo = blobs.withColumn("todo", names)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
    per_rule = F.array(
        *(
            F.when(
                F.array_contains("todo", rule.key),
                F.struct(
                    F.lit(rule.key).alias("rule"),
                    F.lit(rank).alias("rank"),
                    F.lit(rule.kind).alias("kind"),
                    F.lit(rule.least).alias("least"),
                    pieces(F.col("content"), rule).alias("pieces"),
                ),
            )
            for rank, rule in enumerate(rules)
        )
    )
    row = (
        todo.where(F.size("todo") > 0)
        .select("blob", F.explode(F.array_compact(per_rule)).alias("row"))
        .select("blob", "row.rule", "row.rank", "row.kind", "row.least", F.posexplode("row.pieces").alias("i", "piece"))
    )
    size = F.coalesce("piece.size", F.lit(0))
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("piece.gap") + size).over(upto).cast("int")
    span = F.when(
        F.col("piece.counted") >= F.col("least"),
        F.struct((F.col("end") - size).alias("start"), "rank", "kind", F.col("end").alias("end")),
    )
    return row.withColumn("end", end).groupBy("blob", "rule").agg(F.sort_array(F.collect_list(span)).cast(SPANS).alias("spans"))


def write_ledger(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(folder)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (blob, spans) for each blob that has any: spans of all given rule versions by start, then rule order."""
    return (
        ledger.where(F.col("rule").isin([rule.key for rule in rules]) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )


def with_findings(versions: DataFrame, found: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Every version row with the spans of its blob; an empty list for clean ones."""
    key = "__blob"
    return (
        versions.withColumn(key, blob_id(F.col(text).cast("string")))
        .join(found.select(F.col("blob").alias(key), F.col("spans").alias(into)), key, "left")
        .withColumn(into, F.coalesce(F.col(into), F.array().cast(SPANS)))
        .drop(key)
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [kind]; overlapping spans become one.

    The spans (by start) are first reduced to the parts of the text that stay. These are cut
    out of its UTF-32 form, where a place is found without walking over what is before it.
    """
    begin = F.expr("struct(0 AS at, cast(array() AS array<struct<begin: int, end: int, kind: string>>) AS parts)")

    def step(state: Column, span: Column) -> Column:
        part = F.struct(state["at"].alias("begin"), span["start"].alias("end"), span["kind"].alias("kind"))
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.array_append(state["parts"], part)).otherwise(state["parts"]).alias("parts"),
        )

    def cut(units: Column, first: Column, last: Column) -> Column:
        return F.decode(F.substring(units, 4 * first + 1, 4 * (last - first)), "UTF-32")

    def rebuilt(row: Column) -> Column:
        parts = F.transform(row["kept"]["parts"], lambda p: F.concat(cut(row["units"], p["begin"], p["end"]), F.lit("["), p["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(row["units"], row["kept"]["at"], row["length"]))

    # One entry through a transform, so that what its parts share is computed once.
    row = F.struct(F.encode(text, "UTF-32").alias("units"), F.length(text).alias("length"), F.aggregate(spans, begin, step).alias("kept"))
    return F.when(F.size(spans) == 0, text).otherwise(F.get(F.transform(F.array(row), rebuilt), 0))


def document_secrets(docs: DataFrame, ledger_folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans of every document, through the ledger (a fresh one unless a folder is given).

    The documents are the versions: the text is read once to fill the ledger and once,
    for its hash only, to join findings back. Null and empty texts have no findings;
    repeated rows give repeated results.
    """
    spark = docs.sparkSession
    versions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ledger_folder is None:
        ledger = saved(scan(versions, None, rules), "ledger")
    else:
        from shelfmark.sources import storage

        known = read_ledger(spark, ledger_folder) if storage.exists(spark, ledger_folder) else None
        write_ledger(saved(scan(versions, known, rules), "scan"), ledger_folder)
        ledger = read_ledger(spark, ledger_folder)
    return with_findings(versions, findings(ledger, rules)).drop("text")
