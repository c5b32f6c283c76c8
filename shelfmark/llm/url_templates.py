"""URL filters: rules by host and path, and per host a tree of path templates judged by their labelled pages.

DataFrame functions only. A path is cut into segments, digits in them become 0. A node of
a host's tree is the sequence of kinds of the segments before it; of its segments,
numbers and frequent ones stay, all others are one wildcard. Segments of a node that are followed by
the same mixture of kinds and are blocked by rules as often are one branch. Templates of
which rules block a large share, smoothed towards the host's share and that towards the share of all
pages, are rejected.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved, small

#: verdict, host, path: a rule holds for its host, all subdomains, and paths that begin with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Segments with a level of their own; what follows them is one more segment.
LEVELS = 12
#: A segment stays if it has at least so many pages and this share (percent) of its node's; at most 50 do.
LEAST_PAGES = 5
LEAST_PERCENT = 2
#: How far shares of a branch may lie from its node's; sampling errors are added.
SLACK = 0.05
#: Pages that the wider scope's share counts as, and the smoothed share from which a template is rejected.
SMOOTHING = 5.0
REJECT = 0.6

ANY, MERGED = "*", "~"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lowered; empty without :// or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together; of equally long ones that with the longer host) that fits, and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def masked(path: Column) -> Column:
    """The path's segments that are not empty, digits as one 0, between single slashes."""
    plain = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(F.lit("/"), F.array_join(F.array_remove(F.split(plain, "/", -1), ""), "/"))


def _kind(segment: Column) -> Column:
    """n: a number, m: letters and digits, w: no digit; with the ending of a file name."""
    base = F.when(segment == "0", "n").when(F.contains(segment, F.lit("0")), "m").otherwise("w")
    return F.concat(base, F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0))


def _places(paths: DataFrame, levels: int) -> DataFrame:
    """One row per path and segment: i, node (kinds before it), segment, rest (kinds after it); the others of the columns stay."""
    named = F.split(F.substring("masked", 2, 2**31 - 1), "/", levels + 1)  # the last one holds all that follows
    segments = paths.where("masked != '/'").select("*", named.alias("segments"))
    rows = segments.select("*", F.transform("segments", _kind).alias("kinds")).select(
        *paths.columns, "kinds", F.posexplode("segments").alias("i", "segment")
    )
    kinds = F.col("kinds")
    return rows.select(
        *paths.columns, "i", "segment",
        F.array_join(F.slice(kinds, 1, F.col("i")), "/").alias("before"),
        F.array_join(F.slice(kinds, F.col("i") + 2, F.size(kinds)), "/").alias("rest"),
    ).withColumn("node", F.concat_ws("/", F.col("i"), "before")).drop("before")


def branches(places: DataFrame) -> DataFrame:
    """host, node, segment, token: the segments that are no wildcard; token is MERGED for those that go as one branch.

    A branch is like its node if half the summed differences of their shares of rests, and the difference of their
    blocked shares, are within the slack and the sampling error of the branch's pages.
    """
    key = ["host", "node"]
    sums = [F.sum(c).alias(c) for c in ("pages", "blocked", "labelled")]
    children = saved(places.groupBy(*key, "segment").agg(*sums), "children")
    totals = children.groupBy(*key).agg(F.sum("pages").alias("total"))
    frequent = children.where(F.col("pages") >= LEAST_PAGES).join(totals, key).where(100 * F.col("pages") >= LEAST_PERCENT * F.col("total"))
    frequent = saved(frequent.drop("total"), "frequent")
    # Places meet the frequent segments of their node in a join whose right side has at most 50 rows a node.
    kept = small(frequent.select(*key, "segment"))
    profile = saved(places.join(kept, [*key, "segment"]).groupBy(*key, "segment", "rest").agg(F.sum("pages").alias("pages")), "profile")
    pool = profile.groupBy(*key, "rest").agg(F.sum("pages").alias("pool"))
    node = profile.groupBy(*key).agg(F.sum("pages").alias("all"), F.countDistinct("rest").alias("rests"))
    node = saved(node.join(frequent.groupBy(*key).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m")), key), "nodes")
    shares = (
        profile.join(pool, [*key, "rest"])
        .join(node.select(*key, "all"), key)
        .join(frequent.select(*key, "segment", F.col("pages").alias("own")), [*key, "segment"])
        .groupBy(*key, "segment")
        .agg(
            F.sum(F.abs(F.col("pages") / F.col("own") - F.col("pool") / F.col("all"))).alias("differ"),
            F.sum(F.col("pool") / F.col("all")).alias("met"),
        )
    )
    distance = F.round((F.col("differ") + 1 - F.col("met")) / 2, 6)
    alike = distance <= F.round(SLACK + F.sqrt(F.col("rests") / F.col("pages")), 6)
    off = F.round(F.abs(F.col("blocked") / F.nullif("labelled", F.lit(0)) - F.col("b") / F.nullif("m", F.lit(0))), 6)
    as_blocked = F.coalesce(off <= F.round(SLACK + F.sqrt(1 / F.nullif("labelled", F.lit(0))), 6), F.lit(True))
    judged = frequent.join(shares, [*key, "segment"]).join(node, key).withColumn("like", alike & as_blocked)
    together = F.sum(F.col("like").cast("int")).over(Window.partitionBy(*key))
    token = F.when(F.col("like") & (together > 1), F.lit(MERGED)).otherwise(F.col("segment"))
    return judged.select(*key, "segment", token.alias("token"))


def templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, masked, template of each row of ``paths`` (host, masked, pages, blocked, labelled; one row per host and path)."""
    places = _places(paths, levels)
    decided = small(saved(branches(places), "branches"))
    other = F.when(F.col("segment") == "0", F.lit("0")).otherwise(F.lit(ANY))
    tokens = places.join(decided, ["host", "node", "segment"], "left").select("host", "masked", "i", F.coalesce("token", other).alias("token"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "token"))), lambda t: t["token"])
    made = tokens.groupBy("host", "masked").agg(F.concat(F.lit("/"), F.array_join(ordered, "/")).alias("template"))
    return made.union(paths.where("masked = '/'").select("host", "masked", F.lit("/").alias("template")))


def judged_templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, masked, template, labelled, purity, rejected: purity is the smoothed share of the template's labelled pages that rules block."""
    rows = saved(templates(paths, levels).join(paths, ["host", "masked"]), "templates")
    everything = paths.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m")).head()
    prior = ((everything["b"] or 0) + 1.0) / ((everything["m"] or 0) + 2.0)
    sums = [F.sum("blocked").alias("b"), F.sum("labelled").alias("m")]
    of_template = rows.groupBy("host", "template").agg(*sums)
    of_host = rows.groupBy("host").agg(F.sum("blocked").alias("host_b"), F.sum("labelled").alias("host_m"))
    host_share = (F.col("host_b") + SMOOTHING * prior) / (F.col("host_m") + SMOOTHING)
    purity = F.round((F.col("b") + SMOOTHING * host_share) / (F.col("m") + SMOOTHING), 6)
    shares = of_template.join(of_host, "host").select(
        "host", "template", F.col("m").alias("template_labelled"), purity.alias("purity"),
        ((F.col("host_m") > 0) & (purity >= REJECT)).alias("rejected"),
    )
    return rows.join(small(saved(shares, "shares")), ["host", "template"]).select(
        "host", "masked", "template", F.col("template_labelled").alias("labelled"), "purity", "rejected"
    )


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, levels: int = LEVELS, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, purity for each row of ``pages``.

    Pages with a rule are the labels; the others are blocked if their host has any labelled page and their
    template is rejected, else allowed. A null URL or one without :// has an empty host and path
    and is judged as they are. Repeated rows count and are returned each time; page_id may be null.

    Pages become one row per host and masked path before anything is compared, so that a
    host with a third of all pages is a few rows per task; joins by host then meet at most
    50 segments of a node.
    """
    link = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = saved(rows.select("*", name.alias("rule"), verdict.alias("by_rule"), masked(F.col("path")).alias("masked")), "urls")
    paths = rows.groupBy("host", "masked").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum((F.col("by_rule") == "block").cast("long")).alias("blocked"),
        F.count("by_rule").alias("labelled"),
    )
    paths = saved(paths.withColumn("blocked", F.coalesce("blocked", F.lit(0))), "paths")
    found = small(saved(judged_templates(paths, levels), "judged"))
    return rows.join(found, ["host", "masked"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "labelled", "purity",
    )
