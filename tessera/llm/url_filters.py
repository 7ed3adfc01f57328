"""URL filters: dated list entries become validity intervals, and an as-of join finds those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, unused

#: Intervals are broadcast up to this many rows; beyond it the join shuffles, and adaptive execution splits hot hosts.
BROADCAST_ROWS = 200_000


#: Scheme, authority up to a slash (either way), question mark or number sign, and the rest of an absolute URL.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/\\?#]*)"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without final dots; null if there is none.

    User and password end at the authority's last @; a port is digits after the last colon, outside the brackets of an address.
    """
    authority = F.regexp_extract(url, AUTHORITY, 1)
    host = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(host.startswith("["), F.regexp_extract(host, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_replace(host, r":.*$", ""))
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of an absolute URL, without query and fragment and without the first slash; a backslash counts as a slash."""
    return F.translate(F.regexp_extract(url, AUTHORITY + r"[/\\]([^?#]*)", 2), "\\", "/")


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which an entry of a list is active, from its dated additions and removals.

    entries has list_name, action (block or allow), pattern, change (add or remove) and
    dated. An addition lasts until the entry's next change, or for ever. Of changes on
    one day the removal comes last and holds.
    """
    changes = entries.where("pattern IS NOT NULL AND dated IS NOT NULL").distinct()
    changes = changes.withColumn("pattern", F.lower(F.trim("pattern")))
    nearest = "lead(dated) OVER (PARTITION BY list_name, action, pattern ORDER BY dated, change)"
    return (
        changes.selectExpr("list_name", "action", "pattern", "change", "dated AS valid_from", f"{nearest} AS valid_to")
        .where("change = 'add' AND (valid_to IS NULL OR valid_to > valid_from)")
        .drop("change")
    )


def filter_urls(
    captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at"
) -> DataFrame:
    """Evaluates every capture against the entries active on the day it was fetched.

    A pattern is a domain, which covers its subdomains, or a host with the start of a
    path, which covers the paths below it. Of the active entries that cover a capture, the
    one with the longest pattern decides; of equal ones `allow` before `block`, then the
    first list by name. Returns the captures' columns with host, decision (allow, block,
    none, or invalid for a URL without host or a missing date), list_name, pattern and
    n_active; columns of the captures with these names are replaced, and all others kept.

    Captures of one URL and day are judged once, and every capture meets its verdict
    again by (URL, day): repeated rows keep their number. The candidate patterns of a URL
    are its host's suffixes and its path's prefixes, as long and as deep as any pattern is, so
    they are few for a very long URL too; the join is on equal patterns, and the interval
    decides among them. A hot host's captures are spread by URL and day, and verdicts are
    read back from a staged table, so that adaptive execution can split a hot URL. The
    intervals are staged, and broadcast while they are few, by a count; beyond it a hot
    pattern's join is split likewise. An empty list decides nothing, and an empty table of captures gives
    an empty result. A null URL or date makes a capture invalid.
    """
    added = ("host", "decision", "list_name", "pattern", "n_active")
    captures = captures.select(*[c for c in captures.columns if c.lower() not in added])
    at, day, best, many = (unused(name, captures) for name in ("_url", "_day", "_best", "_n"))
    keyed = captures.withColumns({at: F.col(url), day: F.to_date(F.col(fetched))})
    scratch = Scratch(captures.sparkSession, "url-filters")
    intervals = scratch.stage(validity(entries), "intervals")
    host, path = F.substring_index("pattern", "/", 1), F.size(F.split("pattern", "/")) - 1
    told = intervals.agg(F.count("*"), F.max(F.size(F.split(host, r"\."))), F.max(path)).first()
    longest, deepest = told[1] or 0, told[2] or 0

    asked = keyed.select(F.col(at).alias("url"), F.col(day).alias("day")).where("url IS NOT NULL AND day IS NOT NULL").distinct()
    asked = asked.withColumn("host", host_of(F.col("url"))).where("host IS NOT NULL")
    labels, steps = F.split("host", r"\."), F.filter(F.split(F.lower(path_of(F.col("url"))), "/"), lambda s: s != "")
    upto = lambda parts, most: F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most)))
    suffixes = F.transform(upto(labels, max(1, longest)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.when((F.size(steps) > 0) & F.lit(deepest > 0), F.transform(upto(steps, max(1, deepest)), lambda i: F.concat_ws("/", "host", F.array_join(F.slice(steps, 1, i), "/"))))
    candidates = F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>"))))
    wanted = asked.select("url", "day", F.explode(candidates).alias("pattern"))
    if told[0] <= BROADCAST_ROWS:
        intervals = F.broadcast(intervals)
    active = wanted.join(intervals, "pattern").where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
    rank = F.struct((-F.length("pattern")).alias("n"), F.col("action"), F.col("list_name"), F.col("pattern"))
    verdicts = active.groupBy(F.col("url").alias(at), F.col("day").alias(day)).agg(F.min(rank).alias(best), F.count("*").alias(many))
    verdicts = scratch.stage(verdicts, "verdicts")
    scratch.drop("intervals")
    own = host_of(F.col(at))
    valid = F.col(day).isNotNull() & own.isNotNull()
    return keyed.join(verdicts, [at, day], "left").select(
        *[F.col(f"`{c}`") for c in captures.columns],
        own.alias("host"),
        F.when(valid, F.coalesce(F.col(best)["action"], F.lit("none"))).otherwise(F.lit("invalid")).alias("decision"),
        F.col(best)["list_name"].alias("list_name"),
        F.col(best)["pattern"].alias("pattern"),
        F.coalesce(many, F.lit(0)).cast("long").alias("n_active"),
    )
