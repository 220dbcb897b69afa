"""URL filters from dated lists: each entry's history becomes validity intervals, joined as of every capture's time.

An entry names a list, a kind, a pattern and a verdict. It is listed and delisted by dated events; between a listing and
the next event it is valid. Kinds: ``domain`` (a host and all below it), ``prefix`` (host and start of the path, ending in
``/``), ``url`` (host and path). A capture has one key for every entry that could apply to it, so the as-of join is an
equality join on key and time bucket with a range check, never a comparison of all pairs. Intervals are cut at bucket
edges, so a capture meets only what was valid near its time, however long an entry's history is. A host that holds much
of the captures makes a skewed join key on the captures' side alone, which adaptive execution splits.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import next_in_time
from .common import row_key

BUCKET_DAYS = 32
KINDS = {"domain": 1, "prefix": 2, "url": 3}
ENTRY = ["list_name", "kind", "pattern", "verdict"]

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(url: Column) -> Column:
    """Host in lower case, without port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.$", "")


def url_path(url: Column) -> Column:
    """Path without query and fragment, ``/`` if empty."""
    path = F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))
    return F.when(path == "", "/").otherwise(path)


def validity(events: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which an entry is listed; the last one may be open (null).

    ``events`` has list_name, kind, pattern, verdict, at and listed. Several events of an entry at one time count as a
    listing if one of them is. Rows with a null in kind, pattern, verdict, at or listed are left out.
    """
    clean = events.dropna(subset=["kind", "pattern", "verdict", "at", "listed"])
    clean = clean.withColumn("list_name", F.coalesce("list_name", F.lit("")))
    merged = clean.groupBy(*ENTRY, "at").agg(F.max("listed").alias("listed"))
    timed = next_in_time(merged, ENTRY, "at", [], "valid_to")
    return timed.where("listed").select(*ENTRY, F.col("at").alias("valid_from"), "valid_to")


def _bucket(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (BUCKET_DAYS * 86400))


def capture_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Array of (kind, pattern, length) that could match: ``labels`` and ``depth`` are the most that any entry has."""
    parts = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))),
        lambda n: F.struct(
            F.lit("domain").alias("kind"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".").alias("pattern"), n.alias("length")
        ),
    )
    steps = F.split(path, "/", depth + 2)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(depth + 1))),
        lambda n: F.struct(
            F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/")).alias("pattern"), n.alias("length")
        ),
    )
    whole = F.array(F.struct(F.lit("url").alias("kind"), F.concat(host, path).alias("pattern"), F.lit(0).alias("length")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,pattern:string,length:int>>")).otherwise(
        F.concat(domains, prefixes, whole)
    )


def filter_urls(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """What the lists said about each capture when it was fetched. One row per input row.

    Columns: identifier, url, time, ``host``, ``n_matches`` (entries valid then that match), ``blocked``, and the entry
    that decides: ``list_name``, ``kind``, ``pattern``. The most specific decides: url before prefix before domain, then
    the longer, then ``block`` before other verdicts, then list name in order. Captures with a null url or time, or a
    url without host, match nothing and are not blocked. Repeated rows get the same answer each. Empty tables are
    fine on either side. Other columns are not read.
    """
    rows = captures.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("time")
    )
    intervals = validity(events)
    # Bounds of the keys that can match and of the buckets that are needed: two rows of numbers.
    size = intervals.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 2)).alias("depth"),
    ).first()
    span = rows.agg(F.min(_bucket(F.col("time"))).alias("low"), F.max(_bucket(F.col("time"))).alias("high")).first()
    low, high = (0, 0) if span["low"] is None else (span["low"], span["high"])
    first = F.greatest(_bucket(F.col("valid_from")), F.lit(low))
    last = F.least(F.coalesce(_bucket(F.col("valid_to")), F.lit(high)), F.lit(high))
    valid = intervals.withColumn(
        "bucket", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    )

    host = url_host(F.col("url"))
    looked = (
        rows.where("url IS NOT NULL AND time IS NOT NULL")
        .select(row_key("id", "url", "time").alias("row"), "time", _bucket(F.col("time")).alias("bucket"), host.alias("host"), url_path(F.col("url")).alias("path"))
        .select("row", "time", "bucket", F.explode(capture_keys(F.col("host"), F.col("path"), size["labels"] or 1, size["depth"] or 0)).alias("key"))
        .select("row", "time", "bucket", F.col("key.kind").alias("kind"), F.col("key.pattern").alias("pattern"), F.col("key.length").alias("length"))
    )
    then = (F.col("valid_from") <= F.col("time")) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to")))
    matches = looked.join(valid, ["kind", "pattern", "bucket"]).where(then)
    level = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    decides = F.struct(
        (-level[F.col("kind")]).alias("kind_rank"), (-F.col("length")).alias("shorter"), (F.col("verdict") != "block").alias("passes"), "list_name", "kind", "pattern"
    )
    decided = (
        matches.dropDuplicates(["row", *ENTRY])
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n"), F.min(decides).alias("entry"))
    )
    return rows.withColumn("row", row_key("id", "url", "time")).join(decided, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("time").alias(time_col),
        host.alias("host"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_matches"),
        F.coalesce(~F.col("entry.passes"), F.lit(False)).alias("blocked"),
        F.col("entry.list_name").alias("list_name"),
        F.col("entry.kind").alias("kind"),
        F.col("entry.pattern").alias("pattern"),
    )
