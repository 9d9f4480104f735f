"""URL lists with dates: each capture is held against the entries in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading 'www.'; no authority part: empty string."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


def domains_of(host: Column) -> Column:
    """The host and each parent domain with a dot: a.b.c gives a.b.c and b.c."""
    parts = F.split(host, r"\.")
    all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, 1_000_000), "."))
    return F.when(host != "", F.array_distinct(all_of)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (domain, list_name, action 'add' or 'remove', day) to intervals [from_day, to_day).

    Of several entries of one list and domain on a day the last by action stands, so a removal wins. A
    further 'add' while in force changes nothing; entries with a null in domain, list or day are ignored; an
    interval without an end has a null to_day.
    """
    w = Window.partitionBy("list_name", "domain").orderBy("day")
    daily = entries.dropna(subset=["domain", "list_name", "day"]).groupBy("list_name", "domain", "day").agg(F.max("action").alias("action"))
    changes = daily.withColumn("was", F.lag("action").over(w)).filter("NOT action <=> was")
    return changes.withColumn("to_day", F.lead("day").over(w)).filter("action = 'add'").select("list_name", "domain", F.col("day").alias("from_day"), "to_day")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetched_day") -> DataFrame:
    """Each capture with the entry in force at its fetch day: the longest domain, then the first list by name.

    An as-of join without a range over all entries of a domain: intervals are laid into buckets of
    BUCKET_DAYS days, so captures meet only intervals of their domain and bucket, of which at most one per
    list holds on a day. It is an equi-join, so a domain with a third of all captures can be split. The
    matches are summed up per capture with a partial aggregate.

    Returns key, url, host, day, blocked, domain, list_name, from_day, one row per (key, url, day) with the
    number of equal rows in `copies`. A null URL or day is never blocked. Empty lists block nothing, no captures give no
    rows. Only the three columns named are read, so others may have any name; a long URL costs one entry per domain level.
    """
    c = captures.select(F.col(key), F.col(url), F.col(day)).groupBy(key, url, day).agg(F.count("*").alias("copies"))
    c = c.withColumn("host", host_of(F.coalesce(F.col(url), F.lit(""))))
    asked = c.select(key, url, day, F.explode(domains_of(F.col("host"))).alias("domain")).filter(F.col(day).isNotNull())
    asked = asked.withColumn("bucket", F.floor(F.col(day) / BUCKET_DAYS))
    spans = validity(entries)
    last = F.lit(captures.agg(F.max(day)).first()[0] or 0)  # no interval is laid out beyond the last capture
    end = F.least(F.coalesce(F.col("to_day") - 1, last), last)
    laid = spans.filter(F.col("from_day") <= last).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from_day") / BUCKET_DAYS), F.greatest(F.floor(F.col("from_day") / BUCKET_DAYS), F.floor(end / BUCKET_DAYS)))))
    hit = asked.join(laid, ["domain", "bucket"]).filter((F.col(day) >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col(day) < F.col("to_day"))))
    best = hit.groupBy(key, url, day).agg(F.min(F.struct((-F.length("domain")).alias("n"), "list_name", "domain", "from_day")).alias("best"))
    keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (key, url, day)]
    joined = c.alias("c").join(best.alias("b"), keys[0] & keys[1] & keys[2], "left")
    return joined.select(
        *[F.col(f"c.{k}").alias(k) for k in (key, url)], "host", F.col(f"c.{day}").alias(day), F.col("best").isNotNull().alias("blocked"),
        F.col("best.domain").alias("domain"), F.col("best.list_name").alias("list_name"), F.col("best.from_day").alias("from_day"), "copies",
    )
