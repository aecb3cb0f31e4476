"""URL filters by a temporal list join.

Dated list entries (host, action add or remove, date) become validity intervals
by a window over each listed host; an as-of join then finds, for every capture,
the entry that was active at fetch time for its host or a parent domain of it.
The intervals of one host never overlap, so a capture meets at most one of each
of its suffixes and the join cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.tables import checkpoint

#: Intervals up to which the list is broadcast; beyond, captures are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Labels of a host that are looked up at most (a DNS name has 127 at most).
MOST_LABELS = 127


def host_of(url):
    """Lower-cased host of a URL without user, port or leading "www."; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """host, valid_from, valid_to (excluded; null: still listed), category, from entries (host, entry_date, action, category).

    Of entries with one host and date, a removal counts last; an addition while
    listed starts a new interval with its own category.  Entries with a null host,
    date or action other than add or remove are left out.
    """
    good = entries.where(F.col("host").isNotNull() & F.col("entry_date").isNotNull() & F.col("action").isin("add", "remove")).select(F.lower("host").alias("host"), "entry_date", "action", "category")
    day = good.groupBy("host", "entry_date").agg(F.max("action").alias("action"), F.max("category").alias("category"))
    following = F.lead("entry_date").over(Window.partitionBy("host").orderBy("entry_date"))
    return day.withColumn("valid_to", following).where("action = 'add'").select("host", F.col("entry_date").alias("valid_from"), "valid_to", "category")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetch_date") -> DataFrame:
    """captures with listed_host, listed_category, blocked (boolean).

    The longest listed suffix of the host that was active at fetch time decides.
    A capture without a host or time is not blocked.  Repeated captures stay;
    columns of these names are replaced.
    """
    base = captures.drop("listed_host", "listed_category", "blocked")
    active = checkpoint(intervals(entries))
    listed = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    host = host_of(F.col(url_col))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(MOST_LABELS))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # distinct (host, time) pairs are looked up; a host with a third of all captures is one row a day
    asked = base.select(host.alias("__host"), F.col(time_col).alias("__at"), suffixes.alias("__tail")).where("__host is not null and __at is not null").distinct()
    tails = asked.select("__host", "__at", F.posexplode("__tail").alias("__k", "__suffix"))
    inside = (F.col("__suffix") == F.col("host")) & (F.col("__at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to")))
    best = tails.join(listed, inside).groupBy("__host", "__at").agg(F.min_by(F.struct("host", "category"), "__k").alias("__hit"))
    b = base.withColumn("__h", host)
    out = b.join(best, (b["__h"] == best["__host"]) & (b[time_col] == best["__at"]), "left")
    return out.select(*[b[c] for c in base.columns], F.col("__hit.host").alias("listed_host"), F.col("__hit.category").alias("listed_category"), F.col("__hit").isNotNull().alias("blocked"))
