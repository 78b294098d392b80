"""Retention (I1): age tiers of log records and expiry of samples."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions import epoch_us

DAY_US = 86_400 * 1_000_000
# Log tiers by age -- hot below 7 days, warm from 7, cold from
# 30, deleted from 90 -- and metric samples kept 15 days.
TIERS = (("delete", 90), ("cold", 30), ("warm", 7))
HOT = "hot"
SAMPLE_RETENTION_DAYS = 15


def age_us(ts: str | Column, now) -> Column:
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return epoch_us(now_c) - epoch_us(ts)


def age_tier(df: DataFrame, ts: str, now) -> DataFrame:
    """Add ``tier`` from the record's age at ``now`` (a literal or column)."""
    a = age_us(ts, now)
    tier = None
    for name, days in TIERS:
        cond = a >= F.lit(days * DAY_US)
        tier = F.when(cond, F.lit(name)) if tier is None else tier.when(cond, F.lit(name))
    return df.withColumn("tier", tier.otherwise(F.lit(HOT)))


def expire(df: DataFrame, ts: str, now, days: int = SAMPLE_RETENTION_DAYS) -> DataFrame:
    """Keep records younger than ``days`` at ``now`` (for tables by day see
    :func:`drop_expired`)."""
    return df.filter(age_us(ts, now) < F.lit(days * DAY_US))


def land_by_day(df: DataFrame, ts: str, path: str) -> None:
    """Append records to a table with a folder per day of ``ts`` (UTC).
    Records without a time share a folder that never ages.  The rebalance
    splits a day that holds most records."""
    (df.withColumn("day", F.to_date(ts)).hint("rebalance", "day")
       .write.mode("append").partitionBy("day").parquet(path))


def _day_folders(spark: SparkSession, path: str):
    """The store's file system and (day, folder) of the table's days: one
    entry per retained day, no file is opened."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = []
    for entry in (fs.listStatus(root) if fs.exists(root) else []):
        name = entry.getPath().getName()
        if name.startswith("day=") and name[4:5].isdigit():
            days.append((date.fromisoformat(name[4:]), entry.getPath()))
    return hadoop, fs, sorted(days, key=lambda x: x[0])


def _youngest_age(day: date, now: datetime) -> timedelta:
    """Age that every record of the day has reached."""
    return now - datetime.combine(day + timedelta(days=1), time())


def drop_expired(spark: SparkSession, path: str, now: datetime, days: int = SAMPLE_RETENTION_DAYS) -> list[date]:
    """Remove the days of a table by day whose records are all at least
    ``days`` old.  Folders go, no file of another day is read or written; a
    second call removes nothing more.  The one day that is partly over the
    limit stays until it is wholly over it: read through :func:`expire`."""
    _, fs, folders = _day_folders(spark, path)
    gone = [(day, folder) for day, folder in folders if _youngest_age(day, now) >= timedelta(days=days)]
    for _, folder in gone:
        fs.delete(folder, True)
    return [day for day, _ in gone]


def move_tiers(spark: SparkSession, roots: dict[str, str], now: datetime) -> dict[date, str]:
    """Move the days of the tier tables ``roots`` (tier -> path) to the tier
    that all their records have reached, or remove them (tier ``delete``).  A
    move renames the day's folder; where the tier already has the day, its
    files join it.  Returns where each day went."""
    limits = [*((name, timedelta(days=d)) for name, d in TIERS), (HOT, timedelta.min)]
    went = {}
    for tier, path in roots.items():
        hadoop, fs, folders = _day_folders(spark, path)
        for day, folder in folders:
            to = next(name for name, least in limits if _youngest_age(day, now) >= least)
            if to == tier:
                continue
            went[day] = to
            if to == "delete":
                fs.delete(folder, True)
                continue
            target = hadoop.Path(roots[to], folder.getName())
            if not fs.exists(target):
                fs.mkdirs(target.getParent())
                fs.rename(folder, target)
                continue
            for entry in fs.listStatus(folder):          # file names are unique to their writers
                fs.rename(entry.getPath(), hadoop.Path(target, entry.getPath().getName()))
            fs.delete(folder, True)
    return went
