"""Figure records: review rules, geometry, status counts, and accounts.

Records: num, page, file, status, sourcePage, bbox array<double>, reviewed,
reviewNote, reviewedAt.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql import types as T

from foliant.functions.text import text
from foliant.operators.layout import valid_rect

STATUSES = ("cut", "carry", "manual", "fallback", "missing", "error")


def geometry(width: Column, height: Column, pages: Column) -> Column:
    """Rules on a record's file, page and box: array of the names that fail."""
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    rules = {
        "file": ~F.regexp_like(text("file"), F.lit(r"^[^/\\]+\.(?i:png|jpe?g|webp)$")),
        "page": ~F.coalesce(F.col("sourcePage").between(1, pages), F.lit(False)),
        "box": (F.size("bbox") != 4) | ~valid_rect(*b, width, height),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())


def review_errors(layout: DataFrame, records: DataFrame, stamped: bool = False) -> DataFrame:
    """num, error: listed figures without a record, unreviewed, without a note, or missing."""
    r = records.select("num", F.lit(True).alias("_there"), "status", "reviewed", "reviewNote", "reviewedAt")
    both = layout.select("num").distinct().join(r, "num", "left")
    blank = lambda x: F.trim(text(x)) == ""
    err = F.when(F.col("_there").isNull(), "no_record").when(F.col("status") == "missing", "missing").when(~F.coalesce("reviewed", F.lit(False)), "unreviewed").when(blank("reviewNote"), "no_note")
    if stamped:
        err = err.when(blank("reviewedAt"), "no_time")
    return both.withColumn("error", err).where("error is not null").select("num", "error")


def clear_review(records: DataFrame, changed: Column) -> DataFrame:
    """A new crop undoes the review."""
    return records.withColumns({"reviewed": F.when(changed, F.lit(False)).otherwise(F.col("reviewed")), **{k: F.when(~changed, F.col(k)) for k in ("reviewNote", "reviewedAt")}})


def approve(records: DataFrame, num: str, note: str, now: str) -> DataFrame:
    if not note.strip():
        raise ValueError("a review needs a note")
    hit = F.col("num") == num
    return records.withColumns({"reviewed": F.when(hit, True).otherwise(F.col("reviewed")), "reviewNote": F.when(hit, F.lit(note)).otherwise(F.col("reviewNote")), "reviewedAt": F.when(hit, F.lit(now)).otherwise(F.col("reviewedAt"))})


def status_counts(records: DataFrame) -> DataFrame:
    """status, n for all statuses, zeros included."""
    axis = records.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return axis.join(records.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(records: DataFrame, num: Column) -> DataFrame:
    """Numbers that come twice, in normal form; blank ones aside."""
    return records.select(num.alias("num")).where("num <> ''").groupBy("num").agg(F.count("*").alias("n")).where("n > 1")


def unknown(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return requested.join(available.select(key).distinct(), key, "left_anti")


@pandas_udf(T.DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts; not an edit distance, so no built-in."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def reference_check(ours: DataFrame, source: DataFrame, least: float = 0.90, prefix: int = 80) -> DataFrame:
    """num, error: missing, extra, duplicate, or another reference (identity column ``key``, normalised)."""
    a = ours.groupBy("num").agg(F.count("*").alias("n"), F.min("key").alias("a"))
    both = a.join(source.select("num", F.col("key").alias("b")), "num", "full")
    alike = (F.substring("a", 1, prefix) == F.substring("b", 1, prefix)) & (sequence_ratio_udf("a", "b") >= least)
    err = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("n") > 1, "duplicate").when(~alike, "identity")
    return both.withColumn("error", err).where("error is not null").select("num", "error")


# Accounts.


def public_user() -> list[Column]:
    """An account as its owner sees it: the name falls back to the address' local part; no secrets."""
    name = F.when(F.trim(text("displayName")) != "", F.col("displayName")).otherwise(F.get(F.split("email", "@"), F.lit(0)))
    return [F.col("id"), F.col("email"), name.alias("displayName"), F.col("role"), F.col("disabled").cast("boolean").alias("disabled")]


def sign_in(users: DataFrame, email: str) -> DataFrame:
    return users.where((F.lower("email") == email.strip().lower()) & ~F.col("disabled").cast("boolean"))


def create_users(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all users, rejected): addresses that exist or are malformed are rejected."""
    ok = F.regexp_like("email", F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
    known = users.select(F.lower("email").alias("_e"))
    n = new.withColumn("_e", F.lower("email"))
    good = n.where(ok).join(known, "_e", "left_anti").dropDuplicates(["_e"])
    bad = n.where(~ok).unionByName(n.where(ok).join(known, "_e", "left_semi"))
    return users.unionByName(good.drop("_e"), allowMissingColumns=True), bad.drop("_e")


def create_shares(requests: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """Requests (token, user_id, slug, days) for papers that exist; no days, no expiry."""
    end = F.when(F.coalesce("days", F.lit(0)) > 0, F.date_format(now + F.make_dt_interval(F.col("days").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    known = requests.join(catalog.select("slug").distinct(), "slug", "left_semi")
    return known.select("token", "user_id", "slug", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"), end.alias("expires_at"), F.lit(0).alias("revoked"))


def revoke(shares: DataFrame, token: str, user_id: int) -> DataFrame:
    """Only the owner's token is revoked."""
    hit = (F.col("token") == token) & (F.col("user_id") == user_id)
    return shares.withColumn("revoked", F.when(hit, 1).otherwise(F.col("revoked")))
