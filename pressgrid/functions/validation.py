"""Row checks that yield messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.urls import strip

# What an e-mail address and a URL must look like.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_SHAPE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def is_url(c: Column) -> Column:
    """Has a scheme and a host."""
    return F.coalesce(c.rlike(URL_SHAPE), F.lit(False))


def is_email(c: Column) -> Column:
    """Optional: empty passes."""
    return F.coalesce(c == "", F.lit(True)) | c.rlike(EMAIL)


def is_day(c: Column) -> Column:
    """YYYY-MM-DD and a day of the calendar."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit(False)) & \
        F.try_to_timestamp(c, F.lit("yyyy-M-d")).isNotNull()


def required_message(name: str) -> Column:
    """'Title Case is required' where the field is blank."""
    label = name.replace("_", " ").title()
    blank = F.coalesce(strip(F.col(name)) == "", F.lit(True))
    return F.when(blank, F.lit(f"{label} is required"))


def bad_backlinks(c: Column) -> Column:
    """One message per non-blank line that is no URL."""
    numbered = F.transform(F.split(strip(c), "\n"), lambda l, i: F.struct((i + 1).alias("n"), strip(l).alias("l")))
    wrong = F.filter(numbered, lambda x: (x["l"] != "") & ~is_url(x["l"]))
    messages = F.transform(wrong, lambda x: F.concat(F.lit("Line "), x["n"].cast("string"), F.lit(": Invalid URL format")))
    return F.coalesce(messages, F.array().cast("array<string>"))


def tags(c: Column) -> Column:
    """Comma list as trimmed, non-empty entries."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def validate_rows(
    df: DataFrame, required: list[str], url: str | None = "url", email: str | None = None,
    day: str | None = None, backlinks: str | None = None,
) -> DataFrame:
    """Adds `errors`; a row with none is acceptable."""
    checks = [required_message(n) for n in required]
    if url:
        checks.append(F.when(~is_url(F.col(url)), F.lit("Invalid URL format")))
    if email:
        checks.append(F.when(~is_email(F.col(email)), F.lit("Invalid email format")))
    if day:
        checks.append(F.when(~is_day(F.col(day)), F.lit("Invalid date format")))
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    if backlinks:
        found = F.concat(found, bad_backlinks(F.col(backlinks)))
    return df.withColumn("errors", found)


def split_accepted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted without the `errors` column, rejected with it)."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
