"""Filings in XML as rows: private raises, fund holdings, company events, offerings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

#: A holdings total above this was filed in thousands by mistake.
TOO_BIG = 1e13


def tag(body: Column, name: str) -> Column:
    """The text of the first element of that name, whatever its prefix."""
    got = F.trim(F.regexp_replace(F.regexp_extract(body, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1), r"(?s)^\s*<value>(.*?)</value>\s*$", "$1"))
    return F.nullif(X.unescape(got), F.lit(""))


def _amount(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def private_raises(df: DataFrame, body: str = "body") -> DataFrame:
    """issuer, kind, sold, offered, title of new notices of exempt offerings; amendments go."""
    b = F.col(body)
    group = F.coalesce(tag(b, "industryGroupType"), F.lit("other"))
    kind = F.when(group == "Pooled Investment Fund", F.coalesce(tag(b, "investmentFundType"), group)).otherwise(group)
    rows = df.filter((F.lower(F.coalesce(tag(b, "isAmendment"), F.lit("false"))) != "true") & tag(b, "entityName").isNotNull())
    rows = rows.withColumns({"issuer": V.readable(tag(b, "entityName")), "kind": kind, "sold": _amount(tag(b, "totalAmountSold")), "offered": _amount(tag(b, "totalOfferingAmount")), "state": V.readable(tag(b, "stateOrCountryDescription"))})
    title = F.when(F.col("sold") > 0, F.concat("issuer", F.lit(" reported raising $"), V.short(F.col("sold")), F.lit(" privately"))).when(F.col("offered") > 0, F.concat("issuer", F.lit(" reported an offering of up to $"), V.short(F.col("offered")))).otherwise(F.concat("issuer", F.lit(" filed to raise money privately")))
    return rows.withColumn("title", F.concat(title, F.lit(" ("), F.lower("kind"), F.lit(", Form D)"))).drop(body)


def holdings(df: DataFrame, body: str = "body") -> DataFrame:
    """manager, quarter, value, positions of holdings reports with a plausible total in dollars."""
    b = F.col(body)
    period = F.coalesce(tag(b, "reportCalendarOrQuarter"), F.lit(""))
    rows = df.withColumns({
        "manager": V.readable(tag(tag(b, "filingManager"), "name")), "value": _amount(tag(b, "tableValueTotal")), "positions": _amount(tag(b, "tableEntryTotal")).cast("int"),
        "quarter": F.when(period.rlike(r"^\d\d-\d\d-\d{4}$"), F.concat(F.substring(period, 7, 4), F.lit(" Q"), F.ceil(F.substring(period, 1, 2).try_cast("int") / 3).cast("string"))),
    })
    kind = F.upper(F.coalesce(tag(b, "reportType"), F.lit("")))
    good = (kind.contains("HOLDINGS") | kind.contains("COMBINATION")) & F.col("manager").isNotNull() & F.col("quarter").isNotNull() & F.col("value").between(1, TOO_BIG)
    dollars = F.coalesce(F.try_divide("value", "positions") >= 1000, F.lit(True))
    return rows.filter(good & dollars).drop(body)


def company_events(df: DataFrame, followed: list[str], items: str = "items") -> DataFrame:
    """Filings with the first of their items that is followed, in the order of `followed`."""
    first = F.get(F.filter(F.array(*[F.lit(f) for f in followed]), lambda f: F.array_contains(items, f)), F.lit(0))
    return df.withColumn("item", first).filter("item is not null")


def offerings(df: DataFrame, excluded: list[str], code: str = "sic") -> DataFrame:
    """First registrations, without blank-cheque companies and the like (by industry code)."""
    return df.filter(~F.coalesce(F.col(code).cast("string").isin(*excluded), F.lit(False)))


def awards(df: DataFrame, min_value: float) -> DataFrame:
    """Awards above a value as a sentence, largest first."""
    what = X.squeeze(F.coalesce("description", F.lit("")))
    title = F.concat(V.readable(F.col("recipient")), F.lit(" was awarded $"), V.short(F.col("amount")), F.lit(" by "), F.col("agency"), F.when(what != "", F.concat(F.lit(": "), F.lower(what))).otherwise(""))
    return df.filter(F.col("amount") >= min_value).withColumn("title", title).orderBy(F.desc("amount"))
