"""Public records: filings, spending, awards, markets, chains and agencies, brought to one shape each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import fullest
from ..operators.joins import first_of, without_mirrors

#: A price and a value that no filing states but by mistake.
PLAUSIBLE_PRICE, PLAUSIBLE_VALUE = 10_000, 5e9


def trades(rows: DataFrame, filing: str, code: str, shares: str, price: str, after: str, day: str, seq: str) -> DataFrame:
    """One trade for each filing and code: shares, value, volume-weighted price, holdings after the last row, first day.

    Unpriced rows count for shares alone; an implausible price is kept as filed_price only."""
    p = (F.col(price).isNotNull()) & (F.col(price) != 0)
    g = rows.filter((F.col(shares).isNotNull()) & (F.col(shares) != 0)).groupBy(filing, code)
    t = g.agg(F.sum(shares).alias("shares"), F.sum(F.when(p, F.col(shares) * F.col(price))).alias("value"), F.sum(F.when(p, F.col(shares))).alias("_priced"), F.max_by(after, seq).alias("shares_after"), F.min(day).alias("traded_on"))
    vwap = F.try_divide("value", "_priced")
    odd = F.coalesce((vwap > PLAUSIBLE_PRICE) & (F.col("value") > PLAUSIBLE_VALUE), F.lit(False))
    return t.select(filing, code, "shares", F.when(~odd, F.round(vwap, 4)).alias("price"), F.when(~odd, F.round("value", 2)).alias("value"), "shares_after", "traded_on", F.when(odd, F.round(vwap, 2)).alias("filed_price"))


def latest_amendments(rows: DataFrame, by: list[str], amendment: str, seq: str) -> DataFrame:
    """The row with the highest amendment of each key, ties to the later row."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(amendment, seq)).alias("_r")).select(*by, "_r.*")


def outside_spending(rows: DataFrame, committees: DataFrame, min_value: float) -> DataFrame:
    """Latest amendments of listed committees' expenditures above a value, with the committee's name."""
    last = latest_amendments(rows, ["spe_id", "tran_id"], "amndt_ind", "image_num").filter(F.col("exp_amo") >= min_value)
    return last.join(committees.select("spe_id", F.col("name").alias("committee")), "spe_id")


def ownership(submissions: DataFrame, owners: DataFrame, transactions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Transactions with their submission and its first owner."""
    return transactions.join(submissions, key).join(first_of(owners, [key], order), key)


def stakes(rows: DataFrame) -> DataFrame:
    """Parties of a filing folded into one stake: its subject, and all who filed."""
    role = lambda r: F.col("role") == r
    return rows.groupBy("accession").agg(F.max(F.when(role("Subject"), F.col("party"))).alias("subject"), F.array_sort(F.collect_set(F.when(role("Filed by"), F.col("party")))).alias("filed_by"))


def transfers(rows: DataFrame, min_value: float) -> DataFrame:
    """Large transfers without those that a mirrored leg of the same transaction undoes."""
    return without_mirrors(rows, ["tx", "address", "value"], "from", "to").filter(F.col("value") >= min_value)


def funding(rows: DataFrame, min_funding: float = 0.0, min_open_interest: float = 0.0) -> DataFrame:
    """Hourly funding rates a year, by size."""
    out = rows.withColumn("annual_pct", F.col("funding") * 24 * 365 * 100)
    return out.filter((F.abs("annual_pct") >= min_funding) & (F.col("open_interest") >= min_open_interest)).orderBy(F.desc(F.abs("annual_pct")))


def word_at(data, i: int):
    """The i-th 32-byte word of call data, as hex."""
    return F.substring(F.regexp_replace(data, "^0x", ""), 64 * i + 1, 64)


def amount(word, decimals: int):
    """An unsigned word as a number of whole tokens; exact for the low 60 bits, a double above."""
    high, low = F.substring(word, 1, 49), F.substring(word, 50, 15)
    part = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda a, k: a * F.lit(16.0**12) + F.coalesce(F.conv(F.substr(F.lpad(s, 48, "0"), k * 12 + 1, F.lit(12)), 16, 10).cast("double"), F.lit(0.0)))
    return (part(F.substring(high, 2, 48)) * F.lit(16.0**15) + F.conv(low, 16, 10).cast("double")) / F.lit(10.0**decimals)


def markets(rows: DataFrame, min_utilization: float = 0.0) -> DataFrame:
    """Lending markets: utilisation is what is borrowed of what is supplied; ray rates in per cent."""
    out = rows.withColumn("utilization", F.try_divide(F.col("stable") + F.col("variable"), F.col("supplied")))
    return out.withColumn("rate_pct", F.col("rate_ray") / 1e27 * 100).filter(F.col("utilization") >= min_utilization)


def airports(df: DataFrame, body: str = "body") -> DataFrame:
    """Delays, closures and ground stops of an airport status document."""
    parts = []
    for kind, tag, reason in (("delay", "Delay", "Reason"), ("closure", "Airport", "Reason"), ("ground stop", "Program", "Reason")):
        block = F.explode(F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1))
        get = lambda n: F.nullif(F.regexp_extract("x", rf"(?s)<{n}>(.*?)</{n}>", 1), F.lit(""))
        parts.append(df.select(block.alias("x")).select(F.lit(kind).alias("kind"), get("ARPT").alias("airport"), get(reason).alias("reason"), get("Max").alias("longest")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("airport is not null")


def minutes(text):
    """'1 hour and 30 minutes' -> 90."""
    n = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+) {unit}", 1).try_cast("int"), F.lit(0))
    return n("hour") * 60 + n("minute")


#: Wind in knots from which a storm has a category.
CATEGORIES = (64, 83, 96, 113, 137)


def storm_category(knots):
    out = F.lit(0)
    for least in CATEGORIES:
        out = out + (knots >= least).cast("int")
    return out


def in_boxes(points: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of points and the boxes that hold them; boxes are a stated short list (checked) sent to all tasks."""
    if boxes.limit(10_001).count() > 10_000:
        raise ValueError("in_boxes: more than 10,000 boxes")
    return points.join(F.broadcast(boxes), F.col(lat).between(F.col("lat1"), F.col("lat2")) & F.col(lon).between(F.col("lon1"), F.col("lon2")))


def bad_days(flights: DataFrame, day: str, place: str, cancelled, late, cause: str, least: int, share: float) -> DataFrame:
    """Days on which a place's share of cancelled or late movements is high, with the main cause."""
    n = flights.groupBy(day, place).agg(F.count(F.lit(1)).alias("flights"), F.count_if(cancelled).alias("cancelled"), F.count_if(late).alias("late"))
    causes = flights.filter(cancelled | late).groupBy(day, place, cause).agg(F.count(F.lit(1)).alias("c")).groupBy(day, place).agg(F.min(F.struct((-F.col("c")).alias("c"), cause)).alias("m")).select(day, place, F.col(f"m.{cause}").alias("main_cause"))
    return n.filter((F.col("flights") >= least) & ((F.col("cancelled") + F.col("late")) / F.col("flights") >= share)).join(causes, [day, place], "left")


#: The least Kp of each storm level, G1 to G5.
STORM_KP = (5, 6, 7, 8, 9)


def storm_level(kp):
    """0, or 1 to 5 for a geomagnetic storm of G1 to G5."""
    return sum((F.when(kp >= k - 0.001, 1).otherwise(0) for k in STORM_KP), F.lit(0))


def eruption(title):
    """The explosivity that a title states ("VEI 5")."""
    return F.regexp_extract(title, r"\bVEI (\d)\b", 1).try_cast("int")


def priced(logs: DataFrame, prices: DataFrame, least: float, key: list[str]) -> DataFrame:
    """Logs (token, ts, amount) with their value at their token's close of the day (token, day, price). A log that repeats counts once;
    those without a price, or below `least`, go."""
    once = logs.dropDuplicates(key).withColumn("day", F.to_date("ts"))
    return once.join(prices, ["token", "day"]).withColumn("value", F.col("amount") * F.col("price")).filter((F.col("price") != 0) & (F.col("value") >= least))


QUAKE = "agency string, id string, t double, lat double, lon double, mag double, title string, place string, link string"
_POINT = "id string, properties struct<mag:double,place:string,time:double,title:string,url:string,type:string>, geometry struct<coordinates:array<double>>"


def _quake(agency: str, **columns) -> list:
    return [F.lit(agency).alias("agency"), *[columns[f.split()[0]].alias(f.split()[0]) for f in QUAKE.split(", ")[1:]]]


def usgs_quakes(df: DataFrame, body: str = "body") -> DataFrame:
    """GeoJSON bodies as one report for each earthquake that has a magnitude and a place."""
    f = df.select(F.explode(F.from_json(F.col(body), f"features array<struct<{', '.join(x.replace(' ', ':', 1) for x in _POINT.split(', ', 2))}>>")["features"]).alias("f")).select("f.*")
    p, at = F.col("properties"), F.col("geometry.coordinates")
    f = f.filter(p["mag"].isNotNull() & F.get(at, F.lit(1)).isNotNull() & (F.coalesce(p["type"], F.lit("earthquake")) == "earthquake"))
    title = F.coalesce(F.nullif(p["title"], F.lit("")), F.concat(F.lit("M "), F.format_number(p["mag"], 1), F.lit(" - "), F.coalesce(p["place"], F.lit(""))))
    return f.select(*_quake("USGS", id=F.col("id"), t=p["time"] / 1000, lat=F.get(at, F.lit(1)), lon=F.get(at, F.lit(0)), mag=p["mag"], title=title, place=F.coalesce(p["place"], F.lit("")), link=F.coalesce(p["url"], F.lit(""))))


def gfz_quakes(df: DataFrame, body: str = "body", link: str = "https://geofon.gfz.de/eqinfo/event.php?id=") -> DataFrame:
    """Lines of a text service, fields between bars: id, time, latitude, longitude, ..., magnitude (11th), ..., place (13th), kind (14th)."""
    lines = df.select(F.explode(F.split(F.col(body), "\n")).alias("l")).filter((F.col("l") != "") & ~F.col("l").startswith("#"))
    x = lambda i: F.get(F.split("l", "[|]"), F.lit(i))
    number = lambda i: x(i).try_cast("double")
    kept = lines.filter(x(13).isin("", "earthquake") & number(10).isNotNull() & number(2).isNotNull() & number(3).isNotNull())
    return kept.select(*_quake("GFZ", id=x(0), t=F.unix_micros(F.to_timestamp(x(1))) / 1e6, lat=number(2), lon=number(3), mag=number(10), title=F.concat(F.lit("M "), F.format_number(number(10), 1), F.lit(" - "), x(12)), place=x(12), link=F.concat(F.lit(link), x(0))))


#: Words of a region's name that stay small, and intensities that count whatever the magnitude.
SMALL_WORDS, STRONG = "of the and off near in de del la".split(), ["5-", "5+", "6-", "6+", "7"]


def region(text):
    """A region in capitals as people read it."""
    words = F.split(F.lower(F.trim(text)), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def emsc_quakes(df: DataFrame, body: str = "body", link: str = "https://www.seismicportal.eu/eventdetails.html?unid=") -> DataFrame:
    """Messages of a live stream: quakes that were just located or revised."""
    kind = "action string, data struct<properties:struct<evtype:string,mag:double,lat:double,lon:double,flynn_region:string,unid:string,time:string>>"
    m = df.select(F.from_json(F.col(body), kind).alias("m")).select("m.action", "m.data.properties")
    p = F.col("properties")
    whole = p["mag"].isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull() & p["flynn_region"].isNotNull() & p["unid"].isNotNull() & F.try_to_timestamp(p["time"]).isNotNull()
    kept = m.filter(F.col("action").isin("create", "update") & F.coalesce(p["evtype"], F.lit("")).isin("", "ke", "se") & whole)
    place = region(p["flynn_region"])
    return kept.select(*_quake("EMSC", id=p["unid"], t=F.unix_micros(F.try_to_timestamp(p["time"])) / 1e6, lat=p["lat"], lon=p["lon"], mag=p["mag"], title=F.concat(F.lit("M "), F.format_number(p["mag"], 1), F.lit(" - "), place), place=place, link=F.concat(F.lit(link), p["unid"])))


def jma_quakes(df: DataFrame, least: float, body: str = "body", link: str = "https://www.jma.go.jp/bosai/map.html#contents=earthquake_map&id=") -> DataFrame:
    """Lists of reports, one quake for each id: the last report with an intensity, else the first. Strong shaking counts whatever the magnitude."""
    e = df.select(F.posexplode(F.from_json(F.col(body), "array<struct<eid:string,at:string,en_ttl:string,cod:string,mag:string,maxi:string,en_anm:string>>")).alias("n", "e")).select("n", "e.*")
    at = lambda k: F.regexp_extract("cod", r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", k).try_cast("double")
    e = e.select("n", "eid", "at", "en_ttl", "en_anm", F.coalesce("maxi", F.lit("")).alias("maxi"), F.col("mag").try_cast("double").alias("mag"), at(1).alias("lat"), at(2).alias("lon"))
    e = e.filter(F.col("en_ttl").contains("Earthquake") & ~F.col("en_ttl").contains("Distant") & F.col("lat").isNotNull() & F.col("at").isNotNull() & ((F.col("mag") >= least) | F.col("maxi").isin(STRONG) & F.col("mag").isNotNull()))
    q = fullest(e, "eid", F.col("maxi") != "", "n")
    place = F.concat(F.coalesce("en_anm", F.lit("Japan")), F.lit(", Japan"))
    shaken = F.when(F.col("maxi") != "", F.concat(F.lit(" (JMA intensity "), F.replace(F.replace("maxi", F.lit("-"), F.lit(" lower")), F.lit("+"), F.lit(" upper")), F.lit(")"))).otherwise("")
    return q.select(*_quake("JMA", id=F.col("eid"), t=F.unix_micros(F.try_to_timestamp("at")) / 1e6, lat=F.col("lat"), lon=F.col("lon"), mag=F.col("mag"), title=F.concat(F.lit("M "), F.format_number("mag", 1), F.lit(" - "), place, shaken), place=place, link=F.concat(F.lit(link), "eid")))
