"""Reports of several agencies in a stream against a loop that hears them batch by batch."""

import random

from eventloom.operators import joins
from eventloom.streaming import ops

SCHEMA = "agency string, id string, t double, lat double, lon double, priority int"


def plain(batches, days):
    heard, heads, out = {}, [], {}
    newest = 0
    for batch in batches:
        heard = {k: t for k, t in heard.items() if t >= newest - days * 86400}
        heads = [h for h in heads if h[1] >= newest - days * 86400]
        fresh = sorted({(p, t, f"{a}:{i}", lat, lon) for a, i, t, lat, lon, p in batch if (a, i) not in heard})
        near = lambda h, t, lat, lon: abs(h[1] - t) <= 120 and joins._km(h[2], h[3], lat, lon) <= 400
        before, new = list(heads), []
        for _, t, key, lat, lon in fresh:
            own = next((h for h in before if near(h, t, lat, lon)), None) or next((h for h in new if near(h, t, lat, lon)), None)
            if own is None:
                new.append((key, t, lat, lon))
            out[key] = own[0] if own else key
        heads += new
        heard |= {(a, i): t for a, i, t, *_ in batch if (a, i) not in heard}
        newest = max([newest, *[x[2] for x in batch]])
    return out


def test_four_agencies_over_batches(spark, tmp_path):
    r = random.Random(2)
    quakes = [(r.uniform(0, 86400 * 3), r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(60)] + [(1000 + 60 * i, 0.1 * i, 0.0) for i in range(20)]
    reports = [(a, f"{j}", round(t + r.uniform(-40, 40), 3), lat + r.uniform(-1, 1), lon, p) for j, (t, lat, lon) in enumerate(quakes) for p, a in enumerate(["USGS", "EMSC", "GFZ", "JMA"]) if r.random() < 0.7]
    r.shuffle(reports)
    batches = [reports[i::3] for i in range(3)]
    batches[1] += batches[0][:10]  # said again
    read = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for i, b in enumerate(batches):
        extra = [(None, "x", 1.0, 1.0, 1.0, 1), ("USGS", "nowhere", 1.0, None, 1.0, 1)] if i == 0 else []
        spark.createDataFrame(b + extra, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ops.heard_once(read(), f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = plain(batches, 9)
    assert {f"{x.agency}:{x.id}": x.cluster for x in got} == want and len(got) == len(want)
    assert {x.cluster for x in got if x.opens} == set(want.values()) and len(set(want.values())) < len(want) / 2
    one = ops.heard_once(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/s1", f"{tmp_path}/o1", f"{tmp_path}/c1")
    one.awaitTermination()
    df = spark.createDataFrame(reports, SCHEMA).selectExpr("concat(agency, ':', id) as id", "t", "lat", "lon", "priority")
    assert {f"{x.agency}:{x.id}": x.cluster for x in spark.read.parquet(f"{tmp_path}/o1").collect()} == {x.id: x.cluster for x in joins.clusters(df).collect()}
