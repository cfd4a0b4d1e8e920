"""The stored word index: which months a question reads, that no item of them is lost, and that nothing else is opened."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.operators import catalog, index, search


def plain_months(posted, words, feeds, rare=60, most=12):
    """The rule, told with sets: posted is {(word, feed): months}."""
    stems = [{search.stem(f) for f in search.forms(w)} for w in words]
    have = [set().union(*[m for (x, _), m in posted.items() if x in s]) for s in stems]
    sets = []
    for w, word in enumerate(words):
        of = have[w] if len(stems[w]) == 1 else set().union(*[m for (x, _), m in posted.items() if x in stems[w]])
        for feed in feeds:
            own = posted.get((search.stem(word), feed), set())
            if own and 12 < len(of) <= 120 and len(own) < len(of):
                sets.append((False, len(own), 0, w, feed, own))
        if of and len(of) <= rare:
            sets.append((False, len(of), 1, w, "", of))
    if len(words) > 1 and (together := set.intersection(*have)):
        sets.append((True, len(together), 2, -1, "", together))
    if not sets:
        return []
    chosen = min(sets)[-1]
    return sorted(chosen, key=lambda m: (sum(m in h for h in have), m), reverse=True)[:most]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    r = random.Random(9)
    words = ["ronin", "bridge", "reddit", "filing", "Companies", "placed", "bought", "vote", "u.s.", "7", "themes", "theme", "car", "cars", "naïve"]
    months = [f"{y}-{m:02}" for y in (2021, 2022, 2023) for m in range(1, 13)]
    rows = []
    for i in range(1500):
        feed, month = r.choice(["crypto-hacks", "sec-filings", "7", "quakes"]), r.choice(months)
        known = [w for j, w in enumerate(words) if (hash_of(w, feed, month) % (j + 2)) == 0]
        rows.append((i, feed, " ".join(r.sample(known, min(len(known), 3)) + [f"x{i}"]), " ".join(r.choices(known or ["none"], k=2)), f"{month}-{r.randint(1, 28):02}", f"https://e.org/{i}"))
    items = catalog.with_keys(spark.createDataFrame(rows, "id long, feed string, title string, summary string, date string, link string"))
    path = str(tmp_path_factory.mktemp("archive"))
    index.write(items, path)
    posted = collections.defaultdict(set)
    for _, feed, title, summary, date, _ in rows:
        for w in re.findall(r"[\w']+", f"{title}\n{summary}".lower()):
            if len(w) > 2 and not w.isdigit():
                posted[search.stem(w), feed].add(date[:7])
    return path, rows, posted


def hash_of(*x):
    import zlib

    return zlib.crc32("|".join(x).encode())


ASKED = (["ronin"], ["ronin", "bridge"], ["reddit", "filing"], ["bridge", "hacks"], ["filing", "vote"], ["companies", "bought"], ["unseen"], ["unseen", "ronin"], ["theme"], ["us", "vote"], ["7", "car"], ["naïve"], ["x77"])


@pytest.mark.parametrize("rare", [60, 8])
def test_months_against_sets(spark, archive, rare):
    path, _, posted = archive
    for words in ASKED:
        feeds = [f for f in ("crypto-hacks", "sec-filings", "7", "quakes") if any(re.search(search.pattern(w).replace("(?iU)", "(?i)"), f.replace("-", " ")) for w in words)]
        got = [m for m, _ in index.months(spark, path, words, rare).collect()]
        looked_up = [w for w in words if w.isascii() and None not in [index._starts(f) for f in search.forms(w)]]
        if looked_up == words:
            assert got == plain_months(posted, words, feeds, rare), words


def test_no_item_is_lost(spark, archive):
    path, rows, _ = archive
    items = catalog.read(spark, f"{path}/items")
    for words in ASKED[1::2]:
        want = {x.id for x in search.find(items.filter("date >= '2021-06-10' and date < '2022-03'"), words).select("id").collect()}
        got = index.find(spark, path, words, "2021-06-10", "2022-02").select("id").collect()
        assert {x.id for x in got} == want and len(got) == len(want), words
        chosen = [x.month for x in index.months(spark, path, words).collect()]
        assert {x.id for x in index.find(spark, path, words).select("id").collect()} == {x.id for x in search.find(items.filter(items.month.isin(chosen)), words).select("id").collect()}, words
    assert any(r[1] == "7" for r in rows) and items.filter("feed = '7'").count() > 0


def test_only_chosen_partitions_are_opened(spark, archive):
    path = archive[0]
    found = index.find(spark, path, ["x77"])
    assert found.count() == 1
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    filters = [x for x in plan.split("\n") if x.startswith("PartitionFilters")]
    assert any(x.count("IN dynamicpruning#") == 2 for x in filters), filters
    assert any(f"(shard#" in x and f"= {index.shard_of('x77')})" in x for x in filters)
    rows = found.collect()
    metrics = found._jdf.queryExecution().executedPlan()
    read = [n for n in _scans(metrics) if "/items" in n[0]]
    chosen = [m for m, _ in index.months(spark, path, ["x77"]).collect()]
    where = index.places(spark, path, ["x77"]).filter(F.col("month").isin(chosen)).collect()
    assert len(rows) == 1 and read and 0 < read[0][1] <= len(where) < 5


def _scans(plan):
    """Scans of an executed plan, with the number of partitions that each read."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec":
            m = p.metrics().get("numPartitions")
            out.append((p.toString(), m.get().value() if m.isDefined() else None))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out
