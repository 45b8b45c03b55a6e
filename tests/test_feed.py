"""The feed source: pages, years, broken pages, and streams that read each page once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowtally.plans.views import vulnerabilities
from flowtally.sources import corpus, feed


def record(i, published="2023-05-06T00:00:00.000", **more):
    return {"cve": {"id": i, "published": published, "descriptions": [{"lang": "en", "value": f"text of {i}"}], **more}}


def land(folder, name, *records, at=None):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"totalResults": len(records), "vulnerabilities": list(records), "extra": [1]}, f, indent=1)
    if at is not None:
        os.utime(path, ns=(at, at))


@pytest.fixture
def pages(folder):
    land(folder, "a.json", record("CVE-1"), record("CVE-2", "2021-01-01"), record(None, None), {"cve": None}, "odd")
    land(folder, "b.json", record("CVE-3", "2021-09-09", metrics={"cvssMetricV31": [{"cvssData": {"baseScore": 9, "baseSeverity": "HIGH", "more": {}}}]}, weaknesses="none"))
    land(folder, "_temporary.json", record("CVE-9"))
    with open(f"{folder}/broken.json", "w") as f:
        f.write("{")
    with open(f"{folder}/list.json", "w") as f:
        f.write("[]")
    with open(f"{folder}/notes.txt", "w") as f:
        f.write("{}")
    return folder


def test_a_partition_for_each_page_and_records_as_they_are(spark, pages):
    rows = feed.read_feed(spark, pages)
    assert rows.rdd.getNumPartitions() == 4  # broken pages are pages without records
    got = {(os.path.basename(r.page), r.place): r for r in rows.collect()}
    assert set(got) == {("a.json", 0), ("a.json", 1), ("a.json", 2), ("a.json", 3), ("a.json", 4), ("b.json", 0)}
    assert got["a.json", 0].cve.descriptions[0].value == "text of CVE-1" and got["a.json", 2].cve.id is None and got["a.json", 3].cve is None
    b = got["b.json", 0]
    assert b.year == 2021 and b.cve.metrics.cvssMetricV31[0].cvssData.baseScore == 9.0 and b.cve.weaknesses is None
    want = corpus.read_vulnerability_pages(spark, f"{pages}/b.json").select("cve.id", "cve.descriptions", "cve.published").collect()
    assert want == rows.where("page like '%b.json'").select("cve.id", "cve.descriptions", "cve.published").collect()


def test_years_are_met_in_the_reader(spark, pages):
    rows = feed.read_feed(spark, pages, [2021, 2020])
    assert {r.id for r in rows.select("cve.id").collect()} == {"CVE-2", "CVE-3"}
    assert "isin" not in rows._jdf.queryExecution().executedPlan().toString().lower().split("scan")[0]
    reader = feed.FeedReader(pages, (".json",), None)
    left = list(reader.pushFilters([feed.In(("year",), (2020, 2021)), feed.EqualTo(("year",), 2021), feed.EqualTo(("place",), 0)]))
    assert left == [feed.EqualTo(("place",), 0)] and {p.years for p in reader.partitions()} == {(2021,)}


def test_no_pages(spark, folder):
    assert feed.read_feed(spark, folder).count() == 0 and feed.read_feed(spark, folder + "/none").count() == 0


def test_a_later_page_is_read_once(spark, folder):
    os.makedirs(f"{folder}/in")

    def run():
        q = (feed.stream_feed(spark, f"{folder}/in").select("cve.id", "page").writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(once=True).start())
        q.awaitTermination()
        return sorted(r.id for r in spark.read.schema("id string").parquet(f"{folder}/out").collect())

    land(f"{folder}/in", "a.json", record("CVE-1"), record("CVE-2"), at=10**18)
    land(f"{folder}/in", "b.json", record("CVE-3"), at=10**18)  # the same moment: by path
    assert run() == ["CVE-1", "CVE-2", "CVE-3"]
    land(f"{folder}/in", "c.json", record("CVE-4"), at=10**18 + 5)
    assert run() == ["CVE-1", "CVE-2", "CVE-3", "CVE-4"]
    assert run() == ["CVE-1", "CVE-2", "CVE-3", "CVE-4"]


def test_landed_views_come_back(spark, folder):
    rows = vulnerabilities(spark, "/root/testdata/sf0.001")
    feed.land_pages(rows, F.pmod(F.xxhash64("cve.id"), F.lit(5)), f"{folder}/pages")
    back = feed.read_feed(spark, f"{folder}/pages", suffixes=".txt")
    assert back.select("page").distinct().count() == 5
    told = [sorted(map(str, corpus.vulnerability_records(x.select("cve")).collect())) for x in (rows, back)]
    assert told[0] == told[1] and len(told[0]) == rows.count()
