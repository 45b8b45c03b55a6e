"""The rolling stream next to the batch answer: batches, restarts, silent services."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.operators.monitor import rolling_latency
from flowtally.streaming.rolling import rolling_stream

NAMES = ["p50_ms", "p95_ms", "p99_ms", "error_rate", "total_requests"]


@pytest.fixture
def events(spark, folder):
    """Three files in time order; one service has most of the requests."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(900), "at": np.arange(900) // 3, "svc": rng.choice(["busy", "b", "c"], 900, p=[0.8, 0.15, 0.05]),
                        "ms": rng.gamma(2.0, 50.0, 900), "bad": rng.random(900) < 0.1})

    def land(i):
        spark.createDataFrame(pdf.iloc[i * 300:(i + 1) * 300].sample(frac=1, random_state=i)).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def stream():
        return spark.readStream.schema("id long, at long, svc string, ms double, bad boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    return pdf, land, stream


def answers(df):
    return {r["id"]: tuple(round(r[n], 9) for n in NAMES) for r in df.collect()}


def test_stream_equals_batch_over_restarts(spark, folder, events):
    pdf, land, stream = events
    for i in range(3):  # each round is a stream that starts anew from its checkpoint
        land(i)
        got = rolling_stream(stream(), "svc", "at", "id", "ms", f"{folder}/out", F.col("bad"), rows=100)
    want = rolling_latency(spark.createDataFrame(pdf), "svc", "at", "id", "ms", rows=100, block=200, error=F.col("bad"))
    assert answers(got) == answers(want) and got.count() == 900


def test_window_of_one(spark, folder, events):
    pdf, land, stream = events
    land(0)
    land(1)
    got = {r["id"]: r for r in rolling_stream(stream(), "svc", "at", "id", "ms", f"{folder}/out", rows=1).collect()}
    assert len(got) == 600 and all(got[i].p50_ms == got[i].p99_ms == pytest.approx(pdf.ms[i]) and got[i].error_rate == 0 for i in got)


def test_silent_services_are_forgotten(spark, folder, events):
    pdf, land, stream = events
    once = {"once": True}  # with timers, a stream that runs until it has caught up never has
    land(0)
    rolling_stream(stream(), "svc", "at", "id", "ms", f"{folder}/out", rows=50, idle_ms=1, trigger=once)
    time.sleep(0.1)
    spark.createDataFrame([(9000, 9000, "other", 1.0, False)], "id long, at long, svc string, ms double, bad boolean").write.mode("append").parquet(f"{folder}/in")
    rolling_stream(stream(), "svc", "at", "id", "ms", f"{folder}/out", rows=50, idle_ms=1, trigger=once)  # the timers run out in this batch
    land(1)
    got = rolling_stream(stream(), "svc", "at", "id", "ms", f"{folder}/out", rows=50, idle_ms=60_000, trigger=once).where("id between 300 and 599")
    n = pdf.iloc[300:600].groupby("svc").size()
    assert {r.svc: r.t for r in got.groupBy("svc").agg(F.max("total_requests").alias("t")).collect()} == n.to_dict()
