"""The provider data source: pruning by symbol, adapters of the caller, payloads that do not parse, streams that go on."""

import json

import pytest
from pyspark.sql import functions as F

from pitframe.sources import provider
from pitframe.sources.provider import Adapter, EqualTo, In, Reader
from pitframe.streaming import jobs


def payloads(folder, symbol, closes, name="a.txt"):
    (folder / f"symbol={symbol}").mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"symbol": symbol, "close": c}) for c in closes]
    (folder / f"symbol={symbol}" / name).write_text("\n".join(lines) + "\n")


def closes(p):
    yield p["symbol"], float(p["close"])


def test_reads_prune_files_by_symbol(spark, tmp_path):
    for s in "abc":
        payloads(tmp_path, s, [1, 2])
    (tmp_path / "_SUCCESS").write_text("")
    provider.register(spark, closes=Adapter("symbol string, close double", closes))
    df = spark.read.format("provider").option("adapter", "closes").option("path", str(tmp_path)).load()
    assert df.count() == 6 and df.filter("symbol = 'b'").agg(F.sum("close")).first()[0] == 3.0
    assert df.filter(F.col("symbol").isin("a", "c") & (F.col("symbol") != "a")).count() == 2
    reader = Reader(str(tmp_path), provider.ADAPTERS["minutes"])
    assert len(reader.partitions()) == 3
    assert list(reader.pushFilters([In(("symbol",), ("a", "b")), EqualTo(("symbol",), "b")]))  # checked again by Spark
    assert [p.path.split("symbol=")[1][0] for p in reader.partitions()] == ["b"]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("provider").option("adapter", "closes").option("path", str(tmp_path / "empty")).load().count() == 0
    with pytest.raises(Exception, match="no adapter"):
        spark.read.format("provider").option("adapter", "none").option("path", str(tmp_path)).load()


def test_payloads_that_do_not_parse(spark, tmp_path):
    payloads(tmp_path, "a", [1, "x", None, 4])
    provider.register(spark, strict=Adapter("symbol string, close double", closes), lenient=Adapter("symbol string, close double", closes, strict=False))
    read = lambda name: spark.read.format("provider").option("adapter", name).option("path", str(tmp_path)).load()
    assert sorted(r["close"] for r in read("lenient").collect()) == [1.0, 4.0]
    with pytest.raises(Exception, match="could not convert"):
        read("strict").collect()


def test_streams_take_each_file_once(spark, tmp_path):
    provider.register(spark, closes=Adapter("symbol string, close double", closes))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: spark.readStream.format("provider").option("adapter", "closes").option("path", source).load()
    for k in range(3):
        payloads(tmp_path / "in", "ab"[k % 2], [k, k + 10], f"{k}.txt")
        assert jobs.finished(stream(), "closes", out, state).count() == 2 * k + 2
    assert jobs.finished(stream(), "closes", out, state).count() == 6
