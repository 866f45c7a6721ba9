"""Readers, sinks, contracts, merges, text and streams."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import dedup, merge
from tideline.plans import dataset
from tideline.sources import contract, readers, sinks
from tideline.streaming import flows

T = dt.datetime(2024, 1, 1)


def archive(path, name, body):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(f"{name}.csv", body)
    (path / f"{name}.zip").write_bytes(raw.getvalue())


def test_zipped_klines(spark, tmp_path):
    row = "1,2,0.5,1.5,10,0,15,3,4,5,0"
    archive(tmp_path, "a", f"1577836800000,{row}\n1577836800000,{row}\n")
    archive(tmp_path, "b", f"open_time,{','.join(readers.KLINE[1:])}\n1735689600000000,{row}\n")
    got = readers.klines(readers.zipped_csv(spark, str(tmp_path), readers.KLINE)).orderBy("open_time").collect()
    assert [r["open_time"] for r in got] == [dt.datetime(2020, 1, 1), dt.datetime(2025, 1, 1)]
    assert got[0]["close"] == 1.5 and got[0]["trades"] == 3


def test_metrics_keep_missing(spark):
    raw = spark.createDataFrame([("2024-01-01 00:05:00", "1.5", "", "x", "1", "1", "1"), ("bad", *["1"] * 6)], ", ".join(f"{c} string" for c in ("create_time", *readers.METRICS)))
    r = readers.metrics(raw).collect()
    assert len(r) == 1 and r[0]["sum_open_interest"] == 1.5 and r[0]["sum_open_interest_value"] is None


def line(text_, tone="1.5,2,3,4,5", n=27, date="20240101120000"):
    c = [""] * n
    c[1], c[3], c[4] = date, "src.example", f"https://x.example/{text_}"
    if n > 15:
        c[7], c[15] = "A;B;C", tone
    return ("\t".join(c),)


def test_tone_lines(spark):
    df = spark.createDataFrame([line("bitcoin-up"), line("ethereum-and-bitcoin"), line("weather"), line("bitcoin", "x,1,2,3"), line("bitcoin", n=10), line("bitcoin", date="nope")], "value string")
    got = readers.tone_lines(df).collect()
    assert [r["assets"] for r in got] == ["BTC", "BTC,ETH", "BTC"] and got[0]["tone"] == 1.5 and got[0]["n_themes"] == 2 and got[2]["tone"] != got[2]["tone"]


def test_feed_entries(spark):
    xml = "<rss><item><link>http://a</link><title><![CDATA[T <b>x</b>]]></title><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>d</description></item><item><link>http://b</link><pubDate>soon</pubDate></item></rss>"
    got = readers.feed_entries(spark.createDataFrame([(xml,)], "xml string")).orderBy("url").collect()
    assert got[0]["published_at_utc"] == dt.datetime(2024, 1, 2, 10) and got[0]["title"] == "T x" and got[1]["published_at_utc"] is None


def test_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"data": [[1704067200000, 1, 2, 0.5, 1.5], [1704067200000, 1, 2, 0.5, 1.5]]}')
    got = readers.dvol_rows(readers.json_rows(spark, str(tmp_path), "data array<array<double>>")).collect()
    assert len(got) == 1 and got[0]["time"] == T and got[0]["dvol_close"] == 1.5
    m = spark.createDataFrame([("S", "2024-01-01", ".", "2024-01-10"), ("S", "2024-01-02", "4.5", "2024-01-11")], "series string, date string, value string, realtime_start string")
    r = readers.macro_rows(m, 17).collect()
    assert len(r) == 1 and r[0]["published_at"] == dt.datetime(2024, 1, 11, 17)
    rep = readers.report_rows(spark.createDataFrame([(dt.date(2024, 7, 2),)], "report_date date")).first()
    assert rep["published_at"] == dt.datetime(2024, 7, 5, 19, 30)
    oc = readers.onchain_rows(spark.createDataFrame([(dt.date(2024, 1, 1), None), (dt.date(2024, 1, 1), "1704200000")], "date date, eod string")).collect()
    assert oc[0]["published_at"] == dt.datetime(2024, 1, 2, 5) and oc[1]["published_at"] == dt.datetime(2024, 1, 2, 12, 53, 20)


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    assert sinks.load_or_quarantine(spark, p) is None
    sinks.merge_write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), p, ["k"])
    sinks.merge_write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), p, ["k"])
    assert {tuple(r) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    sinks.merge_write(spark.createDataFrame([(3, "z"), (4, "e")], "k int, v string"), p, ["k"], "first")
    assert {tuple(r) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c"), (3, "d"), (4, "e")}
    sinks.insert_or_ignore(spark.createDataFrame([(4, "x"), (5, "f"), (5, "f")], "k int, v string"), p, ["k"])
    assert spark.read.parquet(p).count() == 5
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"PAR1 no")
    assert sinks.load_or_quarantine(spark, str(bad)) is None and not bad.exists() and list(tmp_path.glob("bad.corrupt-*"))
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "day date, v int")
    sinks.write_days(days, str(tmp_path / "d"))
    sinks.write_days(days.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "d"))
    kept = spark.read.parquet(str(tmp_path / "d"))
    assert {r["v"] for r in kept.collect()} == {1, 9}
    assert sinks.pending_days(spark, "2024-01-01", "2024-01-04", kept).count() == 2
    assert sinks.artefact(days.select("v"), None) == '[{"v":1},{"v":2}]'


def test_contract(spark, tmp_path):
    df = spark.createDataFrame([(T, 1.0)], "open_time timestamp, close double")
    df.write.parquet(str(tmp_path / "raw" / "a_1.parquet"))
    c = contract.from_files(spark, str(tmp_path / "raw"), {"k": "a_*.parquet"}, "t")
    contract.export(c, str(tmp_path / "c.json"))
    c = contract.load(str(tmp_path / "c.json"))
    contract.validate(df, c, "k")
    contract.validate(df.withColumn("x", F.lit(1)), c, "k", extra=True)
    for other in (df.drop("close"), df.withColumnRenamed("close", "c"), df.withColumn("x", F.lit(1)), df.withColumn("close", F.lit(1).cast("float"))):
        with pytest.raises(contract.ContractViolation):
            contract.validate(other, c, "k")
    with pytest.raises(contract.ContractViolation):
        contract.validate(df, c, "none")
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, str(tmp_path / "none_*"))


def test_revisions_append(spark):
    s = "k string, c string, at int"
    held = merge.revisions(spark.createDataFrame([("a", "A", 1), ("a", "B", 2), ("a", "B", 3), ("a", "A", 4)], s), "k", "c", ["at"])
    assert [(r["c"], r["revision_no"]) for r in held.orderBy("at").collect()] == [("A", 0), ("B", 1), ("A", 2)]
    more = merge.append_revisions(held, spark.createDataFrame([("a", "A", 5), ("a", "C", 6), ("b", "X", 5)], s), "k", "c", ["at"])
    assert {(r["k"], r["c"], r["revision_no"], r["status"]) for r in more.collect()} == {("a", "C", 3, "revision"), ("b", "X", 0, "new")}


def test_greedy_dedup(spark):
    s = "key string, vector array<double>, seen_at int"
    recent = spark.createDataFrame([("r", [1.0, 0.0], 1)], s)
    pending = spark.createDataFrame([("a", [1.0, 0.05], 2), ("b", [0.0, 1.0], 3), ("c", [0.01, 1.0], 4), ("z", [0.0, 0.0], 5)], s)
    got = {r["key"]: r["duplicate_of"] for r in dedup.greedy_cosine(pending, recent).collect()}
    assert got == {"a": "r", "b": None, "c": "b", "z": None}


def test_anonymise(spark):
    df = spark.createDataFrame([("FTX US and Binance in March 3, 2022",), ("the arctic circle of compound interest",), (None,), ("",)], "t string")
    got = [r["a"] for r in df.select(text.anonymise(F.col("t")).alias("a")).collect()]
    assert got[0]["hits"] == 3 and "FTX" not in got[0]["text"] and "recently" in got[0]["text"]
    assert got[1]["text"] == "the arctic circle of compound interest" and got[1]["hits"] == 0
    assert got[2]["text"] is None and got[3]["hits"] == 0


def test_sequences_pad(spark):
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(3)], "asset string, date int, r double")
    assert [r["window"] for r in dataset.sequences(df, "r", 2).orderBy("date").collect()] == [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]]


def test_training_frame_guards(spark):
    lab = spark.createDataFrame([("a", T), ("a", T + dt.timedelta(days=800))], "asset string, t0_time timestamp")
    m = spark.createDataFrame([("a", T - dt.timedelta(days=1), 1.0, None)], "asset string, decision_day timestamp, feat double, dead double")
    frame, names = dataset.training_frame(lab, m)
    assert frame.count() == 1 and names == ["feat"]
    assert dataset.training_frame(lab, m, lockbox=None)[0].count() == 2
    with pytest.raises(ValueError):
        dataset.training_frame(lab, m.withColumn("decision_day", F.lit(T + dt.timedelta(days=1))))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("u", "A", T), ("u", "B", T + dt.timedelta(hours=1)), ("u", "B", T + dt.timedelta(hours=2))], "url string, body string, at timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.landed(spark, str(tmp_path / "in"), "url string, body string, at timestamp")
    q = flows.run(flows.revisions(stream, "url", "body", "at"), str(tmp_path / "c1"), name="rev")
    q.awaitTermination()
    assert [(r["content"], r["revision_no"]) for r in spark.table("rev").orderBy("revision_no").collect()] == [("A", 0), ("B", 1)]
    sink = flows.append_revision_batches(str(tmp_path / "out"), "url", "body", ["at"])
    flows.run(stream, str(tmp_path / "c2"), sink).awaitTermination()
    sink(spark.read.parquet(str(tmp_path / "in")).where("body = 'B'"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    runs = spark.createDataFrame([("f", T, "e1", "m", None), ("f", T + dt.timedelta(hours=1), None, None, "boom")], "feed_name string, at timestamp, etag string, modified string, error string")
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    q = flows.run(flows.feed_state(flows.landed(spark, str(tmp_path / "runs"), runs.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "))), str(tmp_path / "c3"), name="state", mode="update")
    q.awaitTermination()
    r = spark.table("state").first()
    assert (r["etag"], r["error_count"], r["last_error"]) == ("e1", 1, "boom")
    fresh = {x["feed"]: x["fresh"] for x in flows.freshness({"a": (rows, "at", 48.0), "b": (rows, "at", 1.0)}, T + dt.timedelta(hours=24)).collect()}
    assert fresh == {"a": True, "b": False}


def test_the_last_read_bar_stays(spark, tmp_path):
    rest = "2,0.5,{},10,0,15,3,4,5,0"
    archive(tmp_path, "a", f"1577836800000,1,{rest.format(1.5)}\n1577836800000,1,{rest.format(1.0)}\n1577840400000,1,{rest.format(9.0)}\n")
    archive(tmp_path, "b", f"1577840400000,1,{rest.format(2.0)}\n")
    got = readers.klines(readers.zipped_csv(spark, str(tmp_path), readers.KLINE)).orderBy("open_time").collect()
    assert [r["close"] for r in got] == [1.0, 2.0]


def test_volatility_index_by_currency(spark):
    rows = [("BTC", [[0.0, 1.0, 2.0, 0.5, 1.5], [0.0, 9.0, 9.0, 9.0, 9.0]]), ("ETH", [[0.0, 3.0, 4.0, 2.5, 3.5]])]
    got = readers.dvol_rows(spark.createDataFrame(rows, "currency string, data array<array<double>>"), keep=["currency"]).orderBy("currency").collect()
    assert [(r["currency"], r["dvol_open"]) for r in got] == [("BTC", 1.0), ("ETH", 3.0)]


def test_notify(spark):
    from tideline.sources.notify import Chat, alert_rows

    sent = []
    chat = Chat("t", "c", lambda url, payload: sent.append(payload))
    assert chat.send("error: <Response [403]> & more")
    assert sent[0]["text"] == "error: &lt;Response [403]&gt; &amp; more" and sent[0]["chat_id"] == "c"
    assert not Chat(None, "c", lambda *_: sent.append(None)).send("x") and len(sent) == 1

    def fails(*_):
        raise OSError("no route")

    assert not Chat("t", "c", fails).send("x")
    df = spark.createDataFrame([(f"m{i}",) for i in range(5)] + [(None,)], "message string")
    assert alert_rows(df.where("message is not null"), chat, most=3) == 4 and [p["text"] for p in sent[1:]] == ["m0", "m1", "m2", "and 2 more"]


def test_similar_to_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0, 2.0]), (64, [None, *[1.0] * 7])]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(0, 60, 2) for j in range(60) if i != j and unit[i] @ unit[j] >= 0.3}
    for tile in (2048, 7):
        got = {(g["key"], g["ref"]) for g in dedup.similar_to(df.where("key % 2 = 0"), df, 0.3, tile=tile).collect()}
        assert got == want
    assert dedup.similar_to(df.limit(0), df, 0.3).count() == 0


def test_artefact_is_bounded(spark):
    with pytest.raises(ValueError):
        sinks.artefact(spark.range(5), most=4)


def test_decision_counts_are_the_batch_fan_out(spark, tmp_path):
    from tideline.operators import news

    times = [T, T + dt.timedelta(hours=5), T + dt.timedelta(days=1), T + dt.timedelta(days=30)]
    df = spark.createDataFrame([(t,) for t in times], "usable_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = flows.run(flows.decision_counts(flows.landed(spark, str(tmp_path / "in"), "usable_at timestamp")), str(tmp_path / "c"), name="fan")
    q.awaitTermination()
    got = {r["decision_day"]: r["n"] for r in spark.table("fan").collect()}
    batch = news.fan_out(df.withColumn("usable_at", F.col("usable_at").cast("timestamp_ntz")), "usable_at").groupBy("decision_day").count().collect()
    want = {r["decision_day"]: r["count"] for r in batch}
    assert got == {d: n for d, n in want.items() if d < times[-1]} and len(got) == 8


def test_copies_as_a_stream(spark, tmp_path):
    """Batches one after the other give what one greedy pass gives."""
    import numpy as np

    r = np.random.default_rng(5)
    base = r.standard_normal((6, 4))
    rows = [("k", f"n{i:02d}", (base[i % 6] + r.standard_normal(4) * 0.2).tolist(), T + dt.timedelta(hours=i)) for i in range(30)]
    s = "key string, name string, vector array<double>, at timestamp"
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], s).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    flows.run(flows.copies(source, "key", "name", "vector", "at", 0.9), str(tmp_path / "c"), name="copies").awaitTermination()
    got = {x["name"]: x["duplicate_of"] for x in spark.table("copies").collect()}
    one = spark.createDataFrame([(n, v, i) for i, (_, n, v, _) in enumerate(rows)], "key string, vector array<double>, seen_at int")
    want = {x["key"]: x["duplicate_of"] for x in dedup.greedy_cosine(one, one.limit(0), 0.9).collect()}
    assert got == want and any(want.values())


def against_sql(name, spark, folder, tables):
    """The rows of a query over small tables made here, and those of its SQL."""
    import duckdb
    from compare import rows

    from tideline.plans.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/made/{t}")
        (made,) = (folder / "made" / t).glob("*.parquet")
        made.rename(folder / f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLE[name])
    return got, rows(got.columns, [tuple(r) for r in got.collect()]), rows([d[0] for d in want.description], want.fetchall())


def test_stream_revisions_stand_in_files(spark, tmp_path):
    """Its rows aren't held by the driver; sightings at the same time go by their id, null contents as in the SQL."""
    seen = [(1, T, 1, "b"), (2, T, 1, "a"), (3, T, 1, "b"), (4, T, 2, None), (5, T, 2, "x"), (6, T + dt.timedelta(hours=1), 2, None), (7, T + dt.timedelta(hours=2), 2, "x"), (8, None, 3, "y"), (9, T, 3, "z"), (10, T, None, "n")]
    events = spark.createDataFrame(seen, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    df, have, want = against_sql("stream_revisions", spark, tmp_path, {"events": events})
    assert df.inputFiles()
    assert have == want and len(have[1]) == 9


def test_headlines_as_in_sql(spark, tmp_path):
    """Crypto words, names, ids of hexadecimal letters, too few words and near copies in the order of their URLs."""
    said = {
        0: "one two three four", 350: "one two three four apple", 2: "apple pear", 14: "red green decade", 16: "facade blue facade",
        1: "the token of a mining house", 3: "Visa and Fidelity in May", 7: "bitcoin falls again now", 5: "Tesla İstanbul rises fast", 8: None, 9: "decade token decade mining decade",
    }
    documents = spark.createDataFrame([(i, t) for i, t in said.items()], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "https://a.example/x")], "page_id long, url string")
    _, have, want = against_sql("headlines", spark, tmp_path, {"documents": documents, "pages": pages})
    assert have == want and len(have[1]) == 6


def test_headlines_are_told_apart_and_anonymous(spark):
    """Without a slug or kind given, the URL's words say both, and names are taken out."""
    from tideline.operators import regime

    urls = [(1, f"https://a.example/{s}.html", n) for s, n in (("bitcoin-miners-sell-more", 3), ("visa-and-fidelity-report-gains", 2), ("bitcoin-miners-sell-more-now", 1))]
    got = regime.headlines(spark.createDataFrame(urls, "day int, url string, n_themes int")).orderBy("position").collect()
    assert [(r["kind"], r["position"]) for r in got] == [("crypto", 0), ("macro", 1)]
    assert got[0]["headline"] == "bitcoin miners sell more" and "fidelity" not in got[1]["headline"]
