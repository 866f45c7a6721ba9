"""Readers of landed files: parquet globs, zipped and plain CSV, tone lines, JSON payloads, HTML tables, feeds.

Nothing here fetches: a landing job puts payloads where Spark can read them, and these turn them into typed tables. Text is read as text
and cast leniently, never inferred: what doesn't parse is null.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.clock import from_epoch

KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
FUNDING = ("calc_time", "funding_interval_hours", "last_funding_rate")
METRICS = ("sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")
#: What marks a tone line as being about an asset, in upper case.
KEYWORDS = {
    "BTC": ("BITCOIN", " BTC ", "BTCUSD"),
    "ETH": ("ETHEREUM", "ETHER PRICE", "ETHUSD"),
    "CRYPTO": ("CRYPTOCURRENC", "CRYPTO CURRENC", "CRYPTOASSET", "CRYPTO MARKET"),
}


def parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, tolerant: bool = False) -> DataFrame:
    """Parquet files; tolerant: unreadable ones are skipped (never deleted) and columns that some lack are null."""
    reader = spark.read
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("mergeSchema", "true")
    out = reader.parquet(*([path] if isinstance(path, str) else path))
    return out.select(*columns) if columns else out


def count(spark: SparkSession, path: str) -> int:
    """Rows, from footers."""
    return spark.read.parquet(path).count()


def newest(spark: SparkSession, pattern: str) -> str:
    """The last path by name that a glob matches."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath()) for f in found or [])
    if not names:
        raise FileNotFoundError(f"no files match {pattern}")
    return names[-1]


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], header: str = "auto") -> DataFrame:
    """All-string rows of CSV files inside zip archives, one task an archive, with the place they were read from (file: archive, line). header: "yes", "no", or "auto" (a first row whose first cell is no number)."""
    return unzipped_csv(spark.read.format("binaryFile").load(path).select("path", "content"), columns, header)


def unzipped_csv(files: DataFrame, columns: Sequence[str], header: str = "auto") -> DataFrame:
    """As zipped_csv(), of archives that are rows already: files(path, content)."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                line = 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        part = pd.read_csv(z.open(name), header=None, names=list(columns), dtype=str, usecols=range(len(columns)), keep_default_na=False)
                        first = part.iloc[0, 0] if len(part) else ""
                        if len(part) and (header == "yes" or header == "auto" and not first.lstrip("-").replace(".", "", 1).isdigit()):
                            part = part.iloc[1:]
                        part.insert(0, "line", range(line, line + len(part)))
                        part.insert(0, "file", path)
                        line += len(part)
                        yield part

    return files.mapInPandas(run, ", ".join(["file string, line long", *(f"{c} string" for c in columns)]))


def klines(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed bars from string columns; of rows with one open_time the last read stays: the last line of the archive whose name comes last."""
    read = ["file", "line"]
    typed = raw.select(
        *keep, *read, from_epoch(F.expr("try_cast(open_time as double)")).alias("open_time"),
        *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")], F.expr("try_cast(trades as bigint)").alias("trades"),
        *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("taker_buy_base", "taker_buy_quote")],
    ).where("open_time is not null")
    w = Window.partitionBy(*keep, "open_time").orderBy(*[F.desc(c) for c in read])
    return typed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *read)


def metrics(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed positioning rows; rows whose time doesn't parse are dropped, values that don't are null."""
    typed = [F.expr(f"try_cast({c} as double)").alias(c) for c in METRICS]
    return raw.select(*keep, F.try_to_timestamp("create_time", F.lit("yyyy-MM-dd HH:mm:ss")).alias("create_time"), *typed).where("create_time is not null")


def tone_lines(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of tab-separated event lines about an asset: the keyword test stands before the split, so other lines are never parsed."""
    upper = F.upper(value)
    hit = {a: _any(upper, words) for a, words in KEYWORDS.items()}
    any_hit = None
    for h in hit.values():
        any_hit = h if any_hit is None else any_hit | h
    cols = F.split(value, "\t")
    held = lines.where(any_hit).select(*keep, F.col(value).alias("_v"), cols.alias("_c"), F.array_join(F.array_compact(F.array(*[F.when(h, a) for a, h in hit.items()])), ",").alias("assets"))
    held = held.where(F.size("_c") >= 16).withColumn("gkg_time", F.try_to_timestamp(F.col("_c")[1], F.lit("yyyyMMddHHmmss"))).where("gkg_time is not null")
    tone = F.split(F.col("_c")[15], ",")
    part = [F.get(tone, i).try_cast("double") for i in range(4)]
    bad = part[0].isNull() | part[1].isNull() | part[2].isNull() | part[3].isNull()
    names = ("tone", "positive", "negative", "polarity")
    themes = F.col("_c")[7]
    return held.select(
        *keep, "gkg_time", F.col("_c")[3].alias("source"), F.col("_c")[4].alias("url"), "assets", *[F.when(bad, F.lit(float("nan"))).otherwise(p).alias(n) for p, n in zip(part, names, strict=True)],
        F.regexp_count(themes, F.lit(";")).alias("n_themes"), F.decode(F.expr("substring(encode(_c[7], 'UTF-8'), 1, 600)"), "UTF-8").alias("themes"),
    )


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def json_rows(spark: SparkSession, path: str, schema: str, rows: str | None = None, multiline: bool = True) -> DataFrame:
    """Rows of JSON payloads; ``rows`` names the array inside (a page), else payloads are arrays or objects themselves."""
    held = spark.read.schema(schema).option("multiLine", str(multiline).lower()).option("mode", "PERMISSIVE").json(path)
    return held.select(F.explode(rows).alias("r")).select("r.*") if rows else held


def dvol_rows(payload: DataFrame, data: str = "data", keep: Sequence[str] = ()) -> DataFrame:
    """(time, dvol_open, dvol_high, dvol_low, dvol_close) of arrays [ms, open, high, low, close] by ``keep``. Of several rows of one time the one that stands first in its payload stays; between payloads, the smallest."""
    r = payload.select(*keep, F.posexplode(data).alias("_at", "r")).select(*keep, "_at", F.timestamp_millis(F.col("r")[0].cast("long")).alias("time"), *[F.col("r")[i + 1].alias(f"dvol_{n}") for i, n in enumerate(("open", "high", "low", "close"))])
    values = [c for c in r.columns if c not in (*keep, "time", "_at")]
    first = F.row_number().over(Window.partitionBy(*keep, "time").orderBy("_at", *values))
    return r.withColumn("_n", first).where("_n = 1").drop("_n", "_at")


def macro_rows(payload: DataFrame, hours_utc: int | None = None) -> DataFrame:
    """(series, date, value[, published_at]) of observations with placeholder dots as null; first prints are known a fixed time after their vintage date."""
    out = payload.select("series", F.expr("try_cast(date as date)").alias("date"), F.expr("try_cast(value as double)").alias("value"), *(["realtime_start"] if hours_utc is not None else []))
    out = out.where("date is not null and value is not null")
    return out if hours_utc is None else out.withColumn("published_at", (F.expr("try_cast(realtime_start as date)").cast("timestamp") + F.expr(f"interval {hours_utc} hours"))).drop("realtime_start")


def published_after(rows: DataFrame, day: str, hours: int, name: str = "published_at") -> DataFrame:
    """A source whose value for a day is known a fixed number of hours after that day begins."""
    return rows.withColumn(name, F.col(day).cast("timestamp") + F.expr(f"interval {hours} hours"))


def onchain_rows(payload: DataFrame) -> DataFrame:
    """published_at is the provider's end-of-day stamp (epoch seconds), else 29 hours after the day began."""
    fallback = F.col("date").cast("timestamp") + F.expr("interval 29 hours")
    return payload.withColumn("published_at", F.coalesce(F.timestamp_seconds(F.expr("try_cast(eod as bigint)")), fallback))


def report_rows(payload: DataFrame, day: str = "report_date") -> DataFrame:
    """Weekly positions of a Tuesday, published the Friday after at 15:30 New York time."""
    local = F.col(day).cast("timestamp") + F.expr("interval 3 days 15 hours 30 minutes")
    return payload.withColumn("published_at", F.to_utc_timestamp(local, "America/New_York"))


class _Tables(HTMLParser):
    """All tables of a page as rows of cell texts."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []
            self.open[-1][-1].append("")

    def handle_data(self, data):
        if self.cell is not None and self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1] += data

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()


def html_cells(pages: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, row, cells): the rows of each page's largest table."""
    schema = T.StructType([*[pages.schema[k] for k in keep], T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])

    def run(frames):
        for pdf in frames:
            out = []
            for rec in pdf.to_dict("records"):
                p = _Tables()
                p.feed(rec[html] or "")
                best = max(p.tables, key=len, default=[])
                out += [(*[rec[k] for k in keep], i, [c.strip() for c in row]) for i, row in enumerate(best)]
            yield pd.DataFrame(out, columns=schema.names)

    return pages.select(*keep, html).mapInPandas(run, schema)


def flow_table(pages: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, date, fund, flow_musd) of tables with a header of funds and rows by day: (x) is negative, a dash null; other rows are skipped."""
    rows = html_cells(pages, html, keep)
    first = F.col("cells")[0]
    head = rows.where((F.size("cells") > 3) & first.isin("", "Date"))
    head = head.groupBy(*(keep or [F.lit(0).alias("_k")])).agg(F.min_by("cells", "row").alias("head"))
    days = rows.withColumn("date", F.to_date(F.try_to_timestamp(first, F.lit("d MMM yyyy")))).where("date is not null")
    joined = days.join(head, [*keep]) if keep else days.crossJoin(F.broadcast(head.drop("_k")))
    cells = joined.select(*keep, "date", F.posexplode("cells").alias("i", "raw"), "head").withColumn("fund", F.get("head", F.col("i")))
    cells = cells.where("i > 0 and fund is not null and fund <> ''").withColumn("v", F.trim(F.regexp_replace("raw", ",", "")))
    number = F.regexp_replace("v", r"^\(|\)$", "").try_cast("double")
    blank = F.col("v").isin("-", "")
    value = F.when(~blank, F.when(F.col("v").rlike(r"^\(.*\)$"), -number).otherwise(number))
    return cells.withColumn("flow_musd", value).where(blank | F.col("flow_musd").isNotNull()).select(*keep, "date", "fund", "flow_musd")


def feed_entries(feeds: DataFrame, xml: str = "xml", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, url, title, body, published_at_utc) of RSS items: published, else updated; null if neither parses."""
    items = feeds.select(*keep, F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("_i"))

    def text(tag: str) -> Column:
        got = F.regexp_extract("_i", rf"(?s)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)
        plain = F.regexp_replace(F.regexp_replace(got, "<[^>]*>", " "), r"\s+", " ")
        return F.nullif(F.trim(plain), F.lit(""))

    # names of days are not read: a date in day-month-year order says the same
    when = F.coalesce(text("pubDate"), text("updated"))
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(when, r"^\w{3},\s*", ""), r"\b(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), when.try_cast("timestamp"))
    return items.select(*keep, text("link").alias("url"), text("title").alias("title"), text("description").alias("body"), stamp.alias("published_at_utc")).where("url is not null")


SCORE = "assets array<string>, sentiment double, confidence double, event_type string, severity int, is_price_report boolean"


def scores(payload: Column, events: Sequence[str]) -> Column:
    """A score struct parsed from JSON, or null where it doesn't parse, lacks a field, or is out of range."""
    s = F.from_json(payload, SCORE)
    whole = s["assets"].isNotNull() & s["is_price_report"].isNotNull() & s["sentiment"].between(-1, 1) & s["confidence"].between(0, 1) & s["severity"].between(1, 5) & s["event_type"].isin(*events)
    return F.when(whole, s)


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): lines of text files inside zip archives, one task an archive; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        lines = z.read(member).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"path": [name] * len(lines), "value": lines})

    return files.mapInPandas(run, "path string, value string")


def whole_days(files: DataFrame, expected: int = 96, day: str = "day", state: str = "state") -> DataFrame:
    """Days all of whose source files came, or are known holes (state ok or missing): any other failure leaves a day pending."""
    counts = files.groupBy(day).agg(F.count("*").alias("n"), F.count_if(F.col(state).isin("ok", "missing")).alias("good"))
    return counts.where((F.col("n") == expected) & (F.col("good") == expected)).select(day)


def rates_csv(spark: SparkSession, path: str) -> DataFrame:
    """(day, percent) of a two-column CSV with a header and dots for missing values."""
    raw = spark.read.schema("day string, percent string").option("header", "true").option("enforceSchema", "true").csv(path)
    return raw.select(F.expr("try_cast(day as date)").alias("day"), F.expr("try_cast(percent as double)").alias("percent")).where("day is not null")
