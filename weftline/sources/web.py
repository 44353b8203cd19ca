"""Pages over HTTP as a Spark data source, and rows sent by HTTP.

Fetching is ingestion: it fills a table of captured pages, on which every query works.  The
addresses are dealt over partitions; each partition keeps one opener.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import rules as R

SCHEMA = "url string, final_url string, status int, headers map<string,string>, body binary, error string"
TIMEOUT, PROBE_BYTES = 15.0, 512_000
HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "en"}


def fetch(url: str, most: int, timeout: float = TIMEOUT) -> tuple:
    """One row: an HTTP error has its status and body, a transport error its message; the body is cut at ``most`` bytes."""
    if not url.lower().startswith(("http://", "https://")):
        return url, None, None, None, None, "not http"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as r:
            return url, r.url, r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(most), None
    except urllib.error.HTTPError as e:
        return url, e.url, e.code, {k.lower(): v for k, v in e.headers.items()}, e.read(most), None
    except (OSError, ValueError) as e:
        return url, None, None, None, None, str(e)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.parts = max(1, int(options.get("partitions", "8")))
        self.most = int(options.get("maxbytes", options.get("maxBytes", PROBE_BYTES)))
        self.timeout = float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition) -> Iterator[tuple]:
        for u in partition.urls:
            yield fetch(u, self.most, self.timeout)


class WebSource(DataSource):
    """``spark.read.format("web").option("urls", json_list)``; options ``partitions``, ``maxBytes``, ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, urls: list[str], most: int = PROBE_BYTES, partitions: int = 8) -> DataFrame:
    """Pages of a list of addresses."""
    spark.dataSource.register(WebSource)
    return spark.read.format("web").option("urls", json.dumps(urls)).option("maxBytes", most).option("partitions", partitions).load()


def fetched(urls: DataFrame, most: int = PROBE_BYTES) -> DataFrame:
    """Pages of a table of addresses ``(url)``, whatever its size."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        for b in batches:
            rows = [fetch(u or "", most) for u in b.column("url").to_pylist()]
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in kinds]
            columns[3] = [None if h is None else list(h.items()) for h in columns[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["url", "final_url", "status", "headers", "body", "error"])

    return urls.select("url").mapInArrow(run, SCHEMA)


def usable(pages: DataFrame) -> DataFrame:
    """Pages with ``html`` that came whole and aren't a block; the others are counted by the caller's observation."""
    html = F.make_valid_utf8(F.col("body").cast("string"))
    return pages.withColumn("html", html).withColumn("block", R.block(F.col("status"), F.col("headers"), F.col("html"))).where("status = 200 and block is null").where(R.html_content(F.col("headers")["content-type"])).drop("block", "body")


def send(rows: DataFrame, url: str, method: str = "POST") -> DataFrame:
    """``(n, status)``: each row sent as a JSON object; a failure is a null status and doesn't stop the others."""
    said = rows.select(F.to_json(F.struct(*rows.columns)).alias("row"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for body in b.column("row").to_pylist():
                try:
                    q = urllib.request.Request(url, data=body.encode(), method=method, headers=HEADERS | {"Content-Type": "application/json"})
                    with urllib.request.urlopen(q, timeout=TIMEOUT) as r:
                        out.append(r.status)
                except urllib.error.HTTPError as e:
                    out.append(e.code)
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["status"])

    return said.mapInArrow(run, "status int").groupBy("status").agg(F.count("*").alias("n"))


def store_ready(spark: SparkSession, path: str) -> bool:
    """Whether the store of a table answers and the table's folder is there; an unreachable store is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def healthy(pages: DataFrame) -> DataFrame:
    """Every page, or an error that names the first thing wrong with one."""
    html = F.make_valid_utf8(F.col("body").cast("string"))
    block = R.block(F.col("status"), F.col("headers"), html)
    wrong = (
        F.when(~F.col("url").rlike("^https?://"), F.concat(F.lit("not http: "), "url")).when(block.isNotNull(), F.concat(F.lit("blocked: "), "url", F.lit(" "), block["reason"]))
        .when(F.col("status").isNull(), F.concat(F.lit("no answer: "), "url")).when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"), F.lit(": "), "url"))
    )
    return pages.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))
