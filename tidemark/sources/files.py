"""Sources: JSON tables, text trees, HTML listings, paged search and message channels."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """JSON files under an explicit schema (codes stay strings); the first path that exists is read, none gives no rows."""
    for path in [paths] if isinstance(paths, str) else paths:
        if exists(spark, path):
            return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.createDataFrame([], schema)


def input_root(spark: SparkSession, preferred: str, legacy: str) -> str:
    """The folder to read text files from: the preferred one if it is there, else the older one if it holds folders named by codes."""
    if exists(spark, preferred) or not exists(spark, legacy):
        return preferred
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(legacy)
    held = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return legacy if any(s.isDirectory() and re.fullmatch("[0-9A-Z]{6}", s.getPath().getName()) for s in held) else preferred


def read_config(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """Settings of a JSON file over defaults, section by section; the file is one small document, read on the driver."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])

    def over(base: dict, top: dict) -> dict:
        return {k: over(base[k], top[k]) if isinstance(base.get(k), dict) and isinstance(top.get(k), dict) else top.get(k, base.get(k)) for k in base.keys() | top.keys()}

    return over(defaults or {}, given)


def read_envelopes(spark: SparkSession, folder: str, field: str, schema: str) -> DataFrame:
    """Rows of an array inside one envelope file per company, with the code taken from the file name."""
    rows = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9A-Z]{6})\.json$", 1).alias("file_code"), F.inline(field))


def without_company(base: DataFrame, detail: DataFrame, code: str, column: str = "stock_code") -> DataFrame:
    """A company's rows replaced by its detail table (lazy loading as a pruned read)."""
    return base.where(F.col(column) != code).unionByName(detail)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Bytes as text: empty, UTF-8 with or without mark, CP949, or unreadable."""

    def one(raw: bytes | None) -> tuple:
        if not raw:
            return "", "empty"
        for encoding in ("utf-8-sig", "cp949"):
            try:
                return bytes(raw).decode(encoding), encoding
            except UnicodeDecodeError:
                continue
        return None, "unreadable"

    return pd.DataFrame([one(c) for c in content], columns=["text", "encoding"])


def text_tree(spark: SparkSession, root: str) -> DataFrame:
    """Text files below six-character code folders: path, folder_code, sha256, text, encoding, n_bytes, first_copy.

    Spark's file sources give no row for files of zero bytes.  first_copy marks the first path of each content, so copies can be left out without losing their count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    rows = files.select("path", F.regexp_extract("path", r"/([0-9A-Z]{6})/[^/]*$", 1).alias("folder_code"), F.sha2("content", 256).alias("sha256"), decoded("content").alias("d"), F.col("length").alias("n_bytes"))
    # the least path of each content, found on hashes alone: texts of many copies don't meet in one task
    first = rows.groupBy("sha256").agg(F.min("path").alias("path")).select("path", F.lit(True).alias("first"))
    return rows.join(first, "path", "left").select("path", "folder_code", "sha256", "d.text", "d.encoding", "n_bytes", F.coalesce("first", F.lit(False)).alias("first_copy"))


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.row, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append(self.row)


@F.udtf(returnType=StructType([StructField("position", IntegerType()), StructField("cells", ArrayType(StringType()))]))
class HtmlRows:
    """Rows of the tables in an HTML export."""

    def eval(self, content: bytes, encoding: str):
        if content is None:
            return
        parser = _Cells()
        parser.feed(html.unescape(bytes(content).decode(encoding, "replace")))
        for k, row in enumerate(parser.rows):
            yield k, row


def html_listing(spark: SparkSession, path: str, encoding: str = "euc-kr", columns: int = 10, key: int = 2) -> DataFrame:
    """Listing export as (code, cells): rows of at least ``columns`` cells, header skipped, the last row of a code wins."""
    spark.udtf.register("tidemark_html_rows", HtmlRows)
    spark.read.format("binaryFile").load(path).createOrReplaceTempView("tidemark_html_files")
    rows = spark.sql(f"select r.position, r.cells from tidemark_html_files, lateral tidemark_html_rows(content, '{encoding}') r")
    body = rows.where((F.size("cells") >= columns) & (F.col("position") > 0)).withColumn("code", F.get("cells", F.lit(key)))
    return body.groupBy("code").agg(F.max_by("cells", "position").alias("cells"))


def env_pairs(spark: SparkSession, path: str) -> DataFrame:
    """KEY=VALUE lines; comments and blanks are skipped, the value keeps further equal signs."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%' and line like '%=%'")
    return lines.select(F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.trim(F.expr("substring(line, locate('=', line) + 1)")).alias("value"))


def mock_provider(spark: SparkSession, companies: DataFrame, per_company: int, start: str) -> DataFrame:
    """Deterministic articles, a minute apart: what a provider returns is min(budget, per_company)."""
    n = F.least(F.col("budget"), F.lit(per_company))
    rows = companies.where("budget > 0").withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("stock_code", "k", F.concat("stock_code", F.lit(" article "), F.col("k").cast("string")).alias("title"), F.concat(F.lit("https://mock.example/"), "stock_code", F.lit("/"), F.col("k").cast("string")).alias("url"), (F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k"))).alias("published_at"))


def synthetic_companies(spark: SparkSession, count: int) -> DataFrame:
    """Companies by position: the first tenth core, the first half watch, the rest background."""
    tier = F.when(F.col("id") < count * 0.1, "core").when(F.col("id") < count * 0.5, "watch").otherwise("background")
    return spark.range(count).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.concat(F.lit("Company "), F.col("id").cast("string")).alias("company_name"), tier.alias("monitoring_tier"))


class SearchSource(DataSource):
    """Article search as a data source: one partition per company and provider page.

    Options: fixture (a JSON-lines file of responses: stock_code, provider, title, url, published_at)
    stands for the service where there is no network; start and end bound the published time.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_search"

    def schema(self) -> str:
        return "stock_code string, provider string, title string, url string, published_at string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fixture, self.start, self.end = options["fixture"], options.get("start", ""), options.get("end", "9999")
        self.parts = int(options.get("partitions", "4"))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.fixture, encoding="utf-8") as f:
            for number, line in enumerate(f):
                if number % self.parts != partition.value:
                    continue
                try:
                    row = json.loads(line)
                except ValueError:
                    continue  # unreadable responses are skipped
                if self.start <= row.get("published_at", "") <= self.end:
                    yield tuple(row.get(k) for k in ("stock_code", "provider", "title", "url", "published_at"))


class ChannelSource(DataSource):
    """Message channel as a stream: offsets are message ids, batches are bounded and read where they are planned.

    A batch starts at the offset that the engine hands over, on a restart the one of its checkpoint, so nothing comes twice.
    Options: fixture (JSON lines: id, date, text, ordered by id) and batch (default 500).
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_channel"

    def schema(self) -> str:
        return "id long, date string, text string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _ChannelReader(self.options)


class _ChannelReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.fixture, self.batch = options["fixture"], int(options.get("batch", "500"))

    def _rows(self, after: int, to: int | None = None) -> Iterator[tuple]:
        with open(self.fixture, encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                if row["id"] > after and (to is None or row["id"] <= to):
                    yield row["id"], row.get("date"), row.get("text")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(islice(self._rows(start["id"]), self.batch))
        return iter(rows), {"id": rows[-1][0] if rows else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._rows(start["id"], end["id"])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
    spark.dataSource.register(ChannelSource)
