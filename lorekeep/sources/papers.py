"""Paper search as a Spark data source, and downloads with retries."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions.text import normalize_paper_id, safe_filename
from .files import LEAST_BYTES

_ATOM = {"a": "http://www.w3.org/2005/Atom"}


def query_for(category: str, year: int | None = None) -> str:
    """The remote search for a category, in one year if it is given (0 counts as not given)."""
    return f"cat:{category} AND submittedDate:[{year}01010000 TO {year}12312359]" if year else f"cat:{category}"


def parse_feed(xml: bytes) -> list[tuple]:
    """Raw rows of an Atom feed: id, title, authors, published, summary, pdf_url."""
    out = []
    for e in ET.fromstring(xml).findall("a:entry", _ATOM):
        text = lambda t, e=e: " ".join((e.findtext(f"a:{t}", "", _ATOM)).split())
        pdf = next((x.get("href") for x in e.findall("a:link", _ATOM) if x.get("title") == "pdf"), None)
        out.append((text("id").rpartition("/abs/")[2], text("title"), [a.findtext("a:name", "", _ATOM) for a in e.findall("a:author", _ATOM)], text("published"), text("summary"), pdf))
    return out


def fetch(url: str, timeout: float = 30) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


class _Page(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        """One partition: the remote asks for a pause between requests."""
        return [_Page(0, int(self.options.get("max_results", 10)))]

    def read(self, partition):
        o = self.options
        page, delay, retries = int(o.get("page", 100)), float(o.get("delay", 3.0)), int(o.get("retries", 3))
        done = 0
        while done < partition.count:
            n = min(page, partition.count - done)
            url = f"{o['base']}?{urllib.parse.urlencode({'search_query': o['query'], 'start': done, 'max_results': n, 'sortBy': 'relevance'})}"
            for attempt in range(retries + 1):
                try:
                    rows = parse_feed(fetch(url))
                    break
                except (OSError, ET.ParseError):  # an answer that is cut off is asked for again
                    if attempt == retries:
                        raise
                    time.sleep(delay)
            yield from ((done + i, *r) for i, r in enumerate(rows))
            if len(rows) < n:
                return
            done += n
            time.sleep(delay)


class PaperSource(DataSource):
    """spark.read.format("papers").option("query", ...).option("base", ...): results of a remote paper search by relevance."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return "relevance int, id string, title string, authors array<string>, published string, summary string, pdf_url string"

    def reader(self, schema):
        return _Reader(self.options)


def paper_info(raw: DataFrame) -> DataFrame:
    """schemas.PAPER_INFO, and relevance, of raw results; the category stays empty."""
    return raw.select("relevance", normalize_paper_id(F.col("id")).alias("arxiv_id"), "title", F.transform("authors", lambda a: a.cast("string")).alias("authors"), F.year(F.try_to_timestamp("published")).alias("year"), F.lit("").alias("category"), "summary", "pdf_url")


def search_remote(spark: SparkSession, query: str, base: str, max_results: int = 10, **options) -> DataFrame:
    spark.dataSource.register(PaperSource)
    reader = spark.read.format("papers").option("query", query).option("base", base).option("max_results", max_results)
    for k, v in options.items():
        reader = reader.option(k, v)
    return paper_info(reader.load())


def with_retries(get: Callable[[str], bytes], paper_id: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The bytes of a paper, or None after the last attempt. Short answers are asked for again at once; after an error that
    says 429 the wait is 5 (n + 1) seconds, after others 2^n, except at the end."""
    for n in range(attempts):
        try:
            data = get(paper_id)
            if len(data) > LEAST_BYTES:
                return data
        except Exception as e:  # noqa: BLE001  whatever the connector raises
            if "429" in str(e):
                sleep(5 * (n + 1))
            elif n < attempts - 1:
                sleep(2**n)
    return None


def download(papers: DataFrame, get: Callable[[str], bytes], attempts: int = 3) -> DataFrame:
    """arxiv_id, title, file, content (null if it failed) for papers (arxiv_id, title), a batch at a time in each task."""
    named = papers.select("arxiv_id", "title", F.when(F.coalesce("title", F.lit("")) != "", safe_filename(F.col("title"), F.col("arxiv_id"))).otherwise(F.concat("arxiv_id", F.lit(".pdf"))).alias("file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 8):  # few files at a time in memory
                part = b.iloc[lo : lo + 8]
                yield part.assign(content=[with_retries(get, i, attempts) for i in part["arxiv_id"]])

    return named.mapInPandas(run, "arxiv_id string, title string, file string, content binary")


def search_view(papers: DataFrame) -> DataFrame:
    """What a search shows of papers (schemas.SEARCH_RESPONSE)."""
    from ..functions.text import authors_display, published

    return papers.select(F.col("arxiv_id").alias("id"), "title", "authors", authors_display(F.col("authors")).alias("authors_display"), F.substring("summary", 1, 500).alias("summary"), published(F.col("year")).alias("published"), "pdf_url")


