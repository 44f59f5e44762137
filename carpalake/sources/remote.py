"""Files behind HTTP as a data source whose partitions are ranges of bytes.

Each range is a task: it takes up where a connection broke, and Spark runs it again elsewhere if its executor is lost. A server that
doesn't give ranges is read by one task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from http.client import HTTPException, HTTPResponse
from typing import Any
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.shared import Rounds

SCHEMA = "part int, start long, length long, total long, retries int, data binary"
AGAIN = {408, 425, 429, 500, 502, 503, 504}  # fixed values: statuses after which a request may be sent again


class _OwnHost(HTTPRedirectHandler):
    """Follows redirects and leaves the token out where they go to another host, port or to plain HTTP."""

    def redirect_request(self, req: Request, fp: Any, code: int, msg: str, headers: Any, newurl: str) -> Request | None:
        new, (a, b) = super().redirect_request(req, fp, code, msg, headers, newurl), (urlsplit(req.full_url), urlsplit(newurl))
        if new is not None and (a.scheme, a.netloc) != (b.scheme, b.netloc):
            new.remove_header("Authorization")
        return new


@dataclass
class Range(InputPartition):
    """end: of a range, not in it; None where the server gives no length."""

    part: int
    start: int
    end: int | None
    total: int | None
    tag: str | None
    ranged: bool


class RangeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        """options: as of the data source; their names there are of any case."""
        self.url, self.token = options["url"], options.get("token")
        self.size, self.retries = int(options.get("rangeBytes", 8 << 20)), int(options.get("retries", 4))
        self.wait, self.timeout = float(options.get("waitSeconds", 0.5)), float(options.get("timeoutSeconds", 60))
        if urlsplit(self.url).scheme not in ("http", "https") or self.size < 1:
            raise ValueError("url must be of http or https, rangeBytes at least 1")

    def _open(self, span: str | None, tag: str | None = None) -> HTTPResponse:
        ask = Request(self.url, headers={"Accept-Encoding": "identity"})
        if span:
            ask.add_header("Range", f"bytes={span}")
        if tag:
            ask.add_header("If-Match", tag)
        if self.token:
            ask.add_header("Authorization", f"Bearer {self.token}")
        return build_opener(_OwnHost).open(ask, timeout=self.timeout)

    def _try(self, step: Callable[[], bool]) -> int:
        """Runs step until it says that all is read; gives the number of failures. Errors that another request wouldn't mend are raised at once."""
        failed = 0
        while True:
            try:
                if step():
                    return failed
                raise ConnectionError(f"{self.url} ended early")
            except (OSError, HTTPException) as e:
                if failed >= self.retries or isinstance(e, HTTPError) and e.code not in AGAIN:
                    raise
                failed += 1
                time.sleep(self.wait * 2 ** (failed - 1))

    def partitions(self) -> list[Range]:
        found: list[tuple[bool, int | None, str | None]] = []

        def first() -> bool:
            try:
                answer = self._open("0-0")
            except HTTPError as e:
                if e.code != 416:  # no first byte: an empty file
                    raise
                found.append((False, 0, None))
                return True
            with answer:
                tag = answer.headers.get("ETag")
                total = answer.headers.get("Content-Range", "").rpartition("/")[2] if answer.status == 206 else answer.headers.get("Content-Length", "")
                ranged = answer.status == 206 and total.isdigit()
                found.append((ranged, int(total) if total.isdigit() else None, tag if tag and not tag.startswith("W/") else None))
            return True

        self._try(first)
        ranged, total, tag = found[0]
        if not ranged:
            return [Range(0, 0, total, total, tag, False)]
        return [Range(i, at, min(at + self.size, total or 0), total, tag, True) for i, at in enumerate(range(0, total or 0, self.size))]

    def read(self, partition: Range) -> Iterator[tuple]:
        p, got = partition, bytearray()

        def more() -> bool:
            if p.end == p.start:
                return True
            if not p.ranged:
                got.clear()  # can't be taken up
            with self._open(f"{p.start + len(got)}-{p.end - 1}" if p.ranged else None, p.tag) as answer:
                where = f"bytes {p.start + len(got)}-{p.end - 1}/{p.total}" if p.ranged else None
                if p.ranged and (answer.status != 206 or answer.headers.get("Content-Range") != where):
                    raise ValueError(f"{self.url}: asked for {where}, got {answer.status} {answer.headers.get('Content-Range')}")
                while chunk := answer.read1(1 << 16):
                    got.extend(chunk)
                return p.end is None or len(got) == p.end - p.start

        failed = self._try(more)
        total = p.total if p.total is not None else len(got)
        if p.ranged:
            yield p.part, p.start, len(got), total, failed, bytes(got)
            return
        for part, at in enumerate(range(0, len(got), self.size)):
            yield part, at, len(got[at : at + self.size]), total, failed, bytes(got[at : at + self.size])


class RemoteFile(DataSource):
    """spark.read.format("remote_file"): a row for each range of a file (SCHEMA); an empty file has none.

    Options: url, of http or https; token, sent as a bearer token to the url's own host; rangeBytes (8 MiB), which bounds what a task holds
    where the server gives ranges; retries (4) of one range after its first failure, waitSeconds (0.5) before the first of them, doubled each time; timeoutSeconds (60).
    An error status that isn't a passing one is raised at once; so is a file that changes between its ranges, where the server tags its content.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> RangeReader:
        return RangeReader(self.options)


def read_remote(spark: SparkSession, url: str, token: str | None = None, **options: object) -> DataFrame:
    """The ranges of the file at url, as rows of SCHEMA."""
    spark.dataSource.register(RemoteFile)
    named = {"url": url, **{k: str(v) for k, v in options.items()}} | ({"token": token} if token else {})
    return spark.read.format("remote_file").options(**named).load()


def stage_remote(spark: SparkSession, url: str, target: str, token: str | None = None, least: int = 100_000, progress: Callable[[int, int], None] | None = None, **options: object) -> DataFrame:
    """The file at url as the file target, and what was fetched: part, start, length, total, retries of each range.

    The ranges are fetched in parallel into the shared folder, so a range that is there isn't fetched again; then they are strung
    together in order, of which the driver holds one at a time. target appears whole by a rename, just before which an old one is deleted (so for a moment
    there is none); on any error before that, also if the file has fewer than least bytes, nothing new is left and an old target stays. progress is called with the bytes that are in place and their total.
    """
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    rounds, final, half = Rounds(spark), fs.Path(target), fs.Path(f"{target}.part")
    there = final.getFileSystem(conf)
    try:
        ranges = rounds.keep(read_remote(spark, url, token, **options))
        rows = ranges.drop("data").orderBy("start").collect()  # a narrow row for each range
        total, at = rows[0].total if rows else 0, 0
        if total < least:
            raise ValueError(f"{url} has {total} bytes, fewer than {least}")
        out = there.create(half, True)
        try:
            for row in rows:
                if row.start != at:
                    raise ValueError(f"{url}: the range from {at} is missing")
                out.write(bytearray(ranges.filter(F.col("start") == at).select("data").first().data))
                at += row.length
                if progress:
                    progress(at, total)
        finally:
            out.close()
        if at != total:
            raise ValueError(f"{url}: {at} of {total} bytes")
        there.delete(final, False)
        if not there.rename(half, final):
            raise OSError(f"{target} can't be made")
        return spark.createDataFrame([tuple(r) for r in rows], SCHEMA.rpartition(",")[0])
    finally:
        there.delete(half, False)
        rounds.clear()
