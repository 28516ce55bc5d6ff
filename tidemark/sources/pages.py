"""A paged JSON API, or pages of it that were landed in a folder, as a Spark data source.

    PagedSource.register(spark)
    spark.read.format("tidemark_pages").options(root=..., start="2024-01-01", end="2024-03-31").load()

The reader plans requests on the driver: for each kind of document and each date window
that the API takes (at most ``REQUEST_DAYS`` days a request, within it ``WINDOW_DAYS`` of
a rolled-up kind), times ``splits`` of the users. Requests become partitions, or are
dealt to ``concurrency`` partitions where the API limits the rate. A task follows the
page tokens of its users one page at a time, so it holds one page.

A page that can't be read (an error document, a broken file, a token that goes in a
circle) ends the request of that user and kind with a row that has a ``message``; the
others go on. Each finished request gives a row without body and message, so that a
request without documents is seen as well.
"""

from __future__ import annotations

import datetime as dt
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "user_id long, kind string, window string, page int, place int, name string, day string, body string, message string"

# Kinds of documents by the way they are asked for, days of a window, and pages and days of a request.
ROLLED_UP = (
    "steps", "distance", "floors", "heart-rate", "active-zone-minutes", "active-minutes", "total-calories", "active-energy-burned",
    "sedentary-period", "nutrition-log", "hydration-log",
)
LISTED = ("daily-resting-heart-rate", "daily-heart-rate-variability", "daily-oxygen-saturation", "daily-respiratory-rate", "daily-vo2-max", "weight", "body-fat", "height", "sleep", "exercise")
WINDOW_DAYS = {"heart-rate": 14, "active-minutes": 14, "total-calories": 14}
OTHER_WINDOW_DAYS, LISTED_PAGES, REQUEST_DAYS = 90, 40, 180
KINDS = ROLLED_UP + LISTED


def value_key(kind: str) -> str:
    """The field of a document that holds its value: heart-rate, heartRate."""
    first, *rest = kind.split("-")
    return first + "".join(w.capitalize() for w in rest)


@dataclass(frozen=True)
class Request:
    """One kind and date window (``end`` included) of one split of the users."""

    kind: str
    start: str
    end: str
    split: int
    splits: int


def windows(kind: str, start: dt.date, end: dt.date) -> Iterator[tuple[dt.date, dt.date]]:
    """The windows that cover start to end, both included; a listed kind has one a request."""
    step = min(REQUEST_DAYS, WINDOW_DAYS.get(kind, OTHER_WINDOW_DAYS)) if kind in ROLLED_UP else REQUEST_DAYS
    request = start
    while request <= end:
        last = min(end, request + dt.timedelta(REQUEST_DAYS - 1))
        while request <= last:
            stop = min(last, request + dt.timedelta(step - 1))
            yield request, stop
            request = stop + dt.timedelta(1)


def planned(kinds: list[str], start: str, end: str, splits: int) -> list[Request]:
    """All requests for a range of days."""
    unknown = sorted(set(kinds) - set(KINDS))
    if unknown:
        raise ValueError(f"unknown kinds: {', '.join(unknown)}")
    a, z = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    return [Request(k, str(s), str(e), i, splits) for k in kinds for s, e in windows(k, a, z) for i in range(splits)]


class PageError(Exception):
    """What an API says instead of a page."""


class Landed:
    """Pages in folders root/kind=<kind>/window=<first day>/user=<id>/token=<token>/, one file each; the first token is ``first``."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")

    def users(self, request: Request) -> list[int]:
        """The users of the request's split that have something landed."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/kind={request.kind}/window={request.start}", allow_not_found=True))
        users = sorted(int(f.base_name.removeprefix("user=")) for f in found if f.base_name.startswith("user="))
        return [u for u in users if zlib.crc32(str(u).encode()) % request.splits == request.split]

    def page(self, user: int, request: Request, token: str) -> dict:
        """One page as the API gives it; ``PageError`` where it gives none."""
        from pyarrow import fs

        folder = f"{self.root}/kind={request.kind}/window={request.start}/user={user}/token={token}"
        found = [f.path for f in self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.startswith("part-")]
        if not found:
            raise PageError(f"404 {request.kind}: no page {token}")
        text = "".join(self.files.open_input_stream(path).readall().decode() for path in sorted(found))
        try:
            page = json.loads(text)
        except ValueError as error:
            raise PageError(f"{request.kind}: page {token} is no JSON") from error
        if not isinstance(page, dict) or "error" in page:
            said = page.get("error") if isinstance(page, dict) else None
            said = said if isinstance(said, dict) else {"message": said}
            raise PageError(f"{said.get('code', 500)} {request.kind}: {said.get('message')}"[:400])
        return page


def documents(transport: Landed, user: int, request: Request) -> Iterator[tuple]:
    """The rows of one user's request: its documents in order, then how it ended."""
    key, token, seen, number = value_key(request.kind), "first", set(), 0
    head = (user, request.kind, request.start)
    try:
        while token:
            if token in seen:
                raise PageError(f"{request.kind}: page {token} comes twice")
            seen.add(token)
            page = transport.page(user, request, token)
            for place, point in enumerate(page.get("rollupDataPoints") or page.get("dataPoints") or []):
                value = point.get(key)
                if value is None:
                    continue
                sampled = value.get("sampleTime") or {}
                day = point.get("civilStartTime") or value.get("date") or sampled.get("civilTime") or sampled.get("physicalTime")
                yield (*head, number, place, point.get("name"), None if day is None else json.dumps(day), json.dumps(value), None)
            token, number = page.get("nextPageToken") or None, number + 1
            if request.kind in LISTED and number >= LISTED_PAGES:
                break
    except (PageError, OSError, AttributeError, TypeError) as error:
        yield (*head, number, -1, None, None, None, str(error) or type(error).__name__)
        return
    yield (*head, number, -1, None, None, None, None)


@dataclass
class Requests(InputPartition):
    """The requests of one task."""

    requests: list[Request]


class PageReader(DataSourceReader):
    """Plans the requests and reads their pages."""

    def __init__(self, options: dict) -> None:
        self.root, self.start, self.end = options["root"], options["start"], options["end"]
        self.kinds = [k.strip() for k in options["kinds"].split(",")] if options.get("kinds") else list(KINDS)
        self.splits, self.concurrency = int(options.get("splits", 1)), int(options.get("concurrency", 0))

    def partitions(self) -> list[Requests]:
        every = planned(self.kinds, self.start, self.end, self.splits)
        n = min(self.concurrency or len(every), len(every))
        return [Requests(every[i::n]) for i in range(n)]

    def read(self, partition: Requests | None) -> Iterator[tuple]:
        transport = Landed(self.root)
        for request in partition.requests if partition is not None else []:
            for user in transport.users(request):
                yield from documents(transport, user, request)


class PagedSource(DataSource):
    """``tidemark_pages``: options root, start, end, and if wanted kinds (comma-separated), splits, concurrency."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))
