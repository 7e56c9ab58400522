"""A paged service as a Spark source: one partition a site, filters on site and date pushed to the requests, and a stream that resumes.

`spark.dataSource.register(PagedService)`, then `spark.read.format("paged_service").option("pages", folder).load()`. Pages are what a
service answers: JSON objects {"values": [{"site_no", "date", "value", "status"}, ...], "next": page or null}. They are asked of a
function "module:name" (option fetch) as fetch(site, page, start) and, by default, read from recorded files
<pages>/<site>/<page>.json in a folder that all workers see; <pages>/sites.json lists the sites.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "site_no string, date string, value double, status string"


class Busy(Exception):
    """What a fetch raises when the service asks to come back later."""


def with_backoff(ask: Callable[[], dict], tries: int = 5, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of ask(), tried again after wait, 2 wait, 4 wait ... while it raises Busy or OSError other than a missing file; the last error is raised."""
    for k in range(tries):
        try:
            return ask()
        except FileNotFoundError:
            raise
        except (Busy, OSError):
            if k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("tries must be 1 or more")


def recorded(folder: str) -> Callable[[str, str, str | None], dict]:
    def fetch(site: str, page: str, start: str | None) -> dict:
        return json.loads((Path(folder) / site / f"{page}.json").read_text())

    return fetch


class _Site(InputPartition):
    def __init__(self, site: str, start: str | None, page: str = "0", last: str | None = None) -> None:
        self.site, self.start, self.page, self.last = site, start, page, last


class _Service:
    def __init__(self, options: dict[str, str]) -> None:
        if "pages" not in options and "fetch" not in options:
            raise ValueError("paged_service needs the option pages or fetch")
        self.options = dict(options)

    def fetch(self) -> Callable[[str, str, str | None], dict]:
        if name := self.options.get("fetch"):
            module, _, function = name.partition(":")
            return getattr(importlib.import_module(module), function)
        return recorded(self.options["pages"])

    def sites(self) -> list[str]:
        if listed := self.options.get("sites"):
            return listed.split(",")
        return json.loads((Path(self.options["pages"]) / "sites.json").read_text())

    def rows(self, part: _Site) -> Iterator[tuple]:
        """Rows of a site's pages, from its page on; a page that repeats ends the read with an error."""
        fetch, page, seen = self.fetch(), part.page, set()
        while page is not None and page != part.last:
            if page in seen:
                raise ValueError(f"page {page} of {part.site} comes again")
            seen.add(page)
            answer = with_backoff(lambda page=page: fetch(part.site, page, part.start), int(self.options.get("tries", "5")), float(self.options.get("wait", "0.5")))
            for v in answer["values"]:
                if part.start is None or (v.get("date") or "") >= part.start:
                    value = v.get("value")
                    yield str(v.get("site_no") or part.site), v.get("date"), None if value in (None, "") else float(value), v.get("status")
            page = None if answer.get("next") is None else str(answer["next"])


class ServiceReader(_Service, DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.only: set[str] | None = None
        self.start: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take site = x and site in (...) whole; a least date shortens the requests, and Spark still looks at the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("site_no",):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = given if self.only is None else self.only & given
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == ("date",) and isinstance(f.value, str):
                self.start = f.value if self.start is None else max(self.start, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Site(s, self.start) for s in self.sites() if self.only is None or s in self.only] or [_Site("", None, page="", last="")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition) if partition.site else iter(())


class ServiceStream(_Service, DataSourceStreamReader):
    """Offsets are how many pages of each site are known; a restart goes on after those of the checkpoint and reads none again."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {s: 0 for s in self.sites()}

    def latestOffset(self) -> dict:  # noqa: N802
        folder = Path(self.options["pages"])
        return {s: sum(1 for _ in (folder / s).glob("*.json")) for s in self.sites()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Site(s, None, str(start.get(s, 0)), str(n)) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = self.fetch()
        for page in range(int(partition.page), int(partition.last)):  # recorded pages are numbered from 0
            one = _Site(partition.site, None, str(page))
            answer = with_backoff(lambda one=one: fetch(one.site, one.page, None), int(self.options.get("tries", "5")), float(self.options.get("wait", "0.5")))
            for v in answer["values"]:
                value = v.get("value")
                yield str(v.get("site_no") or one.site), v.get("date"), None if value in (None, "") else float(value), v.get("status")


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return ServiceReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return ServiceStream(self.options)
