"""A paged JSON source as a Python data source, with retries and a cost cap.

`spark.read.format("paged_json").options(path=..., pages=..., cap=...)` reads page files (one JSON document
with `results` and `meta.next_cursor` each) as a remote service would hand them out. Transport is a function,
so a test or a deployment can put its own in place.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Attempts, first delay in seconds, statuses that are tried again, estimated costs.
ATTEMPTS, DELAY = 5, 0.75
SEARCH_COST, PLAIN_COST = 0.001, 0.0001


class BudgetError(RuntimeError):
    pass


class Transient(RuntimeError):
    """An answer that may be better the next time."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def with_retry(call: Callable[[], dict], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Tries again on 429, 5xx and broken connections: after what the answer asks for, else 0.75 s doubled."""
    for n in range(attempts):
        try:
            return call()
        except (Transient, OSError) as e:
            if isinstance(e, Transient) and e.status != 429 and e.status < 500 or n == attempts - 1:
                raise
            after = getattr(e, "retry_after", None)
            sleep(after if after is not None else DELAY * 2**n)
    raise AssertionError


class Budget:
    """Refuses a request before its estimated cost would pass the cap."""

    def __init__(self, cap: float | None):
        self.cap, self.spent, self.requests = cap, 0.0, 0

    def take(self, search: bool) -> None:
        cost = SEARCH_COST if search else PLAIN_COST
        if self.cap is not None and self.spent + cost > self.cap + 1e-12:
            raise BudgetError(f"the next request would pass the cap of {self.cap}")
        self.spent += cost
        self.requests += 1


def request_params(params: dict, contact: str | None = None, key: str | None = None) -> dict:
    """Parameters without nulls and empty values, with the fixed contact and the optional key."""
    full = {**params, "mailto": contact, "api_key": key}
    return {k: v for k, v in full.items() if v is not None and v != ""}


def cursor_pages(fetch: Callable[[str], dict], budget: Budget, limit: int, search: bool = False) -> Iterator[dict]:
    """Records until the cursor ends, a page is empty or the limit is reached; each id once."""
    cursor, seen = "*", set()
    while cursor and len(seen) < limit:
        budget.take(search)
        page = with_retry(lambda c=cursor: fetch(c))
        rows = page.get("results") or []
        if not rows:
            return
        for r in rows:
            if r.get("id") not in seen and len(seen) < limit:
                seen.add(r.get("id"))
                yield r
        cursor = (page.get("meta") or {}).get("next_cursor")


class Lane(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    """A partition per lane (a comma-separated path); pages of a lane are read one after another."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.limit = int(options.get("limit", 1 << 62))
        self.cap = float(options["cap"]) if "cap" in options else None
        self.search = options.get("search", "false") == "true"

    def partitions(self) -> list[Lane]:
        return [Lane(p) for p in self.paths]

    def read(self, partition: Lane) -> Iterator[tuple]:
        def fetch(cursor: str) -> dict:
            with open(f"{partition.path}/{'first' if cursor == '*' else cursor}.json") as f:
                return json.load(f)

        # the cap is the run's: lanes don't know of each other, so each may spend its share
        own = Budget(None if self.cap is None else self.cap / len(self.paths))
        for r in cursor_pages(fetch, own, self.limit, self.search):
            yield str(r.get("id")), json.dumps(r)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "id string, value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedJson)
