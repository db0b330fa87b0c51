"""Fetching with retries, and a batch data source over any fetcher.

Networks, browsers and models stay outside: a fetcher is anything with ``get(url)``. ``fetched``
turns a table of urls into one of responses, a request a row, so that a failing url is null in
its own row and does not fail the job.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.sources.market import Fetcher


def with_retries(get: Callable[[str], str | None], url: str, tries: int = 3, least: float = 1.0, most: float = 3.0, wait: Callable[[float], None] = time.sleep) -> str:
    """The response; a blank one and an error count as failures. Waits a random time between tries."""
    for k in range(tries):
        try:
            body = get(url)
            if body is not None and body.strip():
                return body
            reason: Exception | str = "blank response"
        except Exception as e:  # whatever the fetcher raises is a failed try
            reason = e
        if k + 1 < tries:
            wait(random.uniform(least, most))
    raise ConnectionError(f"{url}: {reason}")


def decoded(body: bytes | str | None, content_type: str | None = None, charset: str = "utf-8") -> str | None:
    """Text of a body, in the charset that its content type names or the given one; what does not
    fit is marked, not dropped."""
    if body is None or isinstance(body, str):
        return body
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    try:
        return body.decode(named[1] if named else charset, "replace")
    except LookupError:  # a charset that nobody knows
        return body.decode(charset, "replace")


def fetched(urls: DataFrame, fetcher: Fetcher, tries: int = 3, least: float = 1.0, most: float = 3.0, charset: str = "utf-8") -> DataFrame:
    """urls(url, ...) with response and error. fetcher must be picklable; its get returns text, bytes,
    or (bytes, content type). Tries wait least to most seconds, by chance."""

    def get(url):
        body = fetcher.get(url)
        return decoded(*body, charset=charset) if isinstance(body, tuple) else decoded(body, charset=charset)

    def run(batches):
        for pdf in batches:
            got = []
            for u in pdf["url"]:
                try:
                    got.append((with_retries(get, u, tries, least, most), None))
                except ConnectionError as e:
                    got.append((None, str(e)))
            pdf["response"], pdf["error"] = [r for r, _ in got], [e for _, e in got]
            yield pd.DataFrame(pdf)

    return urls.mapInPandas(run, T.StructType([*urls.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]))


class Browser(Protocol):
    """A page renderer that a caller brings; none is built in."""

    def open(self, url: str, wait_for: str | None) -> str | None:
        """The page's source once an element that wait_for selects is there."""

    def healthy(self) -> bool: ...

    def restart(self) -> None: ...


class Rendered:
    """A fetcher over a browser: one that is not healthy is restarted before a page, and after a failure."""

    def __init__(self, browser: Browser, wait_for: str | None = None):
        self.browser, self.wait_for = browser, wait_for

    def get(self, url: str) -> str | None:
        if not self.browser.healthy():
            self.browser.restart()
        try:
            return self.browser.open(url, self.wait_for)
        except Exception:
            if not self.browser.healthy():
                self.browser.restart()
            raise
