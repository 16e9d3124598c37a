"""Polite fetching: robots rules, spacing and retries.  Runs on the driver, which alone may hold a rate."""

from __future__ import annotations

import time
import urllib.error
import urllib.robotparser
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


class Blocked(RuntimeError):
    """The server asked to stop."""


@dataclass
class RateLimiter:
    per_second: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = field(default=float("-inf"), repr=False)

    def wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
            now = self._next
        self._next = now + 1 / self.per_second


@dataclass
class Fetcher:
    """`transport` maps a URL to (status, text); 403 and 429 stop, server errors and timeouts are tried again."""

    transport: Callable[[str], tuple[int, str]]
    limiter: RateLimiter = field(default_factory=RateLimiter)
    retries: int = 3
    backoff: float = 2.0
    cache: dict[str, str] = field(default_factory=dict)
    requests: int = 0
    hits: int = 0

    def get(self, url: str) -> str:
        if url in self.cache:
            self.hits += 1
            return self.cache[url]
        for attempt in range(self.retries + 1):
            self.limiter.wait()
            self.requests += 1
            try:
                status, text = self.transport(url)
            except TimeoutError:
                status, text = 599, ""
            if status in (403, 429):
                raise Blocked(f"{status} for {url}")
            if status < 400:
                self.cache[url] = text
                return text
            if status < 500:
                raise urllib.error.HTTPError(url, status, "refused", None, None)  # type: ignore[arg-type]
            if attempt < self.retries:
                self.limiter.sleep(self.backoff * 2**attempt)
        raise TimeoutError(f"{url} after {self.retries + 1} attempts")


@dataclass
class RobotsGate:
    """No file allows all; what cannot be determined is refused."""

    agent: str
    status: int
    text: str = ""

    def __post_init__(self) -> None:
        self.rules = urllib.robotparser.RobotFileParser()
        self.rules.parse(self.text.splitlines() if self.status == 200 else [])

    def allows(self, path: str) -> bool:
        if self.status == 404:
            return True
        return self.status == 200 and self.rules.can_fetch(self.agent, path)

    def crawl_delay(self) -> float | None:
        delay = self.rules.crawl_delay(self.agent) if self.status == 200 else None
        return float(delay) if delay is not None else None

    def require(self, paths: Iterable[str]) -> None:
        refused = [p for p in paths if not self.allows(p)]
        if refused:
            raise Blocked(f"robots rules refuse {', '.join(refused)}")


def paginate(fetch: Callable[[int], Iterable[dict]], key: str, most: int = 50) -> list[dict]:
    """Items of numbered pages until one brings nothing new."""
    seen: dict = {}
    for number in range(1, most + 1):
        fresh = [x for x in fetch(number) if x[key] not in seen]
        if not fresh:
            break
        seen.update({x[key]: x for x in fresh})
    return list(seen.values())
