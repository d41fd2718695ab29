"""Redirects over the network: a pure decision on every hop, with requests and lookups given by the caller.

Off by default.  Nothing here opens a connection: ``fetch`` answers a HEAD request with (status, Location or
None), ``lookup`` gives a host's addresses.  Only hosts on the allowlist are asked; what they point at outside it is
the final address, checked but never requested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ..config import Config
from .url import Url, blocked_ip, host_in, parse, reject_reason

MAX_HOPS = 5
Fetch = Callable[[str, int], tuple[int, str | None]]
Lookup = Callable[[str], Iterable[str]]


def classify(current: Url, location: str, config: Config) -> tuple[str, Url | None]:
    """('follow', URL), ('final', URL) or (why not, None) for the Location of a response."""
    goal = parse(location, current)
    if goal is None:
        return "bad-location", None
    if reason := reject_reason(goal):
        return reason, None
    return ("follow" if host_in(goal.host, config.allowlisted_redirect_domains) else "final"), goal


def resolve(start: Url, config: Config, fetch: Fetch, lookup: Lookup) -> tuple[Url | None, str]:
    """Where a link leads, or None, and a note."""
    now = start
    for _ in range(MAX_HOPS + 1):
        if reason := reject_reason(now):
            return None, f"rejected: {reason}"
        if not host_in(now.host, config.allowlisted_redirect_domains):
            return None, "host not on the allowlist"
        try:
            addresses = list(lookup(now.host))
            if not addresses or any(map(blocked_ip, addresses)):
                return None, "blocked address"
            status, location = fetch(str(now), config.timeout_ms)
        except OSError as e:
            return None, f"request failed: {e}"
        if not 300 <= status < 400 or location is None:
            return now, f"status {status}"
        kind, goal = classify(now, location, config)
        if kind != "follow":
            return goal, "final location" if goal else f"rejected: {kind}"
        now = goal
    return None, "too many redirects"


def resolve_redirects(df: DataFrame, config: Config, fetch: Fetch, lookup: Lookup, url_col: str = "url") -> DataFrame:
    """``df`` with resolved_url (null if there is none) and resolve_note, by the given requests; each different URL of a batch is asked once."""
    from ..operators.clean import by_row

    if not config.network_redirect_resolution:
        raise ValueError("network_redirect_resolution is off")
    seen: dict = {}

    def one(text):
        if text not in seen:
            url = parse(text)
            goal, note = resolve(url, config, fetch, lookup) if url and url.web else (None, "no web address")
            seen[text] = (str(goal) if goal else None, note)
        return seen[text]

    return by_row(df, [url_col], [("resolved_url", "string"), ("resolve_note", "string")], one)
