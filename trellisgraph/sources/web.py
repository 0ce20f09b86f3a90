"""Web pages by URL: every hop is checked before it is fetched, failures are empty texts."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.sources.files import page_text

#: What a fetcher is: from a URL to (status, location of a redirect or None, body). It must not follow redirects.
Fetcher = Callable[[str], tuple[int, str | None, str]]
#: From a host name to its addresses.
Resolver = Callable[[str], list[str]]
REDIRECTS = (301, 302, 303, 307, 308)
#: Hosts that are never fetched.
BLOCKED = {"localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal"}


def addresses(host: str) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(host, None)})


def hop_problem(url: str, resolve: Resolver) -> str | None:
    """Why a URL must not be fetched: scheme, host, credentials, blocked or resolved to an address that is not public."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").strip().rstrip(".").lower()
    except ValueError:
        return "url"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if not host:
        return "host"
    if parts.username or parts.password:
        return "credentials"
    if host in BLOCKED or host.endswith((".localhost", ".local", ".internal")):
        return "host"
    try:
        found = [str(ipaddress.ip_address(host))]
    except ValueError:
        try:
            found = resolve(host)
        except OSError:
            return "unresolved"
    for a in found:
        ip = ipaddress.ip_address(a.split("%")[0])
        ip = getattr(ip, "ipv4_mapped", None) or ip
        if not ip.is_global or ip.is_multicast or ip.is_reserved or ip.is_unspecified:
            return "address"
    return None if found else "unresolved"


def fetch_one(url: str, fetch: Fetcher, resolve: Resolver, redirects: int = 3) -> tuple[str, str, str | None, int]:
    """(text, last URL, error, hops). Up to ``redirects`` redirects are followed, each target being checked as the first."""
    at = url
    for hops in range(redirects + 1):
        problem = hop_problem(at, resolve)
        if problem:
            return "", at, problem, hops
        try:
            status, location, body = fetch(at)
            if status in REDIRECTS and location:
                at = urljoin(at, location)
                continue
            return (page_text(body), at, None, hops) if status < 400 else ("", at, f"status {status}", hops)
        except Exception as e:  # noqa: BLE001  one bad page must not end the job
            return "", at, f"{type(e).__name__}: {e}", hops
    return "", at, "redirects", redirects + 1


def pages(urls: DataFrame, fetch: Fetcher, resolve: Resolver = addresses, redirects: int = 3, per_host: int = 4, column: str = "url") -> DataFrame:
    """``urls`` with text, final_url, error and hops; a URL that fails has an empty text and says why.

    Rows are dealt by host, a host to at most ``per_host`` tasks, so a host that has most of the URLs is asked by a few
    tasks and no more. A null URL is a failure. A row may be fetched again if its executor is lost.
    """
    host = F.lower(F.coalesce(F.try_parse_url(column, F.lit("HOST")), F.lit("")))
    rows = urls.repartition(host, F.pmod(F.xxhash64(column), F.lit(per_host)))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "text string, final_url string, error string, hops int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [fetch_one(u, fetch, resolve, redirects) if u else ("", u, "url", 0) for u in batch[column]]
            yield batch.assign(**{c: [g[i] for g in got] for i, c in enumerate(("text", "final_url", "error", "hops"))})

    return rows.mapInPandas(run, schema)
