"""Polite fetching of pages and hourly weather with an opener that the caller gives.

The engine itself opens no connection: ``opener(url)`` returns (status, body) or raises
OSError, and runs on the executors, one domain in one task, so that the pause between
two requests of a domain holds for the whole cluster.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import weather

Opener = Callable[[str], tuple[int, bytes]]
# Pause between requests of a domain in seconds, tries, and answers that ask for a longer pause.
PAUSE, TRIES, BUSY = 1.5, 3, (429, 503)


def get(url: str, opener: Opener, pause: float = PAUSE, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, bytes | None]:
    """(status, body) of a url; no body when it is not there or stays busy, no status when no answer came."""
    status = None
    for k in range(1, tries + 1):
        try:
            status, body = opener(url)
        except OSError:
            status = None
            sleep(pause * k)
            continue
        if status == 200:
            return status, body
        if status not in BUSY:
            break
        sleep(pause * 2**k)
    return status, None


def pages(urls: DataFrame, opener: Opener, pause: float = PAUSE, tries: int = TRIES) -> DataFrame:
    """(domain, url, status, body) of urls ``(domain, url)``, each once, a domain's in order of url with a pause between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for domain, url in zip(b["domain"], b["url"]):
                if (wait := pause - (time.monotonic() - last.get(domain, -pause))) > 0:
                    time.sleep(wait)
                rows.append((domain, url, *get(url, opener, pause, tries)))
                last = {domain: time.monotonic()}  # a domain's urls come together
            yield pd.DataFrame(rows, columns=["domain", "url", "status", "body"]).astype({"status": "Int64"})

    u = urls.select("domain", "url").where("domain is not null and url is not null").distinct()
    return u.repartition("domain").sortWithinPartitions("domain", "url").mapInPandas(run, "domain string, url string, status long, body binary")


def hourly(requests: DataFrame, opener: Opener, url: str, cache_dir: str, tries: int = TRIES) -> DataFrame:
    """Hourly weather ``(h3_index, ts, fields)`` of requests ``(h3_index, latitude, longitude, start_date, end_date)``.

    An answer is kept as ``{h3}_{start}_{end}.json`` in ``cache_dir``, a folder that all
    executors share, and read from there the next time. An answer with ``error`` is
    asked for again; after ``tries`` the job fails.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(cache_dir, exist_ok=True)
        for b in batches:
            got = []
            for r in b.itertuples():
                at = os.path.join(cache_dir, f"{r.h3_index}_{r.start_date}_{r.end_date}.json")
                if os.path.exists(at):
                    with open(at, encoding="utf-8") as f:
                        got.append((r.h3_index, f.read()))
                    continue
                asked = f"{url}?latitude={r.latitude}&longitude={r.longitude}&start_date={r.start_date}&end_date={r.end_date}&hourly={','.join(weather.HOURLY)}&timezone=Asia%2FHo_Chi_Minh&wind_speed_unit=ms"
                for k in range(1, tries + 1):
                    status, body = get(asked, opener, 2.0, 1)
                    payload = json.loads(body) if body else {"error": True, "reason": f"status {status}"}
                    if not payload.get("error"):
                        break
                    if k == tries:
                        raise RuntimeError(f"{r.h3_index}: no weather after {tries} tries: {payload.get('reason')}")
                    time.sleep(2.0 * k)
                text = json.dumps(payload)
                with open(f"{at}.{os.getpid()}", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(f.name, at)
                got.append((r.h3_index, text))
            yield pd.DataFrame(got, columns=["h3_index", "payload"])

    raw = requests.mapInPandas(run, "h3_index string, payload string")
    return weather.decode_payload(raw.select("h3_index", F.from_json("payload", weather.PAYLOAD).alias("p")).select("h3_index", "p.hourly"))
