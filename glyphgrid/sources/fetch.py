"""Fetching of files that a volume is made of, outside of Spark: resumed, retried, and in place only when complete."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

CHUNK = 1 << 20


def fetch(url: str, path: str, *, tries: int = 5, wait: Callable[[int], float] = lambda n: 5.0 * n, least: int = 1, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Downloads to `path`; False if a file of `least` bytes is there already.

    What a broken transfer left in `path`.part is continued by a range request; an answer 416 means that it is whole.
    wait: seconds before try n, such as 5 n, or 2 ** n for an exponential back-off.
    """
    if os.path.exists(path) and os.path.getsize(path) >= least:
        return False
    part = f"{path}.part"
    for n in range(1, tries + 1):
        have = os.path.getsize(part) if os.path.exists(part) else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        try:
            with opener(request) as answer, open(part, "ab" if have and answer.status == 206 else "wb") as out:
                while data := answer.read(CHUNK):
                    out.write(data)
        except urllib.error.HTTPError as e:
            if e.code != 416:
                if n == tries:
                    raise
                sleep(wait(n))
                continue
        except OSError:
            if n == tries:
                raise
            sleep(wait(n))
            continue
        os.replace(part, path)
        return True
    return False


def fetch_all(files: Iterable[tuple[str, str]], workers: int = 4, **given) -> list[tuple[str, str | None]]:
    """Fetches (url, path) pairs with a few threads: (path, error or None) of each, in order."""

    def one(pair: tuple[str, str]) -> tuple[str, str | None]:
        try:
            os.makedirs(os.path.dirname(pair[1]) or ".", exist_ok=True)
            fetch(*pair, **given)
            return pair[1], None
        except Exception as e:  # noqa: BLE001
            return pair[1], str(e)

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, files))
