"""The registry of detection rules: fetched, else from the cache, else empty."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

#: Fixed value: seconds that a fetch may take.
TIMEOUT = 10


def _get(url: str, etag: str | None) -> tuple[int, str | None, str]:
    request = urllib.request.Request(url, headers={"If-None-Match": etag} if etag else {})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.status, answer.headers.get("ETag"), answer.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, None, ""
    except OSError:
        return 0, None, ""


def registry_file(url: str | None, cache: Path, get: Callable[[str, str | None], tuple[int, str | None, str]] = _get) -> tuple[str, Path | None]:
    """Where rules came from (remote, cache or none) and the file that Spark reads them from.

    An unchanged registry (304) and any failure fall back to the cache.
    """
    tag_file = cache.with_suffix(cache.suffix + ".etag")
    if url:
        status, tag, body = get(url, tag_file.read_text() if tag_file.exists() and cache.exists() else None)
        if status == 200:
            cache.parent.mkdir(parents=True, exist_ok=True)
            cache.write_text(body)
            tag_file.write_text(tag) if tag else tag_file.unlink(missing_ok=True)
            return "remote", cache
    return ("cache", cache) if cache.exists() else ("none", None)
