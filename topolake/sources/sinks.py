"""Where a scan document goes: text, a file, or a server."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

#: Waits before a request is sent again, and answers that count as taken.
WAITS, ACCEPTED = (1, 2, 4), (202, 409)


def document_text(document: DataFrame) -> str:
    """The one row as indented JSON, nulls written out."""
    return json.dumps(document.first().asDict(recursive=True), indent=2, ensure_ascii=False)


def target_of(path: str | None, root: str) -> str:
    """path, or a file named as the root in the root."""
    return str(Path(path) if path else Path(root) / f"{Path(root).resolve().name}.json")


def write_file(document: DataFrame, path: str | None, root: str) -> str:
    """A document of one row to path, or to a file named as the root in the root; the path is returned."""
    target = Path(target_of(path, root))
    target.write_text(document_text(document))
    return str(target)


def write_relations(found: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Every relation as a table, written by the executors."""
    for name, df in found.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def should_retry(status: int | None, attempt: int) -> float | None:
    """Seconds to wait before another attempt (from 0), or None; other refusals than 429 and 5xx are final."""
    again = status is None or status == 429 or status >= 500
    return WAITS[attempt] if again and attempt < len(WAITS) else None


def _post(url: str, token: str, body: bytes) -> int | None:
    request = urllib.request.Request(url, body, {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code
    except OSError:
        return None


def upload(text: str, url: str, token: str, fallback: str, post: Callable[[str, str, bytes], int | None] = _post, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether the server took it; what couldn't be sent after all attempts is saved in ``fallback``."""
    for attempt in range(len(WAITS) + 1):
        status = post(url, token, text.encode())
        if status in ACCEPTED or (status is not None and 200 <= status < 300):
            return True
        wait = should_retry(status, attempt)
        if wait is None:
            break
        sleep(wait)
    if status is None or status == 429 or status >= 500:
        Path(fallback, f"scan-{int(time.time())}.json").write_text(text)
    return False
