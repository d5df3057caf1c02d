"""Questions put to a chat-completion endpoint: bounded, retried, and never failing as a whole."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "id bigint, question string, gold string, answer string, finish_reason string, usage map<string,bigint>, error_type string, status_code int, error string, attempts int"


def delays(retries: int, backoff: float) -> list[float]:
    """Seconds before each further attempt."""
    return [backoff * 2**i for i in range(retries)]


def retryable(status: int | None) -> bool:
    """Timeouts and transport errors (no status), 429 and server errors are tried again."""
    return status is None or status == 429 or status >= 500


def post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def ask(question: str, url: str, model: str, options: dict, key: str | None = None, retries: int = 2, backoff: float = 1.0, timeout: float = 60, send=post, sleep=time.sleep) -> dict:
    """The reply's answer, finish reason and usage, or the error."""
    waits = delays(retries, backoff)
    for attempt in range(retries + 1):
        status = None
        try:
            reply = send(url, {"model": model, "messages": [{"role": "user", "content": question}], **options}, key, timeout)
        except urllib.error.HTTPError as e:
            status, error = e.code, e
        except (OSError, TimeoutError) as e:
            error = e
        except Exception as e:
            return {"error_type": type(e).__name__, "error": str(e), "attempts": attempt + 1}
        else:
            try:
                choice = reply["choices"][0]
                usage = {k: v for k, v in (reply.get("usage") or {}).items() if type(v) is int}
                return {"answer": str(choice["message"]["content"]), "finish_reason": choice.get("finish_reason"), "usage": usage, "attempts": attempt + 1}
            except (KeyError, IndexError, TypeError) as e:
                return {"error_type": "MalformedReply", "error": str(e), "attempts": attempt + 1}
        if attempt == retries or not retryable(status):
            return {"error_type": type(error).__name__, "status_code": status, "error": str(error), "attempts": attempt + 1}
        sleep(waits[attempt])
    raise AssertionError


def answered(samples: DataFrame, concurrency: int, **request) -> DataFrame:
    """samples (id, question, gold) with replies; as many requests run at once as `concurrency`. Rows with an error are failures; write them elsewhere."""

    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in OUT.split(", ")]
        for frame in frames:
            rows = [{"id": i, "question": q, "gold": g} | ask(q, **request) for i, q, g in zip(frame["id"], frame["question"], frame["gold"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"status_code": "Int32"})

    return samples.select("id", "question", "gold").repartition(concurrency).mapInPandas(run, OUT)


def successes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull())


def failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull())
