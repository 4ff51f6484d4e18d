"""Structured Streaming over interchanges.

``parse_stream``: a record is a whole interchange; parsing and rule packs are stateless maps.
``chunked_messages``: an interchange arrives in chunks; per stream key, the bytes that no terminator
has closed and the segments of the open window are state, and whole windows come out as they close.
A key that is silent for ``timeout`` is closed; an open window or rest of a segment is then E001. The
stream's own UNA header rules it. State is bounded: an open window above ``max_window_bytes`` is E020 and ends the key's windows.
``validated``: the issues of each window as it closes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradewire.functions.syntax import DEFAULT, ServiceChars
from tradewire.operators.parse import parse
from tradewire.operators.validate import ValidationContext
from tradewire.operators.windows import with_heads

OUT = "interchange_id string, message_no long, content string, error_code string"
STATE = "rest string, held string, open boolean, message_no long, failed boolean, header string"
MAX_WINDOW_BYTES = 64 << 20


def parse_stream(stream: DataFrame, **options) -> DataFrame:
    """``parse`` on a stream of (…, content); no state, no shuffle."""
    return parse(stream, **options)


def step(state: tuple, chunk: str, chars: ServiceChars = DEFAULT) -> tuple[tuple, list[tuple[int, str | None, str | None]]]:
    """The state after a chunk and the windows it closes: (message_no, text, error code)."""
    rest, held, is_open, number, failed = state
    t, r = re.escape(chars.terminator), re.escape(chars.release)
    data, at, out = rest + chunk, 0, []
    segment = re.compile(rf"(?s)(?:[^{t}{r}]++|{r}.)*+{t}")
    while m := segment.match(data, at):
        at = m.end()
        raw = m.group().lstrip(" \t\r\n")
        tag = raw[:3]
        if failed:
            continue
        if tag == "UNH" and is_open:
            out.append((number, None, "E011"))
            failed, held, is_open = True, "", False
        elif tag == "UNH":
            held, is_open = raw, True
        elif is_open:
            held += raw
            if tag == "UNT":
                out.append((number, held, None))
                held, is_open, number = "", False, number + 1
    return (data[at:], held, is_open, number, failed), out


def header_of(data: str) -> str | None:
    """The header (nine characters, or empty where there is none), or None if the text is too short to tell."""
    text = data.lstrip(" \t\r\n")
    if text.startswith("UNA"):
        return text[:9] if len(text) >= 9 else None
    return None if "UNA".startswith(text) else ""


def chunked_messages(stream: DataFrame, key: str = "interchange_id", order: str = "chunk_no", timeout: str = "1 hour", chars: ServiceChars | None = None, max_window_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """Whole message texts from (key, order, content) chunks. Chunks of a key must arrive in order from one
    micro-batch to the next; within a batch they are sorted. A null chunk is an empty one. Without ``chars`` the stream's header counts."""
    from pyspark.sql import functions as F

    amount, unit = timeout.split()
    wait = int(amount) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]

    def advance(now: tuple, chunk: str) -> tuple[tuple, list]:
        *state, header = now
        data = chunk
        if header is None:
            header = "" if chars is not None else header_of(state[0] + chunk)
            if header is None:
                return (state[0] + chunk, *state[1:], None), []
            if header:  # the text begins after it
                data = (state[0] + chunk).lstrip(" \t\r\n")[9:]
                state[0] = ""
        own = chars or (ServiceChars(header[3], header[4], header[5], header[6], header[8]) if header else DEFAULT)
        new, out = step(tuple(state), data, own)
        if not new[4] and len(new[0]) + len(new[1]) > max_window_bytes:
            out.append((new[3], None, "E020"))
            new = ("", "", False, new[3], True)
        return (*(("", *new[1:]) if new[4] else new), header), out

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("", "", False, 0, False, None)
        rows: list[tuple] = []
        if state.hasTimedOut:
            if not now[4] and (now[2] or now[0].strip()):
                rows.append((group[0], now[3], None, "E001"))
            state.remove()
        else:
            every = pd.concat(list(frames)).sort_values("chunk_no", kind="stable")  # one key's part of a micro-batch
            for chunk in every["content"]:
                now, out = advance(now, chunk if isinstance(chunk, str) else "")
                rows += [(group[0], *o) for o in out]
            state.update(now)
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["interchange_id", "message_no", "content", "error_code"])

    named = stream.select(F.col(key).cast("string").alias("interchange_id"), F.col(order).alias("chunk_no"), "content")
    return named.groupBy("interchange_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def validated(messages: DataFrame, context: ValidationContext, chars: ServiceChars = DEFAULT) -> DataFrame:
    """Issues of the whole windows of ``chunked_messages``, as they come out: (interchange_id, message_no, …, fields of an issue)."""
    from pyspark.sql import functions as F

    whole = parse(messages.where(F.col("content").isNotNull()).drop("error_code"), chars=chars)
    return context.validate(with_heads(whole.drop("error")))
