"""Token streams as they come: the rows of ``tokens.shown``, from a stream of fragments with state.

Every response has one keyed state: the fragments that came early, the line that isn't ended
yet, the last 600 characters of the answer, and whether it is over. What isn't over
``seconds`` after its last fragment ends as a timeout. State and rows survive a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunker import strip
from .debounce import PROVIDER, ROCKS
from .tokens import DONE, FINISH, LOOP, LOOP_TIMES, LOOP_WINDOW

SHOWN = "response string, line long, piece string, ended string"
TIMEOUT = "timeout"
#: Fixed value: seconds a streamed response may stand still.
SECONDS = 120


def line_of(line: str) -> tuple[str | None, str | None]:
    """(piece, stop) of a line; neither if it can't be read or has none. ``tokens.pieces`` says the same in columns."""
    text = strip(line)
    if not text.startswith("data: "):
        return None, None
    if text[6:] == "[DONE]":
        return None, DONE
    try:
        v = json.loads(text[6:])
    except ValueError:
        return None, None
    choices = v.get("choices", []) if isinstance(v, dict) else None
    if not isinstance(choices, list) or not isinstance(v.get("error", {}), dict) or not all(map(_right, choices)):
        return None, None
    first = choices[0] if choices else {}
    finish = first.get("finish_reason")
    if isinstance(finish, str) and finish not in ("", "null"):
        return None, FINISH
    return first.get("delta", {}).get("content") or None, None


def _right(choice) -> bool:
    """Whether a choice has the agreed types."""
    if not isinstance(choice, dict) or not isinstance(choice.get("delta", {}), dict) or not isinstance(choice.get("delta", {}).get("content", ""), str):
        return False
    return "message" not in choice or (isinstance(choice["message"], dict) and isinstance(choice["message"].get("content"), str))


def loops(tail: str, window: int = LOOP_WINDOW, times: int = LOOP_TIMES) -> bool:
    """``text.repetition_loop`` of what ends in tail."""
    if len(tail) < 2 * window:
        return False
    return any(len(tail) >= n * times and len(strip(tail[-n:])) >= 10 and tail[-n * times :] == tail[-n:] * times for n in range(20, window // 2 + 1, 10))


class TokenFold(StatefulProcessor):
    def __init__(self, seconds: float | None):
        self.wait = None if seconds is None else int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "seq long", "fragment string")
        self.at = handle.getValueState("at", "seq long, line long, rest string, tail string, ended boolean")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["response", "line", "piece", "ended"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, number, rest, tail, ended = self.at.get() if self.at.exists() else (0, 0, "", "", False)
        come = {int(s): f or "" for part in rows for s, f in zip(part["seq"], part["fragment"])}
        held = {k[0]: v[0] for k, v in self.early.iterator()}
        come = held | {s: f for s, f in come.items() if s >= seq}
        out: list[tuple] = []
        while not ended and seq in come:
            lines = (rest + come.pop(seq)).split("\n")
            seq, rest = seq + 1, lines.pop()
            for line in lines:
                piece, stop = line_of(line)
                grown = (tail + (piece or ""))[-LOOP_WINDOW * LOOP_TIMES :]
                if stop or (piece and loops(grown)):
                    out.append((number, None, stop or LOOP))
                    ended = True
                    break
                if piece:
                    out.append((number, piece, None))
                    tail = grown
                number += 1
        self.early.clear()
        if not ended:
            for s, f in come.items():
                self.early.updateValue((s,), (f,))
        if self.wait is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        self.at.update((seq, number, "" if ended else rest, "" if ended else tail, ended))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, number, _, _, ended = self.at.get()
        self.early.clear()
        self.at.update((seq, number, "", "", True))
        yield self._rows(key, [] if ended else [(number, None, TIMEOUT)])

    def close(self) -> None: ...


def shown_stream(fragments: DataFrame, seconds: float | None = SECONDS) -> DataFrame:
    """(response, line, piece, ended) of a stream of fragments (response string, seq from 0 without gaps, fragment). Sets the session's state store to RocksDB.

    seconds: None for no timeout; with one a query has to run by a clock, as it never has nothing left to do.
    """
    fragments.sparkSession.conf.set(PROVIDER, ROCKS)
    return fragments.select("response", "seq", "fragment").groupBy("response").transformWithStateInPandas(TokenFold(seconds), SHOWN, "Append", "None" if seconds is None else "ProcessingTime")
