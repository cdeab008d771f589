"""Streams: incremental indexing, pools without repeats, coalesced fragments, reasoning left out, calls refused."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OPEN, CLOSE = "<think>", "</think>"


def pool_stream(arrivals: DataFrame, time: str = "ts", delay: str = "10 minutes", keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """Arrivals without repeats; state is kept as long as the watermark allows."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def fresh_calls(calls: DataFrame, time: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """Tool calls (``conv_id, tool, arguments, ts``) without those made before in their conversation."""
    return pool_stream(calls, time, delay, ("conv_id", "tool", "arguments"))


def index_stream(documents: DataFrame, upsert, checkpoint: str) -> StreamingQuery:
    """Runs ``upsert(batch, number)`` over micro-batches; each number may come again after a failure."""
    return documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_index_stream(chunks: DataFrame, index, checkpoint: str) -> StreamingQuery:
    """Arriving chunks into a stored index: those of documents that it holds replace them."""

    def upsert(batch: DataFrame, number: int) -> None:
        if number == 0 and not index._exists("stats"):
            index.add(batch)
        else:
            index.replace(batch)

    return index_stream(chunks, upsert, checkpoint)


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def frames(fragments: Iterable[tuple[int, str]], window_ms: int, most_bytes: int = 0, state: tuple[bool, str, int, int] = (False, "", 0, -1)) -> Iterator[tuple[str, int] | tuple[bool, str, int, int]]:
    """Frames ``(text, fragments)`` of timed fragments, and at last the state to go on with.

    The first fragment goes at once. Later ones wait: until a time of ``window_ms`` after the first that started to wait, or until there are
    ``most_bytes`` of them. A window that has begun runs to its end, also after a frame went for its size. State: begun, text, fragments, deadline.
    """
    begun, text, n, deadline = state
    for at, fragment in fragments:
        if deadline >= 0 and at >= deadline:
            if text:
                yield text, n
            text, n, deadline = "", 0, -1
        if not fragment:
            continue
        text, n = text + fragment, n + 1
        if not begun or (most_bytes > 0 and len(text.encode()) >= most_bytes):
            begun = True
            yield text, n
            text, n = "", 0
        elif deadline < 0:
            deadline = at + window_ms
    yield begun, text, n, deadline


def coalesce_fragments(fragments: DataFrame, window_ms: int = 120, stream: str = "stream_id", most_bytes: int = 0) -> DataFrame:
    """``stream, frame, n_fragments, text``: the frames of finished streams of ``stream_id, seq, ts_ms, text``, from zero."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "seq"])
        *done, (_, text, n, _) = frames(zip(pdf["ts_ms"], pdf["text"].fillna("")), window_ms, most_bytes)
        done += [(text, n)] if text else []
        return pd.DataFrame([{stream: key[0], "frame": k, "n_fragments": n, "text": t} for k, (t, n) in enumerate(done)], columns=[stream, "frame", "n_fragments", "text"])

    kind = fragments.schema[stream].dataType.simpleString()
    return fragments.groupBy(stream).applyInPandas(run, f"{stream} {kind}, frame long, n_fragments long, text string")


def coalesced_stream(fragments: DataFrame, window_ms: int = 120, most_bytes: int = 0) -> DataFrame:
    """``stream_id, n_fragments, text``: frames of running streams; what waits is state, and goes out when its time is over or the stream is silent."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (False, "", 0, -1)
        done: list[tuple[str, int]] = []
        if state.hasTimedOut:
            done = [(now[1], now[2])] if now[1] else []
            now = (True, "", 0, -1)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts_ms", "seq"])
            *done, now = frames(zip(rows["ts_ms"], rows["text"].fillna("")), window_ms, most_bytes, now)
        state.update(now)
        if now[1]:
            state.setTimeoutDuration(max(window_ms, 1))
        yield pd.DataFrame([{"stream_id": key[0], "n_fragments": n, "text": t} for t, n in done], columns=["stream_id", "n_fragments", "text"])

    return fragments.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, n_fragments long, text string", "begun boolean, text string, n long, deadline long", "append", "ProcessingTimeTimeout")


def without_reasoning(pieces: Iterable[str], held: str = "", inside: bool = False) -> tuple[list[str], str, bool]:
    """What of each piece may be shown, and what is held back: text between the marks of reasoning is left out, wherever pieces are cut.

    A tail that could be the beginning of a mark waits for the next piece.
    """
    shown = []
    for piece in pieces:
        held, out = held + piece, []
        while True:
            before, mark, after = held.partition(CLOSE if inside else OPEN)
            if not inside:
                out.append(before)
            if not mark:
                break
            held, inside = after, not inside
        mark = CLOSE if inside else OPEN
        keep = next((n for n in range(min(len(mark) - 1, len(held)), 0, -1) if mark.startswith(held[-n:])), 0)
        held = held[len(held) - keep :]
        if not inside and keep:
            out[-1] = out[-1][:-keep]
        shown.append("".join(out))
    return shown, held, inside


def shown_stream(fragments: DataFrame) -> DataFrame:
    """``stream_id, seq, text`` of running streams without reasoning; the tail held back and whether reasoning goes on are state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values("seq")
        shown, held, inside = without_reasoning(rows["text"].fillna(""), held, inside)
        state.update((held, inside))
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"].to_numpy(), "text": shown})

    return fragments.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string", "held string, inside boolean", "append", "NoTimeout")


def disabled_tools(failures: DataFrame, at, minutes: int = 30) -> DataFrame:
    """``conv_id, tool``: tools that are out of use for a conversation at a time, as they failed (``conv_id, tool, ts``) less than so many minutes before."""
    last = failures.where((F.col("conv_id") != "") & (F.col("tool") != "") & (F.col("ts") <= at)).groupBy("conv_id", "tool").agg(F.max("ts").alias("ts"))
    return last.where(F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES") >= at).select("conv_id", "tool")


def disabled_stream(calls: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """``conv_id, tool, ts, disabled``: for each call of a stream (``conv_id, tool, failed, ts``) whether its tool was out of use for its conversation, as it failed there less than so many minutes before.

    The state is one time a conversation and tool, and goes when the watermark passes it; calls without a conversation or tool have none and are never refused. Calls of one batch are taken by time.
    """
    life = minutes * 60_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        refused = []
        for at, failed in zip(rows["at_ms"], rows["failed"], strict=True):
            refused.append(at <= until)
            if failed:
                until = max(until, at + life)
        if until > state.getCurrentWatermarkMs():
            state.update((int(until),))
            state.setTimeoutTimestamp(int(until) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"conv_id": key[0], "tool": key[1], "ts": rows["ts"].to_numpy(), "disabled": refused})

    known = calls.where((F.col("conv_id") != "") & (F.col("tool") != "")).withWatermark("ts", delay)
    timed = known.select("conv_id", "tool", F.coalesce("failed", F.lit(False)).alias("failed"), "ts", F.unix_millis("ts").alias("at_ms"))
    return timed.groupBy("conv_id", "tool").applyInPandasWithState(run, "conv_id string, tool string, ts timestamp, disabled boolean", "until long", "append", "EventTimeTimeout")
