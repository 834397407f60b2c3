"""The same operators on streams, and what needs state between micro-batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spans import detect, explode_spans


def windowed_counts(events: DataFrame, text_col: str = "text", time_col: str = "ts", window: str = "1 hour", late: str = "2 hours", **options) -> DataFrame:
    """Spans found for each window and type; rows later than ``late`` are left out."""
    found = explode_spans(detect(events.withWatermark(time_col, late), text_col, **options), time_col)
    return found.groupBy(F.window(time_col, window).alias("window"), "entity_type").agg(F.count("*").alias("n"))


def restore_chunks(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``conv_id, seq, restored`` of streamed response chunks (conv_id, seq, chunk, mapping).

    A placeholder may be cut by the end of a chunk: what may be its beginning waits in the state of its conversation for the
    next chunk, or (where given, for streams that run on) for ``timeout_ms``. Where ``chunks`` has a boolean column ``done``, a true one
    marks the end of its conversation: nothing is held back then. Without either, the tail of a conversation that ends in what
    may begin a placeholder stays in the state. Chunks of one conversation are taken by seq within each micro-batch; where they may
    come late over several, and for state that is typed and freed by timers, see :func:`.conversations.restore_deltas`.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, known, last = state.get if state.exists else ("", "{}", -1)
        mapping = json.loads(known)
        shape = re.compile(r"<[A-Z_]+(?:_\d+)+>")
        back = lambda text: shape.sub(lambda m: mapping.get(m[0], m[0]), text)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"conv_id": [key[0]], "seq": [last], "restored": [back(held)]})
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        out, over = [], False
        for seq, chunk, more, done in zip(rows["seq"], rows["chunk"], rows["mapping"], rows["done"]):
            mapping |= json.loads(more) if more else {}
            text = held + (chunk or "")
            open_ = text[at:] if (at := text.rfind("<")) >= 0 and not done else ""
            text, held = (text[:at], open_) if open_ and any(len(p) > len(open_) and p.startswith(open_) for p in mapping) else (text, "")
            over = bool(done)
            last = int(seq)
            out.append((key[0], last, back(text)))
        if over:
            state.remove()
        else:
            state.update((held, json.dumps(mapping, ensure_ascii=False), last))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "restored"])

    done = F.coalesce(F.col("done"), F.lit(False)) if "done" in chunks.columns else F.lit(False)
    rows = chunks.select("conv_id", "seq", "chunk", F.to_json("mapping").alias("mapping"), done.alias("done"))
    return rows.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, seq long, restored string", "held string, mapping string, last long", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
