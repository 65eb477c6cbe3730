"""Structured Streaming: documents into snapshots, event-stream fragments into deltas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from larkspur.plans.ingest import actions, hashed_embedding, ingest
from larkspur.providers import StreamParser
from larkspur.sources.store import VectorStore, latest


def ingest_stream(docs: DataFrame, store: VectorStore, checkpoint: str, embed=hashed_embedding):
    """Each micro-batch (collection, identifier, text, metadata, tstamp) becomes one version, which rewrites its own collections only; one that changes nothing, as a repeated one, writes none."""

    def commit(batch: DataFrame, number: int) -> None:
        version = store.version()
        new = latest(batch).drop("tstamp")
        touched = [r[0] for r in new.select("collection").distinct().collect()]  # as many as the log entry will name
        held = store.read(version, touched)
        if actions(held, new).where("action <> 'skip'").limit(1).count() == 0:
            return
        store.commit(ingest(held, new, embed, now=number), expected=version, touched=touched)

    return docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "buffer binary, done boolean, pos long, next long, late_seq array<long>, late array<binary>"


def delta_stream(fragments: DataFrame) -> DataFrame:
    """(request_id, seq from 0, fragment binary) → (request_id, pos, delta).

    Fragments are parsed in the order of seq, whatever batch brings them: the
    state keeps the unfinished line and those that came before their turn. A
    seq that comes again is ignored.
    """

    def parse(key, parts, state):
        buffer, done, pos, turn, late_seq, late = state.get if state.exists else (b"", False, 0, 0, [], [])
        waiting = {int(s): bytes(f) for s, f in zip(late_seq, late)}
        for rows in parts:
            waiting.update({int(s): bytes(f) for s, f in zip(rows["seq"], rows["fragment"]) if s >= turn and s not in waiting})
        parser = StreamParser()
        parser.buffer, parser.done = bytes(buffer), done
        out = []
        while turn in waiting:
            out += parser.feed(waiting.pop(turn))
            turn += 1
        held = sorted(waiting)
        state.update((parser.buffer, parser.done, pos + len(out), turn, held, [waiting[s] for s in held]))
        yield pd.DataFrame({"request_id": [key[0]] * len(out), "pos": range(pos, pos + len(out)), "delta": out})

    return fragments.groupBy("request_id").applyInPandasWithState(parse, "request_id string, pos long, delta string", STATE, "append", "NoTimeout")
