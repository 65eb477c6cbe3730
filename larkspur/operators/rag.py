"""Prompts, conversation windows, context blocks, and streamed replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur import errors as E

DEFAULT_PROMPT = "You answer questions from the given documents. If they do not hold the answer, say so."
ROLES = ("user", "assistant")


def truncate(history: DataFrame, max_turns: int) -> DataFrame:
    """The last 2 * max_turns messages of each conversation (conv_id, turn); none for max_turns <= 0."""
    if max_turns <= 0:
        return history.limit(0)
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return history.withColumn("_r", rank).where(F.col("_r") <= 2 * max_turns).drop("_r")


def truncated(messages: Column, max_turns: int) -> Column:
    n = 2 * max_turns
    return F.when(F.size(messages) <= n, messages).otherwise(F.slice(messages, -n, n)) if n > 0 else F.slice(messages, 1, 0)


def checked_role(role: Column) -> Column:
    return F.when(role.isin(*ROLES), role).otherwise(F.raise_error(F.lit(f"role must be user or assistant [{E.HISTORY_ROLE}]")).cast("string"))


def append(messages: Column, role: Column, content: Column) -> Column:
    """messages (array<struct<role, content>>) and one more; another role than user or assistant raises."""
    return F.concat(messages, F.array(F.struct(checked_role(role).alias("role"), content.alias("content"))))


@dataclass(frozen=True)
class History:
    """A conversation on the driver; every change gives a new one."""

    messages: tuple[dict, ...] = ()

    def append(self, role: str, content: str) -> History:
        if role not in ROLES:
            raise E.EngineError("role must be user or assistant", E.HISTORY_ROLE)
        return History((*self.messages, {"role": role, "content": content}))

    def truncated(self, max_turns: int) -> History:
        return History(self.messages[-2 * max_turns :] if max_turns > 0 else ())


def messages(query: str, blocks: list[str], history: History | None = None, system: str | None = None, configured: str | None = None) -> list[dict]:
    """build_messages() for one question on the driver."""
    prompt = next(p for p in (system, configured, DEFAULT_PROMPT) if p is not None)
    asked = "\n\n".join(["Documents:", "\n\n".join(blocks), f"Question: {query}"])
    return [{"role": "system", "content": prompt}, *(history or History()).messages, {"role": "user", "content": asked}]


def build_messages(query: Column, blocks: Column, history: Column | None = None, system: str | None = None, configured: str | None = None) -> Column:
    """[system] + history + the user's documents and question, as array<struct<role, content>>."""
    prompt = next(p for p in (system, configured, DEFAULT_PROMPT) if p is not None)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ask = F.concat(F.lit("Documents:\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), query)
    parts = [F.array(message("system", F.lit(prompt)))] + ([history] if history is not None else []) + [F.array(message("user", ask))]
    return F.concat(*parts)


def context_blocks(hits: DataFrame, records: DataFrame, top_k: int = 5, length: int = 800, threshold: float = 0.30) -> DataFrame:
    """(query_id, blocks): '[id] title' and an excerpt without tags for each hit over the threshold, best first."""
    rows = hits.where((F.col("score") >= threshold) & (F.col("rank") <= top_k)).join(records, "identifier")
    plain = F.regexp_replace("text", "<[^>]*>", "")
    block = F.concat(F.lit("["), F.col("identifier"), F.lit("] "), F.col("title"), F.lit("\n"), F.substring(plain, 1, length))
    made = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return made.select("query_id", F.transform("x", lambda v: v["b"]).alias("blocks"))


def deltas(body: Column) -> Column:
    """Text deltas of a complete event-stream body: complete 'data: ' lines before [DONE]; bad JSON is skipped."""
    lines = F.split(body, "\n")
    lines = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.trim(F.substring(x, 7, 1 << 30)))
    done = F.array_position(data, "[DONE]").cast("int")
    live = F.when(done > 0, F.slice(data, 1, F.greatest(done - 1, F.lit(0)))).otherwise(data)
    found = F.transform(live, lambda x: F.when(F.try_parse_json(x).isNotNull(), F.get_json_object(x, "$.choices[0].delta.content")))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def parse_streams(fragments: DataFrame) -> DataFrame:
    """(request_id, seq, fragment) → (request_id, pos, delta)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fragment"))), lambda v: v["fragment"]), "")
    return fragments.groupBy("request_id").agg(body.alias("body")).select("request_id", F.posexplode(deltas(F.col("body"))).alias("pos", "delta"))
