"""From hits to an answer: grouped context, history, prompt, completion, numbered citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation, without_txt

NO_CONTEXT = "暂无相关文献"
SYSTEM_PROMPT = "你是一个学术助手。基于以下文献回答问题，若无法回答请说明。\n\n文献：\n"
REFERENCES = "\n\n---\n📚 参考来源：\n"
UNKNOWN = "unknown"


def _joined(rows: Column, field: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[field]), between)


def by_source(hits: DataFrame, source: str = "arxiv_id") -> DataFrame:
    """qid, source, first (rank of its first hit), text (its hits in order of rank, a line each). hits: qid, rank, text."""
    named = hits.withColumn("source", F.coalesce(F.col(source), F.lit(UNKNOWN)))
    return named.groupBy("qid", "source").agg(F.min("rank").alias("first"), _joined(F.struct("rank", "text"), "text", "\n").alias("text"))


def contexts(groups: DataFrame) -> DataFrame:
    """qid, context: sources in order of their first hit, ruled off from each other."""
    return groups.groupBy("qid").agg(_joined(F.struct("first", "text"), "text", "\n\n---\n\n").alias("context"))


def citations(groups: DataFrame, titles: DataFrame) -> DataFrame:
    """qid, number, source, line for each cited source; titles: arxiv_id, title and perhaps id. Sources without a title stand for
    it. Of several titles of one arxiv_id, that of the smallest id counts (without ids, the smallest), whatever order rows come in."""
    number = F.row_number().over(Window.partitionBy("qid").orderBy("first"))
    # rows without an id come last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "title"))["title"] if "id" in titles.columns else F.min("title")
    named = groups.withColumn("key_", without_txt(F.col("source")))
    # a few sources a question: other titles are not shuffled
    cited = titles.where("title is not null").withColumn("key_", F.col("arxiv_id")).join(F.broadcast(named.select("key_").distinct()), "key_", "left_semi")
    named = named.join(cited.groupBy("key_").agg(first.alias("title")), "key_", "left")
    return named.select("qid", number.alias("number"), "source", citation(number, F.col("source"), F.coalesce("title", "source")).alias("line"))


def history_pairs(turns: DataFrame, last: int = 5) -> DataFrame:
    """conv_id, pair (from 1), user, assistant: the last pairs of a user's turn and the assistant's directly after it;
    system turns are left out. turns: conv_id, turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    pairs = spoken.withColumn("reply", F.lead("text").over(order)).withColumn("reply_role", F.lead("role").over(order)).where("role = 'user' and reply_role = 'assistant'")
    newest = pairs.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    return newest.select("conv_id", F.row_number().over(order).alias("pair"), F.col("text").alias("user"), F.col("reply").alias("assistant"))


def messages(context: Column, history: Column, question: Column, last: int = 5) -> Column:
    """array<struct<role, content>>: system, the last pairs of history (array<struct<u, a>>), then the question."""
    def said(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    kept = F.slice(history, F.greatest(F.size(history) - last + 1, F.lit(1)), last)
    old = F.flatten(F.transform(F.coalesce(kept, F.array().cast("array<struct<u:string,a:string>>")), lambda h: F.array(said("user", h["u"]), said("assistant", h["a"]))))
    return F.concat(F.array(said("system", F.concat(F.lit(SYSTEM_PROMPT), F.coalesce(context, F.lit(NO_CONTEXT))))), old, F.array(said("user", question)))


def extractive(prompts: list[list[dict]]) -> list[str]:
    """The default completion: the context's first sentence that shares most words with the question."""
    out = []
    for p in prompts:
        body, asked = p[0]["content"].removeprefix(SYSTEM_PROMPT), set(p[-1]["content"].lower().split())
        sentences = [s.strip() for s in body.replace("\n", ". ").split(". ") if s.strip()]
        out.append(max(sentences, key=lambda s: len(asked & set(s.lower().split())), default="") if body != NO_CONTEXT else NO_CONTEXT)
    return out


def completed(prompt: Column, completer: Callable[[list[list[dict]]], list[str]] = extractive) -> Column:
    """Answers by any function from a batch of prompts to texts, e.g. a client of a hosted model."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(completer([[dict(m) if isinstance(m, dict) else m.asDict() for m in p] for p in s]))

    return run(prompt)


def answers(questions: DataFrame, hits: DataFrame, titles: DataFrame, completer: Callable = extractive, last: int = 5) -> DataFrame:
    """qid, question, answer. questions: qid, question, history; hits: qid, rank, text, arxiv_id (may be empty)."""
    groups = by_source(hits)
    refs = citations(groups, titles).groupBy("qid").agg(_joined(F.struct("number", "line"), "line", "\n").alias("refs"))
    asked = questions.join(contexts(groups), "qid", "left").join(refs, "qid", "left")
    text = completed(messages(F.col("context"), F.col("history"), F.col("question"), last), completer)
    tail = F.when(F.col("refs").isNotNull(), F.concat(F.lit(REFERENCES), F.col("refs"))).otherwise("")
    return asked.withColumn("text_", text).select("qid", "question", F.concat("text_", tail).alias("answer"))
