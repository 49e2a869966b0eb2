"""Token budgets: chat history, context blocks, and the split of a model's window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.functions import rules as R
from corpusjobs.functions import text as T

NUM_CTX, RESERVE, MAX_MESSAGES, REWRITE_TURNS, REWRITE_TOKENS = 8192, 1536, 10, 6, 200
CONTEXT_TITLE = "## Relevant Code Sections\n\n"
NO_CONTEXT = (
    CONTEXT_TITLE + "No relevant code was found in the uploaded project for this question. Tell the user that, and answer only in general terms if at all.\n"
)


def _from_first_user(turns: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return turns.withColumn("_first", first).filter(F.col("turn") >= F.col("_first")).drop("_first")


def sanitized(turns: DataFrame) -> DataFrame:
    """User and assistant turns with text (`ai` is the assistant), from the first user turn on."""
    role = F.when(F.col("role") == "ai", "assistant").otherwise(F.col("role"))
    return _from_first_user(turns.withColumn("role", role).filter(F.col("role").isin("user", "assistant") & F.col("text").rlike(r"\S")))


def fitted(turns: DataFrame, budget: int | str, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """The latest turns within the budget (a number, or a column's name), up to the first that does not fit, starting on a user turn."""
    latest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= max_messages)
    used = F.sum(T.estimated_tokens(F.col("text")) + 4).over(latest.rowsBetween(W.unboundedPreceding, 0))
    limit = F.lit(budget) if isinstance(budget, int) else F.greatest(F.col(budget), F.lit(0))
    return _from_first_user(recent.withColumn("_used", used).filter(F.col("_used") <= limit).drop("_n", "_used"))


def rewrite_windows(turns: DataFrame) -> DataFrame:
    """conv_id, transcript: the last turns, each cut, as the model that rewrites questions sees them."""
    latest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= REWRITE_TURNS)
    line = F.concat("role", F.lit(": "), T.truncated(F.col("text"), REWRITE_TOKENS))
    parts = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("transcript"))


def cleaned_rewrite(reply: Column, question: Column) -> Column:
    """The first line of a reply without quotes; the question if that is empty or too long."""
    line = F.regexp_replace(R.strip(F.element_at(F.split(R.strip(reply), r"\r\n|\r|\n"), 1)), "^[\"']+|[\"']+$", "")
    return F.when((F.coalesce(line, F.lit("")) == "") | (F.char_length(line) > 500), question).otherwise(line)


def budgets(system: Column, question: Column, relations: Column, num_ctx: int = NUM_CTX, reserve: int = RESERVE) -> Column:
    """struct(available, relations_budget, context_budget) in tokens."""
    available = F.lit(num_ctx - reserve - 64) - T.estimated_tokens(system) - T.estimated_tokens(question)
    return F.struct(
        available.alias("available"), (available * F.lit(0.15)).cast("int").alias("relations_budget"),
        ((available * F.lit(0.7)).cast("int") - T.estimated_tokens(relations)).alias("context_budget"),
    )


def kept_in_order(costs: Column, budget: Column) -> Column:
    """For an array of costs, best first: which are taken when one that does not fit is skipped."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, cost: Column) -> Column:
        fits = acc["used"] + cost <= budget
        return F.struct((acc["used"] + F.when(fits, cost).otherwise(0)).cast("int").alias("used"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    return F.aggregate(costs, start, step, lambda acc: acc["kept"])


def packed_context(hits: DataFrame, budget: Column) -> DataFrame:
    """project_id, question_id, context, used (ranks): the rendered chunks of a question that fit its budget, best first.

    hits: project_id, question_id, rank, block. A question has a handful of hits.
    """
    blocks = F.sort_array(F.collect_list(F.struct("rank", "block")))
    rows = hits.groupBy("project_id", "question_id").agg(blocks.alias("blocks"))
    kept = kept_in_order(F.transform("blocks", lambda b: T.estimated_tokens(b["block"])), budget)
    rows = rows.withColumn("kept", kept)
    used = F.filter(F.col("blocks"), lambda b, i: F.get(F.col("kept"), i))
    text = F.concat(F.lit(CONTEXT_TITLE), F.array_join(F.transform(used, lambda b: b["block"]), ""))
    return rows.select("project_id", "question_id", F.when(F.size(used) > 0, text).otherwise(NO_CONTEXT).alias("context"), F.transform(used, lambda b: b["rank"]).alias("used"))
