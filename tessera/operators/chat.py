"""Chat rows: messages with content blocks, their targets, and their split into prompt and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT = "array<struct<type:string,text:string>>"
MESSAGES = f"array<struct<role:string,content:{CONTENT}>>"


def conversation_rows(turns: DataFrame) -> DataFrame:
    """One chat row per conversation, its messages in order of turn; turns has conv_id, turn, role, text."""
    message = F.struct("turn", "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).cast(MESSAGES).alias("messages"))


def first_text(message: Column) -> Column:
    """The text of a message's first text block."""
    return F.try_element_at(F.filter(message["content"], lambda b: b["type"] == "text"), F.lit(1))["text"]


def assistants(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] == "assistant")


def first_assistant_text(messages: Column) -> Column:
    """The first text that any assistant message has, in order."""
    texts = F.filter(F.transform(assistants(messages), first_text), lambda t: t.isNotNull())
    return F.try_element_at(texts, F.lit(1))


def last_assistant_text(messages: Column) -> Column:
    """The first text of the last assistant message."""
    return first_text(F.try_element_at(assistants(messages), F.lit(-1)))


def split_at(messages: Column) -> Column:
    """How many messages are the prompt: those before the first assistant one, at least one; without one all but the last."""
    found = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant") - 1
    n = F.size(messages).cast("long")
    at = F.when(found < 0, F.greatest(n - 1, F.lit(1).cast("long"))).otherwise(found)
    return F.when(at <= 0, F.lit(1).cast("long")).otherwise(at).cast("int")


def prompt_of(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), split_at(messages))


def completion_of(messages: Column) -> Column:
    """What follows the prompt; if that is nothing, the last message."""
    rest = F.slice(messages, split_at(messages) + 1, F.size(messages))
    return F.when(F.size(rest) == 0, F.slice(messages, -1, 1)).otherwise(rest)


def dataset_summary(rows: DataFrame) -> DataFrame:
    """One row: how many rows there are, the columns, and the first row's id and first image, by id; empty texts where there is none."""
    first = F.min(F.struct("id", F.coalesce(F.get("images", F.lit(0)), F.lit("")).alias("image")))
    told = rows.agg(F.count("*").alias("rows"), first.alias("f"))
    keys = F.array(*map(F.lit, rows.columns)) if rows.columns else F.array().cast("array<string>")
    return told.select("rows", F.when(F.col("rows") > 0, keys).alias("keys"), F.coalesce("f.id", F.lit("")).alias("first_id"), F.coalesce("f.image", F.lit("")).alias("first_image"))


def file_report(lines: DataFrame, preview: int = 20) -> DataFrame:
    """For each file: lines, good and bad ones, and the first errors in order; lines has file, lineno, error (null if good).

    Only the first errors are gathered: within each block of line numbers, and then overall.
    """
    counts = lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count("error").alias("n_bad"))
    bad = lines.where("error IS NOT NULL").withColumn("_block", F.floor(F.col("lineno") / 4096))
    first = F.row_number().over(Window.partitionBy("file", "_block").orderBy("lineno", "error"))
    first = bad.withColumn("_k", first).where(F.col("_k") <= preview)
    again = F.row_number().over(Window.partitionBy("file").orderBy("lineno", "error"))
    told = first.withColumn("_k", again).where(F.col("_k") <= preview).groupBy("file")
    shown = told.agg(F.array_sort(F.collect_list(F.struct("lineno", "error"))).alias("errors"))
    return counts.join(shown, "file", "left")


def staged_retries(attempts: DataFrame, most: int, system: str, stage: str = "stage", preview: int = 240) -> DataFrame:
    """What a stage gives that is tried up to `most` times, each time told what was wrong before: one row a run.

    attempts has run, attempt (from 1), and what was recorded of it: api_error (null if the call went through), raw,
    parsed (the object in raw as text, null if there is none) and errors (an array: what a validator says of parsed).
    The first attempt without any error ends the run. Returns ok, attempts, data (its parsed text), errors (a message for
    each failed attempt), prompts (what each attempt was asked), last_raw and last_parsed.
    """
    name = F.concat(F.lit(f"{stage} attempt "), F.col("attempt").cast("string"))
    shown = F.substring(F.translate("raw", "\n", " "), 1, preview)
    joined = F.array_join("errors", "; ")
    invalid = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0
    message = (
        F.when(F.col("api_error").isNotNull(), F.concat(name, F.lit(": API error: "), "api_error"))
        .when(F.col("parsed").isNull(), F.concat(name, F.lit(": JSON parse failed; raw_preview="), F.coalesce(shown, F.lit(""))))
        .when(invalid, F.concat(name, F.lit(": validation failed: "), joined))
    )
    carried = F.when(F.col("api_error").isNull() & F.col("parsed").isNotNull(), F.when(invalid, joined)).otherwise(message)
    told = attempts.where(F.col("attempt") <= most).select("run", "attempt", "api_error", "raw", "parsed", message.alias("message"), carried.alias("carried"))
    runs = told.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("attempt", "api_error", "raw", "parsed", "message", "carried"))).alias("tries"))
    end = F.array_min(F.transform(F.filter("tries", lambda t: t["message"].isNull()), lambda t: t["attempt"]))
    runs = runs.select("run", "tries", end.alias("end"))
    used = F.filter("tries", lambda t: F.col("end").isNull() | (t["attempt"] <= F.col("end")))
    issue = lambda i: F.when(i > 0, F.get(used, i - 1)["carried"])
    ask = lambda t, i: F.concat_ws("\n\n", F.lit(system), F.concat(F.lit("Previous output issues:\n"), issue(i), F.lit("\nReturn ONLY valid JSON object.")))
    last = lambda values: F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))
    return runs.select(
        "run",
        F.col("end").isNotNull().alias("ok"),
        F.coalesce("end", F.lit(most)).alias("attempts"),
        F.when(F.col("end").isNotNull(), F.try_element_at(used, F.lit(-1))["parsed"]).alias("data"),
        F.filter(F.transform(used, lambda t: t["message"]), lambda m: m.isNotNull()).alias("errors"),
        F.transform(used, ask).alias("prompts"),
        last(F.transform(used, lambda t: F.when(t["api_error"].isNull(), t["raw"]))).alias("last_raw"),
        last(F.transform(used, lambda t: t["parsed"])).alias("last_parsed"),
    )
