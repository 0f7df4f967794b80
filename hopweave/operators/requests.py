"""Request lines for chat models as JSON, and their results back to rows. Nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranking

ITEMS = "array<struct<id:string,status:string,question:string,reason:string>>"


def batched(items: DataFrame, size: int, order: str, item: Column, bucket: int = 64) -> DataFrame:
    """``batch, items``: every ``size`` items in one batch, in order inside a hash bucket of their ids.

    Buckets are packed by themselves, so no task sees all items; each bucket's last batch may be smaller.
    """
    b = items.withColumn("_b", F.pmod(F.conv(F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(bucket)))
    n = F.floor((F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1) / size)
    g = b.withColumn("_n", n).groupBy("_b", "_n").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("x"))
    return g.select(F.concat_ws("-", F.col("_b").cast("string"), F.col("_n").cast("string")).alias("batch"), F.transform("x", lambda y: y["i"]).alias("items"))


def chat_request(custom_id: Column, system: str, user: Column, model: str, temperature: float = 0.0, most_tokens: int = 512) -> Column:
    """One request line: id, method, address and body with a system and a user message."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(most_tokens).alias("max_tokens"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def parse_results(lines: DataFrame, line: str = "value", order: list[str] = ("file", "line_no")) -> tuple[DataFrame, DataFrame]:
    """Items of result lines, and the lines that cannot be read with their reason.

    A line is JSON with the answer's text inside, which holds ``{"items": [...]}`` as JSON again,
    perhaps in a code fence. A later item of an id takes the place of an earlier one. Items
    without an id are left out.
    """
    content = F.get_json_object(line, "$.response.body.choices[0].message.content")
    bare = F.regexp_replace(F.regexp_replace(content, r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")
    x = lines.withColumn("_c", content).withColumn("_i", F.from_json(F.get_json_object(bare, "$.items"), T._parse_datatype_string(ITEMS)))
    failed = F.get_json_object(line, "$.error").isNotNull()
    reason = F.when(F.get_json_object(line, "$.custom_id").isNull(), "no_id").when(failed, "error").when(F.col("_c").isNull(), "no_content").when(F.col("_i").isNull(), "no_items")
    x = x.withColumn("_r", reason)
    good = x.where("_r is null").select(F.get_json_object(line, "$.custom_id").alias("custom_id"), *order, F.posexplode("_i").alias("_p", "item")).where("item.id is not null").select("custom_id", *order, "_p", "item.*")
    kept = ranking.keep_first(good, ["id"], [*(F.col(o).desc() for o in order), F.col("_p").desc()]).drop("_p", *order)
    return kept, x.where("_r is not null").select(*order, F.col("_r").alias("reason"))


def accepted(generated: DataFrame, judged: DataFrame, predicate: Column) -> DataFrame:
    """Generated items joined with their judgement (by ``id``), as far as the predicate holds; an item without one is left out."""
    return generated.join(judged, "id").where(F.coalesce(predicate, F.lit(False)))
