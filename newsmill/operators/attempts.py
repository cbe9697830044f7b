"""A run of generations against a provider that may fail: rounds of attempts over the rows that are still open.

A round reserves its requests' ceilings from what is left of the budget (first come, first served), asks the provider for
all reserved ones at once, and keeps the answers as a table of attempts. Answers that ask for another attempt make the
next round; there are RETRIED_ATTEMPTS rounds at most. Nothing but the amount that is left comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import summaries
from .lineage import cut

#: One attempt for each row (generation_id, number and the request's own columns): what provider_outcome() looks at, and
#: json, model, tokens_in, tokens_cached, tokens_out (null where the answer has no usage).
Ask = Callable[[DataFrame], DataFrame]
ANSWER = ["generation_id", "error", "http_status", "envelope_ok", "refused", "envelope_status", "output_json_ok", "json", "model", "tokens_in", "tokens_cached", "tokens_out"]
UNPRICED = "budget_exceeded_or_unpriced_model"


@dataclass
class Run:
    """generations: generation_id, status, issues, calls, cost; attempts: generation_id, number, outcome and the answer."""

    generations: DataFrame
    attempts: DataFrame


def _reserved(rows: DataFrame, left: Decimal) -> DataFrame:
    if left <= 0:
        return rows.withColumn("reserved", F.lit(False))
    return summaries.within_budget(rows, float(left))


def run(requests: DataFrame, ask: Ask, items: DataFrame, limit_usd: float) -> Run:
    """requests: generation_id, seq (order, without ties), eligible, ceiling (null: the model has no price) and what the
    provider needs; items: generation_id, item_id, text.

    Cost is null where any attempt's usage or price isn't known, and for generations that made none.
    """
    open_, left, made, over = requests.where("eligible"), Decimal(str(limit_usd)), [], []
    for number in range(1, summaries.RETRIED_ATTEMPTS + 1):
        rows = cut(_reserved(open_, left).withColumn("number", F.lit(number)))
        over.append(rows.where("not reserved").select("generation_id"))
        asked = rows.where("reserved").drop("reserved")
        answers = ask(asked).select(*ANSWER).withColumns({"number": F.lit(number), "priced": F.lit(True)})
        made.append(cut(answers.withColumn("outcome", summaries.provider_outcome())))
        left -= Decimal(asked.agg(F.sum(F.col("ceiling").cast("decimal(28,8)"))).first()[0] or 0)
        open_ = requests.join(made[-1].where("outcome = 'retry'").select("generation_id"), "generation_id", "left_semi")
    attempts = reduce(DataFrame.unionByName, made).drop("priced")
    ended = attempts.where("outcome is null or outcome <> 'retry'")
    failed = ended.where("outcome is not null").select("generation_id", F.col("outcome").alias("failure")).unionByName(reduce(DataFrame.unionByName, over).withColumn("failure", F.lit(UNPRICED)))
    judged = summaries.validated(summaries.parsed(ended.where("outcome is null").select("generation_id", "json")), items)
    none = F.array().cast("array<string>")
    found = judged.select("generation_id", F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("status"), "issues")
    found = found.unionByName(failed.select("generation_id", F.lit("rejected").alias("status"), F.array(F.concat("failure", F.lit("@provider"))).alias("issues")))
    price = summaries.cost(F.col("model"), F.col("tokens_in"), F.col("tokens_cached"), F.col("tokens_out"))
    spent = attempts.withColumn("price", price).groupBy("generation_id").agg(F.count("*").alias("calls"), summaries.all_or_null(F.col("price")).alias("cost"))
    out = requests.select("generation_id", "eligible").join(found, "generation_id", "left").join(spent, "generation_id", "left")
    return Run(
        out.select(
            "generation_id", F.when(F.col("eligible"), F.col("status")).otherwise("skipped").alias("status"), F.when(F.col("eligible"), F.coalesce("issues", none)).otherwise(F.array(F.lit("ineligible_source_time"))).alias("issues"),
            F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.when(F.col("eligible"), F.col("cost")).otherwise(F.lit(0)).cast("decimal(28,8)").alias("cost"),
        ),
        attempts,
    )
