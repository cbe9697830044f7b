"""Summaries of clusters: a provider, and the mechanical checks of its evidence.

A provider is any function DataFrame to DataFrame. The fixture one extracts sentences with built-in functions. The
checks explode claims and citations, join them to the sources and compare; a summary with any issue is rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.text import forbidden, numbers, sentences
from .lineage import cut

Provider = Callable[[DataFrame], DataFrame]
CLAIMS = "array<struct<text:string,evidence:array<struct<item_id:string,quote:string>>>>"
#: Wording that recommends a trade (fixed values).
FORBIDDEN = ["buy now", "sell now", "go long", "go short", "execute order", "guaranteed return", "price will", "trade signal"]
MODELS = ["gpt-4.1-mini-2025-04-14", "gpt-4.1-mini"]


def extractive(clusters: DataFrame) -> DataFrame:
    """clusters (generation_id, item_id, title, text of the first member) to summaries: its first two sentences."""
    parts = F.filter(F.transform(sentences(F.col("text")), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take an index as what to trim
    claims = F.transform(F.slice(parts, 1, 2), lambda s: F.struct(s.alias("text"), F.array(F.struct(F.col("item_id"), s.alias("quote"))).alias("evidence")))
    return clusters.select("generation_id", F.col("title").alias("headline"), claims.alias("claims"), F.array(F.lit("Sentences taken from the source as they stand; no model wrote them.")).alias("uncertainty"))


def schema_issues() -> Column:
    """Paths of what breaks the summary's size rules."""
    size = lambda c, low, high: ~F.coalesce(F.char_length(c).between(low, high), F.lit(False))
    count = lambda c, low, high: ~F.coalesce(F.size(c).between(low, high), F.lit(False))
    bad_quote = lambda e: size(e["item_id"], 1, 160) | size(e["quote"], 12, 1200)
    bad_claim = lambda c: size(c["text"], 1, 500) | count(c["evidence"], 1, 4) | F.exists(c["evidence"], bad_quote)
    return F.array_compact(F.array(
        F.when(size(F.col("headline"), 1, 160), "headline"), F.when(count(F.col("claims"), 1, 4) | F.exists("claims", bad_claim), "claims"),
        F.when(~F.coalesce(F.size("uncertainty") <= 4, F.lit(False)) | F.exists("uncertainty", lambda u: size(u, 1, 300)), "uncertainty"),
    ))


def validated(summaries: DataFrame, items: DataFrame) -> DataFrame:
    """(generation_id, issues, accepted): issues are 'code@path', sorted; items: generation_id, item_id, text."""
    rows = summaries.withColumn("wrong", schema_issues())
    schema = rows.select("generation_id", F.explode("wrong").alias("path")).select("generation_id", F.concat(F.lit("schema@"), "path").alias("issue"))
    fine = rows.where(F.size("wrong") == 0)
    claims = fine.select("generation_id", F.posexplode("claims").alias("i", "claim"))
    cited = claims.select("generation_id", "i", F.posexplode("claim.evidence").alias("j", "e")).select("generation_id", "i", "j", "e.item_id", "e.quote")
    met = cited.join(items.select("generation_id", "item_id", "text"), ["generation_id", "item_id"], "left")
    met = met.withColumn("code", F.when(F.col("text").isNull(), "unknown_citation").when(~F.contains("text", "quote"), "evidence_mismatch")).drop("text")
    path = F.concat(F.lit("claims."), F.col("i").cast("string"), F.lit(".evidence."), F.col("j").cast("string"))
    citations = met.where("code is not null").select("generation_id", F.concat("code", F.lit("@"), path).alias("issue"))
    proven = met.where("code is null").withColumn("n", numbers(F.col("quote")))
    by_claim = proven.groupBy("generation_id", "i").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("n"))
    none = F.array().cast("array<string>")
    unsupported = lambda text, n: F.size(F.array_except(numbers(text), F.coalesce(n, none))) > 0
    loose = claims.join(by_claim, ["generation_id", "i"], "left").where(unsupported(F.col("claim.text"), F.col("n")))
    loose = loose.select("generation_id", F.concat(F.lit("unsupported_number@claims."), F.col("i").cast("string"), F.lit(".text")).alias("issue"))
    by_all = proven.groupBy("generation_id").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("n"))
    head = fine.join(by_all, "generation_id", "left").where(unsupported(F.col("headline"), F.col("n"))).select("generation_id", F.lit("unsupported_number@headline").alias("issue"))
    text = F.concat_ws(" ", "headline", F.array_join(F.transform("claims", lambda c: c["text"]), " "), F.array_join("uncertainty", " "))
    advice = fine.where(forbidden(text, FORBIDDEN)).select("generation_id", F.lit("trade_action@output").alias("issue"))
    issues = schema.unionByName(citations).unionByName(loose).unionByName(head).unionByName(advice)
    found = issues.groupBy("generation_id").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    out = summaries.select("generation_id").join(found, "generation_id", "left").withColumn("issues", F.coalesce("issues", none))
    return out.withColumn("accepted", F.size("issues") == 0)


def generate(clusters: DataFrame, provider: Provider, items: DataFrame) -> DataFrame:
    """(generation_id, status, issues): eligible clusters go to the provider, the others are skipped before it."""
    ready = clusters.where("eligible")
    judged = validated(provider(ready), items).select("generation_id", F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("status"), "issues")
    skipped = clusters.where("not eligible").select("generation_id", F.lit("skipped").alias("status"), F.array(F.lit("ineligible_source_time")).alias("issues"))
    return judged.unionByName(skipped)


#: What a summary's JSON may hold, by level (fixed values).
SUMMARY_KEYS = {"$": ["schemaVersion", "headline", "claims", "uncertainty"], "claims": ["text", "evidence"], "evidence": ["itemId", "quote"]}
_SUMMARY = "schemaVersion string, headline string, claims array<struct<text:string,evidence:array<struct<itemId:string,quote:string>>>>, uncertainty array<string>"


def parsed(candidates: DataFrame) -> DataFrame:
    """candidates (generation_id, json) as summaries. What isn't an object of the schema's keys and version gets no
    headline, and so fails the size rules of validated()."""
    none = F.array().cast("array<string>")
    listed = lambda j, path: F.coalesce(F.from_json(F.get_json_object(j, path), "array<string>"), none)
    only = lambda j, level: F.coalesce(F.size(F.array_except(F.json_object_keys(j), F.array(*map(F.lit, SUMMARY_KEYS[level])))) == 0, F.lit(False))
    claims = listed(F.col("json"), "$.claims")
    nested = F.forall(claims, lambda c: only(c, "claims") & F.forall(listed(c, "$.evidence"), lambda e: only(e, "evidence")))
    d = F.from_json("json", _SUMMARY)
    rows = candidates.select("generation_id", d.alias("d"), (only(F.col("json"), "$") & nested & F.coalesce(d["schemaVersion"] == "summary-v1", F.lit(False))).alias("fits"))
    evidence = lambda c: F.transform(c["evidence"], lambda e: F.struct(e["itemId"].alias("item_id"), e["quote"].alias("quote")))
    return rows.select("generation_id", F.when(F.col("fits"), F.col("d.headline")).alias("headline"), F.transform("d.claims", lambda c: F.struct(c["text"].alias("text"), evidence(c).alias("evidence"))).alias("claims"), F.col("d.uncertainty").alias("uncertainty"))


RETRIED_ATTEMPTS = 3


def provider_outcome() -> Column:
    """The failure that an attempt ends its generation with, null if it doesn't; 'retry' before another attempt.

    Columns: number, priced (the budget holds the request), error (timeout, network), http_status, envelope_ok, refused,
    envelope_status, output_json_ok.
    """
    status = F.col("http_status")
    again = ((status == 429) | (status >= 500)) & (F.col("number") < RETRIED_ATTEMPTS)
    return (
        F.when(~F.col("priced"), "budget_exceeded_or_unpriced_model").when(F.col("error") == "timeout", "provider_timeout").when(F.col("error").isNotNull(), "provider_network_error")
        .when(~status.between(200, 299) & again, "retry").when(~status.between(200, 299), F.concat(F.lit("provider_http_"), status.cast("string")))
        .when(~F.col("envelope_ok"), "invalid_provider_envelope").when(F.col("refused"), "provider_refused").when(F.col("envelope_status") != "completed", "provider_incomplete").when(~F.col("output_json_ok"), "invalid_output_json")
    )


def telemetry(generations: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """One row: accepted, rejected, skipped; with attempts (generation_id, cost): calls and cost, null if any is null."""
    out = generations.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "skipped")))
    if attempts is None:
        return out
    spent = attempts.groupBy("generation_id").agg(F.count("*").alias("calls"), all_or_null(F.col("cost")).alias("cost"))
    each = generations.select("generation_id").join(spent, "generation_id", "left").agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.round(all_or_null(F.col("cost")), 8).alias("cost"))
    return out.withColumn("_one", F.lit(1)).join(each.withColumn("_one", F.lit(1)), "_one").drop("_one")


def cost(model: Column, tokens_in: Column, tokens_cached: Column, tokens_out: Column) -> Column:
    """USD to eight decimals; null for an unknown model or usage."""
    rate = lambda n, usd: n.cast("decimal(18,0)") * F.lit(usd).cast("decimal(4,2)")
    total = rate(tokens_in - tokens_cached, C.PRICE_IN) + rate(tokens_cached, C.PRICE_CACHED) + rate(tokens_out, C.PRICE_OUT)
    return F.when(model.isin(MODELS), F.round(total / F.lit(1_000_000), 8).cast("decimal(18,8)"))


def all_or_null(value: Column) -> Column:
    """Sum over a group, null if any value is."""
    return F.when(F.bool_and(value.isNotNull()), F.sum(value))


def within_budget(requests: DataFrame, limit_usd: float, rounds: int = 32) -> DataFrame:
    """requests (seq, which has no ties, and ceiling) and reserved: first come, first served; a refused one takes nothing, and
    one without a ceiling is refused. Amounts are exact to eight decimals.

    Requests are cut into ranges of seq. What the ranges take together tells in which one the budget is met, and that one
    alone is summed row by row, up to the first request that is refused. From there on only requests that what is left
    could hold are looked at, in the same way; so a round ends with a refusal, and every other request up to it is
    reserved. If that takes more than so many rounds, one task walks what little is left of the budget.
    """
    if not 0 < limit_usd <= 10:
        raise ValueError("the budget must be above 0 and at most 10 USD")
    seq, ceiling = F.col("seq").cast("long"), F.col("ceiling").cast("decimal(28,8)")
    rows = requests.select(seq.alias("seq"), ceiling.alias("ceiling")).where("ceiling is not null")
    rows = cut(rows.repartitionByRange("seq").withColumn("span", F.spark_partition_id()))
    left, after, reserved = Decimal(str(limit_usd)).quantize(Decimal("1e-8")), None, F.lit(False)
    for _ in range(rounds):
        may = (F.col("ceiling") <= F.lit(left)) & (F.col("seq") > after if after is not None else F.lit(True))
        taken = rows.where(may).groupBy("span").agg(F.sum("ceiling").alias("total"))
        met = taken.withColumn("upto", F.sum("total").over(Window.orderBy("span"))).where(F.col("upto") > F.lit(left)).orderBy("span").first()
        fits = (ceiling <= F.lit(left)) & (seq > after if after is not None else F.lit(True))
        if met is None:
            return requests.withColumn("reserved", F.coalesce(reserved | fits, F.lit(False)))
        inside = rows.where(may & (F.col("span") == met["span"])).withColumn("upto", F.sum("ceiling").over(Window.orderBy("seq")) + F.lit(met["upto"] - met["total"]))
        refused = inside.where(F.col("upto") > F.lit(left)).orderBy("seq").first()
        reserved = reserved | (fits & (seq < refused["seq"]))
        left, after = left - (refused["upto"] - refused["ceiling"]), refused["seq"]

    def walk(batches):
        room = left
        for batch in batches:
            found = []
            for number, price in zip(batch["seq"].tolist(), batch["ceiling"].tolist(), strict=True):
                if price <= room:
                    room -= price
                    found.append(number)
            yield pd.DataFrame({"walked": pd.Series(found, dtype="int64")})

    rest = rows.where((F.col("seq") > after) & (F.col("ceiling") <= F.lit(left))).select("seq", "ceiling")
    walked = rest.repartition(1).sortWithinPartitions("seq").mapInPandas(walk, "walked long")
    out = requests.join(walked, seq == F.col("walked"), "left")
    return out.withColumn("reserved", F.coalesce(reserved, F.lit(False)) | F.col("walked").isNotNull()).drop("walked")


def quoted(texts: DataFrame, quotes: DataFrame, key: str = "doc_id", run: int = 8, letters: int = 8) -> DataFrame:
    """(key, item_id) of the texts that hold a quote as it stands.

    Each quote gives one run of words from its middle, which a text with the quote must have too; the texts' runs meet
    them in an equi-join, and only the pairs that meet are searched. Quotes of two words or fewer have no such run and
    are met by their first characters.
    """
    parts = quotes.withColumn("w", F.split("quote", " ")).withColumn("n", F.least(F.lit(run), F.size("w") - 2)).withColumn("by_word", F.col("n") >= 1)
    n = F.when(F.col("by_word"), F.col("n")).otherwise(F.least(F.lit(letters), F.char_length("quote")))
    part = F.when(F.col("by_word"), F.array_join(F.expr("slice(w, 2, greatest(n, 0))"), " ")).otherwise(F.substring("quote", F.lit(1), n))
    parts = parts.select("item_id", "quote", "by_word", n.alias("n"), part.alias("part"))
    few = parts.count() <= 20_000
    out = None
    for by_word, size in sorted(tuple(r) for r in parts.select("by_word", "n").distinct().collect()):  # run + letters rows at most
        mine = parts.where((F.col("by_word") == by_word) & (F.col("n") == size)).select("item_id", "quote", "part")
        rows = texts.withColumn("w", F.split("text", " ") if by_word else F.split("text", "")).where(F.size("w") >= size)
        at = rows.select(key, "text", "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i")) if size else rows.select(key, "text", "w", F.lit(0).alias("i"))
        at = at.select(key, "text", F.array_join(F.slice("w", F.col("i") + 1, size), " " if by_word else "").alias("part"))
        met = at.join(F.broadcast(mine) if few else mine, "part").where(F.contains("text", "quote")).select(key, "item_id")
        out = met if out is None else out.unionByName(met)
    return (out if out is not None else texts.select(key).join(quotes.select("item_id"), F.lit(False))).distinct()


def stage_share(stages: DataFrame) -> DataFrame:
    """(stage, runs, share) of stages (stage, duration): each stage's time against the longest one's, one percent at least."""
    total = stages.groupBy("stage").agg(F.count("*").alias("runs"), F.sum("duration").alias("_d"))
    most = total.agg(F.max("_d").alias("_most")).withColumn("_one", F.lit(1))
    share = F.round(F.greatest(F.lit(0.01), F.col("_d") / F.col("_most")), 6)
    return total.withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one").select("stage", "runs", share.alias("share"))


def citations(generations: DataFrame) -> DataFrame:
    """(generation_id, citations): evidence of all claims."""
    return generations.select("generation_id", F.aggregate(F.transform("claims", lambda c: F.size(c["evidence"])), F.lit(0), lambda a, b: a + b).cast("long").alias("citations"))


def evaluation(cases: DataFrame) -> DataFrame:
    """One row over cases (expected, accepted): passed, false accepts, false rejects."""
    return cases.agg(F.count_if(F.col("expected") == F.col("accepted")).alias("passed"), F.count_if(~F.col("expected") & F.col("accepted")).alias("false_accepts"), F.count_if(F.col("expected") & ~F.col("accepted")).alias("false_rejects"))
