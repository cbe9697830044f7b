"""Operator 2 [native]: URL rules indexed by their rarest literal token.

A rule names a host (it fits that host and its subdomains), the beginning of a path, and optionally a pattern that the
whole url must match. Each rule is filed under one literal token that every url it fits must have, the token that is
rarest among all urls. A url's tokens fetch their rules, and only on those is the regular expression run.

Up to INLINE_RULES rules the index is a constant map inside the projection: no join and no shuffle. A larger rule set
is joined by token; Spark then chooses the join from its size.

Defined cases: a null url, or one without "://", has an empty host and path and no rule; of fitting rules the longest
(host and path) wins, then the longer host, then block before allow; without a rule the default verdict (allow)
holds; repeated rows stay; an empty table or an empty rule list is fine; columns of the input named like an added one
are replaced, all others stay.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, spare, table


@dataclass(frozen=True)
class Rule:
    """action: allow or block. path: how the url's path begins ('' for any)."""

    action: str
    host: str
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """On host + path; a host has no slash and a path is empty or begins with one."""
        end = re.escape(self.path) if self.path else r"(?:/|$)"
        return r"^(?:[^/]*\.)?" + re.escape(self.host) + end

    def tokens(self) -> list[str]:
        """What a fitting url must have: whole host labels, and path segments that the rule closes with a slash."""
        inner = [s for s in self.path.split("/")[1:-1] if s]
        return sorted({"h:" + x for x in self.host.split(".")} | {"p:" + x for x in inner})


#: The rules of the query (fixed values).
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
DEFAULT = "allow"
#: Rules that are kept as a constant in the plan; more are joined.
INLINE_RULES = 2_000

_HIT = "struct<size:int,host_size:int,action:string,rule:string,regex:string,pattern:string>"


def parts(df: DataFrame, url: str) -> DataFrame:
    """df with host and path of its url."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    at = lambda k: F.coalesce(F.regexp_extract(url, whole, k), F.lit(""))
    return df.withColumns({"host": F.translate(at(1), UPPER, LOWER), "path": at(2)})


def url_tokens() -> Column:
    """Distinct tokens of host and path; each path segment counts, as a rule's closed segments do."""
    host = F.transform(F.split("host", r"\.", -1), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.array_remove(F.split("path", "/", -1), ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(host, path))


def rarest(df: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """Each rule's token with the fewest urls (all of them counted; ties by name). One count a token of the rules comes back."""
    of_rules = sorted({t for r in rules for t in r.tokens()})
    wanted = df.sparkSession.createDataFrame([(t,) for t in of_rules], "token string")
    seen = df.select(F.explode(url_tokens()).alias("token")).join(wanted, "token", "left_semi").groupBy("token").count()
    counts = {t: n for t, n in seen.collect()}
    return {r: min(r.tokens(), key=lambda t: (counts.get(t, 0), t)) for r in rules}


def _best(hits: Column) -> Column:
    """The winning rule among fetched ones: the regular expressions run here and nowhere else."""
    text = F.concat("host", "path")
    fits = F.filter(hits, lambda c: F.regexp_like(text, c["regex"]) & ((c["pattern"] == "") | F.regexp_like("url", c["pattern"])))
    return F.array_max(fits)


def judge(df: DataFrame, rules: list[Rule], default: str = DEFAULT, inline_rules: int = INLINE_RULES) -> DataFrame:
    """df (with a url column) and host, path, rule, verdict."""
    best, = spare(df, "best")
    rows = parts(df.drop("rule", "verdict"), "url")
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    index: dict[str, list] = {}
    for r, token in rarest(rows, rules).items():
        index.setdefault(token, []).append({"size": len(r.name), "host_size": len(r.host), "action": r.action, "rule": r.name, "regex": r.regex, "pattern": r.pattern})
    if len(rules) <= inline_rules:
        filed = F.from_json(F.lit(json.dumps(index)), f"map<string,array<{_HIT}>>")
        hits = F.flatten(F.transform(F.filter(url_tokens(), lambda t: F.map_contains_key(filed, t)), lambda t: F.element_at(filed, t)))
        out = rows.withColumn(best, _best(hits))
    else:
        filed = df.sparkSession.createDataFrame([(t, json.dumps(h)) for t, h in index.items()], "token string, hits string")
        filed = filed.select("token", F.from_json("hits", f"array<{_HIT}>").alias("hits"))
        keys = rows.select("url", "host", "path").distinct()
        found = keys.withColumn("token", F.explode(url_tokens())).join(filed, "token").withColumn("best", _best(F.col("hits")))
        found = found.where("best is not null").groupBy("url").agg(F.max("best").alias(best))
        out = rows.join(found, "url", "left").select(*(F.col(f"`{c}`") for c in rows.columns), best)
    return out.withColumns({"rule": F.col(best)["rule"], "verdict": F.coalesce(F.col(best)["action"], F.lit(default))}).drop(best)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under RULES."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN hits ON parts.page_id = hits.page_id
"""
