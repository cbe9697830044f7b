"""Operator 6: quality rules as a short-circuit cascade.

A rule rejects a document by its counts. On a hashed sample of documents each rule's cost and rejections are measured;
the cascade then runs the rules in descending order of rejections per cost, and a rule sees only what the rules before
it let through. The order changes what is computed, never which documents are kept: a document is kept if no rule
rejects it.

The statistics are computed in one pass over each text inside the tasks that read the table; no row is shuffled.

Defined cases: null text has no words and is rejected; empty texts likewise; texts of any length are taken whole;
repeated rows stay; an empty table gives an empty result (rules then keep their given order).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled_texts, spare, table

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: About so many different texts, none longer than SAMPLE_CHARS, are the sample that costs and selectivities are measured on.
SAMPLE_TEXTS, SAMPLE_CHARS = 1_000, 20_000

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_ODD_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """One text and what rules ask of it, each computed at most once."""

    def __init__(self, text: str):
        self.text = text

    def __getattr__(self, name: str):
        value = _FACTS[name](self)
        self.__dict__[name] = value
        return value


def _repeats(t: Text) -> int:
    """Words inside 8-word windows found twice or more in the text, the first included."""
    n = len(t.words)
    if n <= WINDOW:
        return 0
    # a text whose words are all different has no repeated window
    if len(set(t.words)) == n:
        return 0
    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in t.words], np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h = h * _ODD_MULTIPLIER + ids[k : n - WINDOW + 1 + k]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _lines(t: Text) -> int:
    return max(1, sum(1 for x in t.data.split(b"\n") if x and not x.isspace()))


#: bytes.split() parts at \x20 and \x09-\x0D and nothing else, as the word rule does.
_FACTS: dict[str, Callable[[Text], object]] = {
    "data": lambda t: t.text.encode("utf-8", "surrogatepass"),
    "words": lambda t: t.data.split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, " \t\n\r\x0b\x0c")),
    "n_symbols": lambda t: sum(map(t.data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
    "n_dup_lines": _dup_lines,
    "n_lines": _lines,
    "n_repeat_words": _repeats,
    "n_letters": lambda t: len(t.text) - len(_NOT_LETTERS.findall(t.text)),
    "n_alpha_words": lambda t: sum(1 for w in t.words if _LETTER.search(w)),
}
_NOT_LETTERS = re.compile(r"[\W\d_]")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class Rule:
    """rejects: true where the document goes."""

    name: str
    rejects: Callable[[Text], bool]


#: Public heuristics of web-corpus filtering; the bounds are far from what ordinary prose reaches.
RULES = [
    Rule("few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > REPEAT_PERCENT * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words * 3),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("alpha_words", lambda t: 10 * t.n_alpha_words < 7 * t.n_words),
]


def order_by_yield(texts: list[str], rules: list[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second on a sample; ties keep the given order. Each rule is timed from scratch."""
    if not texts:
        return list(rules)
    gain = {}
    for rule in rules:
        began = time.perf_counter()
        n = sum(rule.rejects(Text(t)) for t in texts)
        gain[rule.name] = n / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda r: -gain[r.name])


def verdict(text: Text, rules: list[Rule]) -> str | None:
    """Name of the first rule that rejects, None if the document stays."""
    return next((r.name for r in rules if r.rejects(text)), None)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def apply(docs: DataFrame, keep: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """Columns `keep` of docs (none of SCHEMA's names) and SCHEMA."""
    order = [r.name for r in order_by_yield(sampled_texts(docs, SAMPLE_TEXTS, SAMPLE_CHARS), rules)]
    by_name = {r.name: r for r in rules}

    def judge(batches):
        ranked = [by_name[x] for x in order]
        for batch in batches:
            found = []
            for text in batch.column(len(keep)):
                t = Text(text.as_py() or "")
                why = verdict(t, ranked)
                failed = t.n_words < MIN_WORDS or 100 * t.n_repeat_words > REPEAT_PERCENT * t.n_words
                found.append((*(getattr(t, c) for c in _COUNTS), failed, why is None, why))
            columns = zip(*found, strict=True) if found else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns, added.values())], names=[*keep, *added])

    added = dict.fromkeys(_COUNTS, pa.int64()) | {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias(spare(docs, "content")[0])).mapInArrow(judge, f"{fields}, {SCHEMA}")


def kept(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    order = [r.name for r in order_by_yield(sampled_texts(docs, SAMPLE_TEXTS, SAMPLE_CHARS), rules)]
    by_name = {r.name: r for r in rules}

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        ranked = [by_name[x] for x in order]
        return texts.map(lambda t: verdict(Text(t or ""), ranked) is None)

    return docs.where(stays("text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    out = apply(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *_COUNTS, "base_failed", "kept")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM d) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - coalesce(list_unique(lines), 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         greatest(1, len(lines)) AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 10 * n_alpha < 7 * n_words) AS kept
FROM c
"""
