"""Stable hashes and canonical JSON."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, eight hex digits. Astral characters count as their two surrogates."""
    units = F.split(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")), r"(?<=\G....)")
    code = lambda u: F.conv(u, 16, 10).cast("long")
    start = F.lit(2166136261)
    step = lambda h, u: ((h.bitwiseXOR(code(u))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.lpad(F.lower(F.hex(F.aggregate(F.filter(units, lambda u: u != ""), start.cast("long"), step))), 8, "0")


def canonical_json(fields: dict[str, Column], optional: tuple[str, ...] = ()) -> Column:
    """JSON with sorted keys; null fields are written, but for the optional ones, which are absent when null."""
    ordered = sorted(fields)
    kept = [F.when(fields[k].isNotNull() if k in optional else F.lit(True), F.concat(F.lit(f'"{k}":'), _value(fields[k]))) for k in ordered]
    return F.concat(F.lit("{"), F.concat_ws(",", *kept), F.lit("}"))


def _value(c: Column) -> Column:
    """A JSON value: what to_json writes for it inside a struct, without the struct."""
    inside = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(inside, F.lit(6), F.char_length(inside) - 6)


def content_hash(fields: dict[str, Column], optional: tuple[str, ...] = ()) -> Column:
    return F.sha2(canonical_json(fields, optional), 256)


def prompt_hash(text: Column) -> Column:
    """Identity of a prompt: SHA-256 of its text with \\n line ends and no white space around it."""
    return F.sha2(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", ""), 256)


def number_text(x: float) -> str:
    """A double as ECMAScript writes it: the shortest digits that read back, plain from 1e-6 up to 1e21."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if text == "0":
        return "0"
    if len(text) <= point <= 21:
        out = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if text[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def _plain_canonical(text: str) -> str | None:
    """canonical_text() of one text, by the rules themselves."""

    def written(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{written(k)}:{written(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(written, v)) + "]"
        if isinstance(v, str):
            return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(v, ensure_ascii=False))
        return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else number_text(v)

    def no(constant: str):
        raise ValueError(constant)

    try:
        return written(json.loads(text, parse_int=float, parse_float=float, parse_constant=no))
    except (ValueError, RecursionError):
        return None


#: What a variant keeps otherwise than a double or an ECMAScript string would be written.
_ODD_NUMBER = r"[0-9.][eE][+\-0-9]|[0-9.]{16}|-0|\.[0-9]*0(?![0-9])|0\.00000"
_ODD_STRING = r"\\u"


def canonical_text(text: Column) -> Column:
    """JSON of any nesting with the keys of every object sorted (by UTF-16 units) and no white space; null for what is no
    JSON. Numbers are doubles, as ECMAScript writes them; of repeated keys the last counts.

    A variant's objects are sorted, so its text is canonical as it stands, but for some numbers, control characters and
    repeated keys: texts that might hold those go through a helper in Python, and only those.
    """

    @F.pandas_udf("string")
    def helped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _plain_canonical(t)).astype(object)

    sorted_ = F.to_json(F.try_parse_json(text))
    odd = text.isNotNull() & (sorted_.isNull() | text.rlike(_ODD_NUMBER) | text.rlike(_ODD_STRING))
    return F.when(odd, helped(F.when(odd, text))).otherwise(sorted_)


def without_keys(text: Column, keys: list[str]) -> Column:
    """A JSON object's text without some of its keys."""
    fields = F.from_json(text, "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(keys)))
