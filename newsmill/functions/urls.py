"""Canonical URLs as a Column expression, by the URL standard's rules for absolute URLs; what doesn't parse gives null.

Hosts are lower-cased only: no IDNA, no percent-decoding, no shortening of addresses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TRACKING_PARAMETERS

_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\\s]+)((?:[/\\][^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"
#: Ports that go without saying, of the schemes whose paths may be written with backslashes (fixed values).
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
#: One character that a path holds percent-encoded.
_ENCODED = r'[\x00-\x20"#<>?`{}\x7F]|[^\x00-\x7F]'
_DOT, _DOTS = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def _path_encoded(path: Column) -> Column:
    one = lambda c: F.when(c.rlike(_ENCODED), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    letters = F.regexp_extract_all(path, F.lit(r"(?s)(.)"), 1)
    return F.when(path.rlike(_ENCODED), F.array_join(F.transform(letters, one), "")).otherwise(path)


def _without_dots(path: Column) -> Column:
    """A path whose dot segments are gone: a fold that keeps the segments so far; `..` takes the last one off."""
    parts = F.split(F.substring(path, F.lit(2), F.char_length(path)), "/", -1)
    none = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s.rlike(_DOTS), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s.rlike(_DOT), kept).otherwise(F.concat(kept, F.array(s)))
    last = F.element_at(parts, -1)
    folded = F.concat(F.aggregate(parts, none, step), F.when(last.rlike(_DOT) | last.rlike(_DOTS), F.array(F.lit(""))).otherwise(none))
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(path)


def _parameters(query: Column) -> Column:
    """(name, value) of a form-encoded query; percent signs that begin no code stand for themselves."""
    decoded = lambda c: F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    at = lambda p: F.locate("=", p)
    name = lambda p: F.when(at(p) == 0, p).otherwise(F.substring(p, F.lit(1), at(p) - 1))
    value = lambda p: F.when(at(p) == 0, "").otherwise(F.substring(p, at(p) + 1, F.char_length(p)))
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decoded(name(p)).alias("name"), decoded(value(p)).alias("value")))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, dot segment or tracking parameter; the path percent-encoded,
    the parameters form-encoded; slashes at the end of a path go unless a query follows. Hosts with and without www, and
    http and https, stay apart."""
    trimmed = F.regexp_replace(F.regexp_replace(url, r"^[\s\x{A0}\x{FEFF}\p{Z}\x00-\x1F]+|[\s\x{A0}\x{FEFF}\p{Z}\x00-\x1F]+$", ""), r"[\t\n\r]", "")
    return _let(trimmed, lambda t: F.when(t.rlike(_SHAPE), _let(_parts(t), _rebuilt)))


def _let(value: Column, body) -> Column:
    """body(value), in which value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _parts(t: Column) -> Column:
    at = lambda k: F.regexp_extract(t, _SHAPE, k)
    return F.struct(F.lower(at(1)).alias("scheme"), at(2).alias("place"), F.regexp_extract(at(2), r"^(.*@)?", 0).alias("who"), at(3).alias("path"), at(4).alias("query"))


def _rebuilt(p: Column) -> Column:
    scheme, who = p["scheme"], p["who"]
    host = F.lower(F.substring(p["place"], F.char_length(who) + 1, F.char_length(p["place"])))
    for name, port in _PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, f":(0*{port})?$", "")).otherwise(host)
    path = F.when(scheme.isin(*_PORTS), F.translate(p["path"], "\\", "/")).otherwise(p["path"])
    path = _let(_let(F.when(path == "", "/").otherwise(path), _path_encoded), _without_dots)
    kept = F.filter(_parameters(p["query"]), lambda q: ~F.lower(q["name"]).isin(TRACKING_PARAMETERS))
    query = F.array_join(F.transform(kept, lambda q: F.concat(F.url_encode(q["name"]), F.lit("="), F.url_encode(q["value"]))), "&")
    short = lambda e: F.when((e["query"] == "") & (F.char_length(e["path"]) > 1), F.regexp_replace(e["path"], "/+$", "")).otherwise(e["path"])
    end = lambda e: F.concat(F.when(short(e) == "", "/").otherwise(short(e)), F.when(e["query"] == "", "").otherwise(F.concat(F.lit("?"), e["query"])))
    return F.concat(scheme, F.lit("://"), who, host, _let(F.struct(path.alias("path"), query.alias("query")), end))
