"""Operator 8: secret scans by patterns and two character Markov models.

Three kinds have patterns of their own (assignments, access keys, hex runs). Beyond these, every run of token
characters is judged by two first-order Markov models over characters: one of random strings, one of ordinary
identifiers. The log-likelihood ratio of the two, per character, decides.

The models are fitted on the driver from a labelled sample of documented bounds: about SAMPLE_TEXTS different texts of
at most SAMPLE_CHARS characters give ordinary words, from which identifiers, paths and numbers are made; random strings
are drawn from the alphabets that keys and digests use. A word is taken for ordinary only if no pattern's span and no
run with letters and digits touches it, so the secrets of the corpus are never learned as ordinary. One labelled string
in HOLD_OUT is kept out of the fit; the lead that a run needs is the largest that any ordinary one of these has, and
LEAD at least. Scanner.recall and false_positives say what it does on them. Scanning covers every text whole, inside
the tasks that read the table.

Defined cases: null text counts as empty; an empty table trains on the random strings and on built-in words alone;
repeated rows stay; spans are in code points, end exclusive; scan() returns doc_id (of any type, null or not) and its own
columns, redact() keeps all others. A run of several parts joined by other characters (a token with dots) is judged part
by part.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled_texts, table

#: Kinds in the order that ties of a start take.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

#: Runs that the models judge.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: What can't be taken for an ordinary word without a look: letters and digits in one run.
_MIXED = re.compile(r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]+")
#: Nats per character by which the random model must lead, at least.
LEAD = 0.5
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_EACH, HOLD_OUT, SEED = 500, 20_000, 6_000, 4, 7
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_AT = np.zeros(128, np.int64)
_AT[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_SOME_WORDS = "account article author client config content count data default document event example file group handler header image index item language list load message model name number object option page parser path project query record request response result schema server service session source state stream string table test text time title token type update user value version view window"


def places(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a string of the alphabet reads a chain's table: the state before each character, and the character."""
    at = _AT[np.frombuffer(s.encode("ascii"), np.uint8)]
    before = np.zeros(len(at), np.int64)
    before[1:] = at[:-1] + 1
    return before, at


@dataclass
class Markov:
    """First-order chain over _ALPHABET; logp[0] is the start, logp[1 + a] what follows a."""

    logp: np.ndarray

    @classmethod
    def fit(cls, strings: list[str]) -> Markov:
        n = np.full((len(_ALPHABET) + 1, len(_ALPHABET)), 0.5)
        for s in strings:
            np.add.at(n, places(s), 1)
        return cls(np.log(n / n.sum(1, keepdims=True)))

    def score(self, s: str) -> float:
        """Log-likelihood of a string of the alphabet, in nats."""
        return float(self.logp[places(s)].sum())


def ordinary_words(text: str) -> list[str]:
    """Words of letters that no base span and no run of letters and digits touches."""
    taken = [(a, b) for a, _, b in base_spans(text)] + [m.span() for m in _MIXED.finditer(text)]
    free, at = [], 0
    for a, b in sorted(taken):
        free.append(text[at:a])
        at = max(at, b)
    return [w for part in [*free, text[at:]] for w in re.findall(r"[A-Za-z]{2,}", part)]


def labelled_sample(texts: list[str]) -> list[tuple[str, bool]]:
    """(string, is it random): ordinary identifiers, paths and numbers from the texts' words, and as many random strings."""
    rng = np.random.default_rng(SEED)
    words = sorted({w for t in texts for w in ordinary_words(t)} | set(_SOME_WORDS.split()))
    out = []
    for k in range(SAMPLE_EACH):
        some = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 6))]
        number = str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
        low = "_".join(some).lower()
        forms = [low, "-".join(some), "/".join(some), "".join(w.capitalize() for w in some), "_".join(some).upper(), "".join(some), f"/{rng.integers(1990, 2030)}/{number}/" + "-".join(some), f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-" + low, str(rng.integers(10**11, 10**15)), "-=_+/"[k % 5] * int(rng.integers(12, 60))]
        form = forms[k % len(forms)]
        out.append((form + (number if k % 3 == 0 and k % len(forms) < 6 else ""), False))
    alphabets = [_ALPHABET[:62], _ALPHABET[:62] + "+/", "0123456789abcdef", _ALPHABET[:26] + "234567", _ALPHABET[26:62], _ALPHABET[:62] + "_-"]
    for k in range(SAMPLE_EACH):
        a = alphabets[k % len(alphabets)]
        out.append(("".join(a[i] for i in rng.integers(0, len(a), rng.integers(12, 64))), True))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of what the patterns find."""
    out = []
    low = text.lower() if any(c in text for c in ":=") else ""
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


@dataclass
class Scanner:
    """ratio: log-likelihood of the random model over the ordinary one. recall, false_positives: on held-out strings."""

    ratio: np.ndarray
    lead: float = LEAD
    recall: float = 0.0
    false_positives: float = 0.0

    @classmethod
    def train(cls, sample: list[tuple[str, bool]]) -> Scanner:
        fit = [x for k, x in enumerate(sample) if k % HOLD_OUT]
        random, ordinary = (Markov.fit([s for s, label in fit if label is is_random]) for is_random in (True, False))
        out = cls(random.logp - ordinary.logp)
        held = {label: np.array([out.leads(s) for s, is_random in sample[::HOLD_OUT] if is_random is label]) for label in (True, False)}
        out.lead = max(LEAD, held[False].max(initial=LEAD))
        out.recall, out.false_positives = (float((held[label] > out.lead).mean()) for label in (True, False))
        return out

    def leads(self, s: str) -> float:
        """Nats per character by which the random model leads."""
        return float(self.ratio[places(s)].mean())

    def is_random(self, s: str) -> bool:
        return self.leads(s) > self.lead

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) in order."""
        out = base_spans(text)
        taken = list(out)
        for m in _RUN.finditer(text):
            if not any(a < m.end() and m.start() < b for a, _, b in taken) and self.is_random(m[0]):
                out.append((m.start(), 3, m.end()))
        return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def trained(docs: DataFrame) -> Scanner:
    """The scanner for a table, from a sample of its different texts."""
    return Scanner.train(labelled_sample(sampled_texts(docs, SAMPLE_TEXTS, SAMPLE_CHARS)))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every text."""
    scanner = scanner or trained(docs)

    def find(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scanner.spans(text) if text else []
                base = [s for s in spans if s[1] != "random"]
                n = [sum(s[1] == k for s in spans) for k in KINDS]
                rows.append((*n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]))
            columns = zip(*rows, strict=True) if rows else [()] * len(added)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, added.values())], names=["doc_id", *added])

    added = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_random": pa.int64()}
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each secret replaced by the name of its kind; overlapping spans become one."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs with their secrets redacted and n_chars of the new text; all other columns as they are."""
    scanner = scanner or trained(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, scanner.spans(t)) if t else t)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))
