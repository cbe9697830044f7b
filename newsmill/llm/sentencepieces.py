"""Operator 12: SentencePiece encoding and decoding for merge-type vocabularies.

Every space becomes a mark, and one more stands before the text. Adjacent symbols (characters at first) whose
concatenation is a piece wait in an agenda; the pair with the best score, then the leftmost, is merged, and its new
neighbours join the agenda. A pair that has lost a symbol meanwhile is dropped when its turn comes. A symbol that is no
piece becomes the ids of its UTF-8 bytes.

Merges can't cross certain places, which the vocabulary tells: before a mark that follows another character (no piece
holds one inside), and between characters that no piece joins, directly or by way of others (letters and punctuation,
scripts). A text is cut there, and a worker merges each different chunk once. What the merges give is compared with the sentencepiece library's ids, all new chunks
of an Arrow batch at once; a difference is an error.

Decoding joins the pieces, reads marks as spaces, drops the first one and decodes runs of byte ids as UTF-8 (each byte
that is no part of a character becomes U+FFFD).

Defined cases: null text is empty and has no ids; texts of any length are encoded whole; strings such as "</s>" inside
texts are ordinary characters; repeated rows stay; null keys stay; an empty table gives an empty result; extra columns
stay, and those named like an added one are replaced. Vocabularies of another type are an error.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .wordcache import of_worker, slices, vocabulary

TOKENIZER = "piece_bpe_32k.model"
MARK = "▁"
#: Chunks that a worker remembers; more are merged again when met again. Longer ones aren't remembered.
CACHE_CHUNKS, CHUNK_CHARS = 600_000, 64


def _joined(pieces: list[str]) -> list[str]:
    """Groups of characters, the largest first: those of one piece are in one group, but for marks."""
    top: dict[str, str] = {}

    def of(c: str) -> str:
        while top.setdefault(c, c) != c:
            top[c] = c = top[top[c]]
        return c

    for p in pieces:
        own = p.lstrip(MARK)
        for c in own:
            top[of(c)] = of(own[0])
    groups: dict[str, list[str]] = {}
    for c in sorted(top):
        groups.setdefault(of(c), []).append(c)
    return sorted(map("".join, groups.values()), key=len, reverse=True)


class Pieces:
    """Ids of texts and texts of ids by a merge-type vocabulary with byte pieces."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind, norm = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec
        types = {p.type for p in proto.pieces}
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback or not plain or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type vocabulary with byte pieces and plain normalisation")
        if types - {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}:
            raise ValueError("a vocabulary with user-defined or unused pieces")
        ranks = {score: k for k, score in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.rank = {p.piece: ranks[p.score] for p in proto.pieces if p.type == kind.NORMAL}
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.bytes = np.zeros(256, np.int32)
        #: What an id reads as: UTF-8, control ids as nothing.
        self.surface = [b""] * len(proto.pieces)
        for k, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:-1], 16)
                self.bytes[value] = k
                self.surface[k] = bytes([value])
            elif p.type == kind.NORMAL:
                self.surface[k] = p.piece.replace(MARK, " ").encode()
            elif p.type == kind.UNKNOWN:
                self.surface[k] = proto.trainer_spec.unk_surface.encode()
        #: Ids that aren't text, and those whose first mark is dropped at the beginning.
        self.control = frozenset(k for k, p in enumerate(proto.pieces) if p.type == kind.CONTROL)
        self.special = self.control | {k for k, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN}
        self.marked = frozenset(k for p, k in self.id.items() if p[0] == MARK)
        several = [p for p in self.id if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in several):
            raise ValueError("a piece holds a mark after another character")
        groups = "|".join(f"{MARK}*[{re.escape(g)}]+" for g in _joined(several))
        alone = re.escape("".join(sorted(set("".join(several)) | {MARK})))
        self.chunk = re.compile(f"{groups}|{MARK}+|[^{alone}]+")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if check else None
        self.known: dict[str, bytes] = {}

    def merge(self, chunk: str) -> list[str]:
        """The symbols that are left when the agenda is empty. An entry is rank * length + left end; one whose symbols
        no longer make a piece of its rank is dropped."""
        rank, end = self.rank, len(chunk)
        symbols: list[str] = list(chunk)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        agenda = [rank[pair] * end + k for k, pair in enumerate(map(add, chunk, chunk[1:])) if pair in rank]
        heapify(agenda)
        while agenda:
            score, left = divmod(heappop(agenda), end)
            right = after[left]
            if right >= end or not symbols[left] or rank.get(own := symbols[left] + symbols[right]) != score:
                continue
            symbols[left], symbols[right] = own, ""
            after[left] = follow = after[right]
            if follow < end:
                before[follow] = left
                if (pair := own + symbols[follow]) in rank:
                    heappush(agenda, rank[pair] * end + left)
            if (first := before[left]) >= 0 and (pair := symbols[first] + own) in rank:
                heappush(agenda, rank[pair] * end + first)
        return [s for s in symbols if s]

    def ids_of(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a chunk."""
        out: list[int] = []
        for s in self.merge(chunk):
            k = self.id.get(s)
            if k is None:
                out.extend(self.bytes[np.frombuffer(s.encode(), np.uint8)].tolist())
            else:
                out.append(k)
        return np.array(out, "<i4").tobytes()

    def _checked(self, chunks: list[str], ids: list[bytes]) -> None:
        """The library's ids of the chunks must be the same. One that doesn't begin with a mark follows a line end."""
        texts = [c[1:].replace(MARK, " ") if c[0] == MARK else "\n" + c for c in chunks]
        lead = np.array([self.id[MARK], self.bytes[10]], "<i4").tobytes()
        for c, mine, text, theirs in zip(chunks, ids, texts, self.library.encode(texts, num_threads=1), strict=True):
            want = np.array(theirs, "<i4").tobytes()
            if (mine if c[0] == MARK and text else lead + mine if c[0] != MARK else want) != want:
                raise ValueError(f"{c!r}: the library's ids differ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = list({c for chunks in split for c in chunks if c not in known})
        ids = list(map(self.ids_of, new))
        if self.library:
            self._checked(new, ids)
        if len(known) + len(new) > CACHE_CHUNKS:
            known = dict(known)
        known.update(zip(new, ids, strict=True))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        if len(known) <= CACHE_CHUNKS:
            for c in new:
                if len(c) > CHUNK_CHARS:
                    del known[c]
            self.known = known
        return out

    def decode(self, ids: list[int]) -> str:
        """What ids read as; control ids read as nothing and end a run of bytes."""
        surface, runs, begin = self.surface, [], 0
        if not self.special.isdisjoint(ids):
            for k, i in enumerate(ids):
                if i in self.special:
                    runs += [ids[begin:k], [i]]
                    begin = k + 1
        runs.append(ids[begin:])
        out = "".join(_utf8(b"".join(map(surface.__getitem__, run))) for run in runs if run)
        return out[1:] if next((i for i in ids if i not in self.control), None) in self.marked else out


def _utf8(data: bytes) -> str:
    """UTF-8 in which each byte that is no part of a character is U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """docs with ids array<int> of a text column and decoded, what the ids read as. A projection: nothing is shuffled."""
    path = path or vocabulary(TOKENIZER)
    keep = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        coder = of_worker(Pieces, path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in slices(texts):
                ids = [np.frombuffer(x, "<i4") for x in coder.encode(texts[a:b])]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
                decoded = pa.array([coder.decode(x.tolist()) for x in ids], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, decoded], names=[*part.schema.names[:-1], "ids", "decoded"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`")).mapInArrow(run, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by piece_bpe_32k, and back."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
