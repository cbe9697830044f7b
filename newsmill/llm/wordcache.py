"""Tokenizer ids of whole texts by way of their words.

Both tokenizer files split a text before merging, and never join what white space parts. So a text's ids are its
words' ids in a row, and each task encodes a word once. The texts where that isn't certain are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: ASCII white space, that all the splitting rules agree on.
_SPACE = " \t\n\r\x0b\x0c"
#: A word with the white space before it; white space at the end is a chunk too.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Other characters that one of Python, Unicode and the tokenizers counts as white space.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: What isn't ASCII, a letter that Python and the tokenizers lower-case alike, one to one, and no normal form changes, or
#: common punctuation; and the beginning of special strings.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿЀ-џ–—‘’“”«»…€£§°¿¡]|<\\|")
#: The splitting rule of word_bpe for words without those, in lower case: each part is merged by itself.
_LETTER = "a-zß-öø-ÿа-џ"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
#: Punctuation that is a part of its own at a word's end.
_ENDS = frozenset(".,!?;:")
#: Words that a worker remembers; more are encoded again when met again.
CACHE_WORDS, BYTE_CACHE = 500_000, 200_000
#: Words whose encodings, a hundred times larger than their ids, are there at once; and parts that are encoded as one text.
ENCODE_AT_ONCE, PARTS_AT_ONCE = 10_000, 2_000


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer in a file, as it is: without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def plain(text: str) -> bool:
    """Nothing of _OTHER is in a text."""
    if text.isascii():
        return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return not _OTHER.search(text)


def coded(texts):
    """The words of an Arrow array of texts as numbers in a row, where each text's begin (and the last ends), and the different words."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes, begins, words = flat.indices.to_numpy(), lists.offsets.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in words:  # white space at an end of a text
        empty = words.index("")
        real = codes != empty
        codes, begins = codes[real], np.concatenate([[0], np.cumsum(real)])[begins]
        codes = codes - (codes > empty)
        del words[empty]
    return codes, begins, words


def gathered(codes, begins, ids: list[bytes], kind):
    """The ids of coded() texts in a row, and where each text's begin, from those of the different words."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
    n = sizes[codes]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(ids), kind)[at], np.concatenate([[0], ends])[begins]


class Recent:
    """At most so many words and what is known of them. When one half is full, the half not used for longer goes."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def of(self, words: list, find) -> list:
        """What is known of each of the words (all different); find tells it for a list of those that aren't remembered."""
        if not (self.new or self.old):
            found = find(words)
            if len(words) <= self.half:
                self.new.update(zip(words, found, strict=True))
            return found
        out = dict(zip(words, map(self.new.get, words), strict=True))
        lost = [w for w, x in out.items() if x is None]
        if self.old:
            out.update(zip(lost, map(self.old.get, lost), strict=True))
        unknown = [w for w in lost if out[w] is None]
        out.update(zip(unknown, find(unknown), strict=True))
        if len(self.new) + len(lost) > self.half:
            self.old, self.new = self.new, {}
        if len(lost) <= self.half:
            self.new.update(zip(lost, map(out.__getitem__, lost), strict=True))
        return list(out.values())


class WordIds:
    """Little-endian unsigned 32-bit ids of texts for a tokenizer that drops white space (word_bpe)."""

    cache = CACHE_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load(path)
        # the same model for parts that need no normalizing and no splitting but at spaces
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Recent(self.cache)

    def _encode(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), ENCODE_AT_ONCE):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words[k : k + ENCODE_AT_ONCE], add_special_tokens=False)]
        return out

    def _merge(self, parts: list[str]) -> list[bytes]:
        """Ids of parts: many as one text, cut where a token ends a part."""
        out = []
        for k in range(0, len(parts), PARTS_AT_ONCE):
            some = parts[k : k + PARTS_AT_ONCE]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(some):
                out += self._encode(some)
                continue
            held = ids.tobytes()
            out += [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: those of their parts in a row, or of the whole where the parts aren't certain."""
        one, two, many, whole = {}, {}, {}, []
        for w in words:
            low = w.lower()
            if low.isalpha() and (low.isascii() or not _OTHER.search(w)):
                one[w] = low
            elif _OTHER.search(w):
                whole.append(w)
            elif low[-1:] in _ENDS and low[:-1].isalpha():
                two[w] = low
            else:
                many[w] = _PARTS.findall(low)
        parts = set(one.values()) | _ENDS
        parts.update(low[:-1] for low in two.values())
        parts = list(parts.union(*many.values()))
        ids = dict(zip(parts, self._merge(parts), strict=True))
        out = {w: ids[low] for w, low in one.items()}
        out.update((w, ids[low[:-1]] + ids[low[-1]]) for w, low in two.items())
        out.update((w, b"".join(map(ids.__getitem__, p))) for w, p in many.items())
        out.update(zip(whole, self._encode(whole), strict=True))
        return list(map(out.__getitem__, words))

    def whole(self, text: str) -> bytes:
        return self._encode([text])[0]

    def texts(self, texts: list[str]):
        """Yields the ids of each text as bytes."""
        import pyarrow as pa

        # lower case first leaves fewer words; only where that is certain
        lower = [t.lower() if plain(t) else None if _ODD.search(t) else t for t in texts]
        codes, begins, words = coded(pa.array([t for t in lower if t is not None], pa.string()))
        ids, begins = gathered(codes, begins, self.known.of(words, self._words), np.dtype("<u4"))
        begins = zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)
        for text, low in zip(texts, lower, strict=True):
            if low is None:
                yield self.whole(text)
            else:
                a, b = next(begins)
                yield ids[a:b].tobytes()


class ChunkCounts:
    """Numbers of tokens of texts for a byte-level tokenizer (byte_bpe): a chunk is a word and the space before it."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, int] = {}

    def _encode(self, chunks: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def texts(self, texts: list[str]):
        """Yields the number of tokens of each text."""
        split = [None if _ODD.search(t) else _CHUNK.findall(t) for t in texts]
        known = self.known
        new = list({c for chunks in split if chunks for c in chunks if c not in known})
        if len(known) + len(new) > CACHE_WORDS:
            known = dict(known)
        known.update(zip(new, self._encode(new), strict=True))
        if len(known) <= CACHE_WORDS:
            self.known = known
        for text, chunks in zip(texts, split, strict=True):
            yield self._encode([text])[0] if chunks is None else sum(map(known.__getitem__, chunks))


def slices(texts: list[str], chars: int = 2_000_000):
    """Pieces of a batch of about so many characters, and no text cut: bounds what the words of a batch take."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


class ByteIds:
    """Little-endian unsigned 16-bit ids of words, each after one space, for a byte-level tokenizer (byte_bpe ranks)."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = np.zeros(max(ranks.values()) + 1, bool)
        self.first[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.known = Recent(BYTE_CACHE)

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of each of some words: many as one text, cut where a token begins with the space before a word."""
        out = []
        for k in range(0, len(words), ENCODE_AT_ONCE):
            some = words[k : k + ENCODE_AT_ONCE]
            ids = self.tokenizer.encode_to_numpy(" " + " ".join(some), disallowed_special=()).astype("<u2")
            begins = (2 * np.flatnonzero(self.first[ids])).tolist()
            if len(begins) != len(some):
                out += [self.words([w.encode()]) for w in some]
                continue
            held = ids.tobytes()
            out += [held[a:b] for a, b in zip(begins, [*begins[1:], len(held)], strict=True)]
        return out

    def words(self, words: list[bytes]) -> bytes:
        if not words:
            return b""
        text = " " + b" ".join(words).decode("utf-8", "replace")
        return self.tokenizer.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


_OPEN: dict[tuple, object] = {}


def of_worker(kind, path: str):
    """The worker's own instance, kept between tasks; another kind or file takes its place, so that one memory is held."""
    if (kind, path) not in _OPEN:
        _OPEN.clear()
        _OPEN[kind, path] = kind(path)
    return _OPEN[kind, path]
