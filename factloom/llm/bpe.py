"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary is a certain cut: no merge can
ever span it. So each word is cut there, every fragment is encoded by itself (once, however often it occurs), and the
fragments' ids are concatenated. The last byte of a word carries the file's word-end mark and has a table of its own.

Normalising and splitting into words are the tokenizers library's own parts; cutting and merging are done here.

Defined results: a null or empty text has no ids and decodes to an empty text; special tokens written out in a text
are their ids, as in the library; truncation and padding of the file are not used; rows with one doc_id and null
doc_ids are kept as they are; an empty table gives no rows; other columns are ignored. Only byte-level BPE
files without dropout, prefixes and byte fallback are taken, others raise ValueError.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, doc_text, small_batches, text_chunks
from .tokens import CACHED_CHARS, Encoder

#: Pieces and fragments that an encoder remembers at most.
CACHED_PIECES, CACHED_FRAGMENTS = 3 << 17, 1 << 17


def byte_alphabet() -> np.ndarray:
    """The byte that each character of a byte-level vocabulary stands for, -1 for others.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = np.full(256 + len(hidden), -1, np.int16)
    out[shown] = shown
    out[256:] = hidden
    return out


class BoundaryEncoder(Encoder):
    """Encodes with the vocabulary and merges of a byte-level BPE file, fragment by fragment."""

    cached = CACHED_PIECES

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        strange = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or strange or "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")):
            raise ValueError(f"not a plain byte-level BPE file: {path} {strange}")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t.get("single_word") or t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []):
            raise ValueError("special tokens with rules of their own are not supported")
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.at_special = re.compile("(" + "|".join(re.escape(k) for k in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.token = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for k, v in [*self.vocab.items(), *special.items()]:
            self.token[v] = k
        self.alphabet = byte_alphabet()
        self._tables(model["merges"])
        self.fragments: dict[str, bytes] = {}

    def _tables(self, merges: list) -> None:
        """Ranks of pairs of ids, and which pairs of bytes some token holds (inside a word; at its end)."""
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a], self.vocab[b]] = (k, self.vocab[a + b])
        self.inner, self.last = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in self.vocab:
            ended = bool(self.end) and token.endswith(self.end)
            own = self._bytes(token[: -len(self.end)] if ended else token)
            pairs = (own[:-1], own[1:])
            if ended:
                self.inner[pairs[0][:-1], pairs[1][:-1]] = True
                self.last[pairs[0][-1:], pairs[1][-1:]] = True
            else:
                self.inner[pairs] = True
        if not self.end:
            self.last = self.inner

    def _bytes(self, word: str) -> np.ndarray:
        return self.alphabet[np.frombuffer(word.encode("utf-32-le"), "<u4")]

    def cuts(self, words: list[str]) -> tuple[str, np.ndarray]:
        """The words joined, and where fragments begin: at each word and at each certain cut."""
        joined = "".join(words)
        own = self._bytes(joined)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        begin = np.ones(len(own), bool)
        begin[1:] = ~self.inner[own[:-1], own[1:]]
        final = ends[ends >= 2] - 1
        begin[final] = ~self.last[own[final - 1], own[final]]
        begin[ends[:-1][ends[:-1] < len(own)]] = True
        return joined, np.flatnonzero(begin)

    def _merged(self, fragment: str) -> bytes:
        """Ids of one fragment (marked at its end if it ends a word): the pair of lowest rank first, leftmost of equals."""
        chars = [*fragment]
        if self.end and fragment.endswith(self.end):
            chars = [*fragment[: -len(self.end)]]
            chars[-1] += self.end
        ids = [self.vocab[c] for c in chars]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        waiting = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.rank.get((ids[left], ids[right]))):
                    heapq.heappush(waiting, (r[0], left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _words_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from those of its fragments."""
        if not words:
            return []
        joined, begins = self.cuts(words)
        ends = np.append(begins[1:], len(joined))
        word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        owner = np.searchsorted(word_ends, begins, "right")
        closing = ends == word_ends[owner]
        pieces = [joined[a:b] + self.end if c else joined[a:b] for a, b, c in zip(begins.tolist(), ends.tolist(), closing.tolist(), strict=True)]
        own = {p: self._merged(p) for p in set(pieces) - self.fragments.keys()}
        for p, ids in own.items():
            if len(self.fragments) < CACHED_FRAGMENTS and len(p) <= CACHED_CHARS:
                self.fragments[p] = ids
        found = [own[p] if p in own else self.fragments[p] for p in pieces]
        upto = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        return [found[a] if b - a == 1 else b"".join(found[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def _sections(self, text: str) -> list[str]:
        return [s for s in self.at_special.split(text) if s] if self.at_special else [text]

    def _normal(self, text: str) -> str:
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Of pieces between spaces; words of all pieces are found in one call of the library's splitter."""
        parts = [self._sections(p) for p in pieces]
        plain = [self._normal(s) for own in parts for s in own if s not in self.special]
        begins = np.cumsum([0, *[len(p) + 1 for p in plain]])
        words = self.whole.pre_tokenizer.pre_tokenize_str(" ".join(plain)) if plain else []
        owner = np.searchsorted(begins, np.fromiter((at for _, (at, _) in words), np.int64, len(words)), "right") - 1
        ids = self._words_ids([w for w, _ in words])
        upto = np.searchsorted(owner, np.arange(len(plain) + 1)).tolist()
        sections = iter([b"".join(ids[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)])
        return [b"".join(self.special[s] if s in self.special else next(sections) for s in own) for own in parts]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if self.spaced:
            return super().encode_many(texts)
        out = []
        for text in texts:
            own = []
            for s in self._sections(text):
                own += [self.special[s]] if s in self.special else self._words_ids([w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self._normal(s))])
            out.append(np.frombuffer(b"".join(own), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens with it; without a decoder in the file, its tokens joined by spaces."""
        if self.whole.decoder is not None:
            return self.whole.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids.tolist()))


_encoders: dict[str, BoundaryEncoder] = {}


def encoder(path: str) -> BoundaryEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = BoundaryEncoder(path)
    return _encoders[path]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            ids = encoder(path).encode_many([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), _lists(ids)], names=["doc_id", "ids"])

    return doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that the ids decode to; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "ids")
            texts = [encoder(path).decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in ids]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
