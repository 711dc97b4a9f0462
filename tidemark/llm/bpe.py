"""BPE encoding and decoding with a pair occurrence index.

A tokenizer file (``tokenizers`` JSON, BPE with an end-of-word suffix) fixes the vocabulary, the merge
ranks, the special tokens and the normal form. Each partition works on chunks of some MB: texts are
brought to normal form and cut at white space, distinct words are split into pieces, and distinct
pieces are merged all together. The index maps each adjacent pair of symbols, by its rank, to all
positions in the chunk where it occurs. Active ranks are applied in ascending order, each to all its
positions at once; the pairs that arise on either side of a merged symbol are added to their lists and
entries that a merge has used up are skipped when their list is read. Where a merge can give rise to
a pair of lower rank, only the first position of a piece is merged before that rank has its turn, so
each piece sees its merges in the same order as if it were alone.

Texts are then put together from their words' ids by gathers. Nothing is shuffled, every row is
handled where it is read, and memory is bounded by the chunk (a longer text is a chunk by itself).
Words already merged are kept between chunks up to ``cache_words``.

Null texts are empty: no ids, and the empty text decoded. Repeated rows keep a row each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space beyond ASCII, which a text in normal form has as a plain space.
_WIDE_SPACE = regex.compile("[\x85\xa0  -     　]")
#: Code points on which Python's Unicode tables and the tokenizers library's agree (checked one by one); texts with others are normalised and split by the library's own parts.
_AGREED = regex.compile("[\x00-՗֍-ࢎ࢐-౛ೝ-ᲈᲊ-₎₠-ꟊ가-힣豈-￿]*")


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: itself where it is printable
    Latin-1, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Tokenizer:
    """The parts of a tokenizer file, and the merging of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path = path
        self.tokens = np.empty(max([*vocab.values(), *self.special.values()]) + 1, object)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.final = np.array([vocab[s + self.suffix] for s in symbols])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges]) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges])
        self.made, self.same = made, left == right
        self.width = len(self.tokens)
        keys = left * self.width + right
        # of a pair that the file lists twice the last rank counts
        order = np.lexsort((-np.arange(len(keys)), keys))
        keep = np.ones(len(order), bool)
        keep[1:] = np.diff(keys[order]) != 0
        self.keys, self.ranks = keys[order][keep], order[keep]
        self.left, self.right = left, right
        first = np.full(self.width, len(merges))
        np.minimum.at(first, left, np.arange(len(merges)))
        np.minimum.at(first, right, np.arange(len(merges)))
        self.regress = first[made] < np.arange(len(merges))  # what it makes takes part in an earlier rank

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that never merge."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of ids of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(data), np.cumsum(size)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), size)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - size] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[cuts].tolist(), np.split(at, cuts[1:])):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        starts = np.flatnonzero(after >= 0)
        add(starts, self.rank_of(symbol[starts], symbol[after[starts]]))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists))
            left, right, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == left) & (after[at] >= 0)]
            at = at[symbol[after[at]] == right]
            if self.same[rank] and len(at) > 1:  # a run of equal symbols merges from its left end in twos
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            if self.regress[rank] and len(at) > 1:
                later = np.concatenate([[False], owner[at[1:]] == owner[at[:-1]]])
                if later.any():
                    index[rank] = [at[later]]
                    heapq.heappush(heap, rank)
                    at = at[~later]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = new, -1
            after[at] = after[gone]
            has = after[at] >= 0
            before[after[at][has]] = at[has]
            to_right, to_left = at[has], before[at]
            to_left = to_left[to_left >= 0]
            pairs = np.concatenate([to_left, to_right])
            add(pairs, self.rank_of(symbol[pairs], symbol[after[pairs]]))
        alive = symbol >= 0
        return symbol[alive], np.bincount(owner[alive], minlength=len(pieces))

    def normal(self, text: str) -> str:
        """Normal form with special tokens as words of their own; they are the only words in upper case."""
        if "<" not in text or not self.special_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.special_pattern.finditer(text):
            out += [self._plain(text[at : found.start()]), found[0].upper()]
            at = found.end()
        return " ".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not _AGREED.fullmatch(text):
            return self._library.normalizer.normalize_str(text)
        text = _WIDE_SPACE.sub(" ", normalize("NFC", text))
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    @property
    def _library(self):
        return _library(self.path)

    def pieces(self, word: str) -> list[bytes]:
        if word.isascii():
            return [word.encode()] if word.isalpha() else [x.encode() for x in self.pattern.findall(word)]
        if not _AGREED.fullmatch(word):
            symbols = {s: b for b, s in enumerate(byte_symbols())}
            return [bytes(symbols[c] for c in x) for x, _ in self._library.pre_tokenizer.pre_tokenize_str(word)]
        return [x.encode() for x in self.pattern.findall(word)]


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Encoder:
    """Encodes chunks of texts; keeps what it learned about words between them, up to ``cache_words``."""

    def __init__(self, path: str, cache_words: int):
        self.model, self.cache_words = tokenizer(path), cache_words
        self.upper = {t.upper(): i for t, i in self.model.special.items()}
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        split = [self.model.pieces(w) for w in words]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for ps in split for p in ps))}
        if not distinct:
            return
        ids, n = self.model.merge(list(distinct))
        data, ends = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
        of = [data[a:b] for a, b in zip([0, *ends], ends)]
        for w, ps in zip(words, split):
            self.cache[w] = of[distinct[ps[0]]] if len(ps) == 1 else b"".join([of[distinct[p]] for p in ps])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        plain = pa.array([self.model.normal(t) if t else "" for t in texts.to_pylist()], pa.large_string())
        counts, words = common.words_of(plain, lower=False)
        coded = words.dictionary_encode()
        vocab = coded.dictionary.to_pylist()
        special = {i: self.upper[w] for i, w in enumerate(vocab) if w in self.upper} if self.upper else {}
        cache = self.cache
        missing = [w for i, w in enumerate(vocab) if w not in cache and i not in special]
        if len(cache) + len(missing) > self.cache_words:  # a chunk's own words always stay for the chunk
            cache.clear()
            missing = [w for i, w in enumerate(vocab) if i not in special]
        if missing:
            self._learn(missing)
        parts = [special[i].to_bytes(4, "little") if i in special else cache[w] for i, w in enumerate(vocab)]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        width = size[codes]
        ends = np.cumsum(width)
        begin = (np.cumsum(size) - size)[codes]
        flat = ids[np.repeat(begin - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        return flat, np.diff(upto, prepend=0)

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> pa.Array:
        """Texts of ids: the tokens one space apart, as this kind of file has no decoder of its own."""
        tokens = pa.array(self.model.tokens, pa.string()).take(pa.array(ids.astype(np.int64)))
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")


def _digest(path: str, cache_words: int, chunk_bytes: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, cache_words)
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                ids, lens = encoder.encode(part.column("text"))
                decoded = encoder.decode(ids, lens)
                keep = [part.column(i) for i, name in enumerate(part.schema.names) if name != "text"]
                names = [name for name in part.schema.names if name != "text"]
                if texts:
                    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                    made = [pa.array(lens), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), decoded]
                    out = pa.record_batch([*keep, *made], names=[*names, "n_tokens", "ids", "decoded"])
                    del ids, lens, decoded, made
                    common.give_back()  # the batch is as long as the texts: it goes out before the next is made
                    yield out
                else:
                    data, ends = memoryview(ids.tobytes()), np.cumsum(lens) * 4
                    own = [sha256(data[a:b]).hexdigest() for a, b in zip((ends - lens * 4).tolist(), ends.tolist())]
                    back = [sha256(x.as_buffer()).hexdigest() for x in decoded]
                    yield pa.record_batch([*keep, pa.array(lens), pa.array(own, pa.string()), pa.array(back, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cache_words: int = 300_000, chunk_bytes: int = 2 << 20) -> DataFrame:
    """(id, columns to keep, n_tokens, ids array<int>, decoded string) of every text."""
    rows, kind = _rows(docs, id_col, text_col, keep)
    return rows.mapInArrow(common.lean(_digest(path, cache_words, chunk_bytes, True)), f"{kind}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 300_000, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: :func:`encode` with digests in place of its arrays."""
    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(common.lean(_digest(path, cache_words, chunk_bytes, False)), f"{kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
