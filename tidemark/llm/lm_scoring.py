"""LM scoring by a weighted backoff automaton.

Model. Smoothed n-grams up to ``order`` (3) over the V words of the training texts and one unknown word.
The history of a word is what precedes it in its text, a start mark first.

* p(w) = (c(w) - d) / N for known words and d V / N for the unknown one, d = n1 / (n1 + 2 n2);
* p(w | h) = (1 - e) c(h w) / c(h) + e p(w | h'), where h' is h without its first word and e is the escape
  weight of h's length and count bucket (buckets double): the share of continuations in that bucket which
  were seen once, so the leave-one-out chance that the next continuation is new. A history that was never
  seen has escape weight 1.

Each sums to one over V + 1 outcomes. As an automaton: every history seen in training (up to ``order`` - 1
words, the start mark counts as one) is a state, the root is the empty one. State h has an arc for each
continuation seen in training, which weighs log10 p(w | h) and leads to the state of the longest suffix of
h w that is one, and a failure arc to the state of h', which weighs log10 e and reads nothing. The root
reads every word. A text is traversed once from left to right; the state is carried from token to token and
the weights met are summed. Long texts are cut into lanes that run side by side; a lane other than a text's
first starts ``order`` - 1 tokens early at the root, and has the very state of the traversal by then, as
states remember no more.

Execution. The model grows with the corpus and is never broadcast or collected. A task turns its texts into
blocks of some MB (words as codes of the block, a file in the shared folder, named by task and number, so
a task that runs again writes the same file) and sends what the block needs: the sorted keys of its distinct
n-grams with their counts in the block's training texts, cut by ranges of keys (shards). One group for each
shard adds the counts of all blocks up and answers block by block in the order of the request. A block's
answers are what its part of the automaton is built from: the states and arcs that its texts can reach. So
one entry for a distinct n-gram of a block is shuffled, once there and once, as a count, back: a frequent
word or a hot source cannot skew it. Memory is bounded by a block and a shard. Only some hundred sums reach
the driver: those of words are made by the shards, those of escape weights by the blocks (an n-gram seen once
in training is seen by one block).

N-grams are told apart by hashes of 64 bits for words, and for longer ones of 18 bits more than it takes to
number the tokens, so that at any size a few in a million share their key with another.

Null or empty texts are one end token. Without training texts N = V = 0, the unknown word has probability 1.
Repeated rows count each time. Other columns are ignored. An empty table has no rows to return.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Stands for the end of a text among the words; no word holds a space.
END = " "
#: Hash of the history that precedes a text.
START = 0x9E3779B97F4A7C15
#: Count buckets of a history length.
BUCKETS = 64
_EXCHANGE = "block string, shard long, payload binary"
_MODEL = "block string, payload binary, stats array<long>"


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), BUCKETS - 1)


class Grams:
    """The n-grams of a block's tokens, level by level (level k: k words), as indices into sorted keys.

    codes: the word of each token, END is the code ``end``. lens: tokens of each text. word_keys: sorted
    hashes of the block's words, by code. bits: of the keys from level 2 on.
    """

    def __init__(self, codes: np.ndarray, lens: np.ndarray, word_keys: np.ndarray, order: int, bits: int):
        self.codes, self.lens, self.end = codes, lens, int(np.searchsorted(word_keys, _END_KEY))
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
        shift = np.uint64(64 - bits)
        #: By level from 1: keys, for each token its index (-1: the text is not that long yet), for each
        #: distinct n-gram its history (index below; -1 is the start mark), suffix (index below) and word.
        self.keys, self.of = [word_keys], [codes]
        self.history, self.suffix, self.word = [None], [None], [np.arange(len(word_keys))]
        for level in range(2, order + 1):
            at = np.flatnonzero(place >= level - 2)
            before = np.where(place[at] > 0, self.of[-1][at - 1], -1) if level == 2 else self.of[-1][at - 1]
            low = self.keys[-1][before] if len(self.keys[-1]) else np.zeros(0, np.uint64)
            with np.errstate(over="ignore"):
                key = common.mix64(np.where(before < 0, np.uint64(START), low) * np.uint64(3) + word_keys[codes[at]]) >> shift
            sort = np.argsort(key)
            ranked = key[sort]
            first = np.ones(len(sort), bool)
            first[1:] = ranked[1:] != ranked[:-1]
            index = np.full(len(codes), -1, np.int32)
            index[at[sort]] = np.cumsum(first, dtype=np.int32) - 1
            del key, low
            one = sort[first]  # one occurrence of each
            self.keys.append(ranked[first])
            self.of.append(index)
            self.history.append(before[one].astype(np.int32))
            self.suffix.append(self.of[level - 2][at[one]].astype(np.int32))
            self.word.append(codes[at[one]].astype(np.int32))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """By level: how often each distinct n-gram occurs at tokens for which ``train`` holds."""
        return [np.bincount(of[train & (of >= 0)], minlength=len(keys)) for of, keys in zip(self.of, self.keys)]

    def history_counts(self, counts: list[np.ndarray], level: int, starts: int) -> np.ndarray:
        """Training count of the history of each n-gram of ``level``."""
        h = self.history[level - 1]
        return np.where(h < 0, starts, counts[level - 2][h])


class BackoffAutomaton:
    """The part of the automaton that a block's texts can reach.

    counts: training counts by level, as in ``grams``. total, vocab, discount: N, V, d. starts: training
    texts. escape: e by level (from 2) and bucket. State 0 is the root, 1 the start mark.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, vocab: int, discount: float, starts: int, escape: np.ndarray):
        order, self.width = len(counts), max(len(counts[0]), 1)
        unknown = discount * vocab / total if total else 1.0
        chance = np.where(counts[0] > 0, (counts[0] - discount) / max(total, 1), unknown)
        self.root = np.log10(chance)
        fail, leave = [np.zeros(2, np.int64)], [np.array([0.0, math.log10(escape[0][bucket(np.array([starts]))[0]]) if starts and order > 1 else 0.0])]
        self.start = 1 if starts and order > 1 else 0
        n, states, arcs = 2, [], []
        for level in range(1, order + 1):
            c = counts[level - 1]
            lower = np.zeros(len(c), np.int64) if level == 1 else states[-1][grams.suffix[level - 1]]
            if level < order:  # a history is a state if it was seen; nothing follows an end
                own = (c > 0) & (grams.word[level - 1] != grams.end)
                state = lower.copy()
                state[own] = n + np.arange(own.sum())
                n += int(own.sum())
                fail.append(lower[own])
                leave.append(np.log10(escape[level - 1][bucket(c[own])]))
            else:
                state = lower
            if level > 1:
                h, below = grams.history[level - 1], chance
                ch = grams.history_counts(counts, level, starts)
                e = escape[level - 2][bucket(ch)]
                chance = (1 - e) * c / np.maximum(ch, 1) + e * below[grams.suffix[level - 1]]
                seen = np.flatnonzero(c)
                source = np.where(h[seen] < 0, 1, states[-1][h[seen]])
                arcs.append((source * self.width + grams.word[level - 1][seen], np.log10(chance[seen]), state[seen]))
            states.append(state)
        self.first = states[0] if order > 1 else np.zeros(self.width, np.int64)  # where the root's arcs lead
        self.fail, self.leave = np.concatenate(fail), np.concatenate(leave)
        keys = np.concatenate([np.empty(0, np.int64), *(a[0] for a in arcs)])
        sort = np.argsort(keys)
        self.arc = np.append(keys[sort], -1)
        self.weight = np.concatenate([np.empty(0), *(a[1] for a in arcs), [0.0]])[np.append(sort, len(sort))]
        self.next = np.concatenate([np.empty(0, np.int64), *(a[2] for a in arcs), [0]])[np.append(sort, len(sort))]
        self.memory = order - 1

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after each of ``state`` has read its word, and the weight of the arcs taken for it."""
        state, weight = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        arcs = self.arc[:-1]
        while len(todo):
            s, w = state[todo], word[todo]
            key = s * self.width + w
            at = np.searchsorted(arcs, key)
            hit = (self.arc[at] == key) & (s > 0)
            root = s == 0
            done, found = todo[hit], at[hit]
            weight[done] += self.weight[found]
            state[done] = self.next[found]
            done = todo[root]
            weight[done] += self.root[word[done]]
            state[done] = self.first[word[done]]
            todo = todo[~(hit | root)]
            weight[todo] += self.leave[state[todo]]
            state[todo] = self.fail[state[todo]]
        return state, weight

    def traverse(self, codes: np.ndarray, lens: np.ndarray, lane: int = 256) -> np.ndarray:
        """log10 weight of each token. Lanes of ``lane`` tokens are read in step, from left to right."""
        lane = max(lane, self.memory)
        pieces = -(-lens // lane)
        text = np.repeat(np.arange(len(lens)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(lens) - lens)[text] + nth * lane
        size = np.minimum(lens[text] - nth * lane, lane)
        early = np.where(nth > 0, self.memory, 0)
        sort = np.argsort(-(size + early), kind="stable")
        begin, size, early, nth = begin[sort], size[sort] + early[sort], early[sort], nth[sort]
        at = begin - early
        state = np.where(nth > 0, 0, self.start)
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # lanes longer than each step
        out = np.zeros(len(codes))
        for step, n in enumerate(active.tolist()):
            token = at[:n] + step
            state[:n], weight = self.read(state[:n], codes[token])
            if step < self.memory:
                own = step >= early[:n]
                out[token[own]] = weight[own]
            else:
                out[token] = weight
        return out


def word_hash(words: np.ndarray) -> np.ndarray:
    return common.mix64(pd.util.hash_array(words, categorize=False))


_END_KEY = word_hash(np.array([END], object))[0]


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal place together, which compresses small numbers well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def _from_planes(data: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def pack(arrays: list[tuple[np.ndarray, bool]]) -> bytes:
    """Arrays of whole numbers, each with whether it ascends (then its steps are kept)."""
    parts = [struct.pack("<H", len(arrays))]
    for a, ascends in arrays:
        a = np.diff(a, prepend=a.dtype.type(0)) if ascends else a
        parts.append(struct.pack("<I?2s", len(a), ascends, a.dtype.str[1:].encode()))
        parts.append(_planes(a))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    body = memoryview(zstandard.ZstdDecompressor().decompress(data))
    at, out = 2, []
    for _ in range(struct.unpack_from("<H", body)[0]):
        n, ascends, kind = struct.unpack_from("<I?2s", body, at)
        a = _from_planes(body[at + 7 :], n, "<" + kind.decode())
        at += 7 + a.nbytes
        out.append(np.cumsum(a, dtype=a.dtype) if ascends else a)
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Block:
    """A block's texts as they lie in its file."""

    def __init__(self, data: bytes, order: int, bits: int):
        size = struct.unpack_from("<I", data)[0]
        self.ids = common.from_ipc(data[4 : 4 + size])
        lens, keys, place, low, high = unpack(data[4 + size :])
        self.lens = lens.astype(np.int64)
        codes = place[low.astype(np.int64) | high.astype(np.int64) << 16].astype(np.int64)
        self.grams = Grams(codes, self.lens, keys, order, bits)
        self.train = np.repeat(self.ids["train"].to_numpy(), self.lens)

    @staticmethod
    def make(rows: pa.Table) -> bytes:
        n, words = common.words_of(rows["text"].combine_chunks())
        ends = np.cumsum(n + 1) - 1  # each text's end token follows its words
        flat = np.zeros(len(words) + len(n), np.int32)
        is_word = np.ones(len(flat), bool)
        is_word[ends] = False
        coded = words.dictionary_encode()
        flat[is_word] = coded.indices.to_numpy(zero_copy_only=False) + 1
        vocab = np.concatenate([np.array([END], object), coded.dictionary.to_numpy(zero_copy_only=False)])
        keys = word_hash(vocab)
        keys, own = np.unique(keys, return_inverse=True)
        frequent = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")  # low numbers compress well
        number = np.empty(len(vocab), np.uint32)
        number[frequent] = np.arange(len(vocab))
        codes = number[flat]
        ids = common.ipc(rows.select(["id", "train"]))
        packed = pack([((n + 1).astype(np.int32), False), (keys, True), (own[frequent].astype(np.uint32), False), (codes.astype(np.uint16), False), ((codes >> 16).astype(np.uint16), False)])
        return struct.pack("<I", len(ids)) + ids + packed


def _shards(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where the keys of each shard begin, and the end: shards are equal ranges of the top 32 bits."""
    edges = [-(-(s << 32) // shards) << (bits - 32) for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _requests(folder: str, order: int, bits: int, shards: int, block_bytes: int):
    """Texts to blocks, written to files; a row for each block and shard, with the n-grams it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _open(folder)
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            data = Block.make(pa.Table.from_batches(held))
            name, own = f"{task}-{made}", f"{base}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(own, compression=None) as out:
                out.write(data)
            store.move(own, f"{base}/{name}")
            block = Block(data, order, bits)
            counts = [c.astype(np.int32) for c in block.grams.counts(block.train)]
            cuts = [_shards(k, 64 if level == 0 else bits, shards) for level, k in enumerate(block.grams.keys)]
            rows = []
            for s in range(shards):
                parts = [slice(c[s], c[s + 1]) for c in cuts]
                if any(p.stop > p.start for p in parts):
                    rows.append((name, s, pack([x for k, n, p in zip(block.grams.keys, counts, parts) for x in ((k[p], True), (n[p], False))])))
            for at in range(0, len(rows), 64):
                part = list(zip(*rows[at : at + 64]))
                yield pa.record_batch([pa.array(part[0]), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())], names=["block", "shard", "payload"])

        for batch in batches:
            for piece in common.chunks(batch, "text", block_bytes // 4):
                held.append(piece)
                size += piece.column("text").nbytes
                if size >= block_bytes:
                    yield from flush()
                    made, held, size = made + 1, [], 0
                    common.give_back()
        if held:
            yield from flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of sorted rows, which may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        column = batch.column(key).to_pylist()
        cuts = [0, *(i for i in range(1, len(column)) if column[i] != column[i - 1]), len(column)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(key)[0].as_py() != column[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's requests to answers: the counts over all blocks, and sums over its words (block "")."""
    for rows in _groups(batches, "shard"):
        asked = [unpack(x) for x in rows["payload"].to_pylist()]
        answers: list[list[tuple[np.ndarray, bool]]] = [[] for _ in asked]
        for level in range(len(asked[0]) // 2):
            keys, where = np.unique(np.concatenate([x[2 * level] for x in asked]), return_inverse=True)
            total = np.bincount(where, np.concatenate([x[2 * level + 1] for x in asked]), len(keys)).astype(np.int64)
            cuts = np.cumsum([len(x[2 * level]) for x in asked])[:-1]
            for i, part in enumerate(np.split(where, cuts)):
                answers[i].append((total[part], False))
            if level == 0:
                sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        out = [*(pack(x) for x in answers), pack([(np.array(sums, np.int64), False)])]
        shards = [*rows["shard"].to_pylist(), rows["shard"][0].as_py()]
        for at in range(0, len(out), 256):
            yield pa.record_batch([pa.array([*rows["block"].to_pylist(), ""][at : at + 256]), pa.array(shards[at : at + 256], pa.int64()), pa.array(out[at : at + 256], pa.binary())], names=["block", "shard", "payload"])


def _assemble(folder: str, order: int, bits: int, starts: int):
    """Answers, sorted by block and shard, to a block's counts by level, and its sums for escape weights:
    by level from 2 and bucket of the history, continuations seen once in training, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for rows in _groups(batches, "block"):
            name, answers = rows["block"][0].as_py(), [unpack(x) for x in rows["payload"].to_pylist()]
            if not name:
                yield _model_row(name, b"", np.sum([x[0] for x in answers], axis=0))
                continue
            counts = [np.concatenate([x[level] for x in answers]) for level in range(order)]
            with store.open_input_file(f"{base}/{name}") as file:
                block = Block(file.read(), order, bits)
            own, stats = block.grams.counts(block.train), []
            for level in range(2, order + 1):
                of, n, c = bucket(block.grams.history_counts(counts, level, starts)), own[level - 1], counts[level - 1]
                stats += [np.bincount(of[(c == 1) & (n == 1)], minlength=BUCKETS), np.bincount(of, n, BUCKETS).astype(np.int64)]
            yield _model_row(name, pack([(c, False) for c in counts]), np.concatenate([np.zeros(0, np.int64), *stats]))

    return run


def _model_row(block: str, payload: bytes, stats: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block]), pa.array([payload], pa.binary()), pa.array([stats.tolist()], pa.list_(pa.int64()))], names=["block", "payload", "stats"])


def _score(folder: str, order: int, bits: int, model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                counts = unpack(batch.column("payload")[i].as_py())
                with store.open_input_file(f"{base}/{batch.column('block')[i].as_py()}") as file:
                    block = Block(file.read(), order, bits)
                automaton = BackoffAutomaton(block.grams, counts, model["N"], model["V"], model["discount"], model["starts"], model["escape"])
                codes, lens, known = block.grams.codes, block.lens, counts[0]
                begin = np.cumsum(lens) - lens
                base_weight = np.log10((known + 0.5) / (model["N"] + 0.5 * (model["V"] + 1)))
                train = block.ids["train"].to_numpy()
                made = [
                    ~train, lens, np.add.reduceat((known > 0).astype(np.int64)[codes], begin), np.full(len(lens), model["N"]),
                    np.add.reduceat(base_weight[codes], begin), np.add.reduceat(automaton.traverse(codes, lens), begin),
                ]
                out = pa.record_batch([block.ids["id"].combine_chunks(), *map(pa.array, made)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del block, automaton, codes, counts, known, made
                common.give_back()
                yield out

    return run


def score_texts(docs: DataFrame, train: F.Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, block_bytes: int = 5 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """Score every text by a model of the texts for which ``train`` holds (null counts as false).

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. ``block_bytes``,
    ``shard_bytes``: text of a block, and of all texts for each shard; they bound the memory of a task
    and do not change the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size, n, starts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)), F.count_if("train")).first()
    bits = min(64, max(40, 18 + math.ceil(math.log2(size / 4 + n + 2))))  # words take four bytes or more, with their spaces
    shards, blocks = max(32, math.ceil(size / shard_bytes)), max(1, math.ceil(size / block_bytes))
    folder = common.scratch_path(spark, "lm-blocks")
    _make_folder(spark, folder)
    asked = rows.mapInArrow(common.lean(_requests(folder, order, bits, shards, block_bytes)), _EXCHANGE)
    answers = asked.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(common.lean(_count), _EXCHANGE)
    parts = answers.repartition(min(blocks, 10_000), "block").sortWithinPartitions("block", "shard")
    model = common.materialise(parts.mapInArrow(common.lean(_assemble(folder, order, bits, starts)), _MODEL), "lm-model")
    words, escapes = [0] * 4, np.zeros((order - 1, 2, BUCKETS))
    sums = model.select((F.col("block") == "").alias("words"), F.posexplode("stats").alias("i", "n")).groupBy("words", "i").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # 4 + 128 (order - 1) numbers
        if r.words:
            words[r.i] = r.n
        else:
            escapes.reshape(-1)[r.i] = r.n
    total, vocab, once, twice = words
    found = {
        "N": total, "V": vocab, "starts": starts, "discount": min(max(once / max(once + 2 * twice, 1), 0.05), 0.95),
        "escape": np.clip(escapes[:, 0] / np.maximum(escapes[:, 1], 1), 1e-3, 0.999),
    }
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = model.where("block != ''").select("block", "payload").mapInArrow(common.lean(_score(folder, order, bits, found)), schema)
    return scored.withColumnRenamed("id", id_col)


def _make_folder(spark, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
