"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Space. A text's terms are its words and the beginnings of longer words (``prefix`` letters to twice as
many, and a star), which carry over to inflected forms and compounds; of those of a word only the
strongest chosen one counts. Terms that speak for the label are chosen on a bounded
sample of labelled rows (``examples`` of either class, those with the smallest hash of their id), where
copies of an equal text count once, by the log-likelihood ratio, among those whose texts are toxic
``lift`` times as often as labelled texts are (sampled counts weighted back to all labelled rows); the ratio must exceed what chance gives the best of so many
candidates (2 ln of their number). All of them are taken. Document frequencies of these terms are counted
over all documents. A text's vector holds every chosen term that occurs anywhere in it, with
(1 + ln of its occurrences) times its idf, and has length one. Terms that do not speak for the label are
left out: the vector is not that of all words of the text (see the README for what those would give).

Index. The examples' vectors are sorted so that like ones are neighbours, and cut into blocks; each
term keeps its postings and, for each block, its largest weight. A query adds up these maxima to a bound
for each block, reads the blocks of the highest bounds first and then, together, all others whose bound is
above the k-th best cosine found by then; the rest can hold nothing nearer, so the k nearest cosines are exact.
Of examples that tie for the last places, those in blocks read first count, then those of lower numbers: the
same ones in every run. Index and terms are those of a sample bounded by ``examples``, whatever the size of
the corpus, so that the index may be sent to all tasks.

Votes. Neighbours vote with weight (cosine / highest cosine)**4, times the inverse of the rate at which their class was
sampled, shrunk towards the rate of the label with the weight of half a vote: the score is an estimate of
a probability. Texts without any chosen term have cosine 0 with everything; their neighbours are the
examples without terms, and they get the rate of the label among these.

Only words reach a score. Null texts are empty. Repeated rows keep a row each; a repeated labelled id
counts once, as toxic if any of its labels says so. Without labels every score is 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

_WORD = re.compile(r"\w+")
#: Votes that the rate of the label counts for.
PRIOR = 0.5


def terms_of(word: str, prefix: int) -> list[str]:
    """Terms of a run of non-space characters."""
    out = []
    for w in _WORD.findall(word.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in range(prefix, min(len(w), 2 * prefix + 1))]
    return out


class Vectoriser:
    """Counts of terms in whole texts; a word is looked up once for each chunk of texts.

    terms: chosen terms by rank, the strongest first; None to count all terms of all words.
    """

    def __init__(self, terms: dict[str, int] | None, prefix: int):
        self.terms, self.prefix = terms, prefix

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str] | None]:
        """(text, term, count) triples sorted by text and term; the names of all terms if none were given."""
        n, words = common.words_of(texts)
        coded = words.dictionary_encode()
        chosen, names = self.terms, {}
        of, begin = [], [0]
        for word in coded.dictionary.to_pylist():
            if chosen is None:
                of += [names.setdefault(t, len(names)) for t in terms_of(word, self.prefix)]
            else:
                for w in _WORD.findall(word.lower()):
                    if ranks := [chosen[t] for t in terms_of(w, self.prefix) if t in chosen]:
                        of.append(min(ranks))
            begin.append(len(of))
        of, begin = np.array(of, np.int64), np.array(begin)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(n)), n)
        width = np.diff(begin)[codes]
        some = width > 0
        codes, text, width = codes[some], text[some], width[some]
        at = np.repeat(begin[codes] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        size = max(len(names if chosen is None else chosen), 1)
        key, count = np.unique(np.repeat(text, width) * size + of[at], return_counts=True)
        return key // size, key % size, count, list(names) if chosen is None else None


def _evidence(prefix: int, chunk_bytes: int):
    """(term, texts with it, toxic ones) of labelled texts, added up for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                text, term, _, names = Vectoriser(None, prefix).counts(part.column("text"))
                toxic = part.column("y").to_numpy(zero_copy_only=False)[text] > 0
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.bincount(term, minlength=len(names))), pa.array(np.bincount(term[toxic], minlength=len(names)))], names=["term", "n", "toxic"])

    return run


def _vectors(terms: dict[str, int], prefix: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectoriser = Vectoriser(terms, prefix)
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                text, term, tf, _ = vectoriser.counts(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=part.num_rows))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                others = [c for c in part.schema.names if c != "text"]
                yield pa.record_batch([*(part.column(c) for c in others), *lists], names=[*others, "term", "tf"])

    return run


def ratio(toxic: Column, n: Column, all_toxic: int, total: int) -> Column:
    """Log-likelihood ratio of a term that is more frequent in toxic texts, else 0."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, rate = toxic.cast("double"), all_toxic / total
    b, c, d = n - a, all_toxic - a, total - all_toxic - n + a
    sums = part(a, n * rate) + part(b, n * (1 - rate)) + part(c, (total - n) * rate) + part(d, (total - n) * (1 - rate))
    return F.when(a > n * rate, 2 * sums).otherwise(0.0)


class BlockMaxIndex:
    """Examples' unit vectors in blocks of ``width``, with the largest weight of each term in each block that has it."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, width: int = 64):
        self.n, self.blocks = len(vectors), max(1, -(-len(vectors) // width))
        rows = sorted((t, i, w) for i, v in enumerate(vectors) for t, w in v.items())
        term = np.array([r[0] for r in rows], np.int64)
        self.example = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.float64)
        self.block = self.example // width
        self.begin = np.searchsorted(term, np.arange(n_terms + 1))
        first = np.flatnonzero(np.diff(term * self.blocks + self.block, prepend=-1))
        self.highest = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.highest_block = self.block[first]
        self.highest_begin = np.searchsorted(term[first], np.arange(n_terms + 1))

    @staticmethod
    def _gather(begin: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the terms, and for each the query's weight."""
        size = begin[terms + 1] - begin[terms]
        return np.repeat(begin[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(weights, size)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine above 0 and their cosines. The ``first`` blocks of the
        highest bounds are read; after them only those whose bound is above the k-th cosine found. Of
        examples at the same cosine as the k-th, those already found are taken."""
        at, weight = self._gather(self.highest_begin, terms, weights)
        bound = np.bincount(self.highest_block[at], weight * self.highest[at], minlength=self.blocks)
        at, weight = self._gather(self.begin, terms, weights)
        block = self.block[at]

        def cosines(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = blocks[block]
            sums = np.bincount(self.example[at[own]], weight[own] * self.weight[at[own]], minlength=self.n)
            hit = np.flatnonzero(sums > 0)
            return hit, sums[hit]

        read = np.zeros(self.blocks, bool)
        read[np.argsort(-bound, kind="stable")[:first]] = True
        found, cosine = cosines(read)
        floor = np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0
        rest = ~read & (bound > floor + 1e-12)
        if rest.any():
            more, its = cosines(rest)
            found, cosine = np.concatenate([found, more]), np.concatenate([cosine, its])
        # sums of equal vectors may differ in the last bits; they tie
        best = np.lexsort((found, -np.round(cosine, 12)))[:k]
        return found[best], cosine[best]


def unit(terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[terms]
    return w / math.sqrt(float(w @ w))


def _score(model: dict, evidence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf, y, vote, k = model["index"], model["idf"], model["y"], model["vote"], model["k"]
        for batch in batches:
            scores, shown = [], []
            for t, tf in zip(batch.column("term").to_pylist(), batch.column("tf").to_pylist()):
                t = np.array(t)
                near, cosine = index.nearest(t, unit(t, np.array(tf), idf), k)
                weight = (cosine / cosine[:1]) ** 4 * vote[near]
                scores.append(float((weight @ y[near] + PRIOR * model["rate"]) / (weight.sum() + PRIOR)))
                shown.append([(model["ids"][i], float(c), int(y[i])) for i, c in zip(near[:evidence], cosine)])
            cols = [batch.column("term"), batch.column("tf"), pa.array(scores, pa.float64())]
            if evidence:
                struct = pa.struct([("id", model["id_type"]), ("cosine", pa.float64()), ("toxic", pa.int32())])
                cols.append(pa.array([[dict(zip(("id", "cosine", "toxic"), e)) for e in x] for x in shown], pa.list_(struct)))
            yield pa.record_batch(cols, names=["term", "tf", "score", "evidence"][: len(cols)])

    return run


def score(
    docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples: int = 10_000, min_toxic: int = 2, lift: float = 1.5, prefix: int = 4, k: int = 24, evidence: int = 0, chunk_bytes: int = 8 << 20, key_col: str | None = None,
) -> DataFrame:
    """(id, score) of every text, and with ``evidence`` > 0 the nearest examples: id, cosine and label.

    labels: (id_col, label_col); only rows for which ``learn`` (on id_col) holds are looked at.
    key_col: a column that is passed on as ``key``, for rows whose ids are null or repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    carry = ["key"] if key_col else []
    rows = docs.select(F.col(id_col).alias("id"), *([F.col(key_col).alias("key")] if key_col else []), F.col(text_col).alias("text"))
    marked = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    total, toxic = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        empty = rows.select("id", *carry, F.lit(0.5).alias("score"))
        return empty.withColumn("evidence", F.array().cast(f"array<struct<id:{kind},cosine:double,toxic:int>>")) if evidence else empty
    order = [F.xxhash64(F.col("id").cast("string"), F.lit("examples")), F.col("id")]
    chosen = marked.where("y = 1").orderBy(*order).limit(examples).unionByName(marked.where("y = 0").orderBy(*order).limit(examples))
    # at most 2 * examples rows of an id and a label: bounded, whatever the corpus
    bank = F.broadcast(common.materialise(chosen, "toxic-examples"))
    # copies of a text would make all its words speak for the label; 2 * examples texts at most
    known = common.materialise(rows.join(bank, "id").where("text is not null").groupBy("text").agg(F.max("y").alias("y")), "toxic-texts")
    seen = known.select("text", "y").mapInArrow(common.lean(_evidence(prefix, chunk_bytes)), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    size, sampled_toxic = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    strength = ratio(F.col("toxic"), F.col("n"), int(sampled_toxic or 0), max(size, 1))
    # either class counts by the inverse of its sampling rate for the lift, so that it asks for the same share of
    # the labelled texts whether or not ``examples`` cuts a class; chance is judged by the counts as they were drawn
    drawn = [max(min(n, examples), 1) for n in (toxic, total - toxic)]
    w1, w0 = toxic / drawn[0], (total - toxic) / drawn[1]
    s1 = int(sampled_toxic or 0) * w1
    usual = min(s1 / max(s1 + (size - int(sampled_toxic or 0)) * w0, 1e-9), 0.9 / lift)
    weighted = F.col("toxic") * w1 + (F.col("n") - F.col("toxic")) * w0
    candidates = common.materialise(seen.where((F.col("toxic") >= min_toxic) & (F.col("toxic") * w1 >= lift * usual * weighted)).select("term", strength.alias("g")), "toxic-terms")
    chance = 2 * math.log(max(candidates.count(), 2))
    best = candidates.where(F.col("g") > chance).orderBy(F.desc("g"), F.length("term"), "term")
    names = {r.term: i for i, r in enumerate(best.select("term").collect())}  # terms of 2 * examples texts at most
    vectors = common.materialise(rows.mapInArrow(common.lean(_vectors(names, prefix, chunk_bytes)), f"id {kind}, " + (f"key {docs.schema[key_col].dataType.simpleString()}, " if key_col else "") + "term array<int>, tf array<int>"), "toxic-vectors")
    n_docs, df = rows.count(), np.zeros(max(len(names), 1))
    for i, n in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row for a chosen term
        df[i] = n
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    found = sorted(vectors.join(bank, "id").dropDuplicates(["id"]).collect(), key=lambda r: str(r.id))  # 2 * examples at most
    units = [dict(zip(r.term, unit(np.array(r.term), np.array(r.tf), idf).tolist())) if r.term else {} for r in found]
    place = sorted(range(len(found)), key=lambda i: sorted(units[i].items(), key=lambda x: (-x[1], x[0]))[:3])
    y = np.array([found[i].y for i in place], np.float64)
    rate = toxic / total
    in_bank = Counter(y.tolist())
    vote = np.where(y > 0, toxic / max(in_bank[1.0], 1), (total - toxic) / max(in_bank[0.0], 1))
    vote = vote / max(vote.min(), 1e-9) if len(vote) else vote
    bare = np.array([not units[i] for i in place], bool)
    model = {
        "index": BlockMaxIndex([units[i] for i in place], len(df)), "idf": idf, "y": y, "vote": vote, "k": k, "rate": rate,
        "ids": [found[i].id for i in place], "empty": float((vote[bare] @ y[bare] + PRIOR * rate) / (vote[bare].sum() + PRIOR)) if len(y) else rate,
    }
    model["id_type"] = to_arrow_type(docs.schema[id_col].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shown = f"array<struct<id:{kind},cosine:double,toxic:int>>"

    def run(batches):
        yield from _score(sent.value, evidence)(batches)

    # a vector is looked up once, however many texts have it; texts without terms need no search
    distinct = vectors.where(F.size("term") > 0).select("term", "tf").distinct()
    judged = common.materialise(distinct.mapInArrow(common.lean(run), "term array<int>, tf array<int>, score double" + f", evidence {shown}" * bool(evidence)), "toxic-scores")
    columns = ["id", *carry, "score", *(["evidence"] if evidence else [])]
    bare_rows = vectors.where(F.size("term") == 0).select("id", *carry, F.lit(model["empty"]).alias("score"), F.array().cast(shown).alias("evidence"))
    return vectors.where(F.size("term") > 0).join(judged, ["term", "tf"]).select(*columns).unionByName(bare_rows.select(*columns))
