"""Brown class-based bigrams: exchange clustering, class transitions, word emissions and smoothed perplexity.

The LISTED most frequent training words are assigned to CLASSES by exchange: in each round, a part of them moves to the
class that raises the likelihood of the class bigrams most, by counts of the classes beside each word. A round that
lowers the likelihood is undone and taken again with fewer words; rounds end when they raise it by less than SETTLED of
itself. Words beyond the list, known or not, have one of TAIL further classes, told by their form.
P(word | before) = P(class | class before) * P(word | class); transitions are interpolated with class frequencies, tail
emissions are add-one with a place for unknown words.

Counts of words and bigrams cover every training text. Executors get the listed words and class matrices, both of fixed
size; the counts of all other words are joined to the places that need them.

Defined cases: a null or word-free text is its end token alone. Rows that repeat doc_id and text are counted and scored
each. A null doc_id trains (it has no remainder of 2) and is scored. Extra columns are ignored; an empty table gives an
empty one; without training rows all words are unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import crc32_mod, cut

LISTED, CLASSES, TAIL = 60_000, 48, 16
#: The rise of the likelihood, as a share of it, below which rounds end; the smallest part of the words that moves.
SETTLED, FEWEST = 2e-4, 64
#: Weight of class frequencies in transitions, words in a block of the exchange, and words a task counts at a time.
PRIOR, BLOCK, FLUSH = 30.0, 1024, 200_000
#: Tasks that blocks of the list are dealt to; the list has a fixed size.
TASKS = 16
END = b"\n"  # never a word
ALL = CLASSES + TAIL


def tail_class(word: bytes) -> int:
    """By length, ending and whether all is ASCII: forms of one language tend to meet."""
    return (min(len(word), 12) // 3 * 5 + (not word.isascii()) * 7 + zlib.crc32(word[-2:]) % 4) % TAIL


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch["text"].to_pylist():
            seen.update(words_of(text))
            seen[END] += 1
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def encoder(listed: list[bytes]):
    """Training texts as 16-bit ids: places in the list, or LISTED + tail class; each text ends with END's."""
    number = {w: i for i, w in enumerate(listed)}

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            return LISTED + tail_class(word)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(number)
        end = ids[END]
        for batch in batches:
            out = [end]
            for text in batch["text"].to_pylist():
                out.extend(map(ids.__getitem__, words_of(text)))
                out.append(end)
            yield pa.RecordBatch.from_arrays([pa.array([np.array(out, "<u2").tobytes()], pa.binary())], names=["ids"])

    return encode


def by_word(classes: np.ndarray, rows: int):
    """Counts of the classes right and left of each id under `rows`, in blocks of words: places in a block and counts there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, rows * ALL), np.int64)
        for batch in batches:
            for blob in batch["ids"].to_pylist():
                ids = np.frombuffer(blob, "<u2").astype(np.int64)
                own = classes[ids]
                for side, word, other in ((0, ids[:-1], own[1:]), (1, ids[1:], own[:-1])):
                    some = word < rows
                    total[side] += np.bincount(word[some] * ALL + other[some], minlength=rows * ALL)
        total = total.reshape(2, rows, ALL)
        out = []
        for first in range(0, rows, BLOCK):
            part = total[:, first : first + BLOCK].ravel()
            where = np.flatnonzero(part)
            if len(where):
                out.append((first, where.astype("<u4").tobytes(), part[where].astype("<i8").tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "places", "counts"])

    return count


def adder(rows: int):
    def add_up(group: pa.Table) -> pa.Table:
        """All counts of a block."""
        block = group["block"][0].as_py()
        total = np.zeros(2 * min(BLOCK, rows - block) * ALL, np.int64)
        for places, counts in zip(group["places"].to_pylist(), group["counts"].to_pylist(), strict=True):
            total[np.frombuffer(places, "<u4")] += np.frombuffer(counts, "<i8")  # places of one task differ
        return pa.table({"block": group["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    return add_up


def class_matrix(ids: DataFrame, classes: np.ndarray) -> np.ndarray:
    """n(class, next class) over all of `ids`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            for blob in batch["ids"].to_pylist():
                own = classes[np.frombuffer(blob, "<u2")]
                total += np.bincount(own[:-1] * ALL + own[1:], minlength=ALL * ALL)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ALL * ALL)), pa.array(total)], names=["pair", "n"])

    rows = ids.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # ALL * ALL rows
    out = np.zeros(ALL * ALL)
    out[[r["pair"] for r in rows]] = [r["n"] for r in rows]
    return out.reshape(ALL, ALL)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(g: np.ndarray) -> float:
    """What assigning words to classes can change of the log likelihood of the class bigrams."""
    return float(xlogx(g).sum() - xlogx(g.sum(1)).sum() - xlogx(g.sum(0)).sum())


def gains(right: np.ndarray, left: np.ndarray, own: np.ndarray, g: np.ndarray, into: int = ALL) -> np.ndarray:
    """What the likelihood gains by each of the first `into` classes for each word, from counts of the classes beside it,
    its own class and g.

    Only the entries of g that a word's counts touch change with its class, so each non-zero count is one row here.
    """
    gain = np.zeros((len(own), into))
    for counts, others, matrix in ((right, left, g.T), (left, right, g)):
        w, c = np.nonzero(counts)  # in the order of words
        x = counts[w, c]
        rows = np.arange(len(w))
        matrix, mine = matrix[:, :into], own[w]
        base, logs = matrix[c], xlogx(matrix)[c]  # pairs of class c with every class
        home = mine < into
        base[rows[home], mine[home]] -= x[home]
        both = c == mine
        base[both] -= others[w[both], :into]  # the word is also the other one of such a pair
        np.maximum(base, 0, out=base)
        logs[rows[home], mine[home]] = xlogx(base[rows[home], mine[home]])
        logs[both] = xlogx(base[both])
        if len(w):
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[first]] += np.add.reduceat(xlogx(base + x[:, None]) - logs, first)
        total = np.repeat(matrix.sum(0)[None], len(own), 0)
        held, all_of = np.flatnonzero(own < into), counts.sum(1)
        total[held, own[held]] -= all_of[held]
        gain -= xlogx(total + all_of[:, None]) - xlogx(total)
    pairs = np.repeat(g.diagonal()[None, :into], len(own), 0)  # of a class with itself: both sides' counts come together there
    x, y = right[:, :into], left[:, :into]
    pairs[held, own[held]] -= x[held, own[held]] + y[held, own[held]]
    np.maximum(pairs, 0, out=pairs)
    return gain + xlogx(pairs + x + y) + xlogx(pairs) - xlogx(pairs + x) - xlogx(pairs + y)


def exchanger(classes: np.ndarray, g: np.ndarray, turn: int, parts: int, words: int):
    """For one of `parts` parts of the words, the class that each should be in."""

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, to = [], []
            for block, blob in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                right, left = np.frombuffer(blob, np.int64).reshape(2, -1, ALL).astype(float)
                w = block + np.arange(right.shape[0])
                w = w[(w < words) & ((w * 2654435761 >> 8) % parts == turn % parts)]
                gain = gains(right[w - block], left[w - block], classes[w], g, CLASSES)  # listed words have none of the tail's
                best = gain.argmax(1)
                k = np.arange(len(w))
                better = gain[k, best] > gain[k, classes[w]] + 1e-9
                word += w[better].tolist()
                to += best[better].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(to, pa.int64())], names=["word", "to"])

    return exchange


def cluster(ids: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A class for each 16-bit id, the class matrix, and the likelihood after each round."""
    classes = np.zeros(1 << 16, np.int64)
    classes[LISTED : LISTED + TAIL] = CLASSES + np.arange(TAIL)
    classes[:words] = np.arange(words) % CLASSES
    g = class_matrix(ids, classes)
    risen, turn, parts, small = [likelihood(g)], 0, 2, 0
    while words and small < 2 and parts <= FEWEST:
        summed = ids.mapInArrow(by_word(classes, words), "block long, places binary, counts binary").repartition(TASKS, "block").groupBy("block").applyInArrow(adder(words), "block long, counts binary")
        moves = summed.mapInArrow(exchanger(classes, g, turn, parts, words), "word long, to long").collect()  # LISTED rows at most
        moved = classes.copy()
        moved[[m["word"] for m in moves]] = [m["to"] for m in moves]
        turn += 1
        after = class_matrix(ids, moved) if moves else g
        if likelihood(after) < risen[-1]:  # words that move together may spoil each other's gain
            parts *= 2
            continue
        small = small + 1 if likelihood(after) - risen[-1] <= SETTLED * abs(risen[-1]) else 0
        classes, g = moved, after
        risen.append(likelihood(g))
    return classes, g, risen


@dataclass
class Model:
    """What the probability of a text needs, but for the counts of words beyond the list (`vocabulary`)."""

    listed: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    room: np.ndarray
    tokens: int
    distinct: int
    vocabulary: DataFrame
    risen: list[float]


def scorer(listed: list[bytes], counts: np.ndarray, classes: np.ndarray, transition: np.ndarray, emission: np.ndarray, tail_room: np.ndarray, base_room: float):
    """Per row, all that a text's probability needs but the counts of unlisted words; `tail` lists those."""
    number = {w: i for i, w in enumerate(listed)}

    def parts(text: str | None) -> tuple[int, int, float, float, list[bytes]]:
        words = words_of(text)
        words.append(END)
        ids = [number.get(w, -1) for w in words]
        rest = [w for w, i in zip(words, ids, strict=True) if i < 0]
        i = np.array(ids)
        known = i >= 0
        own = np.empty(len(i), np.int64)
        own[known] = classes[i[known]]
        own[~known] = [CLASSES + tail_class(w) for w in rest]
        before = np.r_[classes[number[END]] if END in number else CLASSES + tail_class(END), own[:-1]]
        score = transition[before, own].sum() + emission[i[known]].sum() - tail_room[own[~known]].sum()
        return len(i), int(known.sum()), float(np.log10(counts[i[known]] + 1).sum() - len(i) * base_room), float(score), rest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parts(t) for t in b["text"].to_pylist()]
            columns = (pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64())))
            yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"], *columns], names=["key", "doc_id", "n_tokens", "n_known", "base", "model"])

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, word, n = [], [], []
            for k, t in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                rest = Counter(w for w in words_of(t) if w not in number)
                key += [k] * len(rest)
                word += map(word_hash, rest)
                n += rest.values()
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.int64()), pa.array(n, pa.int64())], names=["key", "word", "n"])

    return rows, tail


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b["word"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in words], pa.int64()), pa.array([tail_class(w) for w in words], pa.int32()), b["c"], b["word"]], names=["hash", "tail", "c", "word"])


def most_frequent(vocabulary: DataFrame, limit: int) -> list:
    """The rows with the greatest counts, most frequent first: as many whole counts as fit in `limit` rows.

    The least count comes from how many words have each count, so that tasks send listed words alone.
    """
    held, least = 0, None
    for c, words in vocabulary.groupBy("c").count().orderBy(F.desc("c")).limit(limit).collect():
        held += words
        if held > limit:
            break
        least = c
    if least is None:
        return []
    return sorted(vocabulary.where(F.col("c") >= least).limit(limit).collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def held_out_fold(fold: int = 2, modulus: int = 7):
    return F.coalesce(crc32_mod("doc_id", modulus) == fold, F.lit(False))


def train(docs: DataFrame, fold: int = 2, modulus: int = 7) -> Model:
    """The model of the rows of docs(doc_id, text) that are not held out."""
    texts = docs.where(~held_out_fold(fold, modulus)).select("text")
    counted = texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    vocabulary = cut(counted.mapInArrow(hash_words, "hash long, tail int, c long, word binary"))
    n, v = (int(x or 0) for x in vocabulary.agg(F.sum("c"), F.count("*")).first())
    top = most_frequent(vocabulary, LISTED)
    listed, counts = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], float)
    classes, g, risen = cluster(cut(texts.mapInArrow(encoder(listed), "ids binary")), len(listed))
    share = g.sum(0) / max(g.sum(), 1)
    share = (share + 1e-6) / (share + 1e-6).sum()
    transition = np.log10((g + PRIOR * share) / (g.sum(1, keepdims=True) + PRIOR))
    mine = classes[: len(listed)]
    room = np.zeros(ALL)
    for r in vocabulary.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).limit(TAIL).collect():
        room[CLASSES + r["tail"]] = r["c"] + r["v"]
    np.subtract.at(room, CLASSES + np.array([r["tail"] for r in top], np.int64), counts + 1)  # listed words count in their own class
    emission = np.log10(counts / np.bincount(mine, counts, minlength=ALL)[mine])
    return Model(listed, counts, classes, transition, emission, room + 1, n, v, vocabulary.select("hash", "c"), risen)


def perplexity_scores(docs: DataFrame, fold: int = 2, modulus: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs."""
    m = train(docs, fold, modulus)
    rows, tail = scorer(m.listed, m.counts, m.classes, m.transition, m.emission, np.log10(m.room), float(np.log10(m.tokens + m.distinct + 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    scored = keyed.mapInArrow(rows, f"key long, doc_id {kind}, n_tokens long, n_known long, base double, model double")
    unlisted = keyed.select("key", "text").mapInArrow(tail, "key long, word long, n long")
    rest = unlisted.join(m.vocabulary.withColumnRenamed("hash", "word"), "word").groupBy("key").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("s"))
    again = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")  # rows of one key count together in `rest`
    rest = rest.join(again, "key", "left").select("key", *((F.col(c) / F.coalesce("m", F.lit(1))).alias(c) for c in ("k", "s")))
    k, s = F.coalesce("k", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    out = scored.join(rest, "key", "left").withColumn("score", F.col("model") + s)
    return out.select(
        "doc_id", held_out_fold(fold, modulus).alias("held_out"), "n_tokens", (F.col("n_known") + k).cast("long").alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + s).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
