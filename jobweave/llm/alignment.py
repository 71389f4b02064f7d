"""Cross-tokenizer alignment: where the tokens of two tokenizers end together in the bytes of a text.

Python only tokenises: a part of the texts becomes the texts as numbers of words, and for each distinct word of the part, in
lists of TOGETHER words, ids and end offsets of both tokenizers. The rest is Spark's higher-order functions on those arrays:
array_intersect of the ends gives the places that cut both sequences into groups, marks are
sorted in after the tokens that end elsewhere, the ids' text is split where there is no mark, a text's groups are those of its
words, and the last two tokens of a group are a link. Links are counted corpus-wide after partial sums in each task; the counts are sent to all executors if there are at most
BROADCAST_ROWS distinct groups, and meet the groups by a shuffle above, where these are summed for each row first and Spark
splits a popular one. Tokens are never stored, groups are, as a compressed table in the shared checkpoint folder.

A word with the white space before it is aligned once in each part of BATCH characters and tokenised once while a worker
keeps it, up to CACHE tokens at a time: neither tokenizer's tokens cross from other characters to white space after them, so
both end with a word, and so does a group. That holds for A's pattern and is read off the
pieces of B when they are loaded; texts with white space that B's pieces cross, such as a carriage return, are one word.

Defined cases: texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens, all counts
0 and an empty hash. Rows are aligned each, those that repeat or lack a doc_id too, and counted each. Long texts are
tokenised whole. Tied counts of a B id are all its best. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from jobweave.llm.common import cut, release, stored

#: Distinct groups up to which the counts of their links are sent to all executors.
BROADCAST_ROWS = 1_000_000
#: Tokens of kept words in a worker's memory; words looked up together; words aligned as one list; characters of texts that share their words.
CACHE, LEARNED, TOGETHER, BATCH = 1_500_000, 1 << 14, 1 << 8, 1 << 21
#: Bits of a token id in numbers that hold an end and an id. Marks are no ids: of a token's end within a group, of a word's end.
BITS = 17
MARK, STOP = (1 << BITS) - 1, (1 << BITS) - 2
# Fixed value: Unicode's White_Space.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows up to the next.
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Words:
    """Ids and byte lengths of both tokenizers for units of text, each tokenised once while it is kept."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path_a, "rb") if line.strip())}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.first = self.b.piece_to_id("▁")
        own = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        #: White space that a piece of B has after other characters, or after the blank that B puts first: texts with it stay whole.
        self.crossing = {c for p in own for c in re.findall(f"(?<=[^{BLANK}])[{BLANK}]|(?<= )[{BLANK.replace(' ', '')}]", p)}
        self.clear()

    def clear(self) -> None:
        """Forgets all units. Unit k of A or B has the n[k] ids and ends (within the unit) from at[k] on."""
        self.number: dict[str, int] = {}
        self.good, self.sizes = np.zeros(0, bool), np.zeros(0, np.int64)
        self.per = [[np.zeros(0, np.int64) for _ in range(4)] for _ in range(2)]

    def units(self, text: str) -> list[str]:
        return [text] if any(c in text for c in self.crossing) else UNIT.findall(text)

    def learn(self, units: list[str]) -> None:
        """Tokenises units that are not known yet, A in one run over all that end before other white space begins."""
        blank = [u for u in units if u[-1] in BLANK]
        apart = len(units) - len(blank)
        units = [u for u in units if u[-1] not in BLANK] + blank if blank else units
        a = [self.a.encode_ordinary("".join(units[:apart])), *map(self.a.encode_ordinary, units[apart:])]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, u in enumerate(units):
            if u == " ":
                b[k] = [self.first]
            elif u[0] != " " and b[k][:1] == [self.first]:
                b[k] = b[k][1:]
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        upto = np.cumsum(sizes)
        good = np.array(["▁" not in u for u in units], bool)
        for k, (ids, table) in enumerate(((chain.from_iterable(a), self.a_bytes), (chain.from_iterable(b), self.b_bytes))):
            ids = list(ids)
            parts = [table[i] for i in ids]
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            if k == 0:  # bytes of A are those of the text, so a unit's tokens are those that end in it
                n = np.diff(np.searchsorted(ends, upto, "right"), prepend=0)
            else:
                n = np.fromiter(map(len, b), np.int64, len(b))
                if b"".join(parts) != b"".join(raw):
                    at = np.cumsum(n) - n
                    good &= np.array([b"".join(parts[i : i + m]) == r for i, m, r in zip(at.tolist(), n.tolist(), raw, strict=True)], bool)
            at = np.cumsum(n) - n
            ends -= np.repeat(np.r_[0, ends][at], n)
            old = self.per[k]
            counts = np.r_[old[3], n]
            self.per[k] = [np.r_[old[0], np.array(ids, np.int64)], np.r_[old[1], ends], np.cumsum(counts) - counts, counts]
        self.number.update(zip(units, range(len(self.good), len(self.good) + len(units)), strict=True))
        self.good, self.sizes = np.r_[self.good, good], np.r_[self.sizes, sizes]

    def tokens(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of texts as units: where each one's tokens of A begin, their ends, their ids, and the same for B. Learns new units."""
        of = np.fromiter(map(len, texts), np.int64, len(texts))
        units = list(chain.from_iterable(texts))
        found = list(map(self.number.get, units))
        fresh = {u for u, k in zip(units, found, strict=True) if k is None}
        if fresh:
            self.learn(list(fresh))
            found = map(self.number.__getitem__, units)
        k = np.fromiter(found, np.int64, len(units))
        text = np.repeat(np.arange(len(texts)), of)
        bad = np.zeros(len(texts), bool)
        bad[text[~self.good[k]]] = True
        k, text = k[~bad[text]], text[~bad[text]]
        sizes, out = self.sizes[k], []
        start = np.cumsum(sizes) - sizes
        start -= np.r_[start, 0][np.searchsorted(text, text)]  # from the text's begin
        for ids, ends, at, n in self.per:
            m = n[k]
            upto = np.cumsum(m)
            take = np.repeat(at[k] - (upto - m), m) + np.arange(m.sum())
            per_text = np.bincount(text, weights=m, minlength=len(texts)).astype(np.int64)
            out += [np.r_[0, np.cumsum(per_text)], ends[take] + np.repeat(start, m), ids[take]]
        return out


WORDS: dict[tuple[str, str], Words] = {}


def spelled(words: Words, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For A and for B: how many tokens each unit has, their ends in all units one after another, their ids."""
    parts = []
    for k in range(0, len(units), LEARNED):
        if len(words.per[0][0]) > CACHE:
            words.clear()
        parts.append(words.tokens([[u] for u in units[k : k + LEARNED]]))
    out, start = [], np.zeros(0, np.int64)
    for k in (0, 3):
        n, ends, own = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.diff(p[k]) for p in parts], [p[k + 1] for p in parts], [p[k + 2] for p in parts]))
        if k == 0:  # a unit ends with its last token, of A as of B
            sizes = np.zeros(len(units), np.int64)
            sizes[n > 0] = ends[np.cumsum(n)[n > 0] - 1]
            start = np.cumsum(sizes) - sizes
        out.append((n, ends + np.repeat(start, n), own))
    return out


def tokeniser(path_a: str, path_b: str):
    """Batches of (doc_id, text) to rows of texts, which are numbers of words, and the tokens of these words, each word once."""

    def listed(first: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values, type=pa.list_(pa.field("element", values.type, nullable=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WORDS.get((path_a, path_b)) or WORDS.setdefault((path_a, path_b), Words(path_a, path_b))
        for batch in batches:
            texts, ids = batch["text"], batch["doc_id"]
            at = 0
            while at < len(texts):  # parts of bounded size, whose words are aligned together
                number: defaultdict[str, int] = defaultdict(count().__next__)
                upto, size, found, of = at, 0, array("i"), []
                while upto < len(texts) and size < BATCH:
                    text, before = texts[upto].as_py() or "", len(found)  # one by one: all of a batch take much memory
                    found.extend(map(number.__getitem__, words.units(f" {text}") if text else ()))
                    of.append(len(found) - before)
                    size += len(text)
                    upto += 1
                (n_a, a_ends, a), (n_b, b_ends, b) = spelled(words, list(number))
                k, text = np.frombuffer(found, np.int32), np.repeat(np.arange(len(of)), of)
                whole = np.ones(len(of), bool)
                whole[text[n_a[k] == 0]] = False  # a word that is not given back
                k, text = k[whole[text]], text[whole[text]]
                lengths = [np.bincount(text, weights=n[k], minlength=len(of)).astype(np.int64) for n in (n_a, n_b)]
                own = listed(np.r_[0, np.cumsum(np.bincount(text, minlength=len(of)))], pa.array(np.cumsum(n_a > 0)[k] - 1, pa.int32()))
                rows = pa.StructArray.from_arrays([ids.slice(at, upto - at), *map(pa.array, lengths), own], names=["doc_id", "n_a", "n_b", "words"])
                known = np.flatnonzero(n_a)
                cuts = np.r_[known[::TOGETHER], len(n_a)]
                first = [np.r_[0, np.cumsum(n)][cuts] for n in (n_a, n_b)]
                inner = np.ones(len(known), bool)  # a list's last word needs no mark
                inner[np.r_[TOGETHER - 1 : len(known) : TOGETHER, len(known) - 1 : len(known)]] = False
                lists = [(first[0], a_ends), (first[0], a_ends << BITS | a), (first[1], b_ends), (first[1], b_ends << BITS | b)]
                lists.append((np.r_[0, np.cumsum(inner)][np.r_[0 : len(known) : TOGETHER, len(known)]], a_ends[np.cumsum(n_a)[known] - 1][inner]))
                spelt = pa.StructArray.from_arrays([listed(f, pa.array(x, pa.int64())) for f, x in lists], names=["a_ends", "a", "b_ends", "b", "stops"])
                yield pa.RecordBatch.from_arrays([listed([0, len(c)], c) for c in (rows, spelt)], names=["texts", "spelt"])
                release()
                at = upto

    return run


def marks(ends: str | Column, mark: int) -> Column:
    """Numbers that are sorted in after the tokens with these ends."""
    return F.transform(ends, lambda e: F.shiftleft(e, BITS).bitwiseOR(F.lit(mark).cast("long")))


def grouped(tokens: Column, within: Column) -> Column:
    """The ids of each group as text, joined by commas: tokens that end within a group have a mark sorted in after them."""
    numerals = F.sequence(F.lit(0), F.lit(MARK)).cast("array<string>")  # a constant: looking a number up is cheaper than writing it out
    ids = F.transform(F.sort_array(F.concat(tokens, marks(within, MARK))), lambda x: F.get(numerals, x.bitwiseAND(F.lit(MARK).cast("long")).cast("int")))
    text = F.replace(F.array_join(ids, ";"), F.lit(f";{MARK};"), F.lit(","))
    return F.split(F.replace(text, F.lit(f";{STOP};"), F.lit("\n;")), ";")


def words_of(spelt: Column) -> Column:
    """The groups of each word of a list as one text, `a1,a2|b1;a3|b2`."""
    b = F.concat(spelt["b"], marks(spelt["stops"], STOP))  # a word's last group ends with a line feed
    own = grouped(spelt["a"], F.array_except(spelt["a_ends"], spelt["common"])), grouped(b, F.array_except(spelt["b_ends"], spelt["common"]))
    return F.split(F.array_join(F.zip_with(*own, lambda x, y: F.concat(x, F.lit("|"), y)), ";"), "\n;")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, line) of each row of docs(doc_id, text); a line is its groups, `a1,a2|b1;a3|b2,b3`."""
    numbers = ArrayType(LongType(), containsNull=False)  # without nulls they are sorted as they are
    text = StructType([*(StructField(c, LongType()) for c in ("doc_id", "n_a", "n_b")), StructField("words", ArrayType(IntegerType(), containsNull=False))])
    spelt = StructType([StructField(c, numbers) for c in ("a_ends", "a", "b_ends", "b", "stops")])
    kinds = StructType([StructField("texts", ArrayType(text, containsNull=False)), StructField("spelt", ArrayType(spelt, containsNull=False))])
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokeniser(path_a, path_b), kinds)
    with_common = F.transform("spelt", lambda s: s.withField("common", F.array_intersect(s["a_ends"], s["b_ends"])))
    words = F.flatten(F.transform(with_common, words_of))

    def put_together(words: Column) -> Column:
        return F.transform("texts", lambda t: F.struct(t["doc_id"], t["n_a"], t["n_b"], F.array_join(F.transform(t["words"], lambda k: F.get(words, k)), ";").alias("line")))

    # in an array of one, so that Spark works the words out once and not at each place that reads them
    return parts.select(F.inline(F.get(F.transform(F.array(words), put_together), F.lit(0)))).toDF("doc_id", "n_a", "n_b", "line")


def link(group: str) -> Column:
    """The last two tokens of a group: `a2|b2`."""
    g = F.col(group)
    ends = F.concat(F.substring_index(F.substring_index(g, "|", 1), ",", -1), F.lit("|"), F.substring_index(F.substring_index(g, "|", -1), ",", -1))
    return F.when(F.contains(g, F.lit(",")), ends).otherwise(g)


def scored(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs."""
    a, b = tokenizer_paths()
    rows = aligned(docs, path_a or a, path_b or b)
    groups = F.when(F.col("n_a") > 0, F.split("line", ";")).otherwise(F.array().cast("array<string>"))
    hashed = F.when(F.col("n_a") > 0, F.sha2("line", 256)).otherwise("").alias("groups_sha256")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", hashed, groups.alias("groups"))
    rows = stored(rows.withColumn("n_groups", F.size("groups")))
    held = cut(rows.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n")).withColumn("link", link("g")))
    counts = held.groupBy("link").agg(F.sum("n").alias("count")).withColumn("b", F.substring_index("link", "|", -1))
    counts = cut(counts)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "b").select("link", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    counts = cut(held.select("g", "link").join(counts, "link").select("g", "count", "best"))
    links = rows.select("row", F.explode("groups").alias("g"))
    if counts.count() <= BROADCAST_ROWS:
        met = links.join(F.broadcast(counts), "g").groupBy("row").agg(F.sum("count").alias("count_sum"), F.sum("best").alias("n_best"))
    else:  # a group goes over the network once for each row that has it
        met = links.groupBy("row", "g").agg(F.count("*").alias("times")).join(counts, "g")
        met = met.groupBy("row").agg(F.sum(F.col("count") * F.col("times")).alias("count_sum"), F.sum(F.col("best") * F.col("times")).alias("n_best"))
    whole = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(met, "row", "left").withColumn("n_links", F.col("n_groups"))  # a group has one link
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return whole.select("doc_id", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in numbers), "groups_sha256")
