"""Best-fit packing of tokenized documents into sequences, by local search with swaps.

Documents become token ids plus an end id, and only those over the limit are cut into pieces. Pieces are dealt to
groups of about GROUP tokens. In a group, pieces first go in the order they come, each into the fullest bin with room;
then local search takes the emptiest bin and gives its tokens to fuller ones: it moves a piece, or exchanges one for a
smaller one, or two for one smaller than both together, whichever raises the sum of squared fills most. Each step
raises that sum, so the search ends; bins that run empty go. Bins that stay underfull are opened again and searched
with those of other groups. Only lengths meet in groups; token ids stay where they are read.

Defined cases: a null or empty text is one piece holding the end id alone. Rows that repeat a doc_id are packed each,
and are spread over the groups like all others; so are rows without one. Extra columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import cut, release

LIMIT, END_ID = 4096, 1
#: Tokens of a group; bins filled below this share are packed again with other groups' bins.
GROUP, OPEN_BELOW = 1 << 20, 0.99
#: Words whose ids a worker keeps, at most: half of them of late, the other half from before.
CACHE = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters of a chunk of texts, whose words are looked up together, each once.
CHUNK = 4 << 20
#: A word that ends in ASCII marks after a letter or digit: the tokenizer cuts it there too.
MARKED = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)\Z", re.S)
MARKS = frozenset(bytes([c]) for c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Words of lower-case ASCII and Latin-1 letters, digits and marks, which the tokenizer's normalizer leaves as they are.
PLAIN = re.compile(rb"(?:[!-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordIds:
    """Token ids as little-endian 32-bit numbers. The tokenizer never joins bytes across white space, so each word
    between blanks has ids of its own, and those of words seen of late are kept: when there are many, those that haven't
    come again since the time before are given up, so that frequent words stay."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.of, self.before = Tokenizer.from_file(path), {}, {}
        #: The same without normalizer and special tokens, for plain words.
        self.tokenizer = Tokenizer(self.whole.model)
        self.tokenizer.pre_tokenizer = self.whole.pre_tokenizer

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.of) > CACHE // 2:
            self.of, self.before = {}, self.of
        of, before = self.of, self.before
        split, rest = {}, set()
        for w in {w for words in texts for w in words if w not in of}:
            if (ids := before.get(w)) is not None:
                of[w] = ids
            elif w[-1:] in MARKS and (m := MARKED.match(w)) and b"<|" not in w:
                split[w] = m.groups()
                rest.update(split[w])
            else:
                rest.add(w)
        apart: tuple[list[bytes], list[bytes]] = ([], [])
        for w in rest.difference(of):
            apart[b"<|" not in w and PLAIN.fullmatch(w) is not None].append(w)
        for tokenizer, words in zip((self.whole, self.tokenizer), apart, strict=True):
            for at in range(0, len(words), 1 << 14):
                some = words[at : at + (1 << 14)]
                coded = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                of.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, coded, strict=True))
        of.update((w, of[a] + of[b]) for w, (a, b) in split.items())

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.of.__getitem__, words))


@cache
def coder_of(path: str) -> WordIds:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    return WordIds(path)


def words_of(text: pa.Array) -> pa.ListArray:
    """Words between blanks, in the lower case that the tokenizer gives ASCII; texts that may hold special tokens as they are."""
    text = pc.fill_null(text, "")
    special = pc.match_substring(text, "<|")
    return pc.ascii_split_whitespace(pc.if_else(special, text, pc.ascii_lower(text)))


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to CHUNK bytes of text, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def cutter(path: str, limit: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        end = END_ID.to_bytes(4, "little")
        for whole in batches:
            for batch in chunks(whole):
                words = words_of(batch["text"])
                coded = words.values.dictionary_encode()
                known = coded.dictionary.cast(pa.binary()).to_pylist()
                coder.learn([known])
                every = pa.array(map(coder.of.__getitem__, known), pa.large_binary(), size=len(known)).take(coded.indices)
                del known, coded
                at = np.frombuffer(every.buffers()[1], np.int64)[words.offsets.to_numpy()].tolist()
                every = memoryview(every.buffers()[2] or b"")
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(batch.num_rows):
                    raw = bytes(every[at[i] : at[i + 1]]) + end
                    for k, a in enumerate(range(0, len(raw), 4 * limit)):
                        part = raw[a : a + 4 * limit]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                arrays = {
                    "doc_id": batch["doc_id"].take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    arrays["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(arrays)
                del batch, words, every, arrays
            del whole
            release()
        release()

    return pieces


def first_places(sizes: list[int], limit: int) -> list[int]:
    """A bin for each piece, in the order given: the fullest with room, else a new one."""
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    out, bins = [], 0
    for size in sizes:
        k = bisect_left(room, (size, -1))
        left, at = room.pop(k) if k < len(room) else (limit, bins)
        bins += at == bins
        out.append(at)
        if left > size:
            insort(room, (left - size, at))
    return out


def gain(have: np.ndarray, theirs: np.ndarray, room: np.ndarray, fuller: np.ndarray) -> tuple[int, int, int]:
    """Of exchanges of one of `have` (sorted) for one of `theirs`, that which raises the squared fill most.

    `room` is what the other bin has left and `fuller` by how much it is fuller than the giving one. Returns the raise,
    which of `have` and which of `theirs`.
    """
    k = np.searchsorted(have, theirs + room, "right") - 1  # the largest that their bin has room for
    more = np.where(k >= 0, have[k] - theirs, 0)
    raised = np.where((more > 0) & (fuller + more > 0), 2 * more * (fuller + more), 0)
    j = int(raised.argmax())
    return int(raised[j]), int(k[j]), j


def searched(sizes: list[int], places: list[int], limit: int) -> list[int]:
    """The places after local search; bins that ran empty are no longer named."""
    size, at = np.array(sizes, np.int64), np.array(places, np.int64)
    fill = np.bincount(at, size).astype(np.int64)
    least, used = -(-int(size.sum()) // limit), len(fill)

    def step(source: int) -> bool:
        """One step that takes tokens from `source`; whether there was one."""
        own = np.flatnonzero(at == source)
        own = own[np.argsort(size[own], kind="stable")]
        room = limit - fill
        room[source] = -1
        whole = np.where((fill > 0) & (room >= size[own[0]]), np.searchsorted(size[own], room, "right"), 0)
        if whole.any():  # a piece moves
            piece = own[np.maximum(whole - 1, 0)]
            better = np.where(whole > 0, size[piece] * (fill - fill[source] + size[piece]), -1)
            target = int(better.argmax())
            if better[target] > 0:
                moved = piece[target]
                at[moved] = target
                fill[target] += size[moved]
                fill[source] -= size[moved]
                return True
        others = np.flatnonzero((at != source) & (room[at] > 0))
        if not len(others):
            return False
        theirs, free, fuller = size[others], room[at[others]], fill[at[others]] - fill[source]
        best, k, j = gain(size[own], theirs, free, fuller)
        out = [own[k]]
        if len(own) > 1:
            a, b = np.triu_indices(len(own), 1)
            both = size[own[a]] + size[own[b]]
            order = np.argsort(both, kind="stable")
            pair, k, i = gain(both[order], theirs, free, fuller)
            if pair > best:
                best, j, out = pair, i, [own[a[order[k]]], own[b[order[k]]]]
        if not best:
            return False
        back = others[j]
        target = at[back]
        at[out], at[back] = target, source
        more = size[out].sum() - size[back]
        fill[target] += more
        fill[source] -= more
        return True

    emptied = True
    while emptied and used > least:
        emptied = False
        for source in np.argsort(fill, kind="stable"):
            if not 0 < fill[source] < limit:
                continue
            while fill[source] and step(source):
                pass
            if not fill[source]:
                emptied, used = True, used - 1
                if used == least:
                    break
    return at.tolist()


def squared_fill(sizes: list[int], places: list[int]) -> int:
    return int((np.bincount(places, sizes) ** 2).sum())


def packer(limit: int, level: int):
    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = group["length"].to_pylist()
        places = np.array(searched(sizes, first_places(sizes, limit), limit))
        order = np.argsort(places, kind="stable")
        size, place = np.array(sizes)[order], places[order]
        before = np.cumsum(size) - size
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - before[np.searchsorted(place, place)]
        full = np.bincount(places, sizes)[places] >= OPEN_BELOW * limit
        keep = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        sequence = places + ((2 * key[0].as_py() + level) << 20)
        return keep.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset)).append_column("full", pa.array(full))

    return pack


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cutter(path, limit, with_ids), schema)


def packed(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for docs(doc_id, text)."""
    rest = cut(pieces(docs, path, limit))
    schema = ", ".join(f"{c} {k}" for c, k in rest.dtypes) + ", sequence_id long, offset long, full boolean"
    done = []
    for level in (0, 1):
        groups = max(1, (rest.agg(F.sum("length")).first()[0] or 0) // GROUP)
        spread = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # of stored rows, so a lost task deals alike
        dealt = rest.withColumn("g", F.pmod(spread, F.lit(groups)))
        placed = dealt.groupBy("g").applyInArrow(packer(limit, level), schema)
        if level == 0:
            placed = cut(placed)
            done.append(placed.where("full"))
            rest = placed.where("not full").drop("sequence_id", "offset", "full")
        else:
            done.append(placed)
    return done[0].unionByName(done[1]).drop("full")
