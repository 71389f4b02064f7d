"""Exact repeated-substring removal over a corpus with linear-grouping suffix arrays.

A byte is removed if a LENGTH-byte string that covers it also starts earlier: in an earlier document, or earlier in the
same one. Documents come in the order of doc_id, those without one last, and among equal ids in the order of their
texts' digests. The suffix arrays decide every removal; what comes before only brings equal strings together in bounded
groups:

1. every LENGTH-byte window belongs to the least hash of its K-byte substrings (its anchor); runs of windows with one
   anchor are one string, and only strings whose anchor occurs twice in the corpus go on;
2. strings are grouped by anchor and suffix-sorted by `grouping_suffix_array` over symbols of a few bytes; windows with
   equal ranks to their depth are equal, and all but the earliest are removed. Of copies of one string, the earliest
   and one that stands for all the later ones are sorted;
3. anchors with over HOT places go on as single windows, of which each block of documents sends every one once.

Of equal texts the first goes this way. The second is sorted beside it in pieces, and what the sort removes from it goes
from all further ones. No group holds more than HOT strings or two rows for each block of documents, whatever the skew.

Defined cases: a null text is empty; a text under LENGTH bytes loses nothing. Each row is a document: rows that repeat
or lack a doc_id are judged each. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import cut, mix64, release, single

LENGTH, K = 100, 32
HOT, LONGEST_RUN = 4096, 4096
#: Text bytes in a block of documents, text bytes for each group of anchors, and bytes that are suffix-sorted at once.
BLOCK, ANCHORS, SORTED = 8 << 20, 16 << 20, 1 << 18
U64 = np.uint64


def grouping_suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol is unique and smallest, in linear time and without recursion.

    First, suffixes are grouped by their longest Lyndon prefix: groups are processed from the greatest down. When a
    group is processed, the previous-smaller pointer of each member is final, and the positions pointed to leave their
    own group for a new one right above it, those with more pointers higher. Then the order is emitted from the least
    suffix up: the position before each emitted one, and the chain of pointers from there, take the next place of
    their groups.
    """
    n = len(s)
    symbols = np.asarray(s)
    order = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.r_[True, symbols[order][1:] != symbols[order][:-1]])
    sizes = np.diff(np.r_[heads, n])
    at = np.empty(n, np.int64)
    at[order] = np.repeat(heads, sizes)
    group: list[int] = at.tolist()  # the first place of the group of each position
    members: dict[int, list[int]] = {}  # of groups that are not from the beginning
    ends, many = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    ends[heads + sizes], many[heads] = heads, sizes
    start_of_end, size, at_first, listed = ends.tolist(), many.tolist(), many.tolist(), order.tolist()
    prev = [-1] * n
    end = n
    while end > 0:
        g = start_of_end[end]
        end = g
        m = at_first[g]
        if m == 1:
            here = listed[end : end + 1]
        else:
            here = [i for i in (listed[g : g + m] if m else members.pop(g)) if group[i] == g]
            if len(here) > 1:
                here.sort()
        if len(here) == 1:
            i = here[0]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = prev[p]
            prev[i] = p
            if p >= 0 and size[group[p]] > 1:  # it leaves its group alone
                h = group[p]
                top = h + size[h]
                new = top - 1
                size[h] -= 1
                size[new] = 1
                start_of_end[top], start_of_end[new] = new, h
                group[p] = new
                members[new] = here
                here[0] = p
            continue
        if len(here) == 2:  # as below, without counting
            i, j = here
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            q = j - 1
            while q >= 0 and group[q] >= g:
                q = prev[q]
            prev[j] = q
            if p >= 0 and p != q and q >= 0 and group[p] == group[q]:
                h = group[p]
                if size[h] > 2:
                    top = h + size[h]
                    new = top - 2
                    size[h] -= 2
                    size[new] = 2
                    start_of_end[top], start_of_end[new] = new, h
                    group[p] = group[q] = new
                    members[new] = [p, q]
                continue
            for p in (p, q) if p != q else (p,):
                if p >= 0 and size[group[p]] > 1:
                    h = group[p]
                    top = h + size[h]
                    new = top - 1
                    size[h] -= 1
                    size[new] = 1
                    start_of_end[top], start_of_end[new] = new, h
                    group[p] = new
                    members[new] = [p]
            continue
        count: dict[int, int] = {}
        for i in here:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        moves: dict[int, list[int]] = {}
        for p, c in count.items():
            if c in moves:
                moves[c].append(p)
            else:
                moves[c] = [p]
        for c in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            of: dict[int, list[int]] = {}
            for p in moves[c]:
                h = group[p]
                if h in of:
                    of[h].append(p)
                else:
                    of[h] = [p]
            for h, leaving in of.items():
                m = len(leaving)
                if m == size[h]:
                    continue  # all of a group stays where it is
                top = h + size[h]
                new = top - m
                size[h] -= m
                size[new] = m
                start_of_end[top], start_of_end[new] = new, h
                for p in leaving:
                    group[p] = new
                members[new] = leaving
    out, place, free = [0] * n, [False] * n, list(range(n))
    out[0], place[n - 1] = n - 1, True
    for j in out:  # which is filled on the way
        j -= 1
        while j >= 0 and not place[j]:
            g = group[j]
            k = free[g]
            out[k] = j
            free[g] = k + 1
            place[j] = True
            j = prev[j]
    return out


def extreme(of: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest of every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def substring_hashes(raw: bytes) -> np.ndarray:
    """A hash of every K-byte substring (K a power of two)."""
    h, size = mix64(np.frombuffer(raw, np.uint8).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(7)), 1
    while size < K:
        h = h[:-size] * U64(0xD6E8FEB86659FD93) + (h[size:] ^ (h[size:] >> U64(32)))
        size *= 2
    return mix64(h)


def anchor_places(raw: bytes) -> np.ndarray:
    """The anchors of a text of LENGTH bytes at least, once for each place."""
    h, width = substring_hashes(raw), LENGTH - K + 1
    low = extreme(np.minimum, h, width)
    edge = np.zeros(width - 1, U64)
    return h[h == extreme(np.maximum, np.concatenate([edge, low, edge]), width)]


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of LENGTH bytes at least: first window, end of windows and anchor of each run with one anchor."""
    low = extreme(np.minimum, substring_hashes(raw), LENGTH - K + 1)
    edge = np.flatnonzero(low[1:] != low[:-1]) + 1
    start, end = np.r_[0, edge], np.r_[edge, len(low)]
    if (end - start).max() > LONGEST_RUN:
        start = np.concatenate([np.arange(a, b, LONGEST_RUN) for a, b in zip(start, end, strict=True)])
        end = np.r_[start[1:], len(low)]
    return start, end, low[start]


def packed(x: np.ndarray, rows: np.ndarray, column: np.ndarray, size: int) -> np.ndarray:
    """Up to 16 bytes from each row's place, as two big-endian numbers; bytes from `column` on count as 0."""
    some = x[rows[:, None] + np.arange(16)]
    some[np.arange(16)[None, :] >= column[:, None]] = 0
    return np.ascontiguousarray(some).view(">u8").astype(U64)


def repeated_windows(strings: list[bytes]) -> list[np.ndarray]:
    """For each string, which of its LENGTH-byte windows also begin in an earlier string or earlier in it."""
    size = np.array([len(s) for s in strings])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    x = np.frombuffer(b"".join(strings) + b"\0" * LENGTH, np.uint8)
    n = len(x) - LENGTH
    place = np.arange(n)
    first = np.repeat(begin, size)
    # Symbols begin after a blank, or anywhere once 16 bytes have had none: the bytes before a place alone decide.
    blank = np.where(x[:n] <= 32, place, -1)
    last = np.r_[-1, np.maximum.accumulate(blank)[:-1]]
    since = place - 1 - np.maximum(last, first - 1)
    after_blank = (since == 0) & (place > first)
    far = since >= 16
    begins = np.flatnonzero(after_blank | far)
    owner = np.repeat(np.arange(len(strings)), size)[begins]
    stop = begin + size
    length = np.minimum(np.r_[begins[1:], n], stop[owner]) - begins
    kind = far[begins]
    words = packed(x, begins, length, 16)
    by = np.lexsort((length, words[:, 1], words[:, 0], kind))
    new = np.zeros(len(by), np.int64)
    for column in (length, words[:, 1], words[:, 0], kind):
        new[1:] |= column[by][1:] != column[by][:-1]
    code = np.empty(len(by), np.int64)
    code[by] = np.cumsum(new) + len(strings) + 1
    # Each string's symbols and an end of its own, then the least symbol of all.
    counts = np.bincount(owner, minlength=len(strings))
    row = np.arange(len(begins)) + owner
    text = np.zeros(len(begins) + len(strings) + 1, np.int64)
    text[row] = code
    text[np.cumsum(counts) + np.arange(len(strings))] = np.arange(1, len(strings) + 1)
    symbol = np.full(len(text), -1)
    symbol[row] = np.arange(len(begins))
    ranked = symbol[np.array(grouping_suffix_array(text.tolist()))]
    ranked = ranked[ranked >= 0]
    common = np.zeros(len(ranked), np.int64)
    room = np.minimum(stop[owner[ranked]] - begins[ranked], LENGTH)
    for a in range(1, len(ranked), 1 << 14):
        b = min(a + (1 << 14), len(ranked))
        view = x[begins[ranked[a - 1 : b]][:, None] + np.arange(LENGTH)]
        differ = view[1:] != view[:-1]
        least = np.where(differ.any(1), differ.argmax(1), LENGTH)
        common[a:b] = np.minimum(least, np.minimum(room[a:b], room[a - 1 : b - 1]))
    common[1:][kind[ranked][1:] != kind[ranked][:-1]] = 0
    rank = np.empty(len(ranked), np.int64)
    rank[ranked] = np.arange(len(ranked))
    # A window begins with bytes up to the first symbol that its own bytes tell, and goes on to a depth in that.
    window = np.flatnonzero(place + LENGTH <= np.repeat(stop, size))
    coming = np.r_[np.minimum.accumulate(np.where(after_blank, place, n + 99)[::-1])[::-1], n + 99]
    ahead = np.minimum(coming[window + 1] - window, 16)
    head = packed(x, window, ahead, 16)
    at = rank[np.searchsorted(begins, window + ahead)]
    deep = np.empty(len(window), np.int64)
    for a in range(1, 17):
        mine = ahead == a
        if mine.any():
            deep[mine] = np.cumsum(common < LENGTH - a)[at[mine]]
    key = mix64(mix64(head[:, 0] ^ mix64(head[:, 1] + U64(1))) + (deep * 17 + ahead).astype(U64))
    exact = (deep, ahead, head[:, 1], head[:, 0])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if any((c[order][1:] != c[order][:-1])[same].any() for c in exact):  # two windows share a key by chance
        order = np.lexsort(exact)
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in exact])
    again = np.zeros(len(window), bool)
    again[order[1:]] = same
    return np.split(again, np.cumsum(np.maximum(size - LENGTH + 1, 0))[:-1])


def texts_of(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, bytes, bool]]:
    """(doc_id, tie, UTF-8 bytes, has a copy) of the texts that are worked on, in order; the second of two equal ones has an odd tie."""
    roles: dict[tuple[int, int], list[tuple[int, bool]]] = {}
    marks = right.filter(pa.compute.equal(right["kind"], 0))
    for d, t, r, c in zip(*(marks[c].to_pylist() for c in ("doc_id", "tie", "role", "copied")), strict=True):
        roles.setdefault((d, t), []).append((r, c))
    rows = [(d, t | r, k, c) for k, (d, t) in enumerate(zip(left["doc_id"].to_pylist(), left["tie"].to_pylist(), strict=True)) for r, c in roles.get((d, t), ())]
    text = left["text"]
    for d, t, k, c in sorted(rows):
        yield d, t, text[k].as_py().encode(), c


def joined(blobs: list[bytes | None], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(b for b in blobs if b), kind)


def anchors_of(groups: int):
    def list_anchors(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct anchors of a block's texts, with their counts, dealt to groups."""
        found = [np.zeros(0, U64), *(anchor_places(raw) for _, t, raw, _ in texts_of(left, right) if not t & 1)]
        anchor, count = np.unique(np.concatenate(found), return_counts=True)
        to = (anchor % U64(groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        where = np.flatnonzero(np.diff(to[order], prepend=-1)) if len(to) else np.zeros(0, np.int64)
        parts = list(zip(where, [*where[1:], len(order)][: len(where)], strict=True))
        return pa.table({
            "to": pa.array(to[order][where], pa.int64()),
            "block": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "anchors": pa.array([anchor[order[a:b]].tobytes() for a, b in parts], pa.binary()),
            "counts": pa.array([count[order[a:b]].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
        })

    return list_anchors


def judge_anchors(group: pa.Table) -> pa.Table:
    """To each block, its anchors that occur twice or more in the corpus, and which of them are hot."""
    blobs = group["anchors"].to_pylist()
    anchor, count = joined(blobs, U64), joined(group["counts"].to_pylist(), np.uint32).astype(np.int64)
    block = np.repeat(group["block"].to_numpy(), [len(b) // 8 for b in blobs])
    _, inverse = np.unique(anchor, return_inverse=True)
    total = np.bincount(inverse, count).astype(np.int64)[inverse]
    keep = np.flatnonzero(total > 1)
    keep = keep[np.argsort(block[keep], kind="stable")]
    where = np.flatnonzero(np.diff(block[keep], prepend=-1)) if len(keep) else np.zeros(0, np.int64)
    parts = list(zip(where, [*where[1:], len(keep)][: len(where)], strict=True))
    return pa.table({
        "block": pa.array(block[keep][where], pa.int64()),
        "kind": pa.array([1] * len(parts), pa.int32()),
        **{c: pa.array([None] * len(parts), pa.int64()) for c in ("doc_id", "tie", "role")},
        "copied": pa.array([None] * len(parts), pa.bool_()),
        "anchors": pa.array([anchor[keep[a:b]].tobytes() for a, b in parts], pa.binary()),
        "hot": pa.array([(total[keep[a:b]] > HOT).astype(np.uint8).tobytes() for a, b in parts], pa.binary()),
    })


def strings_of(groups: int):
    def list_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        """Strings around anchors that occur again, by anchor; around hot ones, what the block's own sort finds and each other window by its hash."""
        anchor, hot = joined(right["anchors"].to_pylist(), U64), joined(right["hot"].to_pylist(), np.uint8)
        order = np.argsort(anchor)
        anchor, hot = anchor[order], hot[order].astype(bool)
        to, by, doc, tie, pos, end, data = columns = [], [], [], [], [], [], []

        def emit(*values: object) -> None:
            for c, v in zip(columns, values, strict=True):
                c.append(v)

        local: list[tuple[int, int, int, int, bytes]] = []
        for d, t, raw, copied in texts_of(left, right):
            for a in range(0, len(raw) - LENGTH + 1, LONGEST_RUN) if copied else ():
                key = int(mix64(np.array([t | 1], U64) + U64(2 * a))[0] >> U64(1))  # pieces of equal texts meet
                b = min(a + LONGEST_RUN, len(raw) - LENGTH + 1)
                emit(groups + key % groups, key, d, t, a, b + LENGTH - 1, raw[a : b + LENGTH - 1])  # apart from anchors, as no sort may hold a place twice
            if t & 1 or not len(anchor):
                continue
            start, stop, own = runs(raw)
            at = np.minimum(np.searchsorted(anchor, own), len(anchor) - 1)
            again = anchor[at] == own
            for k in np.flatnonzero(again & hot[at]).tolist():
                a, b, key = int(start[k]), int(stop[k]), int(own[k].astype(np.int64))
                local.append((key, d, t, a, raw[a : b + LENGTH - 1]))
            others = np.flatnonzero(again & ~hot[at])
            own, starts, ends = own[others], start[others].tolist(), (stop[others] + (LENGTH - 1)).tolist()
            to += (own % U64(groups)).astype(np.int64).tolist()
            by += own.astype(np.int64).tolist()
            doc += [d] * len(own)
            tie += [t] * len(own)
            pos += starts
            end += ends
            data += [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        gone: dict[int, list[tuple[int, int]]] = {}
        local.sort(key=lambda row: row[:4])
        for k, a, b in repeats(local):
            gone.setdefault(k, []).append((a, b))
        for k, (_, d, t, p, s) in enumerate(local):
            first = np.ones(len(s) - LENGTH + 1, bool)
            for a, b in gone.get(k, ()):
                first[a:b] = False
                emit((p + a) % groups, 0, d, t, p + a, p + b + LENGTH - 1, None)
            for q in np.flatnonzero(first).tolist():
                window = s[q : q + LENGTH]
                h = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                emit(h % groups, h, d, t, p + q, p + q + LENGTH, window)
        kinds = {"to": to, "by": by, "doc_id": doc, "tie": tie, "pos": pos, "end": end}
        release()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in kinds.items()} | {"data": pa.array(data, pa.binary())})

    return list_strings


def may_repeat(s: bytes) -> bool:
    """Whether two windows of a run may be equal: then bytes that all windows hold occur again further on."""
    r = len(s) - LENGTH + 1
    return r > LENGTH - K + 1 or s.find(s[r - 1 : r - 1 + K], r) >= 0


def repeats(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Of strings as (anchor, doc_id, tie, place, bytes), in this order: (row, a, b) where its windows a to b begin earlier too.

    Strings of one anchor are sorted together. The earliest of equal strings goes into the sort, and the next one, whose
    windows stand for those of all later ones.
    """
    waiting: list[tuple[tuple[int, int, int], bytes, list[int]]] = []
    held, k = 0, 0

    def sort_some() -> Iterator[tuple[int, int, int]]:
        waiting.sort(key=lambda w: w[0])
        if not waiting:
            return
        again, gap = repeated_windows([s for _, s, _ in waiting]), np.zeros(1, np.int8)
        begin = np.cumsum([0, *(len(x) + 1 for x in again)])
        edge = np.flatnonzero(np.diff(np.concatenate([gap, *chain.from_iterable((x.view(np.int8), gap) for x in again)])))
        string = np.searchsorted(begin, edge[::2], "right") - 1
        for k, a, b in zip(string.tolist(), (edge[::2] - begin[string]).tolist(), (edge[1::2] - begin[string]).tolist(), strict=True):
            for row in waiting[k][2]:
                yield row, a, b

    while k < len(rows):
        own: dict[bytes, list[int]] = {}
        now = rows[k][0]
        while k < len(rows) and rows[k][0] == now:
            own.setdefault(rows[k][4], []).append(k)
            k += 1
        if len(own) > 1 or any(len(same) > 1 or may_repeat(s) for s, same in own.items()):
            for s, same in own.items():
                for part in (same[:1], same[1:]):
                    if part:
                        waiting.append((rows[part[0]][1:4], s, part))
                        held += len(s)
        if held >= SORTED:
            yield from sort_some()
            waiting.clear()
            held = 0
    yield from sort_some()


def find_repeats(group: pa.Table) -> pa.Table:
    """Byte ranges to remove, from all strings of some anchors."""
    group = group.sort_by([(c, "ascending") for c in ("by", "doc_id", "tie", "pos")])
    found = group.filter(pa.compute.is_null(group["data"])).select(["doc_id", "tie", "pos", "end"]).rename_columns(["doc_id", "tie", "a", "b"])
    strings = group.filter(pa.compute.is_valid(group["data"]))
    rows = list(zip(*(strings[c].to_pylist() for c in ("by", "doc_id", "tie", "pos", "data")), strict=True))
    cuts = [(*rows[k][1:3], rows[k][3] + a, rows[k][3] + b + LENGTH - 1) for k, a, b in repeats(rows)]
    columns = list(zip(*cuts, strict=True)) if cuts else [[]] * 4
    del group, strings, rows, cuts
    release()
    return pa.concat_tables([found, pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "tie", "a", "b"), columns, strict=True)})])


def remove_repeats(with_text: bool):
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        """What is left of each text that is worked on, by its digest and role."""
        cuts = right.filter(pa.compute.equal(right["kind"], 2)).sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        keys = list(zip(cuts["doc_id"].to_pylist(), cuts["tie"].to_pylist(), strict=True))
        a, b = cuts["a"].to_numpy(), cuts["b"].to_numpy()
        marks = right.filter(pa.compute.equal(right["kind"], 0))
        sha = {(d, t | r): (s, r) for d, t, r, s in zip(*(marks[c].to_pylist() for c in ("doc_id", "tie", "role", "sha")), strict=True)}
        rows = []
        for d, t, raw, _ in texts_of(left, right):
            lo, hi = bisect_left(keys, (d, t)), bisect_right(keys, (d, t))
            if lo == hi:
                continue
            edge = np.bincount(a[lo:hi], minlength=len(raw) + 1) - np.bincount(b[lo:hi], minlength=len(raw) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((*sha[d, t], int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) > 0).sum()), kept.decode(errors="ignore") if with_text else hashlib.sha256(kept).hexdigest()))
        kinds = {"sha": pa.binary(), "role": pa.int32(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string()}
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})

    return apply


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, sha, text, row): a row's place in the order of documents, its text, and all its columns."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text, 256)
    tie = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long") * 2
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select(doc_id.alias("doc_id"), tie.alias("tie"), F.unhex(sha).alias("sha"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def judged(docs: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows; the first two rows of each text as role 0 and 1; and what the sort removed, by text and role.

    A row is worked on where its doc_id and tie stand; of rows equal in both one is read, as they have one text.
    """
    digests = cut(keyed(docs).select("doc_id", "tie", "sha", F.octet_length("text").cast("long").alias("n"), F.monotonically_increasing_id().alias("at")))
    total = digests.agg(F.sum("n")).first()[0] or 0
    blocks, groups = max(1, -(-total // BLOCK)), max(1, -(-total // ANCHORS))
    block = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(blocks)).alias("block")
    place = F.row_number().over(Window.partitionBy("sha").orderBy("doc_id", "at"))  # Spark keeps two for each key before it shuffles
    first = digests.where(F.col("n") >= LENGTH).withColumn("place", place).where("place <= 2")
    copied = F.max("place").over(Window.partitionBy("sha")) > 1
    first = cut(first.select("doc_id", "tie", "sha", "at", (F.col("place") - 1).cast("int").alias("role"), copied.alias("copied")))
    read = single(keyed(docs).select("doc_id", "tie", "text"), ["doc_id", "tie"], digests)
    by_block = read.select("doc_id", "tie", "text", block).groupBy("block")
    worked = first.select(block, F.lit(0).alias("kind"), "doc_id", "tie", F.col("role").cast("long").alias("role"), "copied")
    listed = by_block.cogroup(worked.groupBy("block")).applyInArrow(anchors_of(groups), "to long, block long, anchors binary, counts binary")
    found = listed.groupBy("to").applyInArrow(judge_anchors, "block long, kind int, doc_id long, tie long, role long, copied boolean, anchors binary, hot binary")
    told = found.unionByName(worked, allowMissingColumns=True)
    strings = by_block.cogroup(told.groupBy("block")).applyInArrow(strings_of(groups * 4), "to long, by long, doc_id long, tie long, pos long, end long, data binary")
    cuts = strings.groupBy("to").applyInArrow(find_repeats, "doc_id long, tie long, a long, b long")
    own_block = F.pmod(F.xxhash64("doc_id", F.col("tie").bitwiseAND(-2)), F.lit(blocks)).alias("block")
    marks = cuts.select(own_block, F.lit(2).alias("kind"), "doc_id", "tie", "a", "b").unionByName(first.select(block, F.lit(0).alias("kind"), "doc_id", "tie", F.col("role").cast("long").alias("role"), "copied", "sha"), allowMissingColumns=True)
    left = by_block.cogroup(marks.groupBy("block")).applyInArrow(remove_repeats(with_text), "sha binary, role int, n_removed long, n_spans long, kept string")
    return digests, first, left


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs(doc_id, text)."""
    digests, first, left = judged(docs, with_text=False)
    roles = digests.join(first.select("at", "role"), "at", "left").withColumn("role", F.coalesce("role", F.lit(1)))
    both = roles.join(left, ["sha", "role"], "left")
    return both.select(
        F.when(F.col("doc_id") != (1 << 63) - 1, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(row, kept) for each row of docs: all its columns as a struct, and what is left of its text, null if all is.

    Rows equal in doc_id and text stand for each other: one is returned, since the others lose all.
    """
    digests, first, left = judged(docs, with_text=True)
    key = ["doc_id", "tie"]
    roles = digests.select(*key, "sha").distinct().join(first.where("role = 0").select(*key, F.lit(0).alias("role")), key, "left")
    changes = roles.withColumn("role", F.coalesce("role", F.lit(1))).join(left, ["sha", "role"]).select(*key, "kept")
    rows = single(keyed(docs).select(*key, "row"), key, digests.where(F.col("n") >= LENGTH))
    return rows.join(changes, key, "left").select("row", "kept")
