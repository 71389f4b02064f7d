"""Token alignment against a plain recount with the whole-text tokenizers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from jobweave.llm import alignment

SCHEMA = "doc_id long, text string, a int, row string, count int, links string"
ODD = [
    None, "", " ", "  ", "\n", "a  b", "\n\nx\n y", "tab\tx", "é日本 x　y", "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b", "▁", " lead", "trail  ", "\x1c a!\x1cb", "don't I'll  x\r\n\r\nz", "\r",
    " a b", "é ﬁ", "\x00a b", "!\x85!", "👍🏽 a", "ⅷ ½x", "x" * 5000, "word " * 8000, "a ;\r b", " x  　y", "same text", "same text",
]


def texts():
    rng = random.Random(5)
    words = ["stone", "Fluß", "rivière", "the", "of", "and", "in2024", "e.g.", "naïve", "日本", "\n", "\t", " ", "don't", "x=1;", "🙂", "über", "\r\n", "…", "ſtrange"]
    return ODD + [" ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(200)]


@pytest.fixture(scope="module")
def plain():
    """doc -> (n_a, n_b, groups as lists of ids, links), from tokenizers run on whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    words = alignment.Words(*alignment.tokenizer_paths())
    out = []
    for text in texts():
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = words.b.encode(text) if text else []
        raw = f" {text}".encode() if text else b""
        p, q = [words.a_bytes[i] for i in x], [words.b_bytes[i] for i in y]
        if b"".join(p) != raw or b"".join(q) != raw:
            x, y, p, q = [], [], [], []
        ends = [np.cumsum([len(t) for t in part]).tolist() for part in (p, q)]
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in both:
            u, v = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((x[i:u], y[j:v]))
            i, j = u, v
        out.append((len(x), len(y), groups, [(g[0][-1], g[1][-1]) for g in groups]))
    return out


@pytest.mark.parametrize("sent", [alignment.BROADCAST_ROWS, 0])
def test_equals_a_plain_recount(spark, plain, monkeypatch, sent):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", sent)
    rows = [(i if i % 50 else None, t, 1, "r", 2, "l") for i, t in enumerate(texts())]
    got = alignment.scored(spark.createDataFrame(rows, SCHEMA)).collect()
    counts = Counter(link for p in plain for link in p[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for (i, *_), (n_a, n_b, groups, links) in zip(rows, plain, strict=True):
        line = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        want.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_words_are_forgotten_and_learned_again(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").coalesce(1)
    once = sorted(map(tuple, alignment.scored(rows).collect()))
    words = alignment.Words(*alignment.tokenizer_paths())
    long = [t for t in texts() if t]
    units = [words.units(f" {t}") for t in long]
    first = [x.tolist() for x in words.tokens(units)]
    words.clear()
    for own in units[::-1]:
        words.tokens([own])
    assert [x.tolist() for x in words.tokens(units)] == first and len(once) == len(texts())


def test_empty_table(spark):
    made = alignment.scored(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0 and made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_repeated_words_are_aligned_once():
    """What goes to Spark for the same text again is its words by number, not their tokens."""
    import pyarrow as pa

    rng = random.Random(7)
    text = " ".join("".join(rng.choice("bcdfghjkxz") for _ in range(9)) for _ in range(400))
    run = alignment.tokeniser(*alignment.tokenizer_paths())
    once, often = (sum(b.nbytes for b in run(iter([pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": [text] * n})]))) for n in (1, 50))
    assert often < 10 * once


def test_words_of_other_lists_and_parts(spark):
    """Texts whose words fill several lists, a word that is not given back in one of them, and words of a text before."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubdst") for _ in range(rng.randint(1, 8))) + rng.choice(["", ".", "é"]) for _ in range(3 * alignment.TOGETHER + 1)]
    long = [" ".join(words), " ".join(words[::-1]), " ".join([*words, "a▁b"]), words[-1], " ".join(words[: alignment.TOGETHER])]
    alone = [tuple(r) for t in long for r in alignment.aligned(spark.createDataFrame([(0, t)], "doc_id long, text string"), *alignment.tokenizer_paths()).collect()]
    made = alignment.aligned(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").coalesce(1), *alignment.tokenizer_paths()).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in made] == [r[1:] for r in alone]
    assert made[2].n_a == 0 and made[2].line == "" and made[0].line.split(";")[::-1] != made[1].line.split(";")
    assert made[3].line == ";".join(made[0].line.split(";")[-len(made[3].line.split(";")) :])
