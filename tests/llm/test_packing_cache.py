"""The words that a packing worker keeps."""

import subprocess
import sys
from pathlib import Path

from jobweave.llm import packing


def test_frequent_words_stay(monkeypatch):
    """Past the limit, words that come again stay and the others go; ids are those of the tokenizer."""
    monkeypatch.setattr(packing, "CACHE", 200)
    coder, coded = packing.WordIds(packing.tokenizer_path()), []
    tokenizer = coder.tokenizer

    class Counted:
        def encode_batch_fast(self, words, **how):
            coded.extend(words)
            return tokenizer.encode_batch_fast(words, **how)

    coder.tokenizer = Counted()
    for n in range(40):
        words = [b"often", *(b"w%dx" % k for k in range(30 * n, 30 * n + 30))]
        coder.learn([words])
        assert coder.ids(words) == b"".join(packing.np.array(tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words)
        assert len(coder.of) + len(coder.before) <= 200 + 2 * 31
    assert coded.count("often") == 1 and coded.count("w0x") == 1


def test_plain_words_skip_the_normalizer(monkeypatch):
    """Chunks of texts give the ids of whole texts; only words that the normalizer may change go through it."""
    monkeypatch.setattr(packing, "CHUNK", 40)
    texts = [None, "", " ", "stone, and grün! stone's", "ÀÉ, é x<|endoftext|>Y", "<|ENDOFTEXT|> Zz", "\x1ca!\x1c a\x85b\xa0c", "µ. ª. ñ'S 0½", "日本。x!", "ß** ÿ. İ! ≮ é≮", "Stone grün! " * 9]
    coder, normalized = packing.WordIds(packing.tokenizer_path()), []
    whole = coder.whole

    class Counted:
        def encode_batch_fast(self, words, **how):
            normalized.extend(words)
            return whole.encode_batch_fast(words, **how)

    coder.whole = Counted()
    monkeypatch.setattr(packing, "coder_of", lambda path: coder)
    batch = packing.pa.RecordBatch.from_pydict({"doc_id": packing.pa.array(range(len(texts)), packing.pa.int64()), "text": packing.pa.array(texts)})
    assert sum(b.num_rows for b in packing.chunks(batch)) == len(texts) and all(b.num_rows == 1 or b["text"].nbytes <= 40 + 4 * 20 for b in packing.chunks(batch))
    got = [r for b in packing.cutter("", 4096, True)(iter([batch])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    for r, t in zip(got, texts, strict=True):
        assert r["ids"] == [*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
    assert "日本。x" in normalized and not {"stone", "grün", "and", "stone's", "!"} & set(normalized)


HELD = """
import re
import pyarrow as pa, pyarrow.parquet as pq
from ctypes import CDLL
import subprocess
import sys
from pathlib import Path

from jobweave.llm import packing
def mb(): return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
batches = pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(10000, columns=["doc_id", "text"])
print(sum(b.num_rows for b in packing.cutter(packing.tokenizer_path(), 4096, False)(batches)))
before = mb()
pa.default_memory_pool().release_unused(), CDLL(None).malloc_trim(0)
print(before - mb())
"""


def test_a_worker_gives_unused_memory_back():
    """Workers live on through later tasks and stages: what a task no longer uses goes back to the system."""
    root = Path(packing.__file__).parents[2]
    rows, unused = subprocess.run([sys.executable, "-c", HELD], cwd=root, check=True, capture_output=True, text=True).stdout.split()
    assert int(rows) >= 10000 and float(unused) < 10
