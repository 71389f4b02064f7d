"""Document quality from compression: zstandard dictionaries of good and bad labelled text.

For each of LEVELS, a dictionary is trained on good labelled text and one on bad. A text is cut into pieces, so short
that they can't be told by their own repetitions, and every piece is compressed on its own with both dictionaries. The
normalised difference (bad - good) / (bad + good) of the two total sizes is all that the score sees: the differences
of the levels go through a logistic curve fitted on labelled rows, which makes them one calibrated score.

Fitting reads a bounded sample: of each class, the SAMPLE labelled rows that come first by a hash of their id, as far
as they have LONGEST bytes at most (documented limits; dictionaries and curve only). Scoring reads whole texts of all
rows.

Defined cases: a null or empty text has differences 0 and gets the curve's value there. Rows of labels that are
null, contradictory or repeat a doc_id count once, as bad if any of them is bad. Without labelled rows of both
classes every score is the share of good ones (0.5 without any). Rows of docs that repeat or lack a doc_id are scored
each; texts of any length are scored whole, in pieces. Equal texts have equal scores. Extra columns are ignored by `scores`
and kept by `keep_good`; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import crc32_mod

SAMPLE, LONGEST, COMPRESSION = 2500, 1 << 15, 3
#: Bytes of a dictionary, of the pieces that it is trained on, and of the pieces that it compresses.
LEVELS = [(32 << 10, 64, 96), (64 << 10, 128, 64), (32 << 10, 256, 96)]
CUT = 0.7
#: Dictionaries of each level, good and bad, and the curve: a weight for each difference, bias last.
Model = tuple[list[tuple[bytes, bytes]], list[float]]


def cut_up(text: str | None, size: int) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def trained(texts: list[str], size: int, piece: int) -> bytes:
    """A dictionary of many small pieces, or their joined tail if there are too few to train one."""
    samples = [p for t in texts for p in cut_up(t, piece)]
    try:
        return zstandard.train_dictionary(size, samples, level=COMPRESSION).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" " * 64


def compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=COMPRESSION)
    return zstandard.ZstdCompressor(level=COMPRESSION, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress


class Differences:
    """The normalised difference of a text's compressed sizes, at each level."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]) -> None:
        self.levels = [(size, compressor(good), compressor(bad)) for (_, _, size), (good, bad) in zip(LEVELS, dictionaries, strict=True)]

    def of(self, text: str | None) -> list[float]:
        out = []
        for size, good, bad in self.levels:
            parts = cut_up(text, size)
            g, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
            out.append((b - g) / (b + g) if parts else 0.0)
        return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps on standardised features; weights for raw features, bias last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * w)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def train(docs: DataFrame, labels: DataFrame, fold: int = 2, sample: int = SAMPLE) -> Model:
    """Dictionaries and curve from labelled rows whose crc32(doc_id) mod 4 is not `fold`."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc32_mod("doc_id", 4) != fold))
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    first = [marks.where(F.col("_quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = first[0].unionByName(first[1])
    some = docs.select("doc_id", "text").where(F.octet_length("text").between(1, LONGEST)).join(F.broadcast(chosen), "doc_id")
    rows = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample).collect()
    texts = {q: [r["text"] for r in rows if r["_quality"] == q] for q in (0, 1)}
    if not texts[0] or not texts[1]:
        share = min(max(len(texts[1]) / len(rows), 1e-3), 1 - 1e-3) if rows else 0.5
        return [(b" " * 64, b" " * 64)] * len(LEVELS), [0.0] * len(LEVELS) + [float(np.log(share / (1 - share)))]
    # Half of the sample makes dictionaries whose sizes fit the curve on the other half, so that the curve sees texts
    # that its dictionaries don't hold.
    dictionaries = [(trained(texts[1][::2], size, piece), trained(texts[0][::2], size, piece)) for size, piece, _ in LEVELS]
    differences = Differences(dictionaries)
    rest = [(differences.of(t), q) for q in (0, 1) for t in texts[q][1::2] or texts[q]]
    curve = fitted(np.array([f for f, _ in rest]), np.array([q for _, q in rest], float))
    share = marks.agg(F.avg("_quality")).first()[0]
    used = np.mean([q for _, q in rest])
    curve[-1] += np.log(share / (1 - share)) - np.log(used / (1 - used))  # the sample is balanced, the rows are not
    return dictionaries, [float(v) for v in curve]


def scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the differences and the score in the place of the column _text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differences, w = Differences(model[0]), np.array(model[1])
        for batch in batches:
            x = np.array([differences.of(t) for t in batch["_text"].to_pylist()]).reshape(-1, len(LEVELS))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            at = batch.schema.get_field_index("_text")
            yield batch.append_column("differences", pa.array(list(x), pa.list_(pa.float64()))).append_column("score", pa.array(p)).remove_column(at)

    return score


def scored(docs: DataFrame, kept: list[str], model: Model) -> DataFrame:
    """(row, differences, score): the named columns of each row as a struct, and what its text gets."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("text").alias("_text"))
    return rows.mapInArrow(scorer(model), f"row {rows.schema['row'].dataType.simpleString()}, differences array<double>, score double")


def scores(docs: DataFrame, labels: DataFrame, fold: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference) for each row of docs(doc_id, text)."""
    out = scored(docs, ["doc_id"], train(docs, labels, fold, sample)).select("row.doc_id", "score", F.col("differences")[0].alias("difference"))
    return out.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference")


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, whose score reaches CUT. Trained on `labelled` texts, or on docs themselves."""
    out = scored(docs, docs.columns, train(docs if labelled is None else labelled, labels))
    return out.where(F.col("score") >= CUT).select("row.*")
