"""Cross-entropy difference of a target and a background model (Moore and Lewis), token by token.

Both models are word bigrams over one vocabulary, every word of all documents, with the same smoothing. The
background is counted over every document, the target over those labelled good; what a document adds to a
model itself is taken out when it is scored.

The models grow with the corpus and no task holds one. Documents are dealt into batches by their ids. A batch
sends the keys of its bigrams and words, each once and with its counts, to buckets; a bucket adds up
and answers each batch with the totals of the keys it sent; the batch then rates its documents. So a frequent
word or pair costs a row of each batch, whatever its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, table, words_of_many, written

#: Bytes of text of a batch, and those whose keys a bucket adds up.
BATCH, BUCKET, BUCKETS = 6 << 20, 16 << 20, 48
_START = 0x5BD1E995
_BIGRAM, _WORD = 0, 1
#: Weight of the unigram law in a bigram row.
PRIOR = 50.0


def words(text: str | bytes | None) -> list[bytes]:
    """Tokens: runs without ASCII white space, A-Z as a-z."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


_RATED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def score(df: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row; losses in nats per token.

    score is the background's loss minus the target's: above 0, the text is likelier under the target. No
    document is scored by its own counts: they are taken out of the background, and out of the target if it is one of
    its documents, while copies of it still count. ``good`` has the keys of the target's rows (repeats and unknown
    keys do no harm). Without target rows its model is the uniform law. A null text, or one without words, has
    no tokens and null losses. Rows that repeat an id are documents of their own and each get a row; a null id
    is never a target. Other columns are not carried. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return score_all(rows, good.select(F.col(key).cast("long").alias("doc_id")))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, docs): the rows (batch, doc_id, text, good) of each batch that a run of rows has, compressed."""
    for b in batches:
        order = np.argsort(b.column(0).to_numpy(), kind="stable")
        t = pa.Table.from_batches([b]).take(pa.array(order))
        cuts = [0, *(np.flatnonzero(np.diff(t.column(0).to_numpy())) + 1).tolist(), len(t)] if len(t) else [0]
        names, blobs = [], []
        for i, j in zip(cuts, cuts[1:], strict=False):
            sink = pa.BufferOutputStream()
            part = t.slice(i, j - i).drop_columns("batch").combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            names.append(t.column(0)[i].as_py())
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "docs"])


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the lowest bytes of all first; sorted ones as differences."""
    size = x.dtype.itemsize
    return bytes([size]) + x.size.to_bytes(8) + pa.Codec("zstd").compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes(), asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    size, n = blob[0], int.from_bytes(blob[1:9])
    raw = pa.Codec("zstd").decompress(blob[9:], size * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<i{size}").ravel()


class Batch:
    """Tokens of a batch: ids and token numbers of its documents, and the keys of their pairs and words."""

    def __init__(self, blobs: list[bytes]):
        t = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
        flags = t.column("good").to_pylist()
        target = {i for i, f in zip(t.column("doc_id").to_pylist(), flags, strict=True) if f}
        t = t.filter(pa.array([not f for f in flags], pa.bool_()))
        self.ids = t.column("doc_id").combine_chunks()
        self.n, parts = np.zeros(len(t), np.int64), []
        texts = [b"" if x is None else x for x in t.column("text").cast(pa.binary()).to_pylist()]
        for low in range(0, len(texts), 500):
            hashes, n = words_of_many(texts[low : low + 500])
            parts.append(hashes.astype(U64, copy=False))
            self.n[low : low + 500] = n
        now = np.concatenate(parts) if parts else np.empty(0, U64)
        self.first = (np.cumsum(self.n) - self.n)[self.n > 0]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[self.first] = U64(_START)
        with np.errstate(over="ignore"):
            pair = mix(mix(before) * U64(0x9E3779B97F4A7C15) + now)
        good = np.repeat(np.array([i is not None and i in target for i in self.ids.to_pylist()], bool), self.n)
        self.good = good
        count = lambda place, n: np.stack((np.bincount(place, minlength=n), np.bincount(place[good], minlength=n))).astype(np.int32)
        pairs, self.pair = np.unique(pair & ~U64(3) | U64(_BIGRAM), return_inverse=True)
        self.pair = self.pair.astype(np.int32)  # places of a batch are few; tokens are many
        del pair, before, parts
        marked = np.append(now, U64(_START)) if len(now) else now
        words, place = np.unique(mix(marked) & ~U64(3) | U64(_WORD), return_inverse=True)
        del marked, now
        place = place.astype(np.int32)
        self.word = place[: len(self.pair)]
        self.head = np.empty_like(self.word)
        self.head[1:] = self.word[:-1]
        self.head[self.first] = place[-1:]
        #: distinct keys, and how often each occurs in all documents and in good ones; words also as the one before
        self.keys = np.concatenate((pairs, words))
        self.counts = np.zeros((4, len(self.keys)), np.int32)
        self.counts[:2, : len(pairs)] = count(self.pair, len(pairs))
        self.counts[:2, len(pairs) :], self.counts[2:, len(pairs) :] = count(self.word, len(words)), count(self.head, len(words))
        self.word, self.head = self.word + len(pairs), self.head + len(pairs)

    def within(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each token's key stands in its own document."""
        _, at, count = np.unique(doc * np.int64(len(self.keys)) + place, return_inverse=True, return_counts=True)
        return count.astype(np.int32)[at]

    def parts(self, buckets: int) -> list[np.ndarray]:
        """Places of the keys that each bucket adds up."""
        of = ((self.keys >> U64(20)) % U64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        return np.split(order, np.searchsorted(of[order], np.arange(1, buckets)))


def score_all(rows: DataFrame, good: DataFrame) -> DataFrame:
    """Scores with every word in the vocabulary."""
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # buckets hold more than batches, so that the rows between them stay in proportion to the input
    batches, buckets = max(1, -(-length // BATCH)), max(BUCKETS, -(-length // BUCKET))
    batch = lambda *of: F.pmod(F.xxhash64(*of), F.lit(batches)).cast("int").alias("batch")
    docs = rows.select(batch(F.coalesce("doc_id", F.xxhash64("text"))), "doc_id", "text", F.lit(False).alias("good"))
    flags = good.where("doc_id is not null").distinct().select(batch(F.col("doc_id")), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("good"))
    dealt = docs.union(flags).mapInArrow(_deal, "batch int, docs binary")

    def send(t: pa.Table) -> pa.Table:
        b = Batch(t.column("docs").to_pylist())
        parts = [(k, p) for k, p in enumerate(b.parts(buckets)) if len(p)]
        column = lambda of: pa.array([_pack(of(p)) for _, p in parts], pa.binary())
        return pa.table({
            "bucket": pa.array([k for k, _ in parts], pa.int32()), "batch": pa.array([t.column("batch")[0].as_py()] * len(parts), pa.int32()),
            "keys": column(lambda p: np.diff(b.keys[p], prepend=U64(0))), "counts": column(lambda p: b.counts[:, p]),
        })

    def add(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x).view(U64), dtype=U64) for x in t.column("keys").to_pylist()]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [_unpack(x).reshape(4, -1) for x in t.column("counts").to_pylist()]
        total = np.stack([np.bincount(place, np.concatenate([c[k] for c in counts]), len(found)).astype(np.int64) for k in range(4)])
        del keys, counts
        words = (found & U64(3)) == _WORD
        # what each bucket knows of the sizes stands in its first row
        sizes = [int(words.sum()), *total[:2, words].sum(axis=1).tolist()]
        wide = np.int64 if total.size and total.max() >= 1 << 31 else np.int32
        total = total.astype(wide)
        blobs = [_pack(total[:, p]) for p in np.split(place, cuts)]
        first = [k == 0 for k in range(len(blobs))]
        return pa.table({
            "batch": t.column("batch").combine_chunks(), "bucket": t.column("bucket").combine_chunks(), "totals": pa.array(blobs, pa.binary()),
            **{c: pa.array([v if f else 0 for f in first], pa.int64()) for c, v in zip(("words", "background", "target"), sizes, strict=True)},
        })

    sent = dealt.groupBy("batch").applyInArrow(send, "bucket int, batch int, keys binary, counts binary")
    back = written(sent.groupBy("bucket").applyInArrow(add, "batch int, bucket int, totals binary, words long, background long, target long"))
    width, *tokens = (int(x or 0) for x in back.agg(F.sum("words"), F.sum("background"), F.sum("target")).first())
    width += 1  # the unknown word; the start mark is among the words

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left.column("docs").to_pylist())
        total, parts = np.zeros((4, len(b.keys)), np.int64), b.parts(buckets)
        for k, blob in zip(*(right.column(c).to_pylist() for c in ("bucket", "totals")), strict=True):
            total[:, parts[k]] = _unpack(blob).reshape(4, -1)
        some, mean = b.n > 0, []
        doc = np.repeat(np.arange(len(b.n)), b.n)
        own = [b.within(doc, place) for place in (b.pair, b.word, b.head)] if len(doc) else []
        for t, heads, n, mine in zip(total[:2], total[2:], tokens, (np.ones(len(doc), bool), b.good), strict=True):
            each = np.full(len(b.n), np.nan)
            if len(b.first):
                pair, word, head = (c * mine for c in own)
                rest = n - b.n[doc] * mine + width
                loss = np.log(heads[b.head] - head + PRIOR) - np.log(t[b.pair] - pair + PRIOR * (t[b.word] - word + 1) / rest)
                each[some] = np.add.reduceat(loss, b.first) / b.n[some]
            mean.append(each)
        background, target = mean
        return pa.table({
            "doc_id": b.ids, "n_tokens": pa.array(b.n), "target_loss": pa.array(target, mask=~some),
            "background_loss": pa.array(background, mask=~some), "score": pa.array(background - target, mask=~some),
        })

    return dealt.groupBy("batch").cogroup(back.select("batch", "bucket", "totals").groupBy("batch")).applyInArrow(rate, _RATED)


def labelled_good(spark, sf_dir: str) -> DataFrame:
    """Keys of the documents labelled of good quality and never toxic."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").groupBy("doc_id")
    return labels.agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
