"""Quality classifier: a linear-chain CRF that labels every line of a document good or bad."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import bucket, documents, query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OWN = 9  # features of a line itself
_GROUP = 4_000_000  # characters scored together


def line_features(text: str):
    """Features per line that is not blank, and the lines' lengths. A text without such a
    line counts as one empty line."""
    import numpy as np

    lines = [line for line in text.split("\n") if line.strip()] or [" "]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.array([len(line) for line in lines])
    starts = np.cumsum(sizes) - sizes
    share = lambda found: np.add.reduceat(found, starts, dtype=np.int64) / sizes
    latin = (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7)
    large = ((codes >= 65) & (codes <= 90)) | (latin & (codes < 0xDF))
    small = ((codes >= 97) & (codes <= 122)) | (latin & (codes >= 0xDF))
    own = np.zeros((len(lines), _OWN))
    own[:, 0], own[:, 1] = share(large), share(small)
    own[:, 2] = share((codes >= 48) & (codes <= 57))
    own[:, 3] = share(codes == 46)
    own[:, 4] = 1 - share(large | small | (codes == 32) | (codes == 46) | (codes == 44))
    for i, line in enumerate(lines):
        tokens = line.split()
        n = max(1, len(tokens))
        own[i, 5] = np.log1p(len(tokens))
        own[i, 6] = len(set(tokens)) / n
        own[i, 7] = sum(map(str.__eq__, tokens, tokens[1:])) / n
        own[i, 8] = min(3.0, len(line) / n / 6)
    return own, sizes.astype(float)


def with_neighbours(own):
    """Features of a line, of the line before and of the line after, whether there are such,
    and a constant."""
    import numpy as np

    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((n, 3))
    edge[0, 0] = edge[-1, 1] = 1
    edge[:, 2] = 1
    return np.hstack([own, before, after, edge])


class Chain:
    """Two labels, bad 0 and good 1. ``weights`` give a line's score for good over bad,
    ``moves`` the score of a label after another."""

    def __init__(self, weights, moves, mean, spread):
        self.weights, self.moves, self.mean, self.spread = weights, moves, mean, spread

    def marginals(self, scores, lengths):
        """Probability of good per line, the probabilities of moves summed up per sequence
        pair, and the log of the partition sum. ``scores`` is (sequences, steps), padded, with
        sequences in falling order of length."""
        import numpy as np

        many, steps = scores.shape
        running = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than the step
        unary = np.stack([np.zeros_like(scores), scores], axis=2)
        ahead, back = np.zeros((many, steps, 2)), np.zeros((many, steps, 2))
        total = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
        ahead[:, 0] = unary[:, 0]
        for t in range(1, steps):
            k = running[t]
            ahead[:k, t] = unary[:k, t] + total(ahead[:k, t - 1, :, None] + self.moves, 1)
        for t in range(steps - 2, -1, -1):
            k = running[t + 1]
            back[:k, t] = total(self.moves + (unary[:k, t + 1] + back[:k, t + 1])[:, None, :], 2)
        norm = total(ahead[np.arange(many), lengths - 1], 1)
        good = np.exp(np.minimum(0, ahead[:, :, 1] + back[:, :, 1] - norm[:, None]))
        moved = np.zeros((2, 2))
        for t in range(1, steps):
            k = running[t]
            pair = ahead[:k, t - 1, :, None] + self.moves + (unary[:k, t] + back[:k, t])[:, None, :]
            moved += np.exp(np.minimum(0, pair - norm[:k, None, None])).sum(axis=0)
        return good, moved, norm

    def documents(self, texts: list[str]) -> list[float]:
        """Quality of documents: the mean probability of good, lines weighed by length."""
        import numpy as np

        found = [line_features(t) for t in texts]
        lengths = np.array([len(own) for own, _ in found])
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros(len(texts))
        start = 0
        while start < len(order):  # padded together: sequences of about one length
            longest = lengths[order[start]]
            stop = start + max(1, int(np.searchsorted(-lengths[order[start:]], -(longest // 2), side="right")))
            some = order[start:stop]
            scores = np.zeros((len(some), longest))
            for row, i in enumerate(some):
                x = with_neighbours((found[i][0] - self.mean) / self.spread)
                scores[row, : lengths[i]] = x @ self.weights
            good, _, _ = self.marginals(scores, lengths[some])
            for row, i in enumerate(some):
                size = found[i][1]
                out[i] = float(good[row, : lengths[i]] @ size / size.sum())
            start = stop
        return np.clip(out, 0.0, 1.0).tolist()


def fit(sequences: list, labels: list[int], rounds: int = 150, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps. Every line of a document has its label."""
    import numpy as np

    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    stacked = np.vstack(sequences)
    mean, spread = stacked.mean(axis=0), stacked.std(axis=0) + 1e-6
    x = np.zeros((len(order), int(lengths[0]), 3 * _OWN + 3))
    for row, i in enumerate(order):
        x[row, : lengths[row]] = with_neighbours((sequences[i] - mean) / spread)
    there = np.arange(x.shape[1]) < lengths[:, None]
    label = np.array([labels[i] for i in order])
    truth = np.where(there, label[:, None], 0)
    seen = np.zeros((2, 2))
    for value in (0, 1):
        seen[value, value] = (lengths[label == value] - 1).sum()
    chain = Chain(np.zeros(x.shape[2]), np.zeros((2, 2)), mean, spread)
    flat, lines = x[there], int(lengths.sum())
    moments = [np.zeros(x.shape[2] + 4), np.zeros(x.shape[2] + 4)]
    for step in range(1, rounds + 1):
        good, moved, _ = chain.marginals(x @ chain.weights, lengths)
        slope = np.concatenate([flat.T @ (good - truth)[there], (moved - seen).ravel()]) / lines
        slope += decay * np.concatenate([chain.weights, chain.moves.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = 0.1 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        chain.weights = chain.weights - move[:-4]
        chain.moves = chain.moves - move[-4:].reshape(2, 2)
    return chain


def stretch(text: str, max_lines: int):
    """Features of up to ``max_lines`` lines of a text that follow each other, from a place that
    the text's checksum picks: any part of a long text may be learned from."""
    from zlib import crc32

    lines = line_features(text)[0]
    spare = len(lines) - max_lines
    start = crc32(text.encode("utf-8", "replace")) % (spare + 1) if spare > 0 else 0
    return lines[start : start + max_lines]


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 60) -> Chain | float:
    """A chain fitted to a bounded sample: up to ``max_docs`` labelled documents outside the
    held-out fold, in hash order, and a stretch of ``max_lines`` lines of each. Features are made by the
    tasks. With one class only, or none, the share of good ones stands for all (0.5 without
    labels)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.md5(F.concat(F.lit("crf:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(max_docs)
    # The sample is bounded, so it goes to the tasks; the texts stay where they are.
    rows = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "d")), F.col("doc_id") == F.col("d")).select("text", "quality")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [stretch(t.as_py() or "", max_lines).ravel().tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["own", "quality"])

    import numpy as np

    found = sorted((tuple(r["own"]), r["quality"]) for r in rows.mapInArrow(run, "own array<double>, quality int").collect())
    marks = [q for _, q in found]
    if len(set(marks)) < 2:
        return float(marks[0]) if marks else 0.5
    return fit([np.array(own).reshape(-1, _OWN) for own, _ in found], marks)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Learns from ``labels (doc_id, quality)`` of documents whose CRC-32 of the id is not 0
    modulo 5; two labels of one id count as the larger. Every line of every whole text is
    labelled, seen with its neighbours; the score weighs the lines' probabilities of good by
    their length. predicted is 1 from 0.3 on. Null and empty texts are one empty line.
    Repeated rows come out as often as they come in, an empty table gives no rows, further
    columns of either table are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows, labels.select("doc_id", "quality"), max_docs, max_lines))

    def run(batches):
        import pyarrow as pa

        chain = model.value
        for batch in batches:
            texts, size, done = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                texts.append(text)
                size += len(text)
                if size >= _GROUP or i == batch.num_rows - 1:
                    scores = [chain] * len(texts) if isinstance(chain, float) else chain.documents(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(scores, pa.float64())], ["doc_id", "score"])
                    done += len(texts)
                    texts, size = [], 0

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_crf_quality")
def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
