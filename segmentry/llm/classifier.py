"""Quality of texts by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column
from .batches import slices


@dataclass(frozen=True)
class NetRules:
    """Production parameters.

    ``chunk`` bytes form a chunk; neighbours overlap by ``width - 1`` bytes, so every stretch of ``width``
    bytes lies in one. Filters slide by ``stride`` bytes. Training: at most ``sample`` labelled rows, whose whole
    texts hold at most ``sample_bytes`` together. Texts are whole in training as in scoring.
    """

    chunk: int = 520
    width: int = 8
    stride: int = 1
    channels: int = 8
    filters: int = 24
    sample: int = 2000
    sample_bytes: int = 8 << 20
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 42


def chunked(text: bytes, rules: NetRules) -> np.ndarray:
    """The text's chunks as rows of bytes. The last chunk ends with the text; a short text is filled with zeros."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < rules.chunk:
        data = np.concatenate([data, np.zeros(rules.chunk - len(data), np.uint8)])
    step = rules.chunk - rules.width + 1
    count = -(-(len(data) - rules.chunk) // step) + 1
    starts = np.minimum(np.arange(count) * step, len(data) - rules.chunk)
    return np.lib.stride_tricks.sliding_window_view(data, rules.chunk)[starts]


def new_network(rules: NetRules) -> dict[str, np.ndarray]:
    random = np.random.default_rng(rules.seed)
    fan = rules.width * rules.channels
    return {
        "bytes": random.normal(0, 0.5, (256, rules.channels)).astype(np.float32),
        "filters": random.normal(0, fan**-0.5, (fan, rules.filters)).astype(np.float32),
        "bias": np.zeros(rules.filters, np.float32),
        "out": random.normal(0, 0.1, 2 * rules.filters).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def windows(chunks: np.ndarray, rules: NetRules) -> np.ndarray:
    """Byte positions' windows: chunk, window, byte."""
    return np.lib.stride_tricks.sliding_window_view(chunks, rules.width, axis=1)[:, :: rules.stride]


def pooled(net: dict, chunks: np.ndarray, rules: NetRules) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in every chunk, and the window that gave it."""
    values = np.empty((len(chunks), rules.filters), np.float32)
    places = np.empty((len(chunks), rules.filters), np.int64)
    for start in range(0, len(chunks), 64):
        part = windows(chunks[start : start + 64], rules)
        inputs = net["bytes"][part].reshape(-1, rules.width * rules.channels)
        response = (inputs @ net["filters"]).reshape(len(part), -1, rules.filters)
        places[start : start + 64] = at = response.argmax(axis=1)
        values[start : start + 64] = np.take_along_axis(response, at[:, None], axis=1)[:, 0]
    return values + net["bias"], places


def combined(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the mean and the largest of its chunks' rectified responses, and the rectified responses."""
    active = np.maximum(values, 0)
    counts = np.diff(np.append(begins, len(values)))[:, None]
    mean = np.add.reduceat(active, begins) / counts
    return np.concatenate([mean, np.maximum.reduceat(active, begins)], axis=1), active


def probabilities(net: dict, chunks: np.ndarray, begins: np.ndarray, rules: NetRules) -> np.ndarray:
    features, _ = combined(pooled(net, chunks, rules)[0], begins)
    return 1 / (1 + np.exp(-(features.astype(np.float64) @ net["out"] + net["out_bias"][0])))


def gradients(net: dict, chunks: np.ndarray, begins: np.ndarray, labels: np.ndarray, rules: NetRules) -> dict:
    """Gradients of the mean log loss. Only the window that won a filter's pool passes an error on."""
    values, places = pooled(net, chunks, rules)
    features, active = combined(values, begins)
    logits = features @ net["out"] + net["out_bias"][0]
    error = ((1 / (1 + np.exp(-logits)) - labels) / len(labels)).astype(np.float32)
    counts = np.diff(np.append(begins, len(chunks)))
    owner = np.repeat(np.arange(len(begins)), counts)
    n = rules.filters
    passed = (error / counts)[owner, None] * net["out"][:n]
    passed = passed + (active == features[owner, n:]) * error[owner, None] * net["out"][n:]
    passed = passed * (values > 0)
    rows = np.arange(len(chunks))[:, None]
    won = windows(chunks, rules)[rows, places]  # chunk, filter, byte
    inputs = net["bytes"][won].reshape(len(chunks), n, -1)
    back = (passed[:, :, None] * net["filters"].T[None]).reshape(-1, rules.channels)
    by_byte = np.zeros_like(net["bytes"])
    np.add.at(by_byte, won.reshape(-1), back)
    return {
        "bytes": by_byte,
        "filters": np.einsum("cf,cfi->if", passed, inputs),
        "bias": passed.sum(axis=0),
        "out": features.T @ error,
        "out_bias": error.sum(keepdims=True),
    }


def train(samples: list[tuple[np.ndarray, int]], rules: NetRules) -> dict[str, np.ndarray]:
    """A network fitted by Adam to chunk arrays with labels 0 or 1; without samples the untrained one."""
    net = new_network(rules)
    if not samples:
        return net
    random = np.random.default_rng(rules.seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(rules.epochs):
        order = random.permutation(len(samples))
        for start in range(0, len(order), rules.batch):
            part = [samples[i] for i in order[start : start + rules.batch]]
            sizes = [len(c) for c, _ in part]
            begins = np.cumsum([0, *sizes[:-1]])
            labels = np.array([y for _, y in part], np.float32)
            step += 1
            for name, g in gradients(net, np.concatenate([c for c, _ in part]), begins, labels, rules).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                rise = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                net[name] = (net[name] - rules.rate * rise).astype(np.float32)
    return net


def held_out(key: str) -> Column:
    """Rows that the network never learns from."""
    return F.coalesce(F.crc32(as_column(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_samples(docs: DataFrame, labels: DataFrame, rules: NetRules) -> list[tuple[np.ndarray, int]]:
    """Chunks and labels of at most ``sample`` labelled texts that are not held out, picked by a hash of their id.

    Texts are taken whole, in the order of the hash; one that would lift their sum above ``sample_bytes`` is passed
    over, which bounds what reaches the driver. Rows with the same id, label and text count once.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label is not null")
    usable = usable.filter(~held_out("doc_id") & F.col("doc_id").isNotNull()).distinct()
    picked = usable.orderBy(F.xxhash64("doc_id"), "label").limit(rules.sample)
    texts = docs.filter(~held_out("doc_id")).join(F.broadcast(picked), "doc_id")
    known = texts.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    sized = known.select("doc_id", "label", F.md5("text").alias("digest"), F.octet_length("text").alias("size"))
    chosen = sized.orderBy(F.xxhash64("doc_id"), "label", "digest").limit(rules.sample)
    total, within = 0, []
    for row in chosen.collect():
        if total + row["size"] <= rules.sample_bytes:
            total += row["size"]
            within.append((row["doc_id"], row["label"], row["digest"]))
    if not within:
        return []
    few = docs.sparkSession.createDataFrame(list(dict.fromkeys(within)), sized.drop("size").schema)
    found = known.withColumn("digest", F.md5("text")).join(F.broadcast(few), ["doc_id", "label", "digest"])
    rows = found.dropDuplicates(["doc_id", "label", "digest"]).orderBy(F.xxhash64("doc_id"), "label", "digest").collect()
    return [(chunked(row["text"].encode(), rules), row["label"]) for row in rows]


def score_texts(
    df: DataFrame, net: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", rules: NetRules | None = None
) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text; NULL counts as empty, and empty texts get a score too."""
    rules = rules or NetRules()
    source = df.select(as_column(key).alias("doc_id"), as_column(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                cut = [chunked((t.as_py() or "").encode(), rules) for t in part.column(1)]
                begins = np.cumsum([0, *map(len, cut[:-1])])
                score = probabilities(shared.value, np.concatenate(cut), begins, rules)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, rules: NetRules | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on) of every document.

    The network is trained on the bounded sample and sees bytes of texts only. Documents with a NULL id are not
    learnt from; repeated rows each get their score; without labels the untrained network scores.
    """
    rules = rules or NetRules()
    net = train(training_samples(docs, labels, rules), rules)
    scored = score_texts(docs, net, rules=rules)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
