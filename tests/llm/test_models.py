"""Language-model scores and the quality classifier."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from segmentry.llm import classifier, mixing
from segmentry.llm.queries import QUERIES
from tests.llm.data import documents, odd_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL_TABLES = mixing.MixRules(slots=(14, 14, 14, 14, 14), hot_tokens=5)


def tokens(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(table) for w in WORDS.findall(text or "")] + [None]


def check_base(rows, source):
    counts = Counter()
    for i, text in source:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    wanted = []
    for i, text in source:
        mine = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in mine)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        wanted.append((i, held, len(mine), sum(counts[t] > 0 for t in mine), total, round(base, 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert Counter(got) == Counter(wanted)


def test_scoring_tasks_get_bounded_batches(spark, monkeypatch):
    name, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, mixing.stage
    before = spark.conf.get(name)

    def recorded(df, table):
        seen[table] = int(spark.conf.get(name))
        return real(df, table)

    monkeypatch.setattr(mixing, "stage", recorded)
    source = odd_texts() + [(100 + i, f"text number {i} of many") for i in range(600)]
    rows = mixing.lm_scores(documents(spark, source), rules=SMALL_TABLES).collect()
    assert len(rows) == len(source) and seen["lm-scored"] <= 500 and spark.conf.get(name) == before
    check_base(rows, source)


def test_base_scores_of_odd_rows(spark):
    source = odd_texts()
    rows = mixing.lm_scores(documents(spark, source), rules=SMALL_TABLES).collect()
    check_base(rows, source)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert all(r.bits_per_byte is None for r in rows if r.doc_id in (3, 4))


def test_scores_without_rows_or_training(spark):
    assert mixing.lm_scores(documents(spark, []), rules=SMALL_TABLES).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = mixing.lm_scores(documents(spark, [(held, "some words")]), rules=SMALL_TABLES).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in rows] == [(0, 0, 0.0)] and rows[0].score < 0


def test_scores_on_the_small_table(spark, small):
    source = [(d.doc_id, d.text) for d in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = QUERIES["op1_lm_scoring"](spark, small).collect()
    check_base(rows, source)
    held = [r for r in rows if r.held_out and r.bits_per_byte]
    assert sum(r.bits_per_byte for r in held) / len(held) < 3  # far less than a byte's 8 bits
    assert sum(r.score > r.base_score for r in rows if not r.held_out) > len(rows) / 2


def test_probabilities_of_all_next_symbols_sum_to_one():
    """The decisions for each possible symbol behind one prefix cover the tree once."""
    rules = mixing.MixRules(slots=(12, 12, 12, 12, 12))
    random = np.random.default_rng(1)
    codes = mixing.Codes(random.integers(0, 1000, mixing.SYMBOLS))
    total = sum(1 << b for b in rules.slots)
    odds, seen = random.integers(-60, 60, total).astype(np.int8), random.integers(0, 255, total).astype(np.uint8)
    model = mixing.Model(codes, odds, seen, random.normal(0, 0.4, (mixing.GATES, mixing.CONTEXTS)))

    def score(unit):
        rows = np.frombuffer(mixing.coded_units([unit], model, rules)[0], np.int64)
        return rows, mixing.text_scores(rows, np.array([0, len(rows)]), model, rules)[0]

    prefix_bits = [score("00ab" + c) for c in (" ", "\n", "\t", "\x0b", "\x0c", "\r")]
    whole = score("00ab")  # ends the text: the end mark
    first, second = codes.lengths[ord("a")], codes.lengths[ord("b")]
    before = mixing.text_scores(whole[0][: first + second], np.array([0, first + second]), model, rules)[0]
    chances = [2 ** (s - before) for _, s in [*prefix_bits, whole]]
    for byte in range(256):
        if chr(byte) in " \n\t\x0b\x0c\r":
            continue
        slots, bits, _ = mixing.decisions(["00ab" + (chr(byte) if byte < 128 else "é") + " "], codes, rules)
        if byte < 128:
            rows = np.frombuffer(mixing.coded_units(["00ab" + chr(byte) + " "], model, rules)[0], np.int64)
            n = first + second + codes.lengths[byte]
            chances.append(2 ** (mixing.text_scores(rows[:n], np.array([0, n]), model, rules)[0] - before))
    assert 0 < sum(chances) < 1 + 1e-6
    kraft = sum(2.0 ** -int(n) for n in codes.lengths)
    assert kraft == pytest.approx(1)


def test_units_rejoin_to_the_text():
    texts = [t or "" for _, t in odd_texts()]
    units, begins = mixing.cut_units(pa.array(texts))
    whole = ["".join(u[2:] for u in units[a:b].to_pylist()) for a, b in zip(begins[:-1], begins[1:])]
    assert whole == texts


def test_chunks_cover_every_window():
    rules = classifier.NetRules(chunk=50, width=8)
    random = np.random.default_rng(0)
    for size in (0, 3, 50, 51, 99, 500):
        text = random.integers(1, 255, size).astype(np.uint8).tobytes()
        found = {w.tobytes() for c in classifier.chunked(text, rules) for w in np.lib.stride_tricks.sliding_window_view(c, 8)}
        assert {text[i : i + 8] for i in range(size - 7)} <= found


def test_gradients_match_differences():
    rules = classifier.NetRules(chunk=40, filters=5)
    random = np.random.default_rng(3)
    net = {k: v.astype(np.float64) for k, v in classifier.new_network(rules).items()}
    chunks = random.integers(1, 20, (6, 40)).astype(np.uint8)
    begins, labels = np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = classifier.probabilities(net, chunks, begins, rules)
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    found = classifier.gradients(net, chunks, begins, labels, rules)
    for name, place in (("out", (3,)), ("out", (8,)), ("out_bias", (0,)), ("filters", (5, 2)), ("bias", (1,)), ("bytes", (7, 3))):
        value, step = net[name][place], 1e-3
        net[name][place] = value + step
        up = loss()
        net[name][place] = value - step
        slope = (up - loss()) / (2 * step)
        net[name][place] = value
        assert found[name][place] == pytest.approx(slope, abs=2e-3)


def plain_probability(net, text, rules):
    """The network's probability of one text, window by window."""
    data = list(text) + [0] * max(0, rules.chunk - len(text))
    step, starts, at = rules.chunk - rules.width + 1, [], 0
    while at + rules.chunk < len(data):
        starts.append(at)
        at += step
    starts.append(len(data) - rules.chunk)
    active = []
    for start in starts:
        responses = []
        for w in range(start, start + rules.chunk - rules.width + 1, rules.stride):
            inputs = [v for b in data[w : w + rules.width] for v in net["bytes"][b]]
            responses.append([sum(x * f for x, f in zip(inputs, column)) for column in net["filters"].T])
        active.append([max(0.0, max(r) + b) for r, b in zip(zip(*responses), net["bias"])])
    features = [sum(f) / len(f) for f in zip(*active)] + [max(f) for f in zip(*active)]
    logit = sum(f * o for f, o in zip(features, net["out"])) + net["out_bias"][0]
    return 1 / (1 + math.exp(-logit))


def test_scores_match_a_plain_network(spark):
    rules = classifier.NetRules(chunk=20, width=4, channels=3, filters=4)
    net = classifier.new_network(rules)
    source = [(1, None), (2, ""), (3, "ab"), (4, "twenty bytes exactly"), (5, "é and more text than one chunk holds, " * 3)]
    found = {r.doc_id: r.score for r in classifier.score_texts(documents(spark, source), net, rules=rules).collect()}
    for i, text in source:
        assert found[i] == pytest.approx(plain_probability(net, (text or "").encode(), rules), abs=1e-5)


def test_training_takes_whole_texts_within_its_bytes(spark):
    rules = classifier.NetRules(sample_bytes=3000)
    usable = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    texts = {usable[0]: "x" * 5000, usable[1]: "y" * 2500, **{i: "word " * 10 for i in usable[2:]}}
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(usable)], "doc_id long, quality int")
    source = [*texts.items(), (usable[2], texts[usable[2]])]
    samples = classifier.training_samples(documents(spark, source), labels, rules)
    wanted = Counter(classifier.chunked(texts[i].encode(), rules).tobytes() for i in usable[1:])
    assert Counter(c.tobytes() for c, _ in samples) == wanted


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_classifier"](spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    weak = [r.predicted == 0 for r in held if labels[r.doc_id] == 0]
    assert right > 0.93 and sum(weak) / len(weak) > 0.8


def test_classifier_of_odd_rows(spark):
    source = odd_texts()
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 0), (8, 1)], "doc_id long, quality int")
    rules = classifier.NetRules(epochs=1)
    rows = classifier.quality_scores(documents(spark, source), labels, rules).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in source)
    assert all(0 <= r.score <= 1 for r in rows)
    assert classifier.quality_scores(documents(spark, []), labels, rules).count() == 0
    assert classifier.quality_scores(documents(spark, source), labels.limit(0), rules).count() == len(source)
