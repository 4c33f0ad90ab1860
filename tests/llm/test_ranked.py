"""Ranked search against scoring every document, bounds against scores, and SQL on the test tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from segmentry.llm import ranked
from tests.llm.data import documents, odd_texts, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def expected(docs, items, top=20):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, count in counts:
            m = 100 - 25 + (25 * sum(count.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * count[t]) // (1000 * count[t] + 12 * m))
                for t in terms(text)
                if count[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda s: s[:3])
        rows += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(scores[:top], 1)]
    return Counter(rows)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, item long, term string")


def answers(spark, docs, items, **options):
    rows = ranked.ranked_documents(documents(spark, docs).repartition(3), asked(spark, items), **options).collect()
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rows)


def corpus(seed=2, n=150):
    state = random.Random(seed)
    words = [sentence(state, 1) for _ in range(120)]
    docs = [(i, " ".join(state.choices(words, [1 / (k + 1) for k in range(120)], k=state.randint(0, 200)))) for i in range(n)]
    items = [(i, " ".join(state.choices(words, k=state.randint(1, 25)))) for i in range(30)]
    return docs, items, words


def test_equals_scoring_everything(spark):
    docs, items, words = corpus()
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # copies: ties by id, beyond the last rank
    docs += [(2000, words[5] + (" " + words[7]) * 400)]  # a frequency beyond a slot's range
    assert answers(spark, docs, items) == expected(docs, items)
    assert answers(spark, docs, items, top=3) == expected(docs, items, 3)


def test_odd_rows(spark):
    docs = odd_texts()
    items = [(1, docs[0][1]), (1, docs[0][1]), (1, "ONE two"), (None, "é 漢字 END"), (2, None), (3, ""), (4, "...")]
    items += [(5, docs[11][1]), (6, "x" * 50_000), (7, "nowhere1234")]
    assert answers(spark, docs, items) == expected(docs, items)


def test_empty_tables(spark):
    assert not answers(spark, [], [(1, "a")]) and not answers(spark, [(1, "a b")], [])


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items, _ = corpus(5, 60)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 40)
    monkeypatch.setattr(ranked, "PARTIAL_TERMS", 50)
    assert answers(spark, docs, items) == expected(docs, items)


def test_no_score_exceeds_its_bound():
    docs, items, words = corpus(9, 40)
    rows = [{"item": i, "term": t, "tf": n, "weight": 10 + len(t)} for i, q in items for t, n in Counter(terms(q)).items()]
    block = ranked.Block(rows)
    exact = loose = 0
    for _, text in docs:
        counts = Counter(terms(text))
        if not counts:
            continue
        tfs = np.fromiter(counts.values(), np.uint32, len(counts))
        length = np.array([90], np.int64)
        sketch = ranked.sketch_of(ranked.term_hashes(list(counts)), tfs).tobytes()
        bounds = block.bounds([sketch], length)[0]
        scores = block.scores("\0".join(counts).encode(), tfs.tobytes(), 90, np.arange(len(block.items)))
        assert all(b >= s for b, s in zip(bounds, scores))
        exact += sum(scores)
        loose += sum(bounds.tolist())
    assert loose < 1.5 * exact


def test_bounds_spare_documents():
    """Once the best are found, documents without an item's telling terms are not scored."""
    state = random.Random(4)
    words = [sentence(state, 1) + str(i) for i in range(4000)]
    docs = [" ".join(state.sample(words, 60)) for _ in range(600)]
    docs += [" ".join(state.sample(words[:30], 20) + state.sample(words, 40)) for _ in range(8)]
    rows = [{"item": 0, "term": t, "tf": 1, "weight": 100} for t in words[:30]]
    block, scored = ranked.Block(rows), []
    plain = block.scores
    block.scores = lambda *a: scored.append(1) or plain(*a)
    columns = {"doc_id": [], "n": [], "sketch": [], "terms": [], "tfs": []}
    for i, text in enumerate(docs):
        counts = Counter(terms(text))
        tfs = np.fromiter(counts.values(), np.uint32, len(counts))
        values = (i, len(counts), ranked.sketch_of(ranked.term_hashes(list(counts)), tfs).tobytes(), "\0".join(counts).encode(), tfs.tobytes())
        for name, value in zip(columns, values):
            columns[name].append(value)
    found = list(ranked.search_part(iter([pa.RecordBatch.from_pydict(columns)]), block, 36_480, 608, 5))
    assert len(found) == 5 and len(scored) < 20


def test_tasks_get_bounded_batches(spark, monkeypatch):
    """A sketch is several times as large as its text, so a task must not hold thousands of them at once."""

    def sizes(batches, block, total, documents, top):
        for batch in batches:
            yield block.items[0], batch.num_rows, 1

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    monkeypatch.setattr(ranked, "search_part", sizes)
    docs = documents(spark, [(i, "one two") for i in range(3000)]).coalesce(1)
    found = [r.doc_id for r in ranked.ranked_documents(docs, asked(spark, [(1, "two")]), top=3000).collect()]
    assert sum(found) == 3000 and max(found) <= 500
    assert spark.conf.get(setting) == before
