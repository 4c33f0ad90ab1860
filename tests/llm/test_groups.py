"""Lines, near duplicates, decontamination and components against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from segmentry.llm import decontaminate, groups, lines, near
from segmentry.llm.queries import QUERIES
from segmentry.sources import staging
from tests.llm.data import documents, odd_texts, sentence


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(300)]])
def test_components(spark, edges):
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in groups.components(table).collect()}
    assert got == {x: sets.find(x) for e in edges for x in e if sets.find(x) != x}


def test_random_components(spark):
    state = random.Random(2)
    edges = [(state.randrange(400), state.randrange(400)) for _ in range(350)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.id: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for e in edges for x in e if sets.find(x) != x}


def test_linked_components_lose_no_link_and_try_few_pairs(spark, tmp_path):
    """Links between values less than 3 apart; one bucket of 300 values, some of them only linked to a neighbour."""
    state = random.Random(4)
    values = [(i, i // 2 if i < 250 else 1000 + 5 * i) for i in range(300)]
    buckets = [(i, 0) for i, _ in values] + [(i, 1 + state.randrange(40)) for i, _ in values]
    table = spark.createDataFrame(buckets, "id long, key long")
    numbers = spark.createDataFrame(values, "id long, v long")
    tried = []

    def verify(pairs):
        tried.append(pairs.count())
        left = numbers.select(F.col("id").alias("a"), F.col("v").alias("x"))
        right = numbers.select(F.col("id").alias("b"), F.col("v").alias("y"))
        return pairs.join(left, "a").join(right, "b").filter(F.abs(F.col("x") - F.col("y")) < 3).select("a", "b")

    got = {r.id: r.component for r in groups.linked_components(table, verify).collect()}
    sets, known = Sets(), dict(values)
    for a, b in itertools.combinations(known, 2):
        if abs(known[a] - known[b]) < 3:
            sets.join(a, b)
    assert got == {i: sets.find(i) for i in known if sets.find(i) != i}
    copies = spark.createDataFrame([(i, 0) for i in range(500)], "id long, key long")
    tried.clear()
    groups.linked_components(copies, lambda pairs: (tried.append(pairs.count()), pairs)[1])
    assert sum(tried) == 499


def test_a_pair_of_several_open_buckets_is_made_once(spark):
    """Values of ten components share four buckets, the heads of which are linked to none of them."""
    rows = [(0, key) for key in range(4)] + [(i, key) for i in range(1, 11) for key in range(i % 2, 4)]
    tried, plans = [], []

    def verify(pairs):
        tried.append(sorted((r.a, r.b) for r in pairs.collect()))
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return pairs.filter("a = 3 and b = 8")

    describe = lambda ids: ids.withColumn("even", F.col("id") % 2 == 0)
    table = spark.createDataFrame(rows, "id long, key long")
    got = groups.linked_components(table, verify, describe, lambda a, b: F.col(a + "even") | F.col(b + "even")).collect()
    pairs = [(a, b) for a, b in itertools.combinations(range(1, 11), 2) if a % 2 == 0 or b % 2 == 0]
    assert tried[-1] == pairs and not plans[-1].startswith("Aggregate")  # by the join, not by dropping repetitions
    assert [(r.id, r.component) for r in got] == [(8, 3)]


def test_pairs_are_screened_and_made_in_parts(spark, monkeypatch):
    """Nothing that cannot be linked is verified, not even against a head; open buckets joined in parts give each pair once."""
    rows = [(0, key) for key in range(4)] + [(i, key) for i in range(1, 11) for key in range(i % 2, 4)]
    table = spark.createDataFrame(rows, "id long, key long")
    describe = lambda ids: ids.withColumn("even", F.col("id") % 2 == 0)
    found = {}
    for most in (4_000_000, 10):
        monkeypatch.setattr(groups, "OPEN_ROWS", most)
        tried, stored, real = [], [], groups.stage
        monkeypatch.setattr(groups, "stage", lambda df, name: stored.append(name) or real(df, name))

        def verify(pairs):
            tried.append(sorted((r.a, r.b) for r in pairs.collect()))
            return pairs.filter("a = 3 and b = 8")

        possible = lambda a, b: F.col(a + "even") != F.col(b + "even")
        got = groups.linked_components(table, verify, describe, possible).collect()
        monkeypatch.setattr(groups, "stage", real)
        assert tried[0] == [(0, b) for b in range(1, 11, 2)]
        assert tried[1] == [(a, b) for a, b in itertools.combinations(range(1, 11), 2) if (a + b) % 2]
        found[most] = sorted((r.id, r.component) for r in got), stored.count("pairs")
    assert found[10][0] == found[4_000_000][0] == [(8, 3)]
    assert found[4_000_000][1] == 2 and found[10][1] > 3


def test_texts_are_compared_in_parts(spark, monkeypatch):
    """Pairs carry their texts part by part, with the links of all at once."""
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(words[: 4 + i % 5] + [f"x{i // 5}"])) for i in range(20)]
    norms = spark.createDataFrame(texts, "id long, norm string")
    pairs = spark.createDataFrame(list(itertools.combinations(range(20), 2)), "a long, b long")
    whole = sorted(tuple(r) for r in lines.similar_pairs(pairs, norms, 0.8).collect())
    stored, real = [], lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, name: stored.append(name) or real(df, name))
    monkeypatch.setattr(lines, "PAIRS", 1)
    parted = sorted(tuple(r) for r in lines.similar_pairs(pairs, norms, 0.8).collect())
    assert stored == ["lines-linked"] * 10 and parted == whole and 0 < len(whole) < 190


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_classes(source):
    sets = Sets()
    parts = {n: shingles(t) for n, (_, t) in enumerate(source)}
    for n in parts:
        sets.find(n)
    for a, b in itertools.combinations(parts, 2):
        if parts[a] and parts[b]:
            both = len(parts[a] & parts[b])
            if both >= 0.8 * (len(parts[a]) + len(parts[b]) - both):
                sets.join(a, b)
    found = defaultdict(list)
    for n in parts:
        found[sets.find(n)].append(n)
    return [v for v in found.values()]


def variants(seed, groups_of):
    state = random.Random(seed)
    source = []
    for copies in groups_of:
        words = sentence(state, 150).split()
        for _ in range(copies):
            changed = list(words)
            for _ in range(state.choice([0, 1, 2, 8])):
                changed[state.randrange(150)] = sentence(state, 1)
            source.append((len(source), " ".join(changed)))
    return source


def test_near_duplicates_against_all_pairs(spark):
    source = variants(6, [30, 5, 2, 2, 1, 1, 1])
    rows = {r.doc_id: r for r in near.near_duplicates(documents(spark, source)).collect()}
    for members in near_classes(source):
        assert {rows[m].class_id for m in members} == {min(members)}
        assert {rows[m].class_size for m in members} == {len(members)}
        assert [m for m in members if rows[m].kept] == [min(members)]


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark, odd_texts())
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    same = [r for r in rows if r.class_id == 1]
    assert sorted((r.doc_id is None, r.doc_id) for r in same) == [(False, 1), (False, 2), (False, 2), (False, 11), (True, None)]
    assert sum(r.kept for r in same) == 1 and {r.class_size for r in same} == {5}
    assert all(r.kept and r.class_size == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert {r.class_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert {r.class_id for r in rows if r.doc_id in (8, 9)} == {8}
    left = near.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in rows)
    assert near.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_probability_jaccard():
    state = random.Random(8)
    a = sentence(state, 400)
    b = a[: len(a) * 3 // 4] + " " + sentence(state, 60) + " " + a[: len(a) // 4]
    owner, shingle, weight = near.weighted_shingles([a, b], 5)
    signature = near.prob_minhash(owner, shingle, weight, 2, 4096)
    keys = sorted(set(shingle.tolist()))
    vectors = near.np.zeros((2, len(keys)))
    for o, s, w in zip(owner, shingle.tolist(), weight):
        vectors[o, keys.index(s)] = w
    exact = near.probability_jaccard(*vectors)
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.03
    assert weight.max() > 1


def normal(line):
    return re.sub(r"\d+", "0", re.sub(r"[^\w ]+|_+", "", line.lower())).strip(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_against_all_pairs(spark):
    state = random.Random(9)
    texts = []
    bases = [sentence(state, 40) for _ in range(6)]
    for i in range(60):
        picked = []
        for base in state.sample(bases, 3):
            words = base.split()
            for _ in range(state.choice([0, 0, 1, 2])):
                words[state.randrange(40)] = sentence(state, 1)
            picked.append(state.choice([" ".join(words), " ".join(words).upper() + "!", sentence(state, 12)]))
        texts.append((i, "\n".join([*picked, "", "  "])))
    docs = lines.numbered(documents(spark, texts), "doc_id", "text")
    rows = {r.doc_id: r for r in lines.line_decisions(docs).collect()}
    found = lines.exploded(docs).filter("norm is not null")
    found = found.select("norm", lines.simhash(F.col("norm"), F.col("k1")).alias("simhash")).distinct()
    hashes = {r.norm: r.simhash & (1 << 64) - 1 for r in found.collect()}
    sets = Sets()
    for a, b in itertools.combinations(hashes, 2):
        if min(a.count(" "), b.count(" ")) < 7:
            continue
        if bin(hashes[a] ^ hashes[b]).count("1") <= 3 and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            sets.join(a, b)
    seen, linked = set(), 0
    for i, text in texts:
        removed = []
        for pos, line in enumerate(text.split("\n")):
            if normal(line):
                root = sets.find(normal(line))
                if root in seen:
                    removed.append(pos)
                    linked += 1
                seen.add(root)
        assert rows[i].removed == removed and rows[i].n_lines == 5
    assert linked > sum(Counter(normal(x) for _, t in texts for x in t.split("\n") if normal(x)).values()) - len(hashes)


@pytest.mark.parametrize("n", [1, 3, 127, 129, 200, 70_000])
def test_simhash_is_the_majority_of_word_hashes(spark, n):
    words = [f"word{i}" for i in range(n)]
    line = spark.createDataFrame([(" ".join(words + words[:2] + ["abc"]), 0x0F0F0F0F0F0F0F0F)], "norm string, tie long")
    got = line.select(lines.simhash(F.col("norm"), F.col("tie"))).first()[0] & (1 << 64) - 1
    counted = words if n >= 5 else [*words, "abc"]
    hashed = spark.createDataFrame([(w,) for w in counted], "w string").select(F.xxhash64("w")).collect()
    value = 0
    for bit in range(64):
        ones = sum(h[0] >> bit & 1 for h in hashed)
        if 2 * ones > len(counted) or (2 * ones == len(counted) and 0x0F0F0F0F0F0F0F0F >> bit & 1):
            value |= 1 << bit
    assert got == value


@pytest.mark.parametrize("n", [1, 2, 5, 6, 126, 128, 300])
def test_simhash_bits_at_the_edges_of_the_counters(spark, n):
    """Bits that all, none, half, one more or one less than half of the hashes have, the topmost counter among them."""
    for ones in {0, n // 2, n // 2 + 1, max(0, (n - 1) // 2), n}:
        line = spark.createDataFrame([([-1] * ones + [0] * (n - ones), 0x0F0F0F0F0F0F0F0F)], "h array<long>, tie long")
        width = F.lit(8 if n < 128 else 16)
        got = line.select(lines._bits(lines._sums(F.col("h"), width), width, F.size("h"), F.col("tie"))).first()[0]
        assert got == (-1 if 2 * ones > n else 0x0F0F0F0F0F0F0F0F if 2 * ones == n else 0)


def test_wanted_lines_are_normalised_after_the_join_only(spark):
    docs = documents(spark, [(1, "One two\nthree"), (1, "other"), (None, "Four!")])
    found = lines.exploded(lines.numbered(docs, "doc_id", "text"))
    wanted = found.filter("norm <> 'three'").select(F.monotonically_increasing_id().alias("id"), "doc_id", "pos", "k1", "k2")
    texts = lines.line_texts(docs, wanted)
    assert sorted(r.norm for r in texts.collect()) == ["four", "one two", "other"]
    joins = [x for x in texts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1 and "xxhash64" not in joins[0] and "regexp_replace" not in joins[0]
    # Text at the place that has another key is no answer.
    assert not lines.line_texts(docs, wanted.withColumn("k2", F.lit(5).cast("long"))).count()


def test_edit_similarity_by_parts_is_that_of_the_whole(spark):
    """Pairs around the bound, with edits that move everything behind them, at one place or everywhere; one beyond ASCII."""
    state = random.Random(12)
    pairs = [("", ""), ("a", ""), ("a", "b"), ("abcd", "abce"), ("abcde", "abcdf"), ("é" * 30, "é" * 24), ("xy" * 20, "yx" * 20)]
    for _ in range(150):
        a = sentence(state, state.randint(2, 25))
        b = list(a)
        for _ in range(state.randint(0, len(a) // 3)):
            at = state.randrange(max(1, len(b) // state.choice([1, 1, 5])))
            b[at : at + 1] = state.choice([[], ["q"], ["é", "z"], list(" word")])
        pairs.append((a, "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in table.select(lines.edit_similar("a", "b", 0.8)).collect()]
    wanted = [edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert got == wanted and 30 < sum(wanted) < len(wanted) - 30


def test_line_dedup_leaves_no_tables_of_its_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "checkpoint_dir", lambda spark: str(tmp_path))
    docs = documents(spark, [(1, "one two three four\nfive"), (2, "one two three four\nsix"), (3, None)])
    left = lines.remove_lines(docs, lines.EDIT_RULES)
    assert sorted({p.parent.name.split("-")[1] for p in tmp_path.rglob("*.parquet")}) == ["cuts", "docs"]
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "one two three four\nfive"), (2, "six"), (3, None)]


def test_lines_of_odd_rows(spark):
    source = odd_texts()
    docs = documents(spark, source)
    rows = lines.line_decisions(lines.numbered(docs, "doc_id", "text")).collect()
    assert len(rows) == len(source)
    assert [len(r.removed) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)) if r.doc_id in (1, 2)] == [0, 1, 1]
    assert all(not r.removed for r in rows if r.doc_id in (3, 4, 5))
    left = lines.remove_lines(docs)
    assert left.columns == docs.columns
    kept = Counter(r.doc_id for r in left.collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 1 and kept[4] == 2 and kept[5] == 1
    assert lines.line_decisions(lines.numbered(documents(spark, []), "doc_id", "text")).count() == 0
    assert lines.remove_lines(documents(spark, [])).count() == 0


def best_match(pattern, text):
    """Smallest distance of the pattern to a substring."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_leaks_against_all_substrings(spark):
    state = random.Random(11)
    items = [(i, sentence(state, state.randint(6, 25)).capitalize() + ".") for i in range(12)]
    texts = []
    for i in range(60):
        passage = list(state.choice(items)[1])
        for _ in range(state.randrange(0, 14)):
            at = state.randrange(len(passage))
            passage[at : at + 1] = state.choice([[], ["q"], [passage[at], "z"]])
        body = [sentence(state, 20), "".join(passage) if i % 4 else sentence(state, 10), sentence(state, 20)]
        texts.append((i, "\n".join(body).upper() if i % 5 == 0 else " ".join(body)))
    benchmark = spark.createDataFrame([*items, (None, None), (99, ""), (98, "...")], "item_id long, text string")
    rules = decontaminate.LeakRules(block_chars=300)  # several blocks
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(documents(spark, texts), benchmark, rules=rules).collect()}
    wanted = {}
    for i, text in texts:
        for item, pattern in items:
            p = decontaminate.normal_text(pattern)
            distance = best_match(f" {p} ", f" {decontaminate.normal_text(text)} ")
            if distance <= int(len(p) * rules.error_rate):
                wanted[i, item] = distance
    assert {k: r.distance for k, r in got.items()} == wanted and len(set(wanted.values())) > 2
    plain = dict(texts)
    for (i, item), r in got.items():
        span = decontaminate.normal_text(plain[i])[r.start : r.end]
        # Blanks at the item's ends count in the distance and are left out of the span.
        assert 0 <= r.distance - edits(decontaminate.normal_text(dict(items)[item]), span) <= 2
        assert span == span.strip()


@pytest.mark.parametrize("block_chars", [10, 4_000_000])
def test_leaking_documents_go_without_a_join_or_a_copy_of_all(spark, block_chars):
    benchmark = spark.createDataFrame([(1, "the art of war"), (2, "old man and the sea")], "item_id long, text string")
    source = [(1, "On the art of war."), (1, "other"), (None, "The old man and the sea"), (2, None), (None, "none"), (None, "none")]
    docs = documents(spark, source)
    left = decontaminate.remove_leaking(docs, benchmark, decontaminate.LeakRules(block_chars=block_chars))
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(
        str(x) for x in [(1, "other"), (2, None), (None, "none"), (None, "none")]
    )
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    if block_chars > 10:  # one block
        assert not left.inputFiles() and left.schema == docs.schema


def test_leaks_begin_and_end_at_word_borders(spark):
    benchmark = spark.createDataFrame([(1, "No."), (2, "art of war")], "item_id long, text string")
    source = [(1, "Knowledge"), (2, "no"), (3, "He said: No!"), (4, "the art of war, again"), (5, "part of warfare"), (6, "")]
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontaminate.leaks(documents(spark, source), benchmark).collect()}
    assert got == {(2, 1): (0, 0, 2), (3, 1): (0, 8, 10), (4, 2): (0, 4, 14)}


def test_leaks_of_odd_rows(spark):
    source = odd_texts()
    base = source[0][1]
    benchmark = spark.createDataFrame([(1, base), (2, base), (None, "one")], "item_id long, text string")
    docs = documents(spark, source)
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect())
    assert got[2, 1] == 2 and got[2, 2] == 2 and got[None, 1] == 1 and got[6, None] == 1
    left = decontaminate.remove_leaking(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 4, 5, 8, 9, 10, 13, 14]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, nothing).count() == 0
    assert decontaminate.leaks(documents(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_line_dedup", "op8_minhash"])
def test_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_texts_of_one_template_make_few_pairs_and_lose_none(spark):
    """Half of each text is a template that all share; some texts are variants of another one, or of the template."""
    state = random.Random(6)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(300):
        words = template + [f"w{i}x{j}" for j in range(state.randint(30, 70))]
        texts.append(words)
        if i % 6 == 0:
            texts.append([w if state.random() > 0.01 else "changed" for w in words])
    for _ in range(60):
        cut = state.randint(0, 50)
        texts.append(template[:cut] + [f"v{state.random()}"] + template[cut + 1 :])
    rules = near.NearRules(words=2)
    sets = [{tuple(t[k : k + 2]) for k in range(len(t) - 1)} for t in texts]
    wanted = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    open_rows = spark.createDataFrame([(i, 1, i) for i in range(len(texts))], "id long, key long, component long")
    bands = spark.createDataFrame([(i, [1]) for i in range(len(texts))], "id long, bands array<long>")
    made = {(r.a, r.b) for r in near.crossing_pairs(open_rows, table, bands, rules).collect()}
    assert len(wanted) > 500 and wanted <= made
    assert len(made) < len(wanted) + len(texts)
