"""Secret scans against the patterns as stated, and random strings against words, digests and identifiers."""

import base64
import hashlib
import random
import re
import uuid

import pytest
import tiktoken

from segmentry.llm import secrets
from segmentry.llm.queries import tokenizer_path
from tests.llm.data import documents, odd_texts, sentence

PATTERNS = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding(tokenizer):
    return tiktoken.Encoding("t", pat_str=secrets.PATTERN, mergeable_ranks=secrets.vocabulary(tokenizer), special_tokens={})


def random_spans(text, encoding):
    rules = secrets.RandomRules()
    runs = re.compile(rf"[A-Za-z0-9+/_-]{{{rules.length},}}={{0,2}}")
    return [(s, e) for s, kind, e in secrets.spans_of(text, runs, rules, encoding) if kind == 3]


def made_texts(seed=1, n=400):
    state = random.Random(seed)
    pieces = [
        lambda: sentence(state, 3), lambda: state.choice(["password", "TOKEN", "Api_Key", "apikey", "passwd", "ſecret", "toKen"]),
        lambda: state.choice(["=", ":", " = ", "\"", "'", "  :  ", "\n"]), lambda: "AKIA" + "".join(state.choices("ABCD0189", k=state.randint(0, 30))),
        lambda: "".join(state.choices("0123456789abcdef", k=state.randint(1, 60))), lambda: state.choice([" ", "é", "漢", "."]),
        lambda: "".join(state.choices("abcXYZ019+/_.=-", k=state.randint(1, 12))),
    ]
    return [(i, "".join(state.choice(pieces)() for _ in range(state.randint(0, 30)))) for i in range(n)]


def test_queries_digests_equal_the_patterns_as_stated(spark, tokenizer):
    source = odd_texts() + made_texts()
    rows = secrets.secret_digests(documents(spark, source), tokenizer).collect()
    assert len(rows) == len(source)
    wanted = sorted((str(i), hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t in source)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == wanted
    assert sum(r.n_assign for r in rows) > 20 and sum(r.n_access for r in rows) > 20 and sum(r.n_hex for r in rows) > 20
    for r in rows:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [kinds.count(k) for k in secrets.KINDS] == [r.n_assign, r.n_access, r.n_hex, r.n_random]
        starts = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_no_rows(spark, tokenizer):
    assert secrets.secret_digests(documents(spark, []), tokenizer).collect() == []


def test_random_strings_are_found_among_words(encoding):
    state = random.Random(7)
    found = 0
    for _ in range(200):
        key = base64.b64encode(state.randbytes(30)).decode()
        text = f"{sentence(state, 20)} {key} {sentence(state, 5)}"
        at = text.index(key)
        found += (at, at + len(key)) in random_spans(text, encoding)
    assert found >= 198


def test_digests_and_identifiers_are_not_random(encoding):
    state = random.Random(8)
    for _ in range(40):
        data = state.randbytes(20)
        for text in (
            hashlib.md5(data).hexdigest(), hashlib.sha1(data).hexdigest().upper(), hashlib.sha512(data).hexdigest(),
            "sha256-" + base64.b64encode(hashlib.sha256(data).digest()).decode(), "SHA1: " + base64.b64encode(data).decode(),
            str(uuid.UUID(bytes=data[:16], version=4)), str(state.randrange(10**24)), "data:image/png;base64," + base64.b64encode(data).decode(),
        ):
            assert random_spans(f"see {text} there", encoding) == [], text


@pytest.mark.parametrize(
    "text",
    ["internationalization_of_everything", "/usr/local/lib/python3/site-packages/numpy/core", "GetElementsByClassName2", "2024-05-17T10_30_00",
     "https://example.com/articles/2024/understanding-large-language-models", "x" * 50_000],
)
def test_words_and_paths_are_not_random(encoding, text):
    assert random_spans(text, encoding) == []


def test_long_random_runs_are_tokenised_whole(encoding):
    run = base64.b64encode(random.Random(3).randbytes(30_000)).decode()
    assert random_spans("a " + run, encoding) == [(2, 2 + len(run))]
    assert abs(secrets.token_count(run, encoding) - len(encoding.encode_ordinary(run))) <= len(run) / secrets.WINDOW + 1


def test_random_runs_inside_base_spans_are_not_listed_again(encoding):
    key = base64.b64encode(random.Random(3).randbytes(24)).decode()
    assert random_spans(f"token = '{key}'", encoding) == []
    assert len(random_spans(f"note = '{key}'", encoding)) == 1


def test_prose_of_the_test_table_holds_few_random_strings(spark, small, tokenizer):
    rows = secrets.secret_digests(spark.read.parquet(f"{small}/documents.parquet"), tokenizer).collect()
    assert sum(r.n_random > 0 for r in rows) <= len(rows) / 50
