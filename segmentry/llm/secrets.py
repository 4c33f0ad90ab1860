"""Secrets in texts: fixed patterns, and random strings exposed by how poorly a vocabulary packs them.

A byte-pair vocabulary learnt from ordinary text packs words, names and paths into few tokens. A random
string has no frequent pieces, so it needs a token for every one or two characters. Known digests and
identifiers are as random as a secret and are told apart by their form.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column
from .batches import slices

# The kinds in the order in which spans that begin together are listed, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGNED = 6  # characters of the assigned value
# A run of 20 characters beginning with AKIA, and one of 24 hex digits; longer ones are taken whole.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Fixed value: how the vocabulary's tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Digests in hex by their number of digits (128 to 512 bits), and any that name their algorithm.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
NAMED_DIGEST = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[-_/].*", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
NUMBERS = re.compile(r"[0-9TZ+/_-]+")  # numbers, dates and times
BEFORE_DIGEST = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[:=\x20]{1,2}$", re.IGNORECASE)
BEFORE_DATA = ";base64,"

WINDOW = 4096  # characters of a run that are tokenised at once
BATCH_BYTES = 4 << 20

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


@dataclass(frozen=True)
class RandomRules:
    """``length``: characters that a run of letters, digits and ``+/_-`` needs to be tested. ``ratio``: it is
    random if it has fewer characters per token; such runs also hold characters of two of the three classes
    lower-case, upper-case and digits, since a single class is a word or a number."""

    length: int = 16
    ratio: float = 2.0


def vocabulary(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, which has a fixed number of tokens."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def token_count(run: str, encoding) -> int:
    """Tokens of a run; a long one is cut into windows, whose counts add up to within one token per cut."""
    return sum(len(encoding.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))


def mixed(run: str) -> bool:
    """Whether a run of ASCII characters has two of the classes lower-case, upper-case and digits."""
    upper, lower = run.lower() != run, run.upper() != run
    return (upper and lower) or ((upper or lower) and any(c in run for c in "0123456789"))


def known(run: str, text: str, start: int) -> bool:
    """Whether a run is a digest or an identifier, or embedded data, by its own form or by what stands before it."""
    bare = run.rstrip("=")
    if any(form.fullmatch(bare) for form in (DIGEST, NAMED_DIGEST, UUID, NUMBERS)):
        return True
    before = text[max(0, start - 10) : start]
    return before.endswith(BEFORE_DATA) or BEFORE_DIGEST.search(before) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place in KINDS, end)`` of the fixed patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_of(text: str, runs: re.Pattern, rules: RandomRules, encoding) -> list[tuple[int, int, int]]:
    """The base spans and the random runs that do not lie inside one of them."""
    found = base_spans(text)
    random = []
    at, reach = 0, 0  # base spans passed, and how far they reach
    for match in runs.finditer(text):
        start, end = match.span()
        while at < len(found) and found[at][0] <= start:
            reach = max(reach, found[at][2])
            at += 1
        run = match.group()
        if end <= reach or not mixed(run) or known(run, text, start):
            continue
        if len(run) < rules.ratio * token_count(run, encoding):
            random.append((start, 3, end))
    return sorted(found + random) if random else found


_ENCODINGS: dict = {}


def _encoding(name: str, ranks: dict[bytes, int]):
    """One encoder per worker process and vocabulary."""
    if name not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[name] = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def secret_spans(
    df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: RandomRules | None = None
) -> DataFrame:
    """The ``keep`` columns and ``spans``, an array of ``kind``, ``start``, ``end`` per row.

    Spans are in code points, the end exclusive, ordered by start and then by ``KINDS``. A NULL or empty
    text has none. Repeated rows each give their row, an empty table none; other columns are not read, so their names
    cannot clash. Work is one pass without a shuffle; memory is bounded by a slice of a batch and the longest text.
    ``tokenizer`` is a tiktoken file on the driver; its ranks, of fixed size, are broadcast.
    """
    rules = rules or RandomRules()
    runs = re.compile(rf"[A-Za-z0-9+/_-]{{{rules.length},}}={{0,2}}")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    source = df.select(*[as_column(c) for c in keep], as_column(text).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("spans", T.ArrayType(SPAN))])
    width = len(keep)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer, shared.value)
        for batch in batches:
            for part in slices(batch, width, BATCH_BYTES):
                found = [spans_of(t.as_py() or "", runs, rules, encoding) for t in part.column(width)]
                offsets = [0]
                for each in found:
                    offsets.append(offsets[-1] + len(each))
                flat = [s for each in found for s in each]
                values = pa.StructArray.from_arrays(
                    [
                        pa.array([KINDS[k] for _, k, _ in flat], pa.string()),
                        pa.array([s for s, _, _ in flat], pa.int64()),
                        pa.array([e for _, _, e in flat], pa.int64()),
                    ],
                    fields=list(span),
                )
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], lists], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def secret_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document the number of spans of each kind, the digest of the base spans, and all spans as text."""

    def listed(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return secret_spans(docs, tokenizer).select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
