"""Byte-level BPE by prefix-sharing trie traversal.

In the encoding of a word's prefix only the last token has to be known: the
token before it is the last one of a shorter prefix. The last token is the only
suffix that is a token and that plain merging leaves as a neighbour of the
shorter prefix's last token. Distinct words are put into a trie, and a
depth-first walk gives every node the last token of its prefix, so a prefix that
many words share is worked out once.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column
from .batches import slices

# The pre-tokenizer's pattern, and Unicode's White_Space characters, which it calls \s.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# Chunks never split a word of PATTERN: one optional blank and what follows up to the next white space.
CHUNKS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

TRIE_WORDS = 20_000  # words of one trie
BATCH_BYTES = 4 << 20  # texts whose words are put into tries together
CACHED_BYTES = 96 << 20
PIECE_BYTES = 240  # of a cached piece besides its text
CACHED_PAIRS = 500_000

# A piece stands for itself with a blank before it. One that begins with a line break, or behind START, stands
# for itself alone, and one behind SPECIAL for a special string. Texts with these characters are unsafe to cut.
START, SPECIAL = "\x00", "\x01"
UNSAFE_CUTS = ("  ", "\n\n", " \n", "\n ", START, SPECIAL)


def piece_text(piece: str) -> str:
    if piece.startswith(START):
        return piece[1:]
    return piece if piece.startswith("\n") else " " + piece


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: Latin-1's visible characters stand for themselves,
    the other bytes, in order, for the code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Tokens as bytes, merges by rank, and strings that are always one token."""

    token_bytes: list[bytes]
    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_json(cls, content: str) -> Vocabulary:
        """From the text of a byte-level ``tokenizer.json`` without normalizer."""
        model = json.loads(content)
        alphabet = byte_alphabet()
        texts = model["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        size = max([*texts.values(), *specials.values()]) + 1
        token_bytes = [b""] * size
        for token, i in texts.items():
            if token not in specials:
                token_bytes[i] = bytes(alphabet[c] for c in token)
        ids = {b: i for i, b in enumerate(token_bytes) if b}
        for token, i in specials.items():
            token_bytes[i] = token.encode()
        merges = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            merges[texts[left], texts[right]] = (rank, texts[left + right])
        return cls(token_bytes, ids, merges, specials)


class Encoder:
    """Encodes and decodes with bounded memory: caches are emptied when they are full."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = True):
        self.vocabulary = vocabulary
        self.lengths = list(map(len, vocabulary.token_bytes))
        self.token_lengths = np.array(self.lengths, np.int64)
        self.token_data = np.frombuffer(b"".join(vocabulary.token_bytes), np.uint8)
        self.words = regex.compile(PATTERN)
        self.chunks = re.compile(CHUNKS)
        self.specials = vocabulary.specials if specials else {}
        self.split = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
            if self.specials
            else None
        )
        self.cache: dict[str, bytes] = {}
        self.cached_bytes = 0
        self.pairs: dict[int, bool] = {}
        self.starts = {b[:n] for b in vocabulary.ids for n in range(len(b) + 1)}
        self.states, self.state_ends, self.state_tokens = {b"": 0}, [b""], [[]]
        self.steps: dict[int, int] = {}
        self.made_from = {whole: (rank, *pair) for pair, (rank, whole) in vocabulary.merges.items()}
        self.edges: tuple[dict, dict] = ({}, {})

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens on a token's right (``side`` 1) or left (0) edge while it is merged, from the whole token
        down to a byte, each with the rank of the merge that uses it up."""
        found = self.edges[side].get(token)
        if found is None:
            found, part, until = [], token, float("inf")
            while True:
                found.append((part, until))
                if part not in self.made_from:
                    break
                rank, *halves = self.made_from[part]
                part, until = halves[side], rank
            self.edges[side][token] = found
        return found

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives just these two tokens.

        It does unless a pair across the border merges while both its halves
        exist. Among equal ranks the leftmost pair merges first, so a pair across the
        border comes after one inside the left token and before one inside the right.
        """
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        merges, valid = self.vocabulary.merges, True
        for a, until_a in self.edge(left, 1):
            for b, until_b in self.edge(right, 0):
                merge = merges.get((a, b))
                if merge is not None and merge[0] < until_a and merge[0] <= until_b:
                    valid = False
        self.pairs[left << 20 | right] = valid
        return valid

    def state_after(self, state: int, byte: int) -> int:
        """The state of a prefix, one byte on. A state stands for the longest end of the
        prefix with which some token starts; all tokens that end the prefix are ends of it."""
        end = self.state_ends[state] + bytes([byte])
        while end not in self.starts:
            end = end[1:]
        if end not in self.states:
            self.states[end] = len(self.state_ends)
            self.state_ends.append(end)
            ids = self.vocabulary.ids
            ends = [(len(end) - i, ids.get(end[i:])) for i in range(len(end))]
            self.state_tokens.append([(n, token) for n, token in ends if token is not None])
        self.steps[state << 8 | byte] = self.states[end]
        return self.states[end]

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Token ids of sorted, distinct words.

        The sorted words are their trie laid out depth first: each word leaves its
        predecessor's path at their common prefix. The path's nodes carry the
        state and the last token, so only the nodes of the new branch are worked out.
        """
        result: dict[bytes, list[int]] = {}
        steps, state_tokens, pairs, lengths = self.steps, self.state_tokens, self.pairs, self.lengths
        path, states, last = b"", [0], [0]
        for word in words:
            depth, most = 0, min(len(path), len(word))
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del states[depth + 1 :], last[depth + 1 :]
            state = states[depth]
            for byte in word[depth:]:
                depth += 1
                state = steps.get(state << 8 | byte) or self.state_after(state, byte)
                for length, token in state_tokens[state]:
                    if length == depth:
                        break
                    before = last[depth - length]
                    valid = pairs.get(before << 20 | token)
                    if valid or valid is None and self.neighbours(before, token):
                        break
                states.append(state)
                last.append(token)
            path, found = word, []
            while depth:
                token = last[depth]
                found.append(token)
                depth -= lengths[token]
            found.reverse()
            result[word] = found
        return result

    def pieces(self, text: str) -> list[str]:
        """A text cut where no word spans the cut, with special strings as pieces of their own."""
        parts = self.split.split(text) if self.split else [text]
        # Every second part is a special string.
        return [
            piece
            for i, part in enumerate(parts)
            for piece in ([SPECIAL + part] if i % 2 else [START + chunk for chunk in self.chunks.findall(part)])
        ]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of all texts, and where each text's pieces begin.

        Cutting at single blanks and line breaks is exact unless two of them meet;
        such texts are cut by the pattern instead.
        """
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring(texts, UNSAFE_CUTS[0])
        for pattern in (*UNSAFE_CUTS[1:], *self.specials):
            unsafe = pc.or_(unsafe, pc.match_substring(texts, pattern))
        safe = texts.filter(pc.invert(unsafe))
        broken = pc.replace_substring(safe, "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(START, broken, ""), " ")
        if len(safe) < len(texts):
            others = pa.array([self.pieces(t) for t in texts.filter(unsafe).to_pylist()], pa.list_(pa.string()))
            flags = unsafe.to_numpy(zero_copy_only=False)
            order = np.where(flags, len(safe) + np.cumsum(flags) - 1, np.cumsum(~flags) - 1)
            lists = pa.concat_arrays([lists, others]).take(pa.array(order))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Token ids (as int32 bytes) of distinct pieces, a bounded trie at a time, neighbours in one trie."""
        pieces.sort()
        known: dict[str, bytes] = {}
        for at in range(0, len(pieces), TRIE_WORDS):
            split = {}
            for piece in pieces[at : at + TRIE_WORDS]:
                if piece.isascii() and piece.isalpha():
                    split[piece] = [b" " + piece.encode()]
                elif piece.startswith(SPECIAL):
                    known[piece] = array("i", [self.specials[piece[1:]]]).tobytes()
                else:
                    split[piece] = [w.encode() for w in self.words.findall(piece_text(piece))]
            ids = self.encode_words(sorted(set(chain.from_iterable(split.values()))))
            for piece, found in split.items():
                known[piece] = array("i", chain.from_iterable(map(ids.__getitem__, found))).tobytes()
        return known

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and where each text's begin; a NULL text has none.

        The pieces met first stay cached until the cache is full; the others live as long as the batch.
        """
        pieces, begins = self.cut(texts)
        coded = pieces.dictionary_encode()
        distinct, cache = coded.dictionary.to_pylist(), self.cache
        new = self.learn([piece for piece in distinct if piece not in cache])
        ids = [new[piece] if piece in new else cache[piece] for piece in distinct]
        if self.cached_bytes < CACHED_BYTES:
            cache |= new
            self.cached_bytes += sum(PIECE_BYTES + 2 * len(piece) for piece in new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, starts = gather(np.frombuffer(b"".join(ids), np.int32), lengths, coded.indices.to_numpy())
        return values, starts[begins]

    def decode_batch(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The texts of token ids; bytes that are no UTF-8 become replacement characters."""
        data, starts = gather(self.token_data, self.token_lengths, ids)
        offsets = pa.py_buffer(starts[begins].astype(np.int32))
        texts = pa.StringArray.from_buffers(len(begins) - 1, offsets, pa.py_buffer(data))
        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            return pa.array([t.as_py().decode(errors="replace") for t in texts.view(pa.binary())])


def gather(values: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (of the given lengths, one after another) in the order of ``index``, and where each begins."""
    sources = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    sizes = lengths[index]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shifts = np.repeat((sources[index] - starts[:-1]).astype(np.int32), sizes)
    shifts += np.arange(len(shifts), dtype=np.int32)
    return values[shifts], starts


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary, specials: bool, key: str) -> Encoder:
    """One encoder per worker process and vocabulary (a broadcast value)."""
    if (key, specials) not in _ENCODERS:
        _ENCODERS[key, specials] = Encoder(vocabulary.value, specials)
    return _ENCODERS[key, specials]


def broadcast_vocabulary(spark, tokenizer: str):
    """The vocabulary file, read on the driver: its size is fixed (here some MB), whatever the corpus."""
    with open(tokenizer, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(Vocabulary.from_json(file.read()))


IDS = T.ArrayType(T.IntegerType(), False)


def encode(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    specials: bool = True,
    decoded: bool = False,
) -> DataFrame:
    """The ``keep`` columns with ``ids``, and with ``decoded`` the text decoded from them again.

    ``specials``: strings such as an end-of-text mark in a text become their one
    token; otherwise they are ordinary text. A NULL or empty text has no tokens
    and decodes to an empty text. One pass without a shuffle; a worker holds an
    Arrow batch, one bounded trie and bounded caches.
    """
    vocabulary, key = broadcast_vocabulary(df.sparkSession, tokenizer), tokenizer
    kept = df.select(*[as_column(c) for c in keep])
    source = df.select(*[as_column(c) for c in keep], as_column(text).alias("__text"))
    fields = [T.StructField("ids", IDS, False)] + [T.StructField("decoded", T.StringType(), False)] * decoded
    schema = T.StructType([*kept.schema, *fields])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, specials, key)
        for batch in batches:
            for part in slices(batch, width, BATCH_BYTES):
                ids, begins = encode.encode_batch(part.column(width))
                arrays = [
                    *part.columns[:width],
                    pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids)),
                    *([encode.decode_batch(ids, begins)] * decoded),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the token ``ids``, ``n_tokens`` and ``exact``: the ids decode to the text."""
    columns = ("doc_id", "lang", "source", "text")
    coded = encode(docs, tokenizer, "text", columns, decoded=True)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"),
        "ids",
    )
