"""Line-first cleaning: rules drop lines, and documents that lose too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column

# Phrases of page furniture in English, German, French and Spanish, as regular expressions for lower-case text. The
# first mark a line of any length, the others, which sentences hold too, only a short one.
BOILERPLATE = (
    r"all rights reserved|cookies? (policy|settings|consent)|accept (all )?cookies|privacy policy|"
    r"terms (of|and) (use|service|conditions)|enable javascript|javascript is (disabled|required)|lorem ipsum|"
    r"alle rechte vorbehalten|cookie-einstellungen|(alle )?cookies akzeptieren|"
    r"tous droits r(é|É)serv(é|É)s|accepter (tous )?les cookies|politique de confidentialit(é|É)|"
    r"todos los derechos reservados|aceptar (todas )?las cookies|pol(í|Í)tica de (cookies|privacidad)"
)
CALLS = (
    r"subscribe to our|sign up for|click here|read more|share this|follow us|"
    r"hier klicken|mehr lesen|weiterlesen|folgen sie uns|"
    r"cliquez ici|lire la suite|suivez-nous|haga clic aqu(í|Í)|leer m(á|Á)s|s(í|Í)guenos"
)
SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&<>!?^~=_{}"
SEPARATORS = "|·•"
ARROWS = ("»«", "›‹")  # a separator unless its counterpart makes it a quotation mark
TERMINAL = ".!?:;\"')]}”’…"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; the defaults are the production parameters.

    ``marks_per_word``: a line fails if it has more marks (``#*$%&<>!?^~=_{}``).
    ``menu_separators``: a line with at least so many separators (``|``, ``·``, ``•``, and ``»`` or ``›`` beyond the
    number of ``«`` or ``‹``) fails if it has one for every ``words_per_separator`` words or fewer.
    ``fragment_words``: a line of fewer words that does not end like a sentence fails. ``call_words``: a
    line of fewer words fails if it holds one of ``CALLS``. ``max_lost``: share of a document's words, in per cent,
    that may be dropped.
    """

    marks_per_word: float = 0.5
    menu_separators: int = 2
    words_per_separator: int = 4
    fragment_words: int = 5
    call_words: int = 8
    max_lost: int = 30
    min_words: int = 20
    max_repeated: int = 30


MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in "n_failed_lines n_lost_words".split()]
    + [T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())]
)


_SINGLE = [c.encode() for c in SEPARATORS]
_PAIRED = [(right.encode(), left.encode()) for right, left in ARROWS]
_BOILERPLATE, _CALLS = re.compile(BOILERPLATE.encode()), re.compile(CALLS.encode())


def line_fails(line: bytes, n_words: int, rules: LineRules) -> bool:
    """Whether a line that holds words breaks a punctuation, navigation or boilerplate rule."""
    if len(line) - len(line.translate(None, MARKS)) > rules.marks_per_word * n_words:
        return True
    separators = sum(map(line.count, _SINGLE)) + sum(max(0, line.count(right) - line.count(left)) for right, left in _PAIRED)
    if separators >= rules.menu_separators and separators * rules.words_per_separator >= n_words:
        return True
    if n_words < rules.fragment_words and not line.decode(errors="replace").rstrip(" \t\r\v\f").endswith(
        tuple(TERMINAL)
    ):
        return True
    lower = line.lower()
    return _BOILERPLATE.search(lower) is not None or (n_words < rules.call_words and _CALLS.search(lower) is not None)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur at least twice.

    Windows get exact ranks by doubling: a pair of equal ranks is an equal window
    of twice the length. A length at which nothing repeats ends the search.
    """
    if len(words) <= window:
        return 0
    codes: dict[bytes, int] = {}
    ranks = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = ranks[:-width] * np.int64(len(words) + 1) + ranks[width:]
        values, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        width *= 2
    twice = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str | None, rules: LineRules) -> tuple:
    """The row of ``MEASURES`` for one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # splits at exactly the bytes 09-0D and 20
    letters = sum(map(len, words))
    seen: set[bytes] = set()
    kept_lines, duplicates, failed, lost = [], 0, 0, 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
            if line_fails(line, n, rules):
                failed += 1
                lost += n
                continue
        kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeated * len(words)
    kept = not base_failed and 100 * lost <= rules.max_lost * len(words)
    cleaned = b"\n".join(kept_lines).decode() if failed else text
    return (
        len(words),
        len(text) - (len(raw) - letters),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        duplicates,
        repeats,
        base_failed,
        failed,
        lost,
        kept,
        cleaned,
    )


def quality_measures(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: LineRules | None = None
) -> DataFrame:
    """One row per document: the ``keep`` columns and ``MEASURES``; ``cleaned`` is the text without failed lines.

    A NULL text counts as empty; it has no words and fails the base rule. Lines
    without a word never fail. Repeated rows each give their row, an empty table
    none. Work is one pass without a shuffle; memory is bounded by an Arrow
    batch and the longest text.
    """
    rules = rules or LineRules()
    source = df.select(*[as_column(c) for c in keep], as_column(text).alias("__text"))
    schema = T.StructType([*df.select(*[as_column(c) for c in keep]).schema, *MEASURES])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [
            {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}[f.dataType]
            for f in MEASURES
        ]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [measure(t.as_py(), rules) for t in part.column(width)]
                values = [pa.array(v, k) for v, k in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *values], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """Documents that pass, with the cleaned text and its length; the columns stay those of ``docs``."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    measured = quality_measures(docs, "text", others, rules).filter("kept")
    new = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return measured.select(*[new[c].alias(c) if c in new else as_column(c) for c in docs.columns])


def _counted(char: str) -> str:
    return f"(length(line) - length(replace(line, '{char}', '')))"


_SEPARATORS = " + ".join(
    [*map(_counted, SEPARATORS), *(f"greatest(0, {_counted(right)} - {_counted(left)})" for right, left in ARROWS)]
)

# The same measures and verdict with the production parameters.
ORACLE_SQL = rf"""
with texts as (select doc_id, coalesce(text, '') as text, row_number() over () as row from documents),
words as (
  select row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from texts),
lines as (
  select row, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from (select row, unnest(string_split(text, chr(10))) as line,
          generate_subscripts(string_split(text, chr(10)), 1) as pos from texts)),
judged as (
  select row, n, row_number() over (partition by row, line order by pos) > 1 as duplicate,
    length(regexp_replace(line, '[^#*$%&<>!?^~=_{{}}]', '', 'g')) > 0.5 * n
    or ({_SEPARATORS} >= 2 and 4 * ({_SEPARATORS}) >= n)
    or (n < 5 and not regexp_matches(line, '[.!?:;"\x27)\]}}”’…][ \t\r\x0B\x0C]*$'))
    or regexp_matches(lower(line), '{BOILERPLATE}') or (n < 8 and regexp_matches(lower(line), '{CALLS}')) as failed
  from lines where n > 0),
by_line as (
  select row, count(*) filter (where duplicate) as n_dup_lines, count(*) filter (where failed) as n_failed_lines,
    coalesce(sum(n) filter (where failed), 0) as n_lost_words
  from judged group by row),
windows as (
  select row, unnest(range(1, len(words) - 6)) as start,
    unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i : i + 7], ' '))) as w
  from words where len(words) >= 8),
twice as (
  select row, start from (select row, start, count(*) over (partition by row, w) as c from windows) where c > 1),
repeats as (
  select row, count(distinct p) as n from (select row, unnest(range(start, start + 8)) as p from twice) group by row),
measured as (
  select doc_id, len(words) as n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
    coalesce(n_failed_lines, 0) as n_failed_lines, coalesce(n_lost_words, 0)::bigint as n_lost_words
  from words left join by_line using (row) left join repeats r using (row))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * n_lost_words <= 30 * n_words as kept
from measured
"""
