"""Statistics of whole texts, one row a document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LETTERS_UP = bytes(range(65, 91))
_LETTERS = _LETTERS_UP + bytes(range(97, 123))
_DIGITS = b"0123456789"
_STOPS = b".,;:!?"

#: Columns that ``measure`` makes, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_stops", "n_bangs", "n_same_next", "longest_word", "n_wide")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence too."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, end = 0, 0
    for k, w in enumerate(windows):
        if often[w] > 1:
            total += k + 3 - max(end, k)
            end = k + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text; a null text counts as empty.

    Words are runs of anything but the six ASCII white-space characters, as
    ``bytes.split`` cuts them; characters are code points.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(raw)
    without = lambda drop: n - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return (
        len(words),
        len(text) - without(_SPACE),
        without(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(text),
        len(lines),
        len(set(words)),
        without(_LETTERS_UP),
        without(_LETTERS),
        without(_DIGITS),
        without(_STOPS),
        raw.count(b"!"),
        sum(map(bytes.__eq__, words, words[1:])),
        max(map(len, words), default=0),
        n - len(text),
    )


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of docs and the counts of ``text``, a row a document.

    Null text: all counts 0.  Repeated rows stay.  Other columns fall away, so none
    can clash with a count.
    """
    fields = list(common.only(docs, *keep).schema)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            counts = zip(*map(measure, batch.column(len(keep)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in counts)], [*keep, *COUNTS])

    return common.only(docs, *keep, "text").mapInArrow(run, schema)


#: Ratios of the counts, in the order of ``shares``.
SHARES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "stop_share", "bang_share", "same_next_share", "distinct_share", "word_length", "line_words", "letter_share", "log_words", "longest_word")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.when(whole != 0, whole), F.lit(0.0))


def shares() -> dict[str, Column]:
    """Ratios of the counts, as column expressions; 0 where the whole is 0."""
    c = F.col
    return {
        "symbol_share": _share(c("n_symbols"), c("word_chars")),
        "repeat_share": _share(c("n_repeat_words"), c("n_words")),
        "dup_line_share": _share(c("n_dup_lines"), c("n_lines")),
        "upper_share": _share(c("n_upper"), c("n_letters")),
        "digit_share": _share(c("n_digits"), c("word_chars")),
        "stop_share": _share(c("n_stops"), c("n_words")),
        "bang_share": _share(c("n_bangs"), c("n_words")),
        "same_next_share": _share(c("n_same_next"), c("n_words")),
        "distinct_share": _share(c("n_distinct_words"), c("n_words")),
        "word_length": _share(c("word_chars"), c("n_words")),
        "line_words": _share(c("n_words"), c("n_lines")),
        "letter_share": _share(c("n_letters") + c("n_wide"), c("word_chars")),
        "log_words": F.log1p(c("n_words")),
        "longest_word": c("longest_word").cast("double"),
    }
