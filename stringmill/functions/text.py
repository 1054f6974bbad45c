"""Column builders over texts: literals as regular expressions, windows, hashes.

Positions are 0-based code points throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are cut into pieces of so many characters before single positions are looked at.
CHUNK = 256


def quoted(literal: Column) -> Column:
    """The regular expression that matches the literal."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def lookahead(literal: Column) -> Column:
    """A regular expression that matches before each occurrence, overlapping ones too."""
    return F.concat(F.lit("(?s)(?="), quoted(literal), F.lit(")"))


def wildcard(pattern: Column, any_one: str = "?") -> Column:
    """Look-ahead for a pattern in which ``any_one`` stands for any one character."""
    escaped = F.replace(quoted(pattern), F.lit(any_one), F.lit("\\E.\\Q"))
    return F.concat(F.lit("(?s)(?="), escaped, F.lit(")"))


def split_positions(text: Column, look: Column, at_start: Column) -> Column:
    """Array of the places where a look-ahead matches.

    ``split`` at an empty match keeps all characters, so a match lies at the end of
    each piece but the last; a match at 0 makes no piece and is added.
    """
    pieces = F.split(text, look, -1)
    ends = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + F.length(x))).alias("ends")),
        lambda acc: acc["ends"],
    )
    return F.concat(F.when(at_start, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), ends)


def chunks(df: DataFrame, text: str, overlap: Column | int, size: int = CHUNK) -> DataFrame:
    """A row a piece of ``size`` characters and ``overlap`` more: columns ``start`` and ``chunk``; the text itself goes.

    A position belongs to the piece in which it starts, so pieces share no hit.  The
    text is cut once, by a regular expression that takes ``size`` characters at a
    time; the overlap is taken from the pieces that follow.  So time is in proportion
    to the text, and no piece carries the whole of it.
    """
    overlap = overlap if isinstance(overlap, Column) else F.lit(overlap)
    more = (F.ceil(overlap / size) + 1).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    # The pieces are bound to a name, so they are made once a text and not once a piece.
    cut = F.transform(F.array(pieces), lambda all_: F.transform(all_, lambda _, k: F.struct((k * size).alias("start"), F.substring(F.array_join(F.slice(all_, k + 1, more), ""), F.lit(1), overlap + size).alias("chunk"))))
    return df.select("*", F.explode(F.element_at(cut, 1)).alias("_piece")).select(*[c for c in df.columns if c != text], "_piece.start", "_piece.chunk")


def windows(df: DataFrame, length: Column, size: int = CHUNK) -> DataFrame:
    """From ``start`` and ``chunk``, a row for each whole window of ``length``: ``pos`` and ``window``."""
    last = F.least(F.length("chunk") - length, F.lit(size - 1))
    inside = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>")))
    return df.withColumn("_k", inside).withColumn("pos", (F.col("start") + F.col("_k")).cast("long")).withColumn("window", F.substring(F.col("chunk"), F.col("_k") + 1, length)).drop("_k")


def polynomial_hash(text: Column, base: int = 256, prime: int = 101) -> Column:
    """Rolling hash of the whole text, character by character."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise((a * base + F.ascii(c)) % prime))
