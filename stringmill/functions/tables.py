"""The searches as table functions of SQL.

After ``register(spark)``::

    SELECT * FROM search(TABLE(SELECT doc_id, text FROM documents), array('the', 'on'), 'rabin_karp')
    SELECT * FROM search_levenshtein(TABLE(SELECT doc_id, text FROM documents), array('there'), 1)

The first two columns of the table are a text's key, of any type, and the text; each
row of the result is a hit.  ``register_search`` adds a function for an algorithm of
one's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: ``prepare(text)`` is called once a text; ``hits(text, pattern, prepared, errors)`` gives (pos, dist).
Prepare, Hits = Callable[[str], object], Callable[[str, str, object, int], Iterable[tuple[int, int]]]


def _exactly(starts: Callable[[str, str], Iterable[int]]) -> tuple[Prepare, Hits]:
    return (lambda text: None), (lambda text, pattern, prepared, errors: ((at, 0) for at in starts(text, pattern)))


def algorithms() -> dict[str, tuple[Prepare, Hits]]:
    """The seven searches of one text by name."""
    import numpy as np

    from ..operators import approx, exact
    from . import arrays as A

    found = _exactly(exact.find_all)
    return {
        "naive": _exactly(lambda t, p: np.flatnonzero(A.prefix_lengths(t, p) == len(p)).tolist()),
        "kmp": found,
        "boyer_moore": found,
        "suffix_tree": (A.suffix_order, lambda t, p, order, k: ((at, 0) for at in A.find_in_order(t, order, p))),
        "rabin_karp": _exactly(exact.hash_hits),
        "shift_or": ((lambda text: None), lambda t, p, _, k: approx.mismatches(t, p, k)),
        "levenshtein": ((lambda text: None), lambda t, p, _, k: approx.greedy_hits(t, p, k)),
    }


def table_function(of: Callable[[str], tuple[Prepare, Hits]], fixed: str | None = None):
    """A table function of (texts, patterns[, algorithm][, errors]); with a ``fixed`` algorithm there is no such argument."""

    class Search:
        @staticmethod
        def analyze(texts: AnalyzeArgument, patterns: AnalyzeArgument, *more: AnalyzeArgument) -> AnalyzeResult:
            if not texts.isTable or len(texts.dataType.fields) < 2 or not isinstance(texts.dataType.fields[1].dataType, StringType):
                raise ValueError("the first argument must be TABLE(...) of a key and a text")
            if not isinstance(patterns.dataType, ArrayType):
                raise ValueError("the second argument must be an array of patterns")
            if not fixed and (not more or not more[0].isConstantExpression):
                raise ValueError("the third argument must name an algorithm")
            of(fixed or more[0].value)
            key = texts.dataType.fields[0]
            return AnalyzeResult(StructType([StructField(key.name, key.dataType), StructField("pattern", StringType()), StructField("pos", LongType()), StructField("dist", LongType())]))

        def eval(self, row: Row, patterns: list[str], *more) -> Iterator[tuple]:
            if row[1] is None:
                return
            prepare, hits = of(fixed or more[0])
            errors, text = int((more if fixed else more[1:] or (0,))[0]) if more else 0, row[1]
            prepared = prepare(text)
            for p in patterns or ():
                for pos, dist in hits(text, p, prepared, errors) if p else ():
                    yield row[0], p, int(pos), int(dist)

    return udtf(Search)


def _named(name: str) -> tuple[Prepare, Hits]:
    known = algorithms()
    if name not in known:
        raise ValueError(f"no algorithm {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def register(spark: SparkSession) -> None:
    """Make ``search`` and a ``search_<algorithm>`` for each of the seven known to SQL."""
    spark.udtf.register("search", table_function(_named))
    for name in algorithms():
        spark.udtf.register(f"search_{name}", table_function(_named, name))


def register_search(spark: SparkSession, name: str, starts: Callable[[str, str], Iterable[int]]) -> None:
    """Make ``name(TABLE(...), patterns)`` known to SQL, for a function of one text and one pattern that gives the starts of hits."""
    spark.udtf.register(name, table_function(lambda _: _exactly(starts), name))
