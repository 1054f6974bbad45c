"""Spelling variants: each word's commoner near word, found without pairs of words.

Two words are near if one inserted, deleted or replaced code point makes one of the
other.

1. Replacements.  A word of length L stands in L wildcard groups, one for each
   (position, what is before it, what is behind it).  Words that differ by one
   replaced code point share exactly one group, so a group's size and its top two
   words say all that a member has to know: how many others there are, and the best
   of them.
2. Insertions and deletions.  The distinct results of deleting one code point are
   joined to the vocabulary; each result that is a word counts for both sides, and
   of each side's words only the number and the best are kept.
3. A word's form is the best near word, if it is ``RATIO`` times as frequent; forms
   are followed to the root by pointer doubling.  Each step multiplies the count by
   ``RATIO``, which bounds the steps by the largest count.

All of it is column expressions, aggregations and equi-joins.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fewest code points and occurrences of a word.
LENGTH, COUNT = 6, 5
#: A form is at least so many times as frequent as the word.
RATIO = 5
#: Of the runs whose hash this divides, one code point is deleted.  Fixed value.
MISSPELT = 199
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"


def without(word: Column, at: Column) -> Column:
    """The word without its code point at a 0-based place."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """(word, n): the words of at least ``length`` code points that occur at least ``count`` times.

    A run too short to become a word is left out where it is found; counts are combined before the shuffle.
    """
    own = common.only(docs, "doc_id", "text")
    # Greedy, from a run's first letter on: all of it.
    runs = own.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    spelt = F.when(h % MISSPELT == 0, without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = runs.select(spelt.alias("word")).filter(F.length("word") >= length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def _key(n: Column, word: Column) -> Column:
    """A struct whose least is the most frequent, ties the first in code-point order."""
    return F.struct((-n).alias("n"), word.alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """(word, k, best): how many words differ by one replaced code point, and the best of them; a row a group with others.

    A group has at most as many members as there are letters, and is told by its size
    and its first two words.
    """
    cut = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    # No letter, so that its place is that of the wildcard.
    group = F.concat(F.substring("word", F.lit(1), F.col("at")), F.lit("*"), F.substring("word", F.col("at") + 2, F.length("word")))
    all_of = Window.partitionBy("group")
    order = all_of.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("n"), "word")
    told = cut.select("word", "n", group.alias("group")).select("word", F.count(F.lit(1)).over(all_of).alias("size"), F.first(own).over(order).alias("first"), F.nth_value(own, 2).over(order).alias("second"))
    return told.filter("size > 1").select("word", (F.col("size") - 1).alias("k"), F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))


def shortened(words: DataFrame, length: int) -> DataFrame:
    """(word, k, best) of the words that are this one but for an inserted or deleted code point: rows for both sides."""
    cut = words.filter(F.length("word") > length).select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    # Of equal letters in a row, deleting any gives the same: the last stands for all.
    cut = cut.filter(F.substring("word", F.col("at") + 1, F.lit(1)) != F.substring("word", F.col("at") + 2, F.lit(1)))
    met = cut.select("word", "n", without(F.col("word"), F.col("at")).alias("less")).join(words.select(F.col("word").alias("less"), F.col("n").alias("less_n")), "less")
    longer = met.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.min(_key(F.col("less_n"), F.col("less"))).alias("best"))
    shorter = met.groupBy("less").agg(F.count(F.lit(1)).alias("k"), F.min(_key(F.col("n"), F.col("word"))).alias("best"))
    return longer.union(shorter)


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form), if no chain is longer than ``steps``."""
    to = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        beyond = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = common.materialize(to.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return to


def group(docs: DataFrame, *, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text).

    Words are maximal runs of Latin letters in lower case (A-Z only), misspelt where
    their hash says so.  Null or empty text: no words.  A null doc_id is hashed as the
    empty string.  Repeated rows count as often as they stand there.  Ties: the near
    word that is first in code-point order.  Texts of any length are taken whole.
    Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    if ratio < 2:
        raise ValueError("forms lead to a root only if each is more frequent than the last: the ratio must be 2 or more")
    words = common.materialize(vocabulary(docs, length, count), "words")
    near = replaced(words).union(shortened(words, length)).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    near = near.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))
    told = words.join(near, "word", "left")
    holds = F.col("form_n") >= ratio * F.col("n")
    told = common.materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or count
    steps = math.ceil(math.log(most / count, ratio)) + 1
    found = roots(told.filter("form IS NOT NULL").select("word", "form"), steps)
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents."""
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# A remainder table is made by eight steps a byte; the checksum walks over the bytes.
_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384::BIGINT) ELSE {c} >> 1 END"
_DOWN, _UP = string.ascii_lowercase, string.ascii_uppercase
#: Pairs are written out here, by the keys they share.
ORACLE_SQL = f"""WITH RECURSIVE b0 AS (SELECT unnest(range(256)) AS i, unnest(range(256)) AS c),
{", ".join(f"b{k + 1} AS (SELECT i, {_STEP.format(c='c')} AS c FROM b{k})" for k in range(8))},
t AS (SELECT list(c ORDER BY i) AS t FROM b8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{6,}}')), '{_UP}', '{_DOWN}') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM o GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda j: (strpos('0123456789ABCDEF', x[j]) * 16 + strpos('0123456789ABCDEF', x[j + 1]) - 17)::BIGINT)),
  lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM r, t),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substring(word, 1, i) AS head, substring(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.head || d.tail = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.head || d.tail = w.word),
k AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, (SELECT min(p.other) FROM p WHERE p.word = w.word AND p.n = k.most) AS best, k.most FROM w LEFT JOIN k ON k.word = w.word),
g AS (SELECT word, n, n_near, CASE WHEN most >= 5 * n THEN best END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM f),
c AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT c.word, g.word, g.form FROM c JOIN g ON g.word = c.next)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word AND c.next IS NULL"""
