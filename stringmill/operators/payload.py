"""The steps of a search, a row a step, in the shape of each algorithm.

``steps`` gives, for each algorithm of the registry, its own columns (``SHAPES``)
besides ``step_number``, ``step_type`` and ``explanation``; a column that a step of
that type has no use for is null.  Places are 0-based code points; windows end
before ``window_end``.  Steps leave a worker in blocks, so texts may be long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import approx, exact, trace

#: Steps that leave a worker at once.
STEP_ROWS = 5_000
#: Suffixes of a text that are shown while its tree is made, characters of each, and places listed at a node.
SHOWN_SUFFIXES, SHOWN_CHARACTERS, SHOWN_PLACES = 5, 20, 10

_COMPARED = "array<struct<text_index:int,pattern_index:int,text_char:string,pattern_char:string,is_match:boolean>>"
_WINDOW = "window_start int, window_end int"
#: Columns of each algorithm's steps.
SHAPES = {
    "naive": f"text_position int, pattern_position int, {_WINDOW}, comparisons {_COMPARED}, comparisons_count int, is_match boolean, match_found boolean, total_comparisons_so_far long",
    "kmp": f"failure_function array<int>, text_index int, pattern_index int, new_pattern_index int, {_WINDOW}, comparisons {_COMPARED}, comparisons_count int, backtracked boolean, "
    "backtrack_details array<struct<from_j:int,to_j:int,failure_value:int,reason:string>>, is_match boolean, match_position int, total_comparisons_so_far long, current_alignment int",
    "boyer_moore": f"bad_char_table map<string,int>, text_position int, pattern_index int, {_WINDOW}, comparisons {_COMPARED[:-2]},direction:string>>, comparisons_count int, is_match boolean, match_position int, "
    "shift int, shift_reason string, chars_skipped int, total_comparisons_so_far long, mismatch_char string, bad_char_position int, scan_direction string",
    "suffix_tree": "suffix_index int, suffix string, suffix_preview string, char_index int, current_char string, path string, char_found boolean, nodes_visited int, suffix_indices array<int>, "
    "num_matches_so_far int, depth_in_tree int, pattern_found boolean, matches_found int, match_positions array<int>",
    "rabin_karp": f"pattern_hash int, base int, prime int, h_value int, text_position int, {_WINDOW}, window_text string, current_hash int, hash_match boolean, hash_comparisons_so_far long, "
    f"character_comparisons {_COMPARED}, character_comparisons_count int, is_match boolean, is_spurious_hit boolean, next_hash int, total_comparisons_so_far long",
    "levenshtein": "start_position int, substring string, substring_length int, dp_matrix array<array<int>>, dp_row int, dp_col int, pattern_char string, text_char string, is_match boolean, deletion_cost int, "
    "insertion_cost int, substitution_cost int, chosen_cost int, operation string, predecessor_cells struct<diagonal:int,left:int,top:int>, edit_distance int, pattern_aligned string, text_aligned string, operations array<string>",
    "shift_or": "pattern_masks map<string,string>, initial_states array<string>, match_mask string, text_index int, text_char string, char_in_pattern boolean, char_mask string, old_states array<string>, "
    "new_states array<string>, matches_found array<struct<position:int,errors:int,state_level:int>>",
}

Step = tuple[str | None, str, dict]


def _compared(text: str, pattern: str, at: int, places, **more) -> list[dict]:
    return [{"text_index": at + j, "pattern_index": j, "text_char": text[at + j], "pattern_char": pattern[j], "is_match": text[at + j] == pattern[j], **more} for j in places]


def _naive(text: str, pattern: str) -> Iterator[Step]:
    m, total = len(pattern), 0
    for at, same in enumerate(trace.A.prefix_lengths(text, pattern).tolist()):
        own = _compared(text, pattern, at, range(min(same + 1, m)))
        total += len(own)
        said = f"All {m} characters agree at {at}" if same == m else f"At {at}, {own[-1]['text_char']!r} is not {own[-1]['pattern_char']!r} after {same} that agree"
        yield None, said, {"text_position": at, "pattern_position": 0, "window_start": at, "window_end": at + m, "comparisons": own, "comparisons_count": len(own), "is_match": same == m, "match_found": same == m, "total_comparisons_so_far": total}


def _kmp(text: str, pattern: str) -> Iterator[Step]:
    fail, m, j = trace.borders(pattern), len(pattern), 0
    yield "preprocessing", f"The longest border of each prefix is {fail}", {"failure_function": fail}
    for i, ch in enumerate(text):
        before, falls = j, []

        def fall(why: str) -> None:
            nonlocal j
            falls.append({"from_j": j, "to_j": fail[j - 1], "failure_value": fail[j - 1], "reason": f"{why} at {j}: on with {fail[j - 1]}"})
            j = fail[j - 1]

        while j and pattern[j] != ch:
            fall("Mismatch")
        fell, own = bool(falls), _compared(text, pattern, i - j, [j])
        j += own[0]["is_match"]
        whole = j == m
        if whole:
            fall("Match")
        first = i - j + 1 if j else i
        said = f"A match begins at {i - m + 1}" if whole else f"{ch!r} fits" if own[0]["is_match"] else f"{ch!r} does not fit"
        yield "search", said + (f", after {sum(d['reason'][1] == 'i' for d in falls)} fall(s)" if fell else ""), {
            "failure_function": fail, "text_index": i, "pattern_index": before, "new_pattern_index": j, "window_start": first, "window_end": first + m, "comparisons": own, "comparisons_count": 1, "backtracked": fell,
            "backtrack_details": falls, "is_match": whole, "match_position": i - m + 1 if whole else None, "total_comparisons_so_far": i + 1, "current_alignment": i - j,
        }


def _boyer_moore(text: str, pattern: str) -> Iterator[Step]:
    m, table, total = len(pattern), {c: k for k, c in enumerate(pattern)}, 0
    yield "preprocessing", f"The last place of each character is {table}", {"bad_char_table": table}
    same, shift = (x.tolist() for x in trace.shifts(text, pattern))
    for at in trace.visited(np.array(shift)):
        hit, wrong = same[at] == m, m - 1 - same[at]
        own = _compared(text, pattern, at, range(m - 1, max(wrong, 0) - 1, -1), direction="right-to-left")
        total += len(own)
        bad = None if hit else text[at + wrong]
        if hit:
            why = f"match; the next character is {text[at + m]!r}" if at + m < len(text) else "match at the end of the text"
        else:
            why = f"{bad!r} at {wrong} is " + (f"last at {table[bad]} of the pattern" if bad in table else "not in the pattern")
        yield "search", f"{same[at]} agree from the right; {why}; shift {shift[at]}", {
            "bad_char_table": table, "text_position": at, "pattern_index": wrong, "window_start": at, "window_end": at + m, "comparisons": own, "comparisons_count": len(own), "is_match": hit, "match_position": at if hit else None,
            "shift": shift[at], "shift_reason": why, "chars_skipped": shift[at] - 1, "total_comparisons_so_far": total, "mismatch_char": bad, "bad_char_position": None if hit else table.get(bad, -1), "scan_direction": "right-to-left",
        }


def _cut(s: str, most: int) -> str:
    return s if len(s) <= most else s[:most] + "..."


def _suffix_tree(text: str, pattern: str) -> Iterator[Step]:
    n = len(text)
    for i in range(min(n, SHOWN_SUFFIXES)):
        yield "preprocessing", f"Suffix {i} goes into the tree", {"suffix_index": i, "suffix": text[i:], "suffix_preview": _cut(text[i:], SHOWN_CHARACTERS)}
    if n > SHOWN_SUFFIXES:
        yield "preprocessing", f"{n - SHOWN_SUFFIXES} more suffixes go into the tree, {n} in all", {}
    starts = list(range(n))
    for k, c in enumerate(pattern):
        starts = [i for i in starts if text[i + k : i + k + 1] == c]
        known = {"char_index": k, "current_char": c, "nodes_visited": k + 1}
        if not starts:
            yield "search", f"No suffix goes on with {c!r} at depth {k}", known | {"path": pattern[:k], "char_found": False}
            return
        yield "search", f"{len(starts)} suffixes begin with {pattern[: k + 1]!r}", known | {"path": pattern[: k + 1], "char_found": True, "suffix_indices": starts[:SHOWN_PLACES], "num_matches_so_far": len(starts), "depth_in_tree": k + 1}
    yield "result", f"{len(starts)} match(es)", {"pattern_found": True, "path": pattern, "matches_found": len(starts), "match_positions": starts}


def _rabin_karp(text: str, pattern: str, base: int = 256, prime: int = 101) -> Iterator[Step]:
    m, wanted, total = len(pattern), exact.rolled(pattern, base, prime), 0
    lead = pow(base, m - 1, prime)
    yield "preprocessing", f"The pattern's hash is {wanted}, the factor of a leaving character {lead}", {"pattern_hash": wanted, "base": base, "prime": prime, "h_value": lead}
    hashes = trace.A.window_hashes(text, m, base, prime).tolist()
    same = trace.A.prefix_lengths(text, pattern).tolist()
    for at, h in enumerate(hashes):
        own = _compared(text, pattern, at, range(min(same[at] + 1, m))) if h == wanted else []
        total += len(own)
        hit = h == wanted and same[at] == m
        said = "the hash differs" if h != wanted else "hash and characters agree" if hit else "the hash agrees, the characters do not"
        yield "search", f"At {at} {said}", {
            "pattern_hash": wanted, "text_position": at, "window_start": at, "window_end": at + m, "window_text": text[at : at + m], "current_hash": h, "hash_match": h == wanted, "hash_comparisons_so_far": at + 1, "character_comparisons": own,
            "character_comparisons_count": len(own), "is_match": hit, "is_spurious_hit": h == wanted and not hit, "next_hash": hashes[at + 1] if at + 1 < len(hashes) else None, "total_comparisons_so_far": total,
        }


def _table(pattern: str, text: str) -> np.ndarray:
    """Edit distances of all prefixes of the pattern, down, to all of the text, across."""
    first = np.arange(len(text) + 1)
    return np.stack([first, *approx._rows(trace.A.codes(text), trace.A.codes(pattern), first, lambda j: j)])


def _levenshtein(text: str, pattern: str, most: int = 1, cells: bool = True) -> Iterator[Step]:
    """Cells are shown at the first three starts, and elsewhere until two matches are found; of a table its first three rows and columns and its last ones."""
    n, m, found = len(text), len(pattern), 0
    for at in range(n - m + most + 1):
        for size in range(max(1, m - most), min(n - at, m + most) + 1):
            part = text[at : at + size]
            table = _table(pattern, part)
            # As before the cells are filled: 0 but for the first row and column.
            seen = np.zeros_like(table)
            seen[0], seen[:, 0] = table[0], table[:, 0]
            if at == 0 and size == min(m + most, n):
                yield "preprocessing", f"An empty table of {m + 1} rows and {size + 1} columns", {"start_position": 0, "substring": part, "substring_length": size, "dp_matrix": seen.tolist()}
            for i in range(1, m + 1) if cells and (at < 3 or found < 2) else ():
                for j in range(1, size + 1):
                    seen[i, j] = table[i, j]
                    if not (i <= 3 or j <= 3 or i == m or j == size):
                        continue
                    same, best = pattern[i - 1] == part[j - 1], int(table[i, j])
                    diagonal, left, top = int(table[i - 1, j - 1]), int(table[i, j - 1]), int(table[i - 1, j])
                    costs = {"substitute": diagonal + (not same), "delete": top + 1, "insert": left + 1}
                    kind = next(k for k, c in costs.items() if c == best)
                    kind = "match" if kind == "substitute" and same else kind
                    yield "dp_computation", f"Row {i}, column {j}: {kind}, {best} in all", {
                        "start_position": at, "substring": part, "substring_length": size, "dp_matrix": seen.tolist(), "dp_row": i, "dp_col": j, "pattern_char": pattern[i - 1], "text_char": part[j - 1], "is_match": same, "deletion_cost": costs["delete"],
                        "insertion_cost": costs["insert"], "substitution_cost": costs["substitute"], "chosen_cost": best, "operation": kind, "predecessor_cells": {"diagonal": diagonal, "left": left, "top": top},
                    }
            if table[m, size] <= most:
                a, b, operations = approx.align(pattern, part)
                yield "match_found", f"{a} and {b} differ by {table[m, size]}", {"start_position": at, "substring": part, "substring_length": size, "dp_matrix": table.tolist(), "edit_distance": int(table[m, size]), "pattern_aligned": a, "text_aligned": b, "operations": operations}
                found += 1
                break


def _shift_or(text: str, pattern: str, most: int = 1) -> Iterator[Step]:
    """States are written with as many bits as the pattern has characters; higher ones never decide."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    absent = {c: sum(1 << k for k, x in enumerate(pattern) if x != c) for c in pattern}
    bits = lambda s: format(s, f"0{m}b")
    levels = [full] * (most + 1)
    yield "preprocessing", f"A mask of {m} bits for each of {len(absent)} characters", {"pattern_masks": {c: bits(s) for c, s in absent.items()}}
    yield "initialization", f"{most + 1} states, no prefix matched", {"initial_states": [*map(bits, levels)], "match_mask": bits(top)}
    for i, c in enumerate(text):
        old, mask = levels, absent.get(c, full)
        # Each level of errors: the old state moved on, or the level below as it was.
        levels = [(old[0] << 1 | mask) & full] + [(s << 1) & low & full for s, low in zip(old[1:], old)]
        hits = [{"position": i - m + 1, "errors": k, "state_level": k} for k, s in enumerate(levels) if not s & top and i >= m - 1]
        yield "bit_operation", f"{c!r} is {'' if c in absent else 'not '}in the pattern; {len(hits)} level(s) match", {
            "match_mask": bits(top), "text_index": i, "text_char": c, "char_in_pattern": c in absent, "char_mask": bits(mask), "old_states": [*map(bits, old)], "new_states": [*map(bits, levels)], "matches_found": hits,
        }


STEPPERS = {"naive": _naive, "kmp": _kmp, "boyer_moore": _boyer_moore, "suffix_tree": _suffix_tree, "rabin_karp": _rabin_karp, "levenshtein": _levenshtein, "shift_or": _shift_or}


def steps(texts: DataFrame, patterns: DataFrame, algorithm: str) -> DataFrame:
    """text_id, pattern, step_number, step_type, the columns of the algorithm's shape, explanation: a row a step, each step of each pair.

    The naive search numbers its steps from 1 and has one type of them, null; the others number from 0.
    """
    schema = f"text_id {texts.schema['text_id'].dataType.simpleString()}, pattern string, step_number int, step_type string, {SHAPES[algorithm]}, explanation string"
    kind, first = to_arrow_schema(StructType.fromDDL(schema)), int(algorithm == "naive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = enumerate(STEPPERS[algorithm](t, p), first)
                while block := list(islice(own, STEP_ROWS)):
                    yield pa.RecordBatch.from_pylist([{"text_id": text_id, "pattern": p, "step_number": n, "step_type": type_, "explanation": said, **fields} for n, (type_, said, fields) in block], kind)

    return trace.pairs(texts, patterns).select("text_id", "pattern", "text").mapInArrow(run, schema)


def counted(text: str, pattern: str, most: int = 1) -> dict[str, dict[str, int]]:
    """Numbers of steps by algorithm and type, without making them and without the cells of distance tables."""
    n, m, places = len(text), len(pattern), len(text) - len(pattern) + 1
    known = next((k for k in range(m) if pattern[: k + 1] not in text), m)
    lengths, dist = approx.start_distances(text, pattern, most)
    starts = min(n, places + most)
    near = (dist[:, :starts] <= most) & (np.arange(starts) + lengths[:, None] <= n)
    # The empty table is shown unless a shorter substring of the first start matches.
    shown = not near[lengths < min(m + most, n), 0].any()
    out = {
        "naive": {"search": places},
        "kmp": {"preprocessing": 1, "search": n},
        "boyer_moore": {"preprocessing": 1, "search": len(trace.visited(trace.shifts(text, pattern)[1]))},
        "suffix_tree": {"preprocessing": min(n, SHOWN_SUFFIXES) + (n > SHOWN_SUFFIXES), "search": min(known + 1, m), "result": int(known == m)},
        "rabin_karp": {"preprocessing": 1, "search": places},
        "levenshtein": {"preprocessing": int(shown), "match_found": int(near.any(axis=0).sum())},
        "shift_or": {"preprocessing": 1, "initialization": 1, "bit_operation": n},
    }
    return {name: {k: v for k, v in own.items() if v} for name, own in out.items()}


def step_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(algorithm, text_id, pattern, step_type, steps) of all algorithms, as ``counted``; type 'search' where an algorithm names none."""
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_id, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [{"algorithm": name, "text_id": text_id, "pattern": p, "step_type": k, "steps": v} for name, own in counted(t, p).items() for k, v in own.items()]
            yield pa.RecordBatch.from_pylist(rows, out)

    schema = f"algorithm string, text_id {kind}, pattern string, step_type string, steps long"
    out = to_arrow_schema(StructType.fromDDL(schema))
    return trace.pairs(texts, patterns).select("text_id", "pattern", "text").mapInArrow(run, schema)


def all_steps(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(algorithm, text_id, pattern, step_number, step_type, explanation) of all algorithms."""
    out = None
    for name in STEPPERS:
        own = steps(texts, patterns, name).select(F.lit(name).alias("algorithm"), "text_id", "pattern", "step_number", "step_type", "explanation")
        out = own if out is None else out.union(own)
    return out
