"""Fill-in-the-middle: texts cut at two of their units and put together again with marks.

A unit is a run of letters A-Z, a-z or any other single code point. The matcher is lazy: a first pass
over the matches only counts them, a second advances a fresh iterator to the lesser rank and then to the
greater one, where the prefix and the middle end. No list of units exists at any time, so beside the text
a task holds one match, however long the text is.

Ranks and forms come from the sha256 of a seed and the row's id: they depend on nothing else, so reruns
and copies of a table agree.

Defined results: a null text is empty; an empty text, and one that contains a mark, stays as it is (form
``plain``); a null id counts as an id without digits; repeated rows give equal results; the result has
only the columns named here, so further columns of the input, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Of 100 texts so many change their form, and of 100 of those so many put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Code points of the texts that a task returns at once (one text may have more).
BATCH = 1 << 22


def count_units(text: str) -> int:
    """Number of units: every match is made and dropped, the last one's rank is kept."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def unit_ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Places where the first ``low`` and the first ``high`` units end, by one pass of a lazy iterator."""
    units, ends, seen = UNIT.finditer(text), [], 0
    at = 0
    for rank in (low, high):
        if rank > seen:
            at = next(islice(units, rank - seen - 1, None)).end()
            seen = rank
        ends.append(at)
    return ends[0], ends[1]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transformed(doc_id: int | None, text: str, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= CHANGED:
        return n, "plain", None, None, text
    a, b = unit_ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; no shuffle."""
    source = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held, start = batch.column("id"), [], 0, 0
            for i in range(batch.num_rows):
                body = batch.column("text")[i].as_py() or ""
                rows.append(transformed(ids[i].as_py(), body, seed))
                held += len(body)
                if held >= BATCH or i == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), *columns], names=names)
                    rows, held, start = [], 0, i + 1

    return source.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The exact text behind an output: no changed text contains a mark, so each mark stands once."""
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    inner = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    one, rest = F.split_part(inner, second, F.lit(1)), F.split_part(inner, second, F.lit(2))
    two, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    before, after = F.when(first == PREFIX, one).otherwise(two), F.when(first == PREFIX, two).otherwise(one)
    return F.when(form == "plain", output).otherwise(F.concat(before, middle, after))
