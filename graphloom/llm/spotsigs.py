"""SpotSigs document fingerprints.

A spot signature is an anchor, one of the most common words of a language, with the chain of the next
``CHAIN`` content words after it (words that are not common). A text's fingerprint is the set of its
signatures, each as a 32-bit print, so it follows the running prose and passes over the menus, numbers
and markup between it. The start of a text counts as an anchor. Where anchors are missing, every content
word starts a chain: all of them in a text without anchors (lists, names, other languages), and in other
texts those more than ``GAP`` content words behind the last anchor, so no text is known by its start
alone, and an edit changes only the signatures around it. A text whose words are all common has a single
signature of all its words.

Likeness is the Jaccard similarity of two sets, given up early where their sizes alone, or what is
left to compare, keep it under a floor. For joins, sets are partitioned by their length (see
``classes``), so that only sets of comparable length meet.

Defined results: null and empty texts have the empty fingerprint, like each other 1 and all others 0;
texts whose words are all common have one signature; ties of ids follow the texts' hashes; repeated
rows are neighbours of each other; of one document the next is itself; an empty table gives no rows;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import components

#: Common words of four languages that serve as anchors.
ANCHORS = frozenset(
    "the of and to in is that it was for on are with as at be this from or an have by not you he which but "
    "de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los y del se las por con no una su para es al lo como más o pero sus le ha me si sin sobre este".split()
)
WORDS = re.compile(r"[^\W_]+")
#: Content words in a chain.
CHAIN = 2
#: Content words behind an anchor that are passed over; those beyond start chains of their own.
GAP = 4
#: Sampled ids for each boundary between slices.
SAMPLE = 64


def signatures(text: str) -> set[int]:
    """Prints of the text's spot signatures."""
    words = WORDS.findall(text.lower())
    content = [w for w in words if w not in ANCHORS]
    if not content:
        return {xxhash.xxh32_intdigest(" ".join(words))} if words else set()
    spots = set()
    pairs = [f"{a} {b}" for a, b in zip(content, [*content[1:], ""], strict=True)]
    spots.add(" " + pairs[0])
    at, n = 0, len(pairs)
    passed = 0 if len(content) < len(words) else GAP  # content words since the last anchor
    for w in words:
        if w in ANCHORS:
            if at < n:
                spots.add(w + " " + pairs[at])
            passed = 0
        else:
            if passed >= GAP:
                spots.add(" " + pairs[at])
            passed += 1
            at += 1
    digest = xxhash.xxh32_intdigest
    return {digest(s) for s in spots}


def likeness(a: set[int], b: set[int], floor: float = 0.0) -> float:
    """Jaccard similarity; 0 as soon as it cannot reach ``floor``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 1.0
    if len(a) < floor * len(b):
        return 0.0
    if floor:
        misses, most = 0, len(a) - floor / (1 + floor) * (len(a) + len(b))
        for spot in a:
            misses += spot not in b
            if misses > most + 1e-9:
                return 0.0
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def written(spots: set[int]) -> str:
    """The fingerprint as text: eight hexadecimal digits a signature, ascending."""
    return np.sort(np.fromiter(spots, np.uint32, len(spots))).byteswap().tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as many characters of the next document's start."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slices: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots).

    Documents are dealt by ranges of the id and sorted, each slice with a copy of the first document
    of the next one, so a single sweep sees every document beside its successor.
    """
    spark = docs.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    ids = source.select("doc_id").distinct()
    sample = sorted(r["doc_id"] for r in ids.dropna().orderBy(F.xxhash64("doc_id")).limit(SAMPLE * slices).collect())
    cuts = sorted({sample[i * len(sample) // slices] for i in range(1, slices)}) if sample else []
    kind = source.schema["doc_id"].dataType
    at = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(at)  # nulls sort first
    firsts = ids.groupBy(at.alias("slice")).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("slice").collect()
    if not firsts:
        firsts = [{"slice": 0, "first": None, "null": True}]
    before = {r["slice"]: firsts[i - 1]["slice"] for i, r in enumerate(firsts)}
    heads = F.create_map(*[x for r in firsts for x in (F.lit(r["slice"]), F.lit(None if r["null"] else r["first"]).cast(kind))])
    back = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    head = F.col("doc_id").eqNullSafe(F.element_at(heads, F.col("slice")))
    dealt = source.withColumn("slice", at)
    own = F.struct(F.col("slice").alias("slice"), F.lit(0).alias("copy"))
    places = F.when(head, F.array(own, F.struct(F.element_at(back, F.col("slice")).alias("slice"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = dealt.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.*")
    lined = dealt.repartition("slice").sortWithinPartitions("slice", "copy", "doc_id", F.xxhash64("text"))
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long"
    return lined.mapInArrow(_sweep, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each own row of a slice beside the row after it; copies only serve as successors."""
    held: tuple | None = None  # slice, id, text, signatures of the own row that waits for its successor
    for batch in batches:
        ids, rows = [], []
        marks = zip(batch.column("slice").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").to_pylist(), strict=True)
        for i, (part, copy, text) in enumerate(marks):
            text = text or ""
            spots: set[int] | None = None
            if held is not None and held[0] == part:
                spots = signatures(text)
                rows.append(_row(held, text, spots))
                ids.append(held[1])
                held = None
            if not copy:
                held = (part, batch.column("doc_id").slice(i, 1), text, signatures(text) if spots is None else spots)
        if rows:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=NAMES)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"]


def _row(held: tuple, after: str, next_spots: set[int]) -> tuple:
    _, _, text, spots = held
    changed = edited(text, after)
    other = signatures(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), written(spots), written(other), likeness(spots, other), likeness(spots, next_spots), len(spots)


def spot_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted signature sets as 64-bit prints spread over the whole range, for ``ngram_join``."""
    out = []
    for text in texts:
        prints = np.sort(np.fromiter(own := signatures(text.decode()), np.uint64, len(own)))
        out.append(prints << np.uint64(32))
    return out


def classes(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component): near-duplicate classes at a signature likeness of ``percent`` or more.

    Exact: sets are partitioned by length into classes that a partner at this likeness can be in.
    """
    return components(docs, spot_sets, percent, doc_id, text)
