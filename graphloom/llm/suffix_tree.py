"""Language-model scores from a probabilistic suffix tree over the bytes of words.

A text is the sequence of its lower-cased words, joined by one space, and one end symbol (a line
feed, which no word holds), so each sequence of words has exactly one spelling and the model's
probability of the spelling is that of the word sequence. States are contexts of up to ``depth``
bytes. A context is retained where its next-symbol counts diverge from those of its suffix by a
likelihood-ratio test; each retained state's distribution is smoothed with its longest retained
suffix (Witten and Bell), the empty context with one count for each byte. A symbol is scored in the
state of the longest retained suffix of what precedes it.

Every window of ``depth`` + 1 bytes that occurs in any text gets one row with its training count.
The tree is grown over that table, dealt by the two newest bytes of context, level by level. Scoring
broadcasts the tree's states and the words' prints only where the windows and the words counted stay
under ``broadcast_rows``; otherwise each document's words and windows are joined with their tables.

Defined results: null and empty texts hold only the end symbol; a null id belongs to the training
part (its checksum text is empty); repeated rows are scored alike and each counts in training; an
empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, texts_of, word_prints

END = 10
#: Standard normal quantile of the likelihood-ratio test (one in a thousand).
LEVEL = 3.09
#: Texts that a task spells at once.
CHUNK = 200
#: Windows a task gathers before it sums them up.
GATHER = 1_000_000


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def spelled(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' spellings in one byte array, each after ``depth`` line feeds, and their sizes."""
    pad = b"\n" * depth
    bodies = [b" ".join(w) + b"\n" for w in words]
    return np.frombuffer(b"".join([x for b in bodies for x in (pad, b)]), np.uint8), np.fromiter(map(len, bodies), np.int64, len(bodies))


def windows_of(flat: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Windows of all symbols of the spelled texts, the newest byte lowest."""
    flat = flat.astype(np.uint64)
    keys = flat.copy()
    for k in range(1, depth + 1):
        keys[k:] |= flat[:-k] << np.uint64(8 * k)
    own = np.ones(len(flat), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]).astype(np.int64)
    for k in range(depth):
        own[starts + k] = False
    return keys[own]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count(docs: DataFrame, depth: int) -> DataFrame:
    """(word, gram, trained): every word and every window of the corpus with its training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, others = Counter(), set()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            train = np.asarray(batch.column("train"))
            texts = texts_of(batch.column("text"))
            for i in range(0, len(texts), CHUNK):
                words = [words_of(t) for t in texts[i : i + CHUNK]]
                for w, t in zip(words, train[i : i + CHUNK], strict=True):
                    if t:
                        trained.update(w)
                    else:
                        others.update(w)
                flat, sizes = spelled(words, depth)
                keys = windows_of(flat, sizes, depth)
                use = np.repeat(train[i : i + CHUNK], sizes)
                keys = np.sort((keys << np.uint64(1)) | use.astype(np.uint64))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                n = np.diff(np.append(first, len(keys)))
                parts.append((keys[first] >> np.uint64(1), n * (keys[first] & np.uint64(1)).astype(np.int64)))
                waiting += len(first)
                if waiting > GATHER:
                    parts = [_summed(parts)]
                    waiting = 0
                    if len(parts[0][0]) > GATHER:
                        yield from emit(*parts.pop())
            if len(trained) + len(others) > GATHER:
                yield from emit_words(trained, others)
        if parts:
            yield from emit(*_summed(parts))
        yield from emit_words(trained, others)

    def emit(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 200_000):
            part = pa.array(keys[i : i + 200_000].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), part, pa.array(counts[i : i + 200_000])], names=["word", "gram", "trained"])

    def emit_words(trained: Counter, others: set) -> Iterator[pa.RecordBatch]:
        rows = [(w, n) for w, n in trained.items()] + [(w, 0) for w in others if w not in trained]
        trained.clear()
        others.clear()
        for i in range(0, len(rows), 100_000):
            words, n = zip(*rows[i : i + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.nulls(len(words), pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "trained"])

    return docs.mapInArrow(run, "word string, gram long, trained long").groupBy("word", "gram").agg(F.sum("trained").alias("trained"))


def _smoothed(grams: np.ndarray, c: np.ndarray, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, n, retained) of one level's sorted grams. ``above``: the level above's (p, c, n) for each."""
    p_above, c_above, n_above = above
    state = grams >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
    spread = np.diff(np.append(first, len(grams)))
    n = np.repeat(np.add.reduceat(c, first), spread)
    kinds = np.repeat(np.add.reduceat((c > 0).astype(np.int64), first), spread)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(c > 0, 2 * c * np.log((c / n) / (c_above / n_above)), 0.0)
        ratio = np.repeat(np.add.reduceat(gain, first), spread)
        free = np.maximum(kinds - 1, 1).astype(float)
        retained = (n > 0) & (ratio > free * (1 - 2 / (9 * free) + LEVEL * np.sqrt(2 / (9 * free))) ** 3)
        p = np.where(retained, (c + kinds * p_above) / (n + kinds), p_above)
    return p, n, retained


def _roots(pairs: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """(grams, p, c, n) of the level with one byte of context, from all of its at most 65,536 grams."""
    symbols = (pairs & np.uint64(255)).astype(np.int64)
    single = np.bincount(symbols, c, 256)
    p0 = (single + 1) / (single.sum() + 256)
    p, n, retained = _smoothed(pairs, c, (p0[symbols], single[symbols], np.full(len(pairs), single.sum())))
    return pairs, p, c, n


def grow(grams: DataFrame, depth: int, whole: bool = False) -> DataFrame:
    """(gram, logp) of the tree's states; with ``whole``, of each window itself.

    A state's row has the gram of its context and next byte, with the context's length in the top
    byte; states that are not retained have none. All windows that share their last two context bytes
    are in one task, where the deeper levels are built: a state's grams and their suffixes' are there.
    """
    spark = grams.sparkSession
    top = grams.groupBy(F.col("gram").bitwiseAND(F.lit(65535)).alias("gram")).agg(F.sum("trained").alias("c")).orderBy("gram").toArrow()
    roots = _roots(top["gram"].to_numpy().astype(np.uint64), top["c"].to_numpy()) if top.num_rows else None
    dealt = grams.repartition(F.shiftright("gram", 8).bitwiseAND(F.lit(65535)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("gram").to_numpy().astype(np.uint64), b.column("trained").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        flat, c = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
        above, p, c_above, n_above = roots
        for d in range(2, depth + 1):
            grams, at = np.unique(flat & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            counts = np.bincount(at, c, len(grams))
            suffix = np.searchsorted(above, grams & np.uint64((1 << 8 * d) - 1))
            p, n, retained = _smoothed(grams, counts, (p[suffix], c_above[suffix], n_above[suffix]))
            above, c_above, n_above = grams, counts, n
            if not whole:
                yield from emit(grams[retained] | np.uint64(d << 56), p[retained])
        if whole:
            yield from emit(above, p)

    def emit(keys: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(np.log10(p[i : i + 100_000]))], names=["gram", "logp"])

    deep = dealt.select("gram", "trained").mapInArrow(run, "gram long, logp double")
    if whole or roots is None:
        return deep
    pairs, p, _, _ = roots
    return deep.union(spark.createDataFrame(list(zip((pairs | np.uint64(1 << 56)).view(np.int64).tolist(), np.log10(p).tolist(), strict=True)), "gram long, logp double"))


def looked_up(keys: np.ndarray, logp: np.ndarray, grams: np.ndarray, depth: int) -> np.ndarray:
    """Log probability of each window: that of its longest state in the sorted table."""
    out, left = np.empty(len(grams)), np.arange(len(grams))
    for d in range(depth, 0, -1):
        wanted = (grams[left] & np.uint64((1 << 8 * (d + 1)) - 1)) | np.uint64(d << 56)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        out[left[hit]] = logp[at[hit]]
        left = left[~hit]
    return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 6, folds: int = 7, fold: int = 2, broadcast_rows: int = 16_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    out = held_out(F.col("doc_id"), folds, fold)
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("train", ~out)
    counted = settle(count(source.select("train", "text"), depth))
    seen = source.agg(F.count(F.when(F.col("train"), 1)).alias("ends")).first()["ends"]
    facts = counted.agg(
        F.sum(F.when(F.col("word").isNotNull(), F.col("trained"))).alias("n"), F.count(F.when(F.col("word").isNotNull() & (F.col("trained") > 0), 1)).alias("v"), F.count("word").alias("words"), F.count("gram").alias("grams")
    ).first()
    n, v = (facts["n"] or 0) + seen, facts["v"] + (seen > 0)
    words = counted.filter(F.col("word").isNotNull()).select("word", "trained")
    grams = counted.filter(F.col("gram").isNotNull()).select("gram", "trained")
    if max(facts["grams"], facts["words"]) <= broadcast_rows:
        scored = _broadcast_scores(source, words, grow(grams, depth), depth, seen)
    else:
        scored = _joined_scores(source, words, grow(grams, depth, whole=True), depth, seen)
    base = F.col("gains") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _broadcast_scores(source: DataFrame, words: DataFrame, tree: DataFrame, depth: int, ends: int) -> DataFrame:
    rows = tree.toArrow()
    order = np.argsort(keys := rows["gram"].to_numpy().view(np.uint64))
    keys, logp = keys[order], rows["logp"].to_numpy()[order]
    del rows, order
    names, counts = _printed(words.filter("trained > 0"))
    shared = source.sparkSession.sparkContext.broadcast((keys, logp, names, counts))
    end_gain = float(np.log10(ends + 1))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp, names, counts = shared.value
        for batch in batches:
            texts = texts_of(batch.column("text"))
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for i in range(0, len(texts), CHUNK):
                words = [words_of(t) for t in texts[i : i + CHUNK]]
                flat, sizes = spelled(words, depth)
                n = np.fromiter(map(len, words), np.int64, len(words))
                which = np.repeat(np.arange(len(words)), n)
                prints = word_prints(flat)[1]
                slot = np.minimum(np.searchsorted(names, prints), max(len(names) - 1, 0))
                hit = names[slot] == prints if len(names) else np.zeros(len(prints), bool)
                gain = np.where(hit, np.log10(counts[slot] + 1.0), 0.0) if len(names) else np.zeros(len(prints))
                grams = windows_of(flat, sizes, depth)
                order = np.argsort(grams)
                ordered = grams[order]
                new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
                each = np.empty(len(grams))
                each[order] = np.repeat(looked_up(keys, logp, ordered[new], depth), np.diff(np.append(np.flatnonzero(new), len(ordered))))
                columns[0].append(n + 1)
                columns[1].append(np.bincount(which, hit, len(words)).astype(np.int64) + (ends > 0))
                columns[2].append(np.bincount(which, gain, len(words)) + end_gain)
                columns[3].append(np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(c)) for c in columns)], names=["doc_id", "n_tokens", "n_known", "gains", "score"])

    return source.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, gains double, score double")


def _printed(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit prints of the words and their counts; two words of one print are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                prints = word_prints(np.frombuffer(b"\n".join(texts_of(batch.column("word"))), np.uint8))[1]
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), batch.column("trained")], names=["print", "trained"])

    rows = words.mapInArrow(run, "print long, trained long").toArrow()
    order = np.argsort(prints := rows["print"].to_numpy().view(np.uint64))
    prints = prints[order]
    if (prints[1:] == prints[:-1]).any():
        raise ArithmeticError("two words share a print; lower broadcast_rows so that words are joined")
    return prints, rows["trained"].to_numpy()[order]


def _joined_scores(source: DataFrame, words: DataFrame, tree: DataFrame, depth: int, ends: int) -> DataFrame:
    """The same with the tables too large to broadcast: each document's counts are joined with them."""
    keyed = source.select("doc_id", "text", F.xxhash64("text").alias("print"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [words_of(t) for t in texts_of(batch.column("text"))]
            for i, words in enumerate(every):
                own = Counter(words)
                grams, n = np.unique(windows_of(*spelled([words], depth), depth), return_counts=True)
                size = len(own) + len(grams)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(batch.column("doc_id")[i], size), pa.repeat(batch.column("print")[i], size),
                        pa.concat_arrays([pa.array(list(own), pa.binary()).cast(pa.string()), pa.nulls(len(grams), pa.string())]),
                        pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(grams.astype(np.int64))]),
                        pa.array([*own.values(), *n.tolist()], pa.int64()),
                    ],
                    names=["doc_id", "print", "word", "gram", "times"],
                )

    asked = keyed.mapInArrow(run, f"doc_id {kind}, print long, word string, gram long, times long").dropDuplicates(["doc_id", "print", "word", "gram"])
    by_word = asked.filter("word is not null").join(words, "word").select("doc_id", "print", (F.col("times") * (F.col("trained") > 0).cast("long")).alias("known"), (F.col("times") * F.log10(F.col("trained") + 1)).alias("gain"), F.lit(0.0).alias("lm"))
    by_gram = asked.filter("gram is not null").join(tree, "gram").select("doc_id", "print", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("gain"), (F.col("times") * F.col("logp")).alias("lm"))
    sums = by_word.unionByName(by_gram).groupBy("doc_id", "print").agg(F.sum("known").alias("known"), F.sum("gain").alias("gain"), F.sum("lm").alias("lm"))
    rows = keyed.select("doc_id", "print", (F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long").alias("n_tokens")).alias("d")
    met = rows.join(sums.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.print").eqNullSafe(F.col("s.print")))
    return met.select("d.doc_id", "n_tokens", (F.col("known") + (1 if ends else 0)).alias("n_known"), (F.col("gain") + float(np.log10(ends + 1))).alias("gains"), F.col("lm").alias("score"))
