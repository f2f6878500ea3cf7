"""Secret scans: fixed patterns and a randomness test battery, in built-in functions only.

Patterns: splitting a text at a pattern gives the gaps, extracting it gives the matches, and running
sums of both lengths give code-point positions. Running sums and extrema of an array of n are made by
doubling steps, so a text of n runs costs n log n. Battery: every run of 16 or more letters, digits and
``+/_=-`` gets the encoding its symbols infer (see ``ENCODINGS``), and three p-values
under uniformly random symbols: a chi-squared test of the alphabet, the runs test about the
alphabet's middle, and lag-one serial correlation; three times the least of them, at most 1, is its
p-value. Over all texts, per encoding and length class, the Benjamini-Hochberg procedure at level
``level`` decides which runs are too regular to be random, so at most that share of truly random
strings is dismissed at every length. Runs that stay, hold at least ``bits`` bits and overlap no
pattern's span are reported as ``random``. Evidence for an encoding is a digit beside letters, or an
upper-case letter behind a lower-case one. Runs of one case without digits, capitalised words, and
numbers with a digit outside 2-7 have none and infer no encoding. Digits beside
letters of one case are read without the signs between them (as in a UUID); other runs keep their signs.
Runs of digits and letters of both cases without any sign are read as base 62, with strata of their own.

The procedure works on counts of p-values in bins of a twentieth of a decade, taken at their upper
ends: a few thousand counts at most, whatever the input.

Defined results: null and empty texts have no spans; repeated rows are reported alike and each counts
in the procedure; an empty table gives no rows; other columns are carried along, except that a column
named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, and the group and size of it that a match needs.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))
KINDS = ("assign", "access", "hex", "random")
RUN = "[A-Za-z0-9+/_=-]{16,}"
#: Alphabets in the order of their values.
HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Encodings a run can infer: each has an alphabet, and strata of its own in the procedure.
ENCODINGS = {"hex": HEX, "base32": BASE32, "base32_lower": BASE32.lower(), "base36": BASE36.upper(), "base36_lower": BASE36, "base52": BASE64[:52], "base62": BASE64[:62], "base64": BASE64, "base64_letters": BASE64}
#: Coefficients of a published approximation of the normal tail (error under 1e-7).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
BIN = 20
SPAN = "array<struct<start:int,end:int,text:string,own:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``step`` over an array: a step of width 1, 2, 4, ... combines all neighbours."""

    def widened(acc: Column, width: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= width, step(F.get(acc, i - width), x)).otherwise(x))

    def run(own: Column) -> Column:
        widths = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda w: w < F.size(own))
        return F.aggregate(widths, own, widened)

    return _let(values, lambda own: F.when(F.size(own) > 1, run(own)).otherwise(own))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, text, own): code-point spans, the match, and the length of its group."""

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = scan(F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit)), lambda x, y: x + y)
        own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        each = F.arrays_zip(ends.alias("end"), hits.alias("hit"), own.alias("own"))
        return F.transform(each, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("text"), F.length(x["own"]).alias("own")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.from_json(F.lit("[]"), SPAN))


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end) of the fixed patterns, in order."""

    def of(rank: int, pattern: str, group: int, least: int) -> Column:
        long = F.filter(_matches(text, pattern, group), lambda m: m["own"] >= least)
        return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(rank, *rule[1:]) for rank, rule in enumerate(BASE)]))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, reversed(TAIL), F.lit(0.0))
    p = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def tested(text: Column) -> Column:
    """Array of (start, end, encoding, class, bin, bits) of the runs that infer an encoding.

    Each step's fields are worked out once for each run, in time linear in its length.
    """

    def measure(m: Column) -> Column:
        bare = F.rtrim(m["text"], F.lit("="))
        flat = F.translate(bare, "-_=+/", "")
        lower, upper, digit = (bare.rlike(p) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        single = digit & (lower != upper)
        encoding = (
            F.when(single & flat.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when((single & upper & flat.rlike("^[A-Z2-7]+$")) | bare.rlike("^[2-7]+$"), "base32").when(single & flat.rlike("^[a-z2-7]+$"), "base32_lower")
            .when(single & upper, "base36").when(single, "base36_lower").when(digit & lower & upper, F.when(bare == flat, "base62").otherwise("base64"))
            .when(bare.rlike("[a-z].*[A-Z]"), F.when(bare == flat, "base52").otherwise("base64_letters"))
        )
        straight = F.when(encoding == "hex", F.lower(flat)).when(single, flat).otherwise(F.translate(bare, "-_=", "+/"))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), encoding.alias("encoding"), straight.alias("run"))

    def spelled(x: Column) -> Column:
        alphabet = F.element_at(F.create_map(*[F.lit(v) for pair in ENCODINGS.items() for v in pair]), x["encoding"])
        values = F.transform(F.split(x["run"], ""), lambda c: F.instr(alphabet, c) - 1)
        counts = F.transform(F.split(alphabet, ""), lambda c: F.length(x["run"]) - F.length(F.replace(x["run"], c, F.lit(""))))
        return F.struct(*[x[f].alias(f) for f in ("start", "end", "encoding")], F.length(alphabet).alias("k"), F.filter(values, lambda v: v >= 0).alias("v"), counts.alias("counts"))

    def summed(x: Column) -> Column:
        v, half = x["v"], x["k"] / 2
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
        pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v) - 1).alias("b"))
        return F.struct(
            *[x[f].alias(f) for f in ("start", "end", "encoding", "k")],
            F.size(v).cast("double").alias("n"),
            total(F.transform(x["counts"], lambda c: (c * c).cast("double"))).alias("squares"),
            total(v).alias("s1"), total(F.transform(v, lambda y: (y * y).cast("double"))).alias("s2"),
            total(F.transform(pairs, lambda p: (p["a"] * p["b"]).cast("double"))).alias("products"),
            (F.element_at(v, 1) + F.element_at(v, -1)).cast("double").alias("ends"),
            F.size(F.filter(v, lambda y: y >= half)).cast("double").alias("high"),
            F.size(F.filter(pairs, lambda p: (p["a"] >= half) != (p["b"] >= half))).alias("flips"),
        )

    def judge(x: Column) -> Column:
        k, n, high = x["k"].cast("double"), x["n"], x["high"]
        chi, free = k / n * x["squares"] - n, k - 1
        p_chi = _tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        mean = 2 * high * (n - high) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * _tail(F.abs(x["flips"] + 1 - mean) / F.sqrt(spread))).otherwise(0.0)
        centre = x["s1"] / n
        power = x["s2"] - n * centre * centre
        lag = x["products"] - centre * (2 * x["s1"] - x["ends"]) + (n - 1) * centre * centre
        p_serial = F.when(power > 0, 2 * _tail(F.abs(lag / power + 1 / n) * F.sqrt(n))).otherwise(0.0)
        p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
        band = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-20))) * BIN), F.lit(20 * BIN)).cast("int")
        return F.struct(*[x[f].alias(f) for f in ("start", "end", "encoding")], F.floor(F.log2(n) * 2).cast("int").alias("class"), band.alias("bin"), (n * F.log2(k)).alias("bits"))

    runs = F.filter(F.transform(_matches(text, RUN), measure), lambda x: x["encoding"].isNotNull() & (F.length(x["run"]) > 3))
    return F.transform(F.transform(F.transform(runs, spelled), summed), judge)


def limits(docs: DataFrame, text: str = "text", level: float = 0.05) -> dict[str, int]:
    """Per encoding and length class, the p-value bin from which on runs are too regular."""
    runs = docs.select(F.explode(tested(docs[text].cast("string"))).alias("r")).select("r.*")
    bins = runs.groupBy("encoding", "class", "bin").count()
    stratum = Window.partitionBy("encoding", "class")
    upto = stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("below", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(stratum))
    passing = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BIN) <= level * F.col("below") / F.col("all"))
    return {f"{r['encoding']}:{r['class']}": r["bin"] for r in passing.groupBy("encoding", "class").agg(F.min("bin").alias("bin")).collect()}


def find(docs: DataFrame, text: str = "text", level: float = 0.05, bits: float = 64, into: str = "spans") -> DataFrame:
    """Add ``into``: array of struct(start, rank, end), ``rank`` counting in ``KINDS``, in order."""
    bounds = limits(docs, text, level)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]) if bounds else None

    def irregular(x: Column) -> Column:
        regular = F.lit(False) if table is None else x["bin"] >= F.coalesce(F.try_element_at(table, F.concat_ws(":", x["encoding"], x["class"])), F.lit(1 << 30))
        return ~regular & (x["bits"] >= bits)

    runs = F.transform(F.filter(tested(body), irregular), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end")))
    found = _let(base_spans(body), lambda base: _let(runs, lambda own: F.when((F.size(base) > 0) & (F.size(own) > 0), _merged(base, own)).otherwise(F.concat(base, own))))
    return docs.withColumn(into, found)


def _merged(base: Column, runs: Column) -> Column:
    """Base spans and the runs that overlap none of them, in order.

    In the order of starts, a run overlaps a base span before it if the greatest end so far is beyond
    its start, and one behind it if the least start from there on is before its end.
    """
    far = F.lit((1 << 31) - 1)
    is_base = lambda s: s["rank"] < 3

    def sifted(spans: Column) -> Column:
        reach = scan(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest)
        behind = F.reverse(scan(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), F.least))
        each = F.arrays_zip(spans.alias("span"), reach.alias("reach"), behind.alias("behind"))
        free = F.filter(each, lambda x: is_base(x["span"]) | ((x["reach"] <= x["span"]["start"]) & (x["behind"] >= x["span"]["end"])))
        return F.transform(free, lambda x: x["span"])

    return _let(F.array_sort(F.concat(base, runs)), sifted)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans (in order of starts) cover replaced by ``mark``; spans that touch get a mark each."""

    def pieces(spans: Column, characters: Column, before: Column) -> Column:
        cut = lambda low, n: F.array_join(F.slice(characters, low + 1, n), "")

        def piece(s: Column, i: Column) -> Column:
            at = F.get(before, i)
            return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(cut(at, s["start"] - at), F.lit(mark)))

        tail = F.element_at(before, -1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(tail, F.size(characters) - tail))

    def reach(own: Column) -> Column:  # the greatest end before each span and before the tail
        return F.concat(F.array(F.lit(0)), scan(F.transform(own, lambda s: s["end"]), F.greatest))

    characters = F.split(text, "")
    return F.when(F.size(spans) > 0, _let(spans, lambda own: _let(characters, lambda c: _let(reach(own), lambda r: pieces(own, c, r))))).otherwise(text)
