"""Source divergences against plain Python over dense count tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import divergence

SCHEMA = "lang string, source string, text string, n long, term string"


def brute(rows, least, top):
    groups, held, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c, *_ in rows):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang, source))
        held[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, d in held[lang].items() if d >= least), key=str.encode)
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in own.items()}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def corpus():
    random.seed(9)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Über", "日本", "é", " ", "🙂", "Z", "z"]
    rows = [(None, None, None), ("en", "a", ""), ("en", "dry", "123 _ 456"), ("de", "only", "wort Wort"), ("", "", "blank names")]
    for i in range(300):
        source = random.choice(["a", "a", "a", "b", "c", None, "ü", "z"])
        rows.append((random.choice(["en", "fr"]), source, " ".join(random.choices(vocabulary, k=random.randint(0, 30)))))
    rows += [("en", "hot", "common word pair\tcommon")] * 40 + [("fr", "one", "x" * 50000 + " y" * 5000)] * 3
    return [(*r, 1, "clash") for r in rows]


@pytest.mark.parametrize("bounds", [(400_000, 100_000), (5, 0)])
@pytest.mark.parametrize("least", [1, 10])
def test_audit_equals_brute_force(spark, monkeypatch, bounds, least):
    monkeypatch.setattr(divergence, "HELD", bounds[0])
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", bounds[1])
    rows = corpus()
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, top=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least, 4)


def test_terms_with_equal_vectors_are_ranked_apart(spark):
    rows = [("en", s, " ".join(f"t{chr(97 + i)}" for i in range(20)), 1, "") for s in "ab"] + [("en", "b", "other words", 1, "")]
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), least=1, top=10).filter("part = 'term' and source = 'a'").orderBy("rank")
    assert [r["item"] for r in found.collect()] == [f"t{chr(97 + i)}" for i in range(10)]


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
