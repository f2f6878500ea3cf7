"""Fill-in-the-middle against units taken from a whole list of matches."""

import hashlib
import re

from pyspark.sql import functions as F

from graphloom.llm import fim, queries

SCHEMA = "doc_id long, text string, id string, output string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_transform_equals_brute_force_and_comes_back(spark):
    texts = [None, "", " ", "x", "<P>", "a <S> b", "<M", "<", "<P<S<M", "one two", "日本語 text 🙂🙂", "a\nb\r\nc\x00d", "word" * 30000, "many short words " * 3000]
    rows = [(i, texts[i % len(texts)], "clash", "clash") for i in range(400)] + [(None, "a null id", "x", "y"), (7, "a repeated id", "x", "y"), (7, "a repeated id", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = fim.transform(docs).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted([tuple(r)[:6] for r in found], key=key) == sorted([(i, *brute(i, t)) for i, t, *_ in rows], key=key)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    back = {(r["id"], r["back"]) for r in found}
    assert back == {(i, t or "") for i, t, *_ in rows}


def test_both_ranks_advance_one_iterator():
    text = "ab c, de"
    ends = [0, 2, 3, 4, 5, 6, 8]
    assert fim.count_units(text) == 6 and fim.count_units("") == 0
    assert all(fim.unit_ends(text, a, b) == (ends[a], ends[b]) for b in range(7) for a in range(b + 1))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_fim_ranks(spark, str(tmp_path)).count() == 0
