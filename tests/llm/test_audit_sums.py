"""Sums of sparse vectors in Arrow batches."""

import numpy as np
import pyarrow as pa
import pytest
from test_round3 import audited

from gridloom.llm import source_audit as A


def test_terms_reach_the_model_once_for_each_document(spark):
    """A term that a document has several times is in one row, with its times (before: as often as it occurs)."""
    docs = spark.createDataFrame([(1, "en", "b a b, c B a"), (2, "de", None), (1, "en", "a"), (3, "", "x")], "g long, lang string, text string")
    got = sorted((r.g, r.times, sorted(r.terms.split(" "))) for r in A.term_texts(docs).collect())
    assert got == [(1, 1, ["en\0a"]), (1, 1, ["en\0c"]), (1, 2, ["en\0a"]), (1, 3, ["en\0b"]), (3, 1, ["\0x"])]


def test_sums_in_batches_are_those_by_entry(monkeypatch):
    """Groups of any number (negative ones too), several models, rows without entries, and more entries than are summed at once."""
    monkeypatch.setattr(A, "ENTRIES", 40)
    r = np.random.default_rng(4)
    rows, want = [], {}
    for _ in range(300):
        g, times, model, k = int(r.choice([-(2**63), -5, 0, 2**62])), int(r.integers(1, 2**33)), int(r.integers(0, 2)), int(r.integers(0, 6))
        i, v = sorted(r.choice([0, 1, 2, 7, 2**31 - 1], min(k, 5), replace=False).tolist()), r.integers(1, 4, min(k, 5)).astype(float).tolist()
        rows.append((g, times, model, i, v))
        for j, x in zip(i, v):
            want[g, model, j] = want.get((g, model, j), 0) + times * int(x)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
    t = pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types)], names=["g", "times", "model", "indices", "values"])
    got: dict = {}
    for b in A.summed_entries(iter(t.to_batches(max_chunksize=10))):
        for x in b.to_pylist():
            got[x["g"], x["model"], x["i"]] = got.get((x["g"], x["model"], x["i"]), 0) + x["n"]
    assert got == want and list(A.summed_entries(iter(t.slice(0, 0).to_batches()))) == []


def flat(texts):
    """(g, times, term) and (docs, term) of term_texts, sorted."""
    rows = texts.collect()
    terms = sorted((r.g, r.times, t) for r in rows if r.terms is not None for t in r.terms.split(" "))
    return terms, sorted((r.docs, t) for r in rows if r.found is not None for t in r.found.split(" "))


def test_documents_of_a_task_are_counted_together(spark):
    """A term has one row for the documents of a group that a task holds, and the model meets it at most min_docs times (before: once for each document)."""
    docs = spark.createDataFrame([(1, "en", "a b a")] * 30 + [(2, "en", "b c")] * 2 + [(3, "de", "a"), (1, "en", None)], "g long, lang string, text string").coalesce(1)
    terms, found = flat(A.term_texts(docs, 10, 1000))
    assert terms == [(1, 30, "en\0b"), (1, 60, "en\0a"), (2, 2, "en\0b"), (2, 2, "en\0c"), (3, 1, "de\0a")]
    assert found == [(1, "de\0a"), (2, "en\0c"), (10, "en\0a"), (10, "en\0b")]


def test_more_rows_for_found_than_for_terms_and_long_rows(spark, monkeypatch):
    """Rows are cut at ROW_TERMS; where one kind has fewer rows its columns are null."""
    monkeypatch.setattr(A, "ROW_TERMS", 2)
    docs = spark.createDataFrame([(1, "en", "a b"), (1, "en", "a c d e"), (1, "en", "a")], "g long, lang string, text string").coalesce(1)
    terms, found = flat(A.term_texts(docs, 10, 1000))
    assert terms == [(1, 1, f"en\0{w}") for w in "bcde"] + [(1, 3, "en\0a")] and found == [(1, f"en\0{w}") for w in "bcde"] + [(3, "en\0a")]
    docs = spark.createDataFrame([(1, "en", "a b b"), (1, "en", "a")], "g long, lang string, text string").coalesce(1)
    rows = A.term_texts(docs, 10, 1000).collect()
    assert len(rows) == 2 and sum(r.terms is None for r in rows) == 1 and flat(A.term_texts(docs, 10, 1000)) == ([(1, 2, "en\0a"), (1, 2, "en\0b")], [(1, "en\0b"), (2, "en\0a")])


@pytest.mark.parametrize("held", [0, 7, 10**6])
def test_audit_is_the_same_however_many_terms_are_held(spark, monkeypatch, held):
    """min_docs is met by documents of many tasks, of one, and of some of each; sources may be as many as documents."""
    monkeypatch.setattr(A, "HELD", held)
    rows = [(f"w{i % 13} w{i % 5} x{i} é w{i % 13}", ("en", None, "a b")[i % 3], f"s{i % (4 if i < 60 else 50)}") for i in range(90)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = sorted(map(tuple, A.source_audit(docs, min_docs=4).collect()))
    assert got == audited([(0, *r) for r in rows], 4)


def test_smallest_hashes_of_a_task_are_one_list():
    """A task gives at most SMALLEST hashes, whatever the number of its rows (before: so many for each row)."""
    lists = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (40, 200))
    t = pa.table({"least": pa.array(lists.tolist(), pa.list_(pa.int64()))})
    got = [h for b in A.smallest_hashes(iter(t.to_batches(max_chunksize=7))) for h in b.column(0).to_pylist()]
    assert got == np.sort(lists.ravel().view(np.uint64))[: A.SMALLEST].view(np.int64).tolist()
    assert sum(b.num_rows for b in A.smallest_hashes(iter([]))) == 0
