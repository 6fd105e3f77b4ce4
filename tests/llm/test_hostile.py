"""Every corpus operator and stage on very long, null, empty and repeated texts, repeated and null ids, ties, clashing columns, empty tables and files split anew."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from test_corpus import links_of, removed
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe_codec, fingerprints, hmm_lm, license_scan, ngram_join, packing, quality_rules, suffix_dedup, token_records, url_filters
from gridloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, source string, row long, row__ long, key string, h long, bucket int, spans string, n_chars long"


def hostile():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    long = " ".join(f"w{r.randrange(40)}" if i % 3 else word() for i in range(15_000)) + "\nmit license\n" + "x" * 5000
    once = prose(60)
    texts = [None, "", " \n\t ", "#", long, once, once, once, prose(25), "MIT license " * 30, "!!! " * 40, "\n".join(["same line here"] * 12)]
    rows = [(None if i % 4 == 3 else i, t) for i, t in enumerate(texts)] + [(5, once), (5, once), (7, "other text " + once), (None, None), (8, long + " end")]
    return [(k, t, "s", 1, 2, "k", 3, 4, "sp", None if t is None else len(t)) for k, t in rows]


@pytest.fixture(scope="module")
def rows():
    return hostile()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hostile") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def key(k):
    return -(2**63) if k is None else k


def test_license_scan_of_hostile_rows(docs, rows):
    got = license_scan.license_scan(docs).collect()
    assert sorted(key(x.doc_id) for x in got) == sorted(key(r[0]) for r in rows)
    assert collections.Counter(x.n_base for x in got)[30] == 1 and sum(x.n_base for x in got) == 32
    assert all(x.n_words == 0 for x in got if x.n_base == 0 and x.labels == "" and x.score == 0 and x.n_words < 1)


def test_quality_rules_of_hostile_rows(docs, rows):
    got = quality_rules.quality_rules(docs, quality_rules.LineField()).collect()
    want = sorted((key(k), *quality_rules.measures((t or "").encode(), quality_rules.LineField())) for k, t, *_ in rows)
    assert sorted((key(x[0]), *x[1:]) for x in got) == want
    kept = quality_rules.keep_good(docs, quality_rules.LineField())
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_ngram_join_of_hostile_rows(docs, rows):
    got = ngram_join.ngram_join(docs).collect()
    assert sorted(key(x.doc_id) for x in got) == sorted(key(r[0]) for r in rows)
    links = links_of({i: t or "" for i, (_, t, *_) in enumerate(rows)})
    assert sorted((key(x.doc_id), x.n_links) for x in got) == sorted((key(rows[i][0]), n) for i, n in links.items())
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.row__ for r in kept.collect()} == {2}
    assert kept.count() == len({(key(x.class_id), x.n_links > 0, None if x.n_links else key(x.doc_id)) for x in got if x.n_links}) + sum(x.n_links == 0 for x in got)


def test_fingerprints_of_hostile_rows(docs, rows):
    got = fingerprints.fingerprint_edits(docs, repeats=True).collect()
    assert sorted((key(x.doc_id), x.n_chars) for x in got) == sorted((key(k), len(t or "")) for k, t, *_ in rows)
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)


def test_token_records_of_hostile_rows(docs, rows):
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = token_records.token_records(docs, tokenizer("byte_bpe_50k.json"), file_bytes=3000, part_bytes=1000).collect()
    want = [(key(k), len(ids := [*t.encode(x or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, x, *_ in rows]
    assert sorted((key(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == sorted(want)
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    assert [key(x.doc_id) for x in sorted(got, key=lambda x: x.start)] == sorted(w[0] for w in want)
    assert len({x.file for x in got}) > 2


def test_token_records_of_one_id(spark, tmp_path):
    """A thousand rows without an id go to several tasks and files."""
    spark.createDataFrame([(None, f"text number {i} of many") for i in range(1000)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = token_records.token_records(spark.read.parquet(f"{tmp_path}/d"), tokenizer("byte_bpe_50k.json"), file_bytes=4000).collect()
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    assert len(got) == 1000 and len({x.file.split("-")[0] for x in got}) > 1


def test_url_filters_of_hostile_rows(spark):
    urls = [(1, "http://example.org/es/x"), (1, "http://example.org/es/x"), (None, None), (None, ""), (2, "http://a.com/" + "y" * 100_000), (3, "http://a.com/fr/" + "z" * 100_000)]
    pages = spark.createDataFrame([(k, u, "h", "p", 5) for k, u in urls], "page_id long, url string, host string, path string, row int")
    got = url_filters.url_filters(pages).collect()
    assert sorted((key(x.page_id), x.rule or "", len(x.path)) for x in got) == sorted([(1, "example.org/es/", 5), (1, "example.org/es/", 5), (key(None), "", 0), (key(None), "", 0), (2, "", 100_001), (3, "com/fr/", 100_004)])


def test_bpe_round_trip_of_hostile_rows(docs, rows):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((key(k), len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    for average in (32, 512):
        got = bpe_codec.bpe_round_trip(docs, tokenizer("word_bpe_49k.json"), average).collect()
        assert sorted((key(x[0]), *x[1:]) for x in got) == sorted(want)


def test_suffix_dedup_of_hostile_rows(docs, rows):
    # Of rows of one doc_id none removes another's bytes: they are measured against those of smaller ids only.
    mine, seen = [], {}
    for k, t, *_ in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen.get(b[i : i + 50], key(k)) < key(k):
                mask[i : i + 50] = b"\1" * 50
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], key(k))
        mine.append((key(k), len(b), sum(mask), sum(1 for i in range(len(mask)) if mask[i] and not (i and mask[i - 1])), hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted((key(x[0]), *x[1:]) for x in got) == sorted(mine)
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(hashlib.sha256(x.text.encode()).hexdigest() for x in left.collect()) == sorted(w[-1] for w in mine) and {x.row__ for x in left.collect()} == {2}
    assert all(x.n_chars == len(x.text) for x in left.collect())


def test_packing_of_hostile_rows(docs, rows):
    got = packing.packing(docs, buckets=4, budget=300).collect()
    assert sorted((key(x.doc_id), x.n_tokens) for x in got) == sorted((key(k), len((t or "").split()) + 1) for k, t, *_ in rows)
    assert max(collections.Counter((x.bucket, x.batch, x.slot) for x in got).values()) == 1


def test_hmm_scores_of_hostile_rows(docs, rows):
    got = hmm_lm.hmm_scores(docs, common=30, symbols=10, states=2, rounds=2).collect()
    assert sorted((key(x.doc_id), x.n_tokens) for x in got) == sorted((key(k), len((t or "").split()) + 1) for k, t, *_ in rows)
    assert all(np.isfinite(x.score) and x.score < 0 for x in got)


def test_pipeline_of_hostile_rows(spark, docs, rows, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs
    held = [(key(r[0]), r[1]) for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert table.columns == docs.columns
        if name == "quality_rules":
            held = [(k, t) for k, t in held if quality_rules.measures((t or "").encode(), quality_rules.LineField())[-1]]
        elif name == "ngram_join":
            first = {}
            for k, t in sorted(held, key=lambda x: (x[0], x[1])):
                first.setdefault(" ".join(t.lower().split()), (k, t))
            sets = {k: {tuple(k.split()[i : i + 5]) for i in range(len(k.split()) - 4)} for k in first}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            held = [v for a, v in first.items() if not any(near(a, b) and first[b] < v for b in first if b != a)]
        elif name == "suffix_dedup":
            sha = {k: v[3] for k, v in removed(dict(held)).items()}
            assert {key(x.doc_id): hashlib.sha256(x.text.encode()).hexdigest() for x in table.collect()} == sha
            held = [(key(x.doc_id), x.text) for x in table.collect()]
        if name != "packing":
            assert sorted((key(x.doc_id), x.text) for x in table.collect()) == sorted(held)
        else:
            assert sorted((key(x.doc_id), x.n_tokens) for x in table.collect()) == sorted((k, len(t.split()) + 1) for k, t in held)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("module,run", [(ngram_join, lambda d: ngram_join.ngram_join(d)), (ngram_join, lambda d: ngram_join.keep_one(d)), (suffix_dedup, lambda d: suffix_dedup.suffix_dedup(d)), (fingerprints, lambda d: fingerprints.fingerprint_edits(d))], ids=["ngram_join", "keep_one", "suffix_dedup", "fingerprints"])
def test_files_split_anew_between_jobs(spark, tmp_path, monkeypatch, module, run):
    """A lost executor changes how files are split; the rows stay the same."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, r.choice(base) if r.random() < 0.5 else r.choice(base) + " " + word()) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/d")
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    spark.conf.set(names[0], "12")
    try:
        want = sorted(map(tuple, run(spark.read.parquet(f"{tmp_path}/d")).collect()), key=str)
        real = module.written

        def written(df, tag):
            out = real(df, tag)
            spark.conf.set(names[0], "2")
            spark.conf.set(names[1], "0")
            return out

        monkeypatch.setattr(module, "written", written)
        spark.conf.set(names[0], "12")
        assert sorted(map(tuple, run(spark.read.parquet(f"{tmp_path}/d")).collect()), key=str) == want
    finally:
        for n in names:
            spark.conf.unset(n)
