"""Source audit, SentencePiece codec and collocations against brute force and the library."""

import collections
import hashlib
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import collocations as L
from gridloom.llm import packing
from gridloom.llm import piece_codec as P
from gridloom.llm import source_audit as A
from gridloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, g long, n long, terms string, phrase string, i int"


def hostile():
    """Nulls in every column, empty and long texts, repeated rows and ids, odd languages, ties, clashing columns."""
    r = random.Random(3)
    word = lambda: r.choice(["Alpha", "beta", "gamma", "é", "ÉÀ", "x1y", "ß", "中文", "delta-two", "b"])
    rows = []
    for i in range(120):
        text = " ".join(word() + r.choice(["", "", ",", ".", "\n", "\t!"]) for _ in range(r.randrange(60)))
        rows.append((i, text, r.choice(["en", "fr", None, "", "a b$\\1", "en"]), r.choice(["s1", "s2", "s2", None, ""])))
    rows += [(None, None, None, None), (None, "Alpha beta", "en", None), (5, "Alpha beta gamma", "en", "s1"), (5, "Alpha beta gamma", "en", "s1"), (7, "", "xx", "lone"), (8, "", "xx", "two")]
    rows.append((9, "alpha beta; " * 6000 + "Z" * 50_000 + " " * 3000, "en", "s3"))
    return [(*row, 1, 2, "t", "p", 3) for row in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("r3") / "d")
    spark.createDataFrame(hostile(), SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def audited(rows, min_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [((r[2] or "", r[3] or ""), re.findall(A.TERM, (r[1] or "").translate(lower))) for r in rows]
    df, n = collections.Counter(), collections.Counter()
    for (lang, source), t in terms:
        df.update((lang, w) for w in set(t))
        n.update((lang, source, w) for w in t)
    groups = {g for g, _ in terms}
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (l, w), c in df.items() if l == lang and c >= min_docs)
        sources = sorted(s for l, s in groups if l == lang)
        count = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        p = {s: {w: 1 + 10**9 * (c + 2) // (sum(cs.values()) + 2 * len(kept)) for w, c in cs.items()} for s, cs in count.items()}
        total = {w: sum(count[s][w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (c + 2) // (sum(total.values()) + 2 * len(kept)) for w, c in total.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:10]
            for part, got in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("model_terms", [1 << 20, 5])
def test_source_audit_of_hostile_rows(docs, model_terms):
    """One model, and several that share the terms."""
    got = A.source_audit(docs, model_terms=model_terms)
    assert sorted(map(tuple, got.collect())) == audited(hostile(), 10)


def test_source_audit_without_kept_terms(docs):
    got = A.source_audit(docs.filter("lang = 'xx'")).collect()
    assert sorted(map(tuple, got)) == [("xx", "lone", "pair", "two", 0, 1), ("xx", "two", "pair", "lone", 0, 1)]
    empty = A.source_audit(docs.limit(0))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0


def test_different_terms_are_estimated(spark):
    docs = spark.range(3000).selectExpr("1L AS g", "'en' AS lang", "concat(conv(id, 10, 26), ' ', conv(id * 7, 10, 26)) AS text").selectExpr("g", "lang", "translate(text, '0123456789', 'qrstuvwxyz') AS text")
    texts = A.term_texts(docs)
    true = texts.selectExpr("explode(split(terms, ' ')) AS t").distinct().count()
    assert 0.85 * true < A.different_terms(texts) < 1.15 * true


def test_piece_codec_of_hostile_rows(docs):
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for row in hostile():
        ids = sp.encode(row[1] or "")
        want.append((row[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    by = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, P.piece_round_trip(docs, path).collect()), key=lambda x: str(by(x))) == sorted(want, key=lambda x: str(by(x)))
    encoded = P.encode(docs, path)
    assert encoded.columns == ["doc_id", "ids"] and sorted(len(x.ids) for x in encoded.collect()) == sorted(w[1] for w in want)
    assert sorted(x.text for x in P.decode(encoded, path).collect()) == sorted(sp.decode(sp.encode(r[1] or "")) for r in hostile())
    assert P.piece_round_trip(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_merge_rounds_are_those_of_the_library(seed):
    path = tokenizer("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), P.PieceModel(path)
    r = random.Random(seed)
    parts = ["a", "b", "e", "th", "in", " ", "  ", "\n", P.SPACE, "é", "①", "中", "0", "the", "ing", "s", " t", "\x00", "😀", "=", "-", "....", "\t", "aaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500)] + ["a" * 4000, " " * 700, "ab" * 3000, "".join(r.choice("etaoinshr") for _ in range(4000))]
    got = list(model.encode(texts))
    assert got == [sp.encode(t) for t in texts]
    assert [model.decode(i) for i in got] == [sp.decode(i) for i in got]


def mined(rows, least, longest=5, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for row in rows:
        lang = "und" if row[2] is None else row[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (row[1] or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in cand.items():
        if any(l == lang and len(o) > len(w) and b >= a and any(o[i : i + len(w)] == w for i in range(len(o))) for (l, o), b in cand.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, k, *o[1:]) for k, o in enumerate(own[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("least, longest", [(20, 5), (100, 5), (6, 3), (10, 2)])
def test_collocations_of_hostile_rows(docs, least, longest):
    got = L.collocations(docs, longest=longest, least=least).drop("doc_id", "at").collect()
    assert sorted(map(tuple, got)) == mined(hostile(), least, longest) and got


def test_collocations_name_their_first_place(docs):
    for x in L.collocations(docs, least=50).collect():
        texts = [r[1] or "" for r in hostile() if r[0] == x.doc_id]
        assert any(" ".join(re.sub("[.,;:!?\n]", " ", t).lower().split()[x["at"] :]).startswith(x.phrase) for t in texts)
    assert L.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at most"):
        L.collocations(docs, longest=6)


def test_phrases_that_share_a_fingerprint_are_told_apart(spark, docs, monkeypatch):
    """With fingerprints of few values nearly all phrases collide; the counts by text stay right."""
    blunt = lambda h: (h >> 60) << 60
    import numpy as np

    words = ["a", "b", "c", "a", "b", "d"]
    memo = L.Words()
    ids = np.array([memo[w.encode()] for w in words])
    w = memo.hashes[ids]
    keep = L.mixed
    monkeypatch.setattr(L, "mixed", lambda h: np.asarray(blunt(keep(h))) & np.uint64(0))
    every = {k: bytes([255] * 8) for k in (1, 2)}
    texts = spark.createDataFrame([("en", 1, "a b c a b d"), ("en", 2, "a b")], "lang string, doc_id long, text string").coalesce(1)
    frame = texts.toArrow().to_batches()[0]
    assert len({int(x) for _, _, h in L.fingerprints(w, 0, (1, 2), L.Powers(100)) for x in h}) == 1
    rows = {x[1]: x[2] for b in L.opened_batches([frame], every, 2) for x in zip(*[c.to_pylist() for c in b.columns])}
    assert {k: v for k, v in rows.items() if k} == {"a": 3, "b": 3, "c": 1, "d": 1, "a b": 3, "b c": 1, "c a": 1, "b d": 1}


def test_split_files_give_the_same_rows(spark, docs, tmp_path):
    """A table whose files are split anew gives the same result."""
    path = str(tmp_path / "again")
    docs.repartition(9).write.parquet(path)
    again = spark.read.parquet(path)
    for run in (A.source_audit, lambda d: L.collocations(d, least=20), lambda d: P.piece_round_trip(d, tokenizer("piece_bpe_32k.model"))):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(again).collect()))


def test_packing_of_many_equal_rows(spark):
    """Equal rows are made in bounded runs, each has a seat of its own, and no row made on the way holds them all."""
    many = 300_007
    rows = spark.range(many).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(1, "a"), (1, "a"), (9, "b c d e f"), (None, None)], "doc_id long, text string"))
    got = packing.packing(rows, buckets=3, budget=400)
    assert got.groupBy("doc_id").count().sort("doc_id").collect() == [(None, 1), (1, 2), (7, many), (9, 1)]
    assert got.select("bucket", "batch", "slot").distinct().count() == many + 4
    full = got.filter("doc_id = 7").groupBy("bucket", "batch").count().filter("count <> 100").count()
    assert full <= 2
    work = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert work < many / 2


def test_packing_with_every_length_exact(spark):
    """With exact at the longest length, buckets are the optimum where bins of lengths would miss it."""
    from itertools import combinations

    lengths = [3, 3, 1001, 1002, 1002, 1003, 1040, 1041, 1041, 1044]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long").withColumn("text", F.lit("x"))
    got = packing.packing(rows, n_tokens=F.col("n"), buckets=4, exact=2000)
    padding = got.agg(F.sum("padding")).first()[0]
    cost = lambda tops: sum(min(t for t in tops if t >= n) - n for n in lengths)
    assert padding == min(cost([*c, 1044]) for c in combinations(sorted(set(lengths))[:-1], 3))
