"""The methods of the corpus operators against brute force: labels of lines, recall, sketches, chunk reuse, buckets, likelihoods."""

import itertools
import math
import random
import struct

import numpy as np
import xxhash
from tokenizers import Tokenizer

from gridloom.llm import bpe_codec, fingerprints, hmm_lm, license_scan, ngram_join, packing, quality_rules
from gridloom.llm.queries import tokenizer


def trained_field(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return quality_rules.train(read("documents"), read("labels"))


def test_lines_have_labels_of_their_own(spark):
    """A boilerplate head and tail around prose: the share lies between 0 and 1, and the right lines are content."""
    model = trained_field(spark)
    prose = ["The of renders and ofthst nd of ouble edoution which are harent.", "Then theoned and that is by the heedat in its ondou.", "Erwhea of the rende and this was the last of all the lines."]
    menu = ["home | about | terms | login | more", "$$$ win### now%%% buy&&& here*** free$$$", "CLICK!! HERE!! NOW!! FOR!! MORE!!"]
    lines = [*menu, *prose, *menu]
    text = "\n".join(lines).encode()
    got = model.decode(quality_rules.line_features(*quality_rules._lines(text)))
    assert got.tolist() == [False] * 3 + [True] * 3 + [False] * 3
    m = dict(zip((n for n, _ in quality_rules.STATS_ARROW), quality_rules.measures(text, model)))
    assert 0 < m["content_share"] < 1 and m["n_content_lines"] == 3 and m["n_lines"] == 9
    assert abs(m["content_share"] - sum(map(len, prose)) / sum(map(len, lines))) < 1e-9


def test_share_and_verdict_by_brute_force(spark):
    model = trained_field(spark)
    r = random.Random(2)
    pool = ["home | about | terms", "SALE!! NOW!! HERE!!", "a prose line of more than eight plain words that ends.", "Short.", "$$$ a### b%%%", "another line of plain words which is quite long and ends so.", "word word word word word word word word word"]
    for _ in range(60):
        lines = [r.choice(pool) for _ in range(r.randint(1, 8))]
        text = "\n".join(lines).encode()
        x = quality_rules.line_features(*quality_rules._lines(text)) @ model.emit
        value = lambda y: sum(x[i] * y[i] for i in range(len(y))) + sum(model.step[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        share = sum(len(s) for s, k in zip(lines, best) if k) / sum(map(len, lines))
        m = quality_rules.measures(text, model)
        assert abs(m[6] - share) < 1e-9 and m[9] == (not m[5] and share >= quality_rules.MIN_CONTENT)


def test_open_lines_are_summed_over():
    """The gradient of partly labelled texts: with no open line it is that of full labels, and open lines move nothing by themselves."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, quality_rules.N_FEATURES + 1))
    full = quality_rules.fit([(x, np.array([1, 1, 0, 0, 1, 0]))], 40, 0.1)
    part = quality_rules.fit([(x, np.array([1, -1, 0, -1, 1, 0]))], 40, 0.1)
    s = x @ part.emit
    assert s[0] > s[2] and s[4] > s[5] and not np.allclose(full.emit, part.emit)
    assert quality_rules.fit([(x, np.full(6, -1))], 5, 0.1).emit[-1] == 1.0


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c.\n" * 500)] * 50 + [(2, "x | y | z\n" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, quality int")
    assert quality_rules.train(docs, labels, rounds=2, max_lines=7).emit.shape == (quality_rules.N_FEATURES + 1,)


def test_recall_of_the_forest(spark, tmp_path):
    """Of pairs of texts at 0.8 to 0.9, nine in ten at least are met (here in one class)."""
    r = random.Random(7)
    rows, pairs = [], []
    for i in range(1500):
        a = [f"w{r.randrange(10**6)}" for _ in range(120)]
        b = list(a)
        for at in r.sample(range(0, 120, 6), r.choice((1, 2))):
            b[at] = f"z{i}-{at}"
        sets = [{tuple(w[k : k + 5]) for k in range(116)} for w in (a, b)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    of = {x.doc_id: x.class_id for x in ngram_join.ngram_join(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert len(pairs) > 1000 and sum(of[a] == of[b] for a, b in pairs) >= 0.99 * len(pairs)


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def sketch(text, k):
    words = text.lower().split()
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        seed = 42
        for v in h[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        out.add(signed(seed))
    return sorted(out)[:k]


def test_fingerprints_by_brute_force(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["", "one", "one two three four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(d, k=8, repeats=True).collect()}
    said = lambda s: "".join(f"{h & (2**64 - 1):016x}" for h in s)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = sketch(t, 8), sketch(edited, 8), sketch(after, 8)
        both = lambda p, q: sorted(set(p) | set(q))[:8]
        like = lambda p, q: 1.0 if not p and not q else sum(h in p and h in q for h in both(p, q)) / len(both(p, q))
        many = float(len(a)) if len(a) < 8 else 7 / ((a[-1] + 2.0**63) / 2.0**64)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (said(a), said(b))
        assert math.isclose(got[i].near_edited, like(a, b)) and math.isclose(got[i].near_next, like(a, c)) and math.isclose(got[i].n_shingles, many, rel_tol=1e-9)


def test_sketches_of_parts(spark):
    """Merged sketches are those of the whole; containment and counts are near the truth."""
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(2000)]
    parts = [" ".join(words[i : i + 504]) for i in range(0, 2000, 500)]
    df = spark.createDataFrame([(1, p) for p in parts], "g int, text string")
    whole = spark.createDataFrame([(" ".join(words),)], "text string").select(fingerprints.sketch(F.col("text"), 64).alias("s")).first().s
    assert df.groupBy("g").agg(fingerprints.merge_agg(fingerprints.sketch(F.col("text"), 64), 64).alias("s")).first().s == whole
    two = spark.createDataFrame([(" ".join(words[:1000]), " ".join(words))], "a string, b string")
    a, b = (fingerprints.sketch(F.col(c), 256) for c in "ab")
    x = two.select(fingerprints.containment(a, b, 256).alias("in_b"), fingerprints.containment(b, a, 256).alias("in_a"), fingerprints.distinct_shingles(b, 256).alias("n")).first()
    assert x.in_b > 0.85 and abs(x.in_a - 0.5) < 0.15 and abs(x.n - 1996) < 400
    rows = fingerprints.fingerprints(df.withColumn("doc_id", F.lit(3)).unionByName(spark.createDataFrame([(2, None, 4)], "g int, text string, doc_id int"))).collect()
    assert len(rows) == len(parts) + 1 and [x.n_shingles for x in rows if x.doc_id == 4] == [0.0]


def test_repeated_chunks_are_encoded_once(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    passage = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(700))
    texts = [f"{i} head " + passage + f" tail {i}" if i % 2 else " ".join(str(r.random()) for _ in range(200)) for i in range(40)] + [passage, passage[100:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    tables = {}
    real, real_repeated = bpe_codec.written, bpe_codec.repeated_chunks

    def written(df, tag, *more):
        tables[tag] = real(df, tag, *more)
        return tables[tag]

    monkeypatch.setattr(bpe_codec, "written", written)
    monkeypatch.setattr(bpe_codec, "repeated_chunks", lambda docs, average: real_repeated(docs, average, 0))
    path = tokenizer("word_bpe_49k.json")
    got = {x.doc_id: x for x in bpe_codec.bpe_round_trip(spark.read.parquet(f"{tmp_path}/d"), path, 128, with_text=True).collect()}
    t = Tokenizer.from_file(path)
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)
    codes, met = tables["bpe-codes"], tables["bpe-pieces"].filter("digest IS NOT NULL")
    assert codes.count() == codes.select("digest").distinct().count() == met.select("digest").distinct().count() > 10
    assert met.count() > 10 * codes.count()


def test_lookup_by_rare_words(spark, tmp_path, monkeypatch):
    """Templates are met through a file's rarest licence words only; base phrases always. Ties in IDF go by the word."""
    notices = " ... ".join(t[2] for t in license_scan.TEMPLATES)
    rows = [(1, notices), (2, "Licensed under the GNU General Public License version 3"), (3, "mit license apache license"), (4, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    wide = {x.doc_id: x for x in license_scan.license_scan(d).collect()}
    monkeypatch.setattr(license_scan, "LOOKUP", 1)
    narrow = {x.doc_id: x for x in license_scan.license_scan(d).collect()}
    for k in (1, 2, 3, 4):
        assert (wide[k].n_base, wide[k].base_labels) == (narrow[k].n_base, narrow[k].base_labels)
        assert set(narrow[k].labels.split(",")) <= set(wide[k].labels.split(","))
    assert "gpl" in wide[2].labels and wide[3].base_labels == "apache,mit" and wide[4].labels == ""
    assert len(narrow[1].labels.split(",")) < len(wide[1].labels.split(","))


def test_packing_by_brute_force(spark, tmp_path):
    """Bins, buckets and batches of lengths below and beyond the exact bins; equal rows have seats of their own."""
    r = random.Random(9)
    lengths = [r.choice((1, 3, 7, 40, 511, 512, 513, 600, 1023, 1025, 1500)) for _ in range(120)]
    rows = [(i, "w " * n) for i, n in enumerate(lengths)] + [(500, "w w")] * 30 + [(None, "w w")] * 5
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = packing.packing(spark.read.parquet(f"{tmp_path}/d"), buckets=3, budget=2000).collect()
    tokens = sorted(len(t.split()) + 1 for _, t in rows)
    assert sorted(x.n_tokens for x in got) == tokens
    # Bins beyond 512 have a width of 2 up to 1024 and 4 up to 2048; a bin counts as its longest member.
    step = lambda n: 1 if n <= 512 else 2 if n <= 1024 else 4
    top = {n: -(-n // step(n)) * step(n) for n in tokens}
    bins = {b: max(n for n in tokens if top[n] == b) for b in set(top.values())}
    tops = sorted(bins.values())
    cost = lambda ends: sum(min(e for e in ends if e >= bins[top[n]]) - n for n in tokens)
    best = min(cost([*c, tops[-1]]) for k in range(3) for c in itertools.combinations(tops[:-1], k))
    assert sum(x.padding for x in got) == best
    for b in {x.bucket for x in got}:
        mine = [x for x in got if x.bucket == b]
        size = max(1, 2000 // mine[0].bucket_tokens)
        assert sorted((x.batch, x.slot) for x in mine) == [(i // size, i % size) for i in range(len(mine))]


def test_runs_are_carried_across():
    r = np.random.default_rng(9)
    m = hmm_lm.Hmm(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(4), 3))
    seqs = [r.integers(0, 4, n).astype(np.uint16) for n in (1, 17, 8, 30, 8)]
    whole = hmm_lm.expected_counts(m, seqs, 100, np.float64)
    for run in (1, 2, 7):
        assert np.allclose(hmm_lm.expected_counts(m, seqs, run, np.float64), whole)
        assert np.allclose(hmm_lm.likelihoods(m, seqs, run), hmm_lm.likelihoods(m, seqs))
    assert np.allclose(hmm_lm.expected_counts(m, seqs), whole, rtol=1e-4)


def test_scores_by_brute_force(spark, tmp_path, monkeypatch):
    """The score of each text: all state paths summed, times each rare word's share of its class."""
    r = random.Random(1)
    words = ["a", "b", "cc", "the", "ending", "ééé", "x1"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    held = {}
    real_train, real_stats = hmm_lm.baum_welch, hmm_lm.word_stats
    monkeypatch.setattr(hmm_lm, "baum_welch", lambda *a, **k: held.setdefault("model", real_train(*a, **k)))
    monkeypatch.setattr(hmm_lm, "word_stats", lambda *a, **k: held.setdefault("stats", real_stats(*a, **k)))
    got = {x.doc_id: x for x in hmm_lm.hmm_scores(spark.read.parquet(f"{tmp_path}/d"), states=2, rounds=3, symbols=4).collect()}
    (model, said), stats = held["model"], held["stats"]
    assert all(b >= a - 1e-6 for a, b in zip(said, said[1:]))
    assert len(stats.symbol) == 4 and len(stats.common) <= hmm_lm.COMMON
    train = [t for i, t in enumerate(texts) if not got[i].held_out]
    count = lambda w: sum(t.split().count(w) for t in train)
    for i, t in enumerate(texts):
        symbols, inside = [], 0.0
        for w in [*t.encode().split(), hmm_lm.END]:
            if w in stats.symbol:
                symbols.append(stats.symbol[w])
            else:
                k = hmm_lm.shape(w)
                symbols.append(len(stats.symbol) + k)
                inside += math.log10((count(w.decode()) + 1) / (stats.class_tokens[k] + stats.class_types[k] + 1))
        p = sum(model.start[z[0]] * math.prod(model.step[a, b] for a, b in zip(z, z[1:])) * math.prod(model.emit[q, x] for q, x in zip(z, symbols)) for z in itertools.product(range(2), repeat=len(symbols)))
        assert abs(got[i].score - (math.log10(p) + inside)) < 1e-6


def test_common_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 0, 1 + i // 10) for i in range(300)], "word binary, class int, n long")
    stats = hmm_lm.word_stats(counts, 50, 20)
    assert len(stats.common) <= 50 and len(stats.symbol) == 20 and min(stats.common.values()) > 20 and stats.tokens == sum(1 + i // 10 for i in range(300))
