"""Corpus operators against brute force on small tables with nulls, empty and repeated texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import bpe_codec, fingerprints, hmm_lm, license_scan, ngram_join, packing, quality_rules, suffix_dedup, token_records, url_filters
from gridloom.llm.queries import tokenizer

DOCS = "doc_id long, text string, row long, key long, n_words string, words string"


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    out = [None, "", "   ", "A", "one two"]
    while len(out) < n:
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 120)))
        out.append(t)
        if r.random() < 0.3:
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if r.random() < 0.1:
            out.append(t)
    passage = " ".join(r.choice(words) for _ in range(60))
    out += [passage + " tail one", "head two " + passage, "Released under the MIT License. " + "x y " * 30 + "mit license", "MIT LICENSE and apache license"]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i * 3, t, 7, 8, "c", None) for i, t in enumerate(texts())]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_license_scan(docs, by_id):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got.keys() == by_id.keys()
    for k, t in by_id.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [(i, label) for p, label in license_scan.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (got[k].n_words, got[k].n_base) == (len(w), len(at))
        assert got[k].base_labels == ",".join(sorted({label for _, label in at}))
        assert got[k].first_word == min((i for i, _ in at), default=None) and got[k].last_word == max((i for i, _ in at), default=None)
        assert 0 <= got[k].score <= 1 and set(got[k].base_labels.split(",")) <= set(got[k].labels.split(",")) | {""}


def test_quality_measures():
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice("ab \n#é") for _ in range(r.randint(0, 150)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = quality_rules.measures(t.encode(), quality_rules.LineField())
        assert m[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert m[5] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    model = quality_rules.LineField(r.normal(size=quality_rules.N_FEATURES + 1), r.normal(size=(2, 2)))
    for n in range(1, 8):
        x = r.normal(size=(n, quality_rules.N_FEATURES + 1))
        s = x @ model.emit
        value = lambda y: sum(s[i] * y[i] for i in range(n)) + sum(model.step[y[i - 1], y[i]] for i in range(1, n))
        best = max(value([int(b) for b in f"{k:0{n}b}"]) for k in range(2**n))
        assert abs(value(model.decode(x).astype(int)) - best) < 1e-9


def test_quality_rules_and_training(spark, docs):
    labels = spark.createDataFrame([(i * 3, int(i % 2), 0) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, quality_rules.train(docs, labels, rounds=5)).collect()
    assert len(got) == docs.count() and all(not r.kept for r in got if r.n_words < 20)


def shingle_sets(by_id):
    sets = {}
    for k, t in by_id.items():
        w = low(t).encode().split()
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else {()}
    return sets


def links_of(by_id):
    """Different texts within the threshold plus other copies."""
    sets, words = shingle_sets(by_id), {k: tuple(low(t).encode().split()) for k, t in by_id.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return {a: len({words[b] for b in sets if words[b] != words[a] and near(a, b)}) + sum(words[b] == words[a] for b in sets) - 1 for a in sets}


def classes(by_id):
    sets = shingle_sets(by_id)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_ngram_join(docs, by_id):
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    want = classes(by_id)
    assert {k: r.class_id for k, r in got.items()} == want
    assert {k: r.n_links for k, r in got.items()} == links_of(by_id)
    kept = ngram_join.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_ngram_join_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 600)
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    by_id = {}
    for i in range(70):
        words = base[: r.randint(85, 120)]
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"z{i}"
        by_id[i] = " ".join(words)
    spark.createDataFrame(list(by_id.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: r for r in ngram_join.ngram_join(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert {k: r.n_links for k, r in got.items()} == links_of(by_id)
    assert {k: r.class_id for k, r in got.items()} == classes(by_id)


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, n, 60)) for n in (50, 90, 400, 400, 50) for _ in range(12)]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    for rare in (0, 1, 128, 10**9):
        monkeypatch.setattr(ngram_join, "RARE", rare)
        monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 100)
        monkeypatch.setattr(ngram_join, "COLUMNS", 37)
        assert (ngram_join.shared_counts(sets) == want).all()
        assert (ngram_join.shared_counts(sets[:20], sets[20:]) == want[:20, 20:]).all()


def test_fingerprints(docs, by_id):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    ids = sorted(by_id)
    for k, after in zip(ids, ids[1:] + ids[:1]):
        t, n = by_id[k], len(by_id[k]) // 4
        edited = t[: len(t) - n] + by_id[after][:n]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        shingles = lambda s: {tuple(s.lower().split()[i : i + 5]) for i in range(max(1, len(s.split()) - 4))} if s.split() else set()
        a, b = shingles(t), shingles(edited)
        assert abs(got[k].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
    same = collections.defaultdict(set)
    for k, r in got.items():
        same[by_id[k]].add(r.fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_fingerprints_of_every_row(spark, tmp_path):
    """The query returns rows that share a doc_id or have none, each with a successor of its own."""
    import xxhash

    from gridloom.llm.queries import op4_fingerprints

    rows = [(r, f"{'word ' * (i % 7)}text {i // 2 if r == 5 else i}") for i, r in enumerate([None] * 20 + [5] * 20 + list(range(20)))] + [(None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    order = sorted((-(2**63) if k is None else k, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for k, t in rows)
    want = []
    for (k, _, t), (_, _, after) in zip(order, order[1:] + order[:1]):
        n = len(t) // 4
        want.append((k, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    got = [(-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in op4_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows)


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b c d e f g h i j", "k l m n o p q")], "x string, y string")
    a, b = fingerprints.sketch(F.col("x"), 4), fingerprints.sketch(F.col("y"), 4)
    m = df.select(fingerprints.merge(a, b, 4).alias("m"), a.alias("a"), b.alias("b")).first()
    assert m.m == sorted(set(m.a) | set(m.b))[:4]


def test_token_records(docs, by_id):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_records.token_records(docs, tokenizer("byte_bpe_50k.json")).collect()}
    start = 0
    for k in sorted(by_id):
        ids = [*t.encode(by_id[k], add_special_tokens=False).ids, 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_damaged_record_is_noticed():
    import io

    data = bytearray(token_records.frame(5, np.arange(9, dtype=np.uint16)))
    key, ids = token_records.read_frame(io.BytesIO(bytes(data)))
    assert key == 5 and ids.tolist() == list(range(9))
    data[20] ^= 1
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(bytes(data)))


ODD = ["a  b   c", "x \n y", "\n\n  z ", "<|endoftext|> hi", " ", "don't  '", "é́ x́ Σ ΑΣ", "a\tb\x0bc \x1cd \x85e", "日本語 テキスト。", "x" * 3000, "    a", "I'll we've 12 3.4"]


def test_encoders_agree_with_the_library():
    from tokenizers import Tokenizer

    r = random.Random(5)
    more = ODD + ["".join(r.choice("ab \n.'<|é1ß") for _ in range(r.randint(0, 60))) for _ in range(500)] + [t or "" for t in texts()]
    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_records.ByteEncoder(path).encode_texts(more)] == [t.encode(x, add_special_tokens=False).ids for x in more]
    path = tokenizer("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), bpe_codec.ChunkCodec(path)
    for x in more:
        ids = t.encode(x, add_special_tokens=False).ids
        for average in (4, 64, 512):
            got, decoded = c.encode_texts([x.encode()], average)[0]
            assert [int(v) for v in got.split()] == ids and decoded[:-1] == t.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(docs, by_id):
    got = {r.doc_id: r for r in bpe_codec.bpe_round_trip(docs, tokenizer("word_bpe_49k.json"), with_text=True).collect()}
    assert got.keys() == by_id.keys()
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got.values())


def test_url_filters(spark):
    r = random.Random(6)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "x.com", "net", "EXAMPLE.org"]
    paths = ["", "/", "/es/", "/es", "/es/1", "/en/1", "/en/12", "/fr/", "/fr/x?y=/de/", "/de/x#/fr/"]
    urls = [None, "", "nothing", "://", "http://"] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    rules = [*url_filters.RULES, ("block", "a.example.org", "/es/1"), ("allow", "example.org", "/"), ("block", "org", "/es/")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: x for x in url_filters.url_filters(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, None, url_filters.DEFAULT_VERDICT))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want[2], want[3])


def removed(by_id):
    first, out = {}, {}
    for k in sorted(by_id):
        b = by_id[k].encode()
        mask, own = bytearray(len(b)), set()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            if s in first:
                mask[i : i + 50] = b"\1" * 50
            own.add(s)
        for s in own:
            first.setdefault(s, k)
        runs = sum(1 for i in range(len(mask)) if mask[i] and not (i and mask[i - 1]))
        out[k] = (len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest())
    return out


def test_suffix_dedup(docs, by_id):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == removed(by_id)
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


def test_suffix_dedup_of_a_hot_gram(spark, tmp_path, monkeypatch):
    """One phrase amid differing surroundings: no gram's contexts may meet whole in one task, and the result stays."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    phrases = ["the phrase that is met in every text", "the phrase that is met in every text and then goes on for long enough to repeat"]
    made = {i: " ".join([*(word() for _ in range(r.randint(0, 12))), r.choice(phrases), r.choice("xy"), *(word() for _ in range(r.randint(0, 12)))] * r.randint(1, 2)) for i in range(-40, 260)}
    rows = [(i, t) for i, t in made.items()]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    # Monkeypatched values do not reach the workers; what meets is looked at here.
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "MERGE", 1000)
    import pyarrow as pa

    texts = [(n, k, t.encode()) for n, (k, t) in enumerate(rows)]
    blocks = [pa.RecordBatch.from_pylist([{"row": n, "key": k, "text": t} for n, k, t in texts[i : i + 30]]) for i in range(0, len(texts), 30)]
    anchors = [b for block in blocks for b in suffix_dedup._anchors(iter([block.select(["row", "text"])]))]
    wanted, hot = collections.defaultdict(list), np.zeros((1 << suffix_dedup.HOT_BITS) // 64, np.int64)
    for b in suffix_dedup._repeated(iter([b.select(["hash", "row", "n"]) for b in anchors])):
        for n, h in zip(b.column("row").to_pylist(), b.column("hash").to_pylist()):
            if n < 0:
                hot[h // 64] |= np.int64(np.uint64(1 << (h % 64)))
            else:
                wanted[n].append(h)
    assert hot.any()
    asked = [block.append_column("hashes", pa.array([wanted[n] for n in block.column("row").to_pylist()], pa.list_(pa.int64()))) for block in blocks]
    met = [x for part in (asked[:5], asked[5:]) for b in suffix_dedup._contexts(iter(part), hot) for x in b.to_pylist()]
    groups = collections.defaultdict(set)
    for x in met:
        if x["context"] is not None:
            groups[x["deal"]].add(x["context"])
    assert max(map(len, groups.values())) <= 20
    # One row a task, and few more, asks for each window, though a text repeats its phrase.
    assert max(collections.Counter(x["deal"] for x in met if x["context"] is not None and x["windows"] == 1).values()) <= 20
    spans = collections.defaultdict(list)
    dealt = sorted(met, key=lambda x: x["deal"])
    schema = pa.schema([("deal", pa.int64()), ("hash", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("context", pa.binary()), ("others", pa.binary())])
    for b in suffix_dedup._covered(iter([pa.RecordBatch.from_pylist(dealt, schema)])):
        for x in b.to_pylist():
            spans[x["row"]].append(x)
    want = removed(made)
    for n, k, t in texts:
        left, gone, runs = suffix_dedup.cut_out(t, spans[n], False)
        assert (len(t), gone, runs, hashlib.sha256(left).hexdigest()) == want[k]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want


def test_hot_grams_of_a_table(spark, tmp_path):
    """With hot grams by the true bound, through Spark."""
    r = random.Random(5)
    made = {i: "".join(r.choice("abcdefgh") for _ in range(30)) + " the phrase that is met in every text, "[: 30 + i % 9] + "".join(r.choice("abc") for _ in range(3 + i % 40)) for i in range(suffix_dedup.HOT + 300)}
    spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/d")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.suffix_dedup(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == removed(made)
    assert sum(x[1] for x in got.values()) > 0


@pytest.mark.parametrize("seed", range(40))
def test_merged_transforms_find_all_repeats(seed):
    r = random.Random(seed)
    alpha = bytes(r.sample(range(256), r.choice([1, 2, 3, 20])))
    length = r.choice([1, 2, 3, 4, 5, 7, 10])
    contexts = [bytes(r.choice(alpha) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 20))]
    keys = np.array([r.randint(-5, 100) for _ in contexts])
    for shard in (5, 30, 10_000):
        for c, g in zip(contexts, suffix_dedup.least_windows(contexts, keys, length, shard), strict=True):
            assert g.tolist() == [min(k for d, k in zip(contexts, keys) if c[i : i + length] in d) for i in range(len(c) - length + 1)]


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(8)
    for _ in range(40):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 9))))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        cost = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts))
        got = packing.boundaries(lengths, counts, 3)
        best = min(cost([*c, lengths[-1]]) for k in range(3) for c in combinations(lengths[:-1].tolist(), k))
        assert cost(got) == best and len(got) <= 3


def test_packing(docs, by_id):
    rows = packing.packing(docs, buckets=4, budget=200).collect()
    assert len(rows) == len(by_id)
    seats = collections.Counter((r.bucket, r.batch, r.slot) for r in rows)
    assert max(seats.values()) == 1
    for r in rows:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0 and (r.slot + 1) * r.bucket_tokens <= max(200, r.bucket_tokens)


def test_forward_and_counts_are_exact():
    r = np.random.default_rng(9)
    m = hmm_lm.Hmm(r.dirichlet(np.ones(2)), r.dirichlet(np.ones(2), 2), r.dirichlet(np.ones(3), 2))
    seqs = [r.integers(0, 3, n).astype(np.uint16) for n in (1, 5, 3)]
    from itertools import product

    def total(s):
        return sum(m.start[z[0]] * math.prod(m.step[a, b] for a, b in zip(z, z[1:])) * math.prod(m.emit[q, x] for q, x in zip(z, s)) for z in product(range(2), repeat=len(s)))

    assert np.allclose(hmm_lm.likelihoods(m, seqs), [math.log10(total(s)) for s in seqs])
    got = hmm_lm.expected_counts(m, seqs, 10)
    assert np.isclose(got[-1], sum(math.log10(total(s)) for s in seqs)) and np.isclose(got[:2].sum(), 3) and np.isclose(got[2:6].sum(), 6) and np.isclose(got[6:-1].sum(), 9)


def test_hmm_scores(docs, by_id):
    got = {r.doc_id: r for r in hmm_lm.hmm_scores(docs, common=40, symbols=10).collect()}
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for k, t in by_id.items()}
    c = collections.Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in words.items():
        g = got[k]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(g.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 and g.score < 0


def test_likelihood_rises(docs):
    counts = hmm_lm.written(hmm_lm.word_counts(docs), "t")
    stats = hmm_lm.word_stats(counts, 40, 20)
    _, said = hmm_lm.baum_welch(hmm_lm.written(hmm_lm.tokenised(docs, stats), "t"), hmm_lm.first_model(stats), 4)
    assert said[-1] > said[0]


def test_empty_tables(spark, empty):
    path = tokenizer("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    made = [license_scan.license_scan(empty), quality_rules.quality_rules(empty, quality_rules.train(empty, labels)), ngram_join.ngram_join(empty), fingerprints.fingerprint_edits(empty), token_records.token_records(empty, path), bpe_codec.bpe_round_trip(empty, tokenizer("word_bpe_49k.json")), suffix_dedup.suffix_dedup(empty), packing.packing(empty), hmm_lm.hmm_scores(empty)]
    assert [df.count() for df in made] == [0] * len(made)
    assert url_filters.url_filters(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, long), (1, long), (None, long), (2, None), (2, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    assert license_scan.license_scan(d).count() == 5 and bpe_codec.bpe_round_trip(d, tokenizer("word_bpe_49k.json")).count() == 5
    assert token_records.token_records(d, tokenizer("byte_bpe_50k.json")).count() == 5 and packing.packing(d).count() == 5 and hmm_lm.hmm_scores(d).count() == 5
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in ngram_join.ngram_join(d).collect()) == [(-1, -1), (1, -1), (1, -1), (2, 2), (2, 2)]
    assert sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.suffix_dedup(d).collect()) == [(-1, 0), (1, len(long)), (1, len(long)), (2, 0), (2, 0)]
    assert fingerprints.fingerprint_edits(d).count() == 3


def test_pipeline_stages(spark):
    import corpus_pipeline
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, SMALL)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 1 and len((r.text or "").split()) >= 20]
    assert set(clean) <= kept
    assert corpus_pipeline.run(spark, SMALL).count() > 0
