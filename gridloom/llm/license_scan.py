"""License scan over a positional index of rare words.

Templates are licence notices. Each template's words (common function words left out) are
posted with their positions. For every file the licence words with the highest inverse document
frequency in the corpus are looked up in the index; they name the candidate templates, whose full
postings are then intersected by relative position (file position minus template position). An
alignment is kept if it covers enough of the template and holds the template's mandatory key
phrase. Base phrases, of which no place may be missed, are candidates of every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, written

#: Characters below 0x80 other than letters and digits separate words; each word found is lower-cased (A-Z) on its own.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Fixed values: (template, label, notice, mandatory key phrase).
TEMPLATES = (
    ("mit_notice", "mit", "released under the mit license", "mit license"),
    ("mit_grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free"),
    ("apache_notice", "apache", "licensed under the apache license version 2 0", "apache license version"),
    ("gpl_notice", "gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl_notice", "lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl_notice", "agpl", "gnu affero general public license", "affero general public license"),
    ("mpl_notice", "mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("bsd_notice", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    ("cc_notice", "cc", "licensed under a creative commons attribution", "creative commons attribution"),
    ("epl_notice", "epl", "available under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense_notice", "unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)
# Phrases whose every place counts, as (phrase, label).
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Words too common to be posted.
STOP_WORDS = ("a", "and", "any", "are", "in", "into", "is", "of", "or", "the", "this", "to", "under", "use", "with", "without", "0", "2", "3")

#: Share of a template's IDF weight that an alignment covers at least.
MIN_COVERAGE = 0.7
#: So many of a file's licence words, the rarest of the corpus, are looked up.
LOOKUP = 8
#: So many of a template's words, the rarest of the corpus, are its anchors.
ANCHORS = 2


def postings(templates=TEMPLATES, phrases=BASE_PHRASES) -> list[tuple]:
    """Rows (template, label, exact, word, t_pos, is_key); exact: a base phrase, to be met in full."""
    rows = []
    for name, label, notice, key in templates:
        words, phrase = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        rows += [(name, label, False, w, i, at <= i < at + len(phrase)) for i, w in enumerate(words) if w not in STOP_WORDS]
    for phrase, label in phrases:
        rows += [(f"phrase {phrase}", label, True, w, i, True) for i, w in enumerate(phrase.split())]
    return rows


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored).

    Columns: doc_id, n_words, n_base (places of base phrases), first_word, last_word (null
    without a place), base_labels, labels (sorted, comma-joined; empty without one), score (the
    best alignment's share of IDF weight, 1 for a base phrase, 0 without a match), n_aligned
    (alignments kept). A null or empty text has no words and no match; very long texts are read
    whole; ties in IDF go by the word; repeated rows and repeated ids each get their own row; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    posted = postings(templates, phrases)
    vocabulary = sorted({p[3] for p in posted})
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    # One pass over the texts: afterwards only the places of licence words are read. lower() is quick but takes more than A-Z, so the few words that pass are tested again.
    likely = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.lower(x["word"]).isin(vocabulary))
    placed = F.filter(F.transform(likely, lambda x: F.struct(x["pos"].alias("pos"), ascii_lower(x["word"]).alias("word"))), lambda x: x["word"].isin(vocabulary))
    files = written(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), placed.alias("places")), "license-files")

    schema = T.StructType([T.StructField(n, t) for n, t in (("template", T.StringType()), ("label", T.StringType()), ("exact", T.BooleanType()), ("word", T.StringType()), ("t_pos", T.IntegerType()), ("is_key", T.BooleanType()))])
    post = spark.createDataFrame(posted, schema)
    # Inverse document frequency of each licence word, over all files; the vocabulary's size is fixed.
    df = files.select(F.explode(F.array_distinct(F.col("places.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n_files = files.agg(F.count("*").alias("n"))
    idf = F.round(F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1, 6)
    post = post.join(df, "word", "left").crossJoin(n_files).withColumn("idf", idf).drop("df", "n")
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("idf"), "word", "t_pos"))
    whole = Window.partitionBy("template").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    post = post.withColumn("anchor", (rank <= ANCHORS) | F.col("exact")).withColumn("weight", F.sum("idf").over(whole)).withColumn("n_key", F.sum(F.col("is_key").cast("int")).over(whole))

    # Each file's rarest licence words name its candidates. The one row beside the files has an entry for each licence word.
    index = post.groupBy("word").agg(F.max("idf").alias("idf"), F.collect_set(F.when(~F.col("exact"), F.col("template"))).alias("templates"))
    index = index.agg(F.map_from_entries(F.collect_list(F.struct("word", "idf"))).alias("idf_of"), F.map_from_entries(F.collect_list(F.struct("word", "templates"))).alias("templates_of"))
    some = files.filter(F.size("places") > 0).crossJoin(F.broadcast(index))
    rare = F.slice(F.array_sort(F.transform(F.array_distinct("places.word"), lambda w: F.struct((-F.col("idf_of")[w]).alias("least"), w.alias("word")))), 1, LOOKUP)
    some = some.select("row", "places", F.array_distinct(F.flatten(F.transform(rare, lambda x: F.col("templates_of")[x["word"]]))).alias("candidates"))
    # Intersect the candidates' postings by relative position.
    hits = some.select("row", "candidates", F.explode("places").alias("p")).select("row", "candidates", "p.pos", "p.word")
    aligned = (
        hits.join(F.broadcast(post), "word")
        .filter(F.col("exact") | F.array_contains("candidates", F.col("template")))
        .groupBy("row", "template", "label", "exact", "weight", "n_key", (F.col("pos") - F.col("t_pos")).alias("start"))
        .agg(F.sum("idf").alias("got"), F.sum(F.col("is_key").cast("int")).alias("keys"), F.max("anchor").alias("anchored"))
        .filter("anchored AND keys = n_key")
        .withColumn("share", F.least(F.lit(1.0), F.round(F.col("got") / F.col("weight"), 6)))
        .filter(F.col("share") >= min_coverage)
    )
    base = lambda c: F.when(F.col("exact"), c)
    found = aligned.groupBy("row").agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).cast("long").alias("first_word"),
        F.max(base(F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base(F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.count(F.lit(1)).alias("n_aligned"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "n_aligned": 0}
    return files.select("row", "doc_id", "n_words").join(found, "row", "left").fillna(none).drop("row")

