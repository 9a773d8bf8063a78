"""Every operator and stage with nulls, empty and very long texts, repeated rows, missing ids, clashing names and empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from larkspur.llm import codes, decontam, fm_dedup, langid, licenses, merkle, minhash_dedup, ogg, pieces, quality, suffix_dedup, toxicity, urlfilter

LONG = " ".join(f"long{i % 977}x{i}" for i in range(40_000))
#: Names that operators use for results or inside.
CLASH = ("score", "lang_pred", "lang_known", "n_words", "n_hit", "_key", "joined", "rest", "no_text", "_no_text", "row", "_row", "id", "doc", "ids", "decoded", "media", "stats", "host", "path", "rule", "licenses", "component", "first", "comp", "node")
TEXTS = [None, "", " \n", "one", "same words here for all of us", "same words here for all of us", LONG, "é🙂 日本", "x" * 5000]


def odd(spark, rows=True):
    data = [(None if i == 3 else 7 if i in (4, 5) else i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(TEXTS)] if rows else []
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(c) for c in CLASH})


BENCH = "item_id string, text string"


def vectors(docs):
    """Eight components made of each row's text; of the long text a vector of three."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("float")
    return docs.withColumnRenamed("doc_id", "vec_id").withColumn("embedding", F.when(n > 6000, F.array(n, n, n)).otherwise(F.array(*(n * k for k in range(8)))))
APPLY = {
    "op2": lambda d: licenses.find(d),
    "op4": lambda d: langid.predict(d, langid.fit(d)),
    "op5": lambda d: fm_dedup.dedup(d),
    "op6": lambda d: minhash_dedup.link(d, size=4),
    "op6 first": lambda d: minhash_dedup.keep_first(d),
    "op7": lambda d: pieces.decode_column(pieces.encode_column(d)),
    "op8": lambda d: quality.score(q := quality.features(d, ["doc_id"]), quality.fit(q.withColumn("quality", F.lit(1)))),
    "op9": lambda d: decontam.judge(d, d.sparkSession.createDataFrame([("a", "one"), (None, None)], BENCH)),
    "op9 joins": lambda d: decontam.judge(d, d.sparkSession.createDataFrame([("a", "one"), (None, None)], BENCH), limit=0),
    "op10": lambda d: suffix_dedup.dedup(d),
    "op10 cut": lambda d: suffix_dedup.cut_column(d),
    "op11": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic"))), [c for c in d.columns if c != "score"]),
    "op11 no labels": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic"))), ["doc_id", "text"]),
    "op12": lambda d: codes.with_label_error(codes.encode(v := vectors(d), codes.fit(v)), "lang"),
    "op13": lambda d: merkle.verify(d),
    "op3": lambda d: ogg.decode_column(ogg.encode_column(d.select("doc_id", "text")), ["doc_id", "n_bytes"]),
    "op1": lambda d: urlfilter.judge(d.withColumn("url", F.concat(F.lit("http://a.b/"), "text")), urlfilter.fit(d.withColumn("url", F.col("text")), urlfilter.lexicon(d, "text")), urlfilter.rules("block b/o")),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_rows(spark, name):
    docs = odd(spark)
    rows = APPLY[name](docs).collect()
    # Of repeated texts op6's first rows keep one; all other operators keep every row.
    assert len(rows) == len(TEXTS) - (name == "op6 first")
    if name in ("op6 first", "op10 cut"):
        assert set(rows[0].asDict()) == set(docs.columns) and all(r[c] == c for r in rows for c in CLASH)


@pytest.mark.parametrize("name", sorted(APPLY))
def test_no_rows(spark, name):
    assert APPLY[name](odd(spark, rows=False)).collect() == []


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages(spark, name, stage):
    sf = "/root/testdata/sf0.001"
    docs = odd(spark)
    got = stage(spark, docs, sf)
    if (name, stage) != P.STAGES[-1]:
        assert got.columns == docs.columns and all(r[c] == c for r in got.collect() for c in CLASH)
    got.collect()
    assert stage(spark, odd(spark, rows=False), sf).collect() == []


def test_stages_keep_clean_rows(spark):
    """Each stage on its own: texts of their own stay, in any order of rows."""
    words = [" ".join(f"{a}{b}{i}" for b in "the house stands near an old river where people come".split()) for i, a in enumerate("abcdefgh")]
    docs = spark.createDataFrame([(i, w, "en", "s", len(w)) for i, w in enumerate(words)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[1:]:
        assert {r["doc_id"] for r in stage(spark, docs.orderBy(F.desc("doc_id")), "/root/testdata/sf0.001").collect()} == set(range(8)), name


def test_bounds_of_bands():
    with pytest.raises(ValueError, match="hash functions"):
        licenses.classes({"a": " ".join(f"w{i}" for i in range(400))}, percent=1, miss=1e-30)
    assert licenses.classes({"a": " ".join(f"w{i}" for i in range(400))}, percent=5)[0].bands > 500
    assert licenses.classes({}) == []


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(5)
    for alphabet in (2, 3, 9):
        text = np.concatenate([np.append(rng.integers(1, alphabet + 1, int(n)), 0) for n in rng.integers(1, 40, 12)])
        index = fm_dedup.FMIndex(text, alphabet + 1)
        ends = np.flatnonzero(text)
        length, lo, hi = index.statistics(text, ends, 8)
        flat = text.tolist()
        for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist()):
            want = 0
            for k in range(1, 9):
                part = flat[e - k + 1 : e + 1]
                if e - k + 1 < 0 or 0 in part or sum(flat[i : i + k] == part for i in range(len(flat))) < 2:
                    break
                want = k
            assert n == want
            if n:
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(flat)) if flat[i : i + n] == flat[e - n + 1 : e + 1]]


def test_links_of_a_large_group(spark):
    """Near copies of one text, with as many words changed as there may be and more, against all pairs."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(240):
        words = list(base)
        for at in rng.choice(90, int(rng.integers(0, 7)), False):
            words[at] = f"new{rng.integers(0, 40)}" if i % 3 else f"own{i}_{at}"
        texts.append(" ".join(words[int(rng.integers(0, 12)) :] if i % 5 == 0 else words))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rare in (0, 2, 64):
        minhash_dedup.RARE, before = rare, minhash_dedup.RARE
        try:
            got = {r["id"]: r["component"] for r in minhash_dedup.link(docs, size=4).collect()}
        finally:
            minhash_dedup.RARE = before
        assert got == {i: find(i) for i in range(len(sets))}


def test_digests_of_empty_and_long(spark):
    docs = odd(spark).select("doc_id", "text")
    got = sorted((r["n_bytes"], r["payload_sha256"]) for r in ogg.decode_column(ogg.encode_column(docs), ["doc_id", "n_bytes"]).collect())
    raw = [(t or "").encode() for t in TEXTS]
    assert got == sorted((len(b), hashlib.sha256(b + b"\xff" * (-len(b) % 576 or (0 if b else 576))).hexdigest()) for b in raw)
