"""Positive-unlabelled learning, screened codes and mountain ranges against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import codes, merkle, queries, toxicity

SF = "/root/testdata/sf0.01"


# --- toxicity


def test_risk_by_differences():
    """The gradients are those of the risk, and a corrected part below zero is climbed, not lowered."""
    rng = np.random.default_rng(1)
    xp, xu = rng.random((7, 4)), rng.random((9, 4))
    wp, wu, w = np.full(7, 1 / 7), np.full(9, 1 / 9), rng.normal(size=4)
    up, down = toxicity.risk(w, xp, wp, xu, wu, 0.3)[2:]
    for j in range(4):
        step = np.eye(4)[j] * 1e-6
        hi, lo = toxicity.risk(w + step, xp, wp, xu, wu, 0.3), toxicity.risk(w - step, xp, wp, xu, wu, 0.3)
        assert np.allclose([(hi[0] - lo[0]) / 2e-6, (hi[1] - lo[1]) / 2e-6], [up[j], down[j]], atol=1e-6)
    plain = 0.3 * np.mean([np.log1p(np.exp(-f)) for f in xp @ w]), np.mean([np.log1p(np.exp(f)) for f in xu @ w]) - 0.3 * np.mean([np.log1p(np.exp(f)) for f in xp @ w])
    assert np.allclose(toxicity.risk(w, xp, wp, xu, wu, 0.3)[:2], plain)


def test_risk_stays_non_negative():
    """Where confirmed and unlabelled texts are the same few, the plain corrected risk falls below zero; the trained one ends near it."""
    cells = [0, int(np.ravel_multi_index(tuple(n - 1 for n in toxicity.LEVELS), toxicity.LEVELS))]
    weights = toxicity.train({cells[1]: 3}, {cells[0]: 97, cells[1]: 1}, 0.3)  # the prior says 30 per cent, the texts 1
    x = np.column_stack([toxicity.values(np.array(cells)), np.ones(2)])
    negative = toxicity.risk(weights, x[1:], np.ones(1), x, np.array([97, 1]) / 98, 0.3)[1]
    assert negative > -0.05


def test_evidence_by_word_sets(spark):
    """Counters hold what word sets say, and confirmed examples leave themselves out."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Sun", "moon,", "star", "bad", "ill!", "rain"]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    toxic = [("bad" in t or "ill" in t) and i % 2 == 0 for i, t in enumerate(texts)]
    rows = spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, confirmed boolean")
    lexicon = toxicity.count(rows)
    assert (lexicon.n_total, lexicon.n_toxic) == (60, sum(toxic))
    sets = [set("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in texts]
    for word in ("sun", "moon", "bad", "ill", "rain", "none"):
        at = toxicity.places(pa.array([word]))[1][0]
        total, found = sum(word in s for s in sets), sum(word in s and t for s, t in zip(sets, toxic, strict=True))
        assert list(lexicon.total[at]) == [total] * 3 and list(lexicon.toxic[at]) == [found] * 3
        want = toxicity.evidence(np.array([found]), np.array([total]), sum(toxic), 60)[0]
        assert np.allclose(lexicon.known[at], want)
        assert np.allclose(lexicon.without[at], toxicity.evidence(np.array([found - 1]), np.array([total - 1]), sum(toxic) - 1, 59)[0])


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op11_positive_unlabelled(spark, SF)
    rows = found.join(labels, "doc_id").collect()
    assert found.count() == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(clean) <= 0.01 * len(clean) and sum(caught) >= 0.6 * len(caught)  # a tenth of a table's few toxic labels are wrong


def test_toxicity_learns_from_positives_alone(spark):
    """With no text labelled 0, unlabelled text is what the confirmed examples are held against; no input but the text counts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(30)) + (" nasty brute" if i % 10 == 0 else "")) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 700, 10)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, prior=0.1), ["doc_id"]).collect()}
    assert all((s >= 0.5) == (i % 10 == 0) for i, s in got.items())


# --- codes


def test_nearest_is_exact():
    """Against all distances in Python integers, with ties, close entries and sizes at the limit."""
    rng = np.random.default_rng(7)
    for most in (1, 4, 1000, 2**21, codes.largest(16)):
        x, book = rng.integers(-most, most + 1, (300, 16)), rng.integers(-most, most + 1, (256, 16))
        book[128:192] = book[:64]
        x[:100] = book[rng.integers(0, 256, 100)] + rng.integers(-1, 2, (100, 16))
        x = np.clip(x, -codes.largest(16), codes.largest(16))
        at, distance = codes.nearest(x, book)
        all_of = ((x.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(axis=2)
        assert at.tolist() == all_of.argmin(axis=1).tolist() and distance.tolist() == all_of.min(axis=1).tolist()


def test_screening_narrows():
    """Few entries survive the float32 product on vectors of usual size."""
    rng = np.random.default_rng(8)
    x, book = rng.integers(-300, 300, (2000, 16)), rng.integers(-300, 300, (256, 16))
    seen = []
    original = np.nonzero
    np.nonzero = lambda m: seen.append(int(m.sum())) or original(m)
    try:
        codes.nearest(x, book)
    finally:
        np.nonzero = original
    assert seen[0] < 1.05 * len(x)


def brute_codes(rows):
    """(id, code, error) and books, by all distances; rows are (id, integers), in order of id."""
    books, codes_of, errors = [], [[] for _ in rows], [0] * len(rows)
    m = len(rows[0][1]) // 4
    for p in range(4):
        parts = [tuple(v[p * m : (p + 1) * m]) for _, v in rows]
        book = list(parts[:256])
        for turn in range(5):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book)) for x in parts]
            if turn == 4:
                break
            for i in range(len(book)):
                mine = [x for x, (_, k) in zip(parts, near, strict=True) if k == i]
                if mine:
                    book[i] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        books.append(book)
        for i, (d, k) in enumerate(near):
            codes_of[i].append(f"{k:02x}")
            errors[i] += d
    said = ",".join(str(c) for b in books for e in b for c in e)
    return ["".join(c) for c in codes_of], errors, hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("limit", [codes.BROADCAST_LABELS, 0])
def test_codes_by_brute_force(spark, limit):
    rng = np.random.default_rng(9)
    vectors = [[float(c) for c in np.round(rng.normal(0, 0.02, 8), 3)] for _ in range(290)]
    rows = [(i, v, [None, 3, 4][i % 3]) for i, v in enumerate(vectors)]
    odd = [(500, None, 1), (501, [1.0, None, *[0.0] * 6], 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 1), (504, [1.0, 2.0], 1), (505, [3e38] * 8, None), (506, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    want_code, want_error, want_books = brute_codes([(i, [int(np.floor(np.float64(np.float32(c)) * 1024)) for c in v]) for i, v, _ in rows])
    books = codes.fit(df)
    assert codes.digest(books) == want_books
    got = {r["vec_id"]: r for r in codes.with_label_error(codes.encode(df, books), limit=limit).collect()}
    assert set(got) == set(range(290)) | {504, 505, 506}  # rows that can't be cut stay without a code
    assert all(got[k]["code"] is None and got[k]["error"] is None for k in (504, 505, 506))
    assert [got[i]["code"] for i in range(290)] == want_code and [got[i]["error"] for i in range(290)] == want_error
    sums = {lab: sum(e for e, (_, _, k) in zip(want_error, rows, strict=True) if k == lab) for lab in (None, 3, 4)}
    assert all(got[i]["label_error"] == sums[rows[i][2]] for i in range(290))
    near = codes.decode(books, want_code[0]) - np.floor(np.array(np.float32(vectors[0]), float) * 1024)
    assert int((near**2).sum()) == want_error[0]


# --- manifest


def naive(docs):
    """doc_id -> (leaf, subroot, root, proof, folded root), level by level."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def grow(level):
        levels = [level]
        while len(level) > 1:
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
            levels.append(level)
        return levels

    def climb(levels, i):
        out = []
        for level in levels[:-1]:
            lo = i - i % 3
            out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
            i //= 3
        return out

    groups = {}
    for d in sorted(docs, key=lambda d: d[0]):
        groups.setdefault(d[1], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([sha("".join(map(said, d))) for d in groups[n]]) for n in names]
    top = grow([t[-1][0] for t in trees])
    found = {}
    for k, n in enumerate(names):
        for i, d in enumerate(groups[n]):
            steps = climb(trees[k], i) + climb(top, k)
            text = d[4]
            if text is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = sha("".join(map(said, (*d[:4], text))))
            for a, b in steps:
                at = sha(a + at + b)
            found[d[0]] = (trees[k][0][i], trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), at, at == top[-1][0])
    return found


def records(n, seed=0):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "Z", None] + [f"s{i}" for i in range(9)]
    pick = lambda: sources[0] if rng.random() < 0.4 else rng.choice(sources)
    return [(i * 3 - 50, pick(), rng.choice(["en", None]), rng.choice([7, None]), rng.choice([None, "", "x", "two\nlines", "é\n🙂", "w " * rng.randint(1, 50)])) for i in range(n)]


@pytest.mark.parametrize(("n", "rows", "wide"), [(1, 16_384, 256), (400, 16_384, 256), (400, 9, 2), (250, 40, 3), (27, 1, 256)])
def test_manifest_by_levels(spark, n, rows, wide):
    docs = records(n, n)
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(c) for c in ("part", "grp", "hash", "at", "key")})
    before, merkle.WIDE = merkle.WIDE, wide
    try:
        got = {r[0]: tuple(r)[1:] for r in merkle.verify(df, rows_each=rows).collect()}
    finally:
        merkle.WIDE = before
    assert got == naive(docs)


def test_nodes_of_the_manifest(spark):
    """Node records: every node above the leaves once, whichever round has made it."""
    docs = records(120, 4)
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    rows = df.select(F.col("doc_id").alias("key"), F.col("source").alias("grp"), merkle.leaf(*(F.col(c) for c in merkle.FIELDS)).alias("hash"))
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}
    want = 0
    for n in sizes.values():
        while n > 1:
            n = -(-n // 3)
            want += n
    for each in (1000, 11):
        nodes = merkle.build(rows, ["key"], each).groups.nodes.collect()
        assert len(nodes) == want == len({(r["grp"], r["level"], r["place"]) for r in nodes})


def test_range_over_any_cuts():
    """However a row of leaves is cut into stretches, its ranges merge into the tree made level by level."""
    rng = random.Random(6)
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 28, 81, 100]:
        leaves = [f"{i:064x}" for i in range(n)]
        level = leaves
        while len(level) > 1:
            level = [merkle.join_hash(level[i : i + 3]) for i in range(0, len(level), 3)]
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(5))})
        peaks = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = merkle.Range()
            for i in range(lo, hi):
                part.push(merkle.Node(0, i, leaves[i]))
            if hi == n:
                part.finish(n)
            peaks += [merkle.Node(x.level, x.index, x.hash) for x in part.stack]
        whole = merkle.Range()
        for x in peaks:
            whole.push(x)
        whole.finish(n)
        assert whole.complete(n) and whole.stack[0].hash == level[0]


def test_manifest_with_repeated_ids(spark):
    """Equal rows and rows of one id are leaves of their own; the root is that of the rows in order of id and hash."""
    docs = [(1, "a", None, 1, "x")] * 5 + [(1, "a", None, 1, "y"), (None, "a", None, 1, None), (2, None, None, None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verify(df, rows_each=2).collect()
    assert len(got) == 8 and all(r["verified"] for r in got)
    leaf = lambda d: merkle.join_hash(["-" if v is None else f"{len(str(v))}:{v}" for v in d])
    level = [leaf(d) for d in sorted(docs[:-1], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))]
    while len(level) > 1:
        level = [merkle.join_hash(level[i : i + 3]) for i in range(0, len(level), 3)]
    assert got[0]["root"] == merkle.join_hash([leaf(docs[-1]), level[0]])
