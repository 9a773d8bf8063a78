"""Small cases of the training-data operators against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import decontam, fm_dedup, langid, licenses, minhash_dedup, ogg, pieces, quality, segments, suffix_dedup, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int"


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or ""), "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.randint(0, 120))] for _ in range(12)]
    out = [None, "", " \n\t", "a"]
    while len(out) < n:
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            if words:
                words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += rng.choice(base)[:40]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_suffix_dedup(spark, texts):
    raw = [(t or "").encode() for t in texts]
    seen, want = {}, []
    for i, b in enumerate(raw):
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    for hot in (5000, 1):  # 1: every anchor goes through Spark's sort
        got = suffix_dedup.dedup(frame(spark, texts), hot=hot).collect()
        assert sorted(tuple(r) for r in got) == want


def test_suffix_dedup_hot_anchors_need_no_spark_sort(spark, monkeypatch):
    """Edges of a line that all texts have: longer anchors tell them apart, so no position of theirs is sorted by Spark."""
    rng = np.random.default_rng(3)
    some = lambda letters, n: "".join(rng.choice(list(letters), n))
    line = some("abcdefgh ", 90)
    texts = [f"{some('xy', 60)}\n{line}\n{some('xy', 60)}" for _ in range(60)]
    monkeypatch.setattr(suffix_dedup, "by_spark_sort", lambda segs: pytest.fail(f"{segs.count()} stretches are sorted by Spark"))
    got = sorted((r["id"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(frame(spark, texts), hot=40).collect())
    seen, want = {}, []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen.setdefault(t[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want.append((i, int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest()))
    assert got == want


def test_first_places_are_dealt_packed(spark):
    """First occurrences and the number of different segments of an anchor, without a row for each occurrence."""
    rng = random.Random(5)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randint(30, 80))) for _ in range(6)]
    rows = [(i if i % 7 else None, "".join(rng.choice(parts) for _ in range(4))) for i in range(40)]
    docs, n = segments.stored(spark.createDataFrame(rows, "doc_id long, text string"), "suffix")
    hits = segments.repeated_anchors(docs, suffix_dedup.SPEC, n)
    places = segments._pieces(docs, hits, suffix_dedup.SPEC, False).collect()
    want, kinds = {}, {}
    for r in places:
        place = (r["doc"], r["start"], r["row"], r["n"])
        want[r["anchor"], r["key"]] = min(place, want.get((r["anchor"], r["key"]), place))
        kinds.setdefault(r["anchor"], set()).add(r["key"])
    first = segments.firsts(docs, hits, suffix_dedup.SPEC, n)
    got = {(r["anchor"], r["key"]): (r["doc"], r["start"], r["row"], r["n"], r["c"]) for r in first.collect()}
    assert len(want) < len(places) and got == {k: (*v, len(kinds[k[0]])) for k, v in want.items()}


def test_suffix_cut_keeps_columns(spark, texts):
    docs = frame(spark, texts)
    cut = suffix_dedup.cut_column(docs)
    assert cut.columns == docs.columns
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert len(rows) == len(texts) and rows[0]["text"] is None and rows[3]["text"] == "a" and rows[5]["row"] == 7


def test_fm_dedup(spark, texts):
    words = [(t or "").split() for t in texts]
    seen, want = {}, []
    for i, w in enumerate(words):
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for hot in (5000, 1):
        assert sorted(tuple(r) for r in fm_dedup.dedup(frame(spark, texts), hot=hot).collect()) == want


def test_minhash(spark, texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["id"]: (r["n"], r["component"], r["first"]) for r in minhash_dedup.link(frame(spark, texts).drop("id", "row"), size=4).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_decontam(spark, texts, limit):
    items = [("7", " ".join((texts[20] or "x").split()[5:25])), ("x", "a"), ("n", None), ("w", " ")]
    cut = lambda t: [w for w in "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in (t or "").lower()).split(" ") if w]
    want = {}
    for i, t in enumerate(texts):
        w, hit, names = cut(t), set(), set()
        for name, item in items:
            v = cut(item)
            n = min(10, len(v))
            for k in range(max(0, len(v) - n + 1) if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        names.add(name)
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    found = decontam.judge(frame(spark, texts), spark.createDataFrame(items, "item_id string, text string"), limit=limit)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()} == want


def test_ogg(spark, texts):
    stored = ogg.encode_column(frame(spark, [*texts, "long " * 40_000]))
    for r in ogg.decode_column(stored, ["doc_id", "text", "n_bytes"]).collect():
        b = (r["text"] or "").encode()
        payload = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    media = bytearray(ogg.encode(ogg.to_payload(b"x" * 2000)))
    media[-1] ^= 1
    with pytest.raises(ogg.OggError, match="checksum"):
        ogg.decode(bytes(media))


def test_pieces(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    all_texts = [*texts, "Hello  world\n\n🙂日本 ", "▁ a▁b", "x" * 500]
    got = {r["doc_id"]: r for r in pieces.decode_column(pieces.encode_column(frame(spark, all_texts))).collect()}
    raw = pieces.Pieces(pieces.load())
    for i, t in enumerate(all_texts):
        want = model.encode(t or "")
        assert got[i]["ids"] == want == pieces.encode(raw, t or "", part=3)
        assert got[i]["decoded"] == (t or "").replace("▁", " ") == pieces.decode(raw, want)


@pytest.mark.parametrize("kind", [pieces.Pieces.MERGES, pieces.Pieces.UNIGRAM])
def test_parts_are_encoded_like_whole_texts(kind, monkeypatch):
    """With few remembered parts too; both model types, symbols without a piece, long parts, runs of spaces."""
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    model = pieces.Pieces(pieces.load())
    model.kind = kind
    made = pieces.Encoder(model)
    texts = ["", None, " ", "a  b", "   x", "one two  one", "\u65e5\u672c " * 9, "x" * 90 + "\u00e9\U0001f600\n\t", "\U0001f600\U0001f600 a\u0300", "ab" * 200, "\x00\x01", "one three"]
    for part in (texts, texts[::-1], texts[:2]):
        assert made.encode(pa.array(part, pa.string())).to_pylist() == [pieces.encode(model, t or "") for t in part]


def test_licenses(spark):
    pad = " ".join(f"w{i}" for i in range(50))
    texts = [None, "", "MIT License", f"{pad} Released under the MIT License. {pad}", f"{pad} this work is licensed under the gnu general public license version 3", pad]
    got = {r["doc_id"]: r["licenses"] for r in licenses.find(frame(spark, texts)).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "MIT", 4: "GPL-3.0", 5: ""}
    for j in (0.4, 0.6, 0.9):
        rows, n = licenses.bands(j)
        assert (1 - j**rows) ** n <= licenses.MISS


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7?x=1", "http://x.com/en/", "http://freebets.example.net/x", "https://b.example.net/de/81#t", "http://c.net/de", "http://casino-win.example.io/a", "http://garden.example.io/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    order = urlfilter.rules("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
    many = pages.sparkSession.createDataFrame([(i, f"http://{h}.example.io/{i}") for i, h in enumerate(["free-bets", "garden", "casino-win", "house", "flower-shop"] * 20)], "page_id long, url string")
    model = urlfilter.fit(many, {"free": 50, "bets": 20, "garden": 30, "house": 10})
    got = {r["page_id"]: r for r in urlfilter.judge(pages, model, order).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(4)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/7")]
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, "example.com/en/7", "com/en/", None, "example.net/de/8", None, None, None]
    assert [got[i]["verdict"] for i in range(3, 10)] == ["allow", "block", "block", "block", "allow", "block", "allow"]
    assert got[5]["host_words"].startswith("free bets ")


def test_classifiers(spark):
    rng = random.Random(1)
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30))
    texts = [make("abcde") if i % 2 else make("vwxyz") for i in range(80)] + [None, "", "123"]
    docs = spark.createDataFrame([(i, t, "odd" if i % 2 else "even") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 60"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("odd" if i % 2 else "even") for i in range(80))
    assert [got[i]["lang_pred"] for i in (80, 81, 82)] == ["und"] * 3
    from pyspark.sql import functions as F

    good = docs.withColumn("text", F.when(F.col("lang") == "odd", F.upper("text")).otherwise(F.col("text")))
    stats = quality.features(good, ["doc_id"])
    q = quality.fit(stats.where("doc_id < 60").withColumn("quality", (F.col("doc_id") % 2).cast("int")))
    scores = {r["doc_id"]: r["score"] for r in quality.score(stats, q).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i in range(80)) and 0 <= scores[81] <= 1


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.dedup(none).count() == fm_dedup.dedup(none).count() == minhash_dedup.link(none).count() == 0
    assert licenses.find(none).count() == pieces.encode_column(none).count() == langid.predict(none, langid.fit(none)).count() == 0
    assert decontam.judge(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    shared = " ".join(f"Passage{i}" for i in range(30))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    texts = ["A clean document with several plain words of its own.", f"first {shared} end of one", f"second text {shared} other end here", f"lead {bench}", "123 456", None]
    texts += [texts[0], " ".join(f"unique{i}" for i in range(40))]
    docs, kept = frame(spark, texts), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    ids = [sorted(v) for v in kept.values()]
    assert ids == [[0, 1, 2, 3, 6, 7], [0, 1, 2, 3, 7], [0, 1, 2, 3, 7], [0, 1, 2, 7], [0, 1, 2, 7]]
    third = kept["suffix-array dedup"]
    assert third[1]["text"] == texts[1] and "Passage15" not in third[2]["text"]


def test_language_stage_rejects_unlearned_languages(spark):
    """Beside the labelled rows of the tables, which nearly all stay, with any label."""
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = ["\u0421\u044a\u0435\u0448\u044c \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0444\u0440\u0430\u043d\u0446\u0443\u0437\u0441\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a", "Hyv\u00e4\u00e4 huomenta kaikille yst\u00e4ville ja tervetuloa meid\u00e4n kotiin t\u00e4n\u00e4\u00e4n", "xkqzv wqxj zzkpq vbnmq jjxw qqzx hjkl bvcx", "### 12 $$ q \u00df\u00df %% zq"]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema)
    stays = {r["doc_id"] for r in P.language(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert not any(i in stays for i in range(-len(odd), 0))
    clean = {r["doc_id"] for r in docs.where("text rlike '\\\\p{L}'").collect()}
    assert len(clean - stays) <= 0.002 * len(clean)


@pytest.mark.parametrize("hot", [5000, 1])
def test_repeated_and_missing_ids(spark, hot):
    """Rows of the same id, and rows without one, against brute force."""
    words = lambda seed, n: [f"{seed}{i * 7 % 61}x{i}" for i in range(n)]
    a, b, c = words("a", 60), words("b", 50), words("c", 40)
    lists = [(3, a), (3, a), (3, b[:5] + a), (None, b), (None, b), (None, c + b), (5, a[:30] + c), (5, a[:30] + c[::-1] + a[:30]), (7, c), (1, c[:25]), (None, a[20:50] + a[20:50]), (3, a[:45] + ["y"] + a[10:])]
    rows = [(i, " ".join(w)) for i, w in lists]
    place = [1 << 62 if i is None else i for i, _ in rows]
    raw = [t.encode() for _, t in rows]
    seen = {}
    for d, t in zip(place, raw):
        for k in range(len(t) - 49):
            seen[t[k : k + 50]] = min(d, seen.get(t[k : k + 50], d))
    want = []
    for (i, _), d, t in zip(rows, place, raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen[t[k : k + 50]] < d:
                gone[k : k + 50] = True
        want.append((str(i), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["id"]), r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs, hot=hot).collect()) == sorted(want)
    seen, want = {}, []
    for d, (_, w) in zip(place, lists):
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            seen[x] = min((d, k), seen.get(x, (d, k)))
    for d, (i, w) in zip(place, lists):
        gone = {p for k in range(len(w) - 19) if seen[tuple(w[k : k + 20])] < (d, k) for p in range(k, k + 20)}
        want.append((str(i), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert sorted((str(r["id"]), r["n_removed"], r["kept_sha256"]) for r in fm_dedup.dedup(docs, hot=hot).collect()) == sorted(want)


def test_minhash_reads_of_different_splits(spark, tmp_path, monkeypatch):
    """The size of splits changes after every table that the operator writes."""
    texts = [" ".join(f"w{i % 8}x{k}" for k in range(40)) + " end" * (i >= 8) for i in range(16)]
    frame(spark, texts).repartition(8).write.parquet(str(tmp_path / "docs"))
    docs, put, sizes = spark.read.parquet(str(tmp_path / "docs")), minhash_dedup.written, ["1m", "128m"]

    def flipping(df, name):
        done = put(df, name)
        sizes.reverse()
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        return done

    monkeypatch.setattr(minhash_dedup, "written", flipping)
    try:
        found = {r["id"]: r["component"] for r in minhash_dedup.link(docs.drop("id", "row"), size=4).collect()}
        kept = minhash_dedup.keep_first(docs)
        sizes.reverse()
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        rows = kept.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {i: i % 8 for i in range(16)}
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in rows) == list(enumerate(texts[:8]))


def test_language_sample_beside_many_copies(spark, monkeypatch):
    """All distinct texts are in the sample as long as they are no more than it holds."""
    sizes = []
    monkeypatch.setattr(langid, "solve", lambda flags, labels, *_: sizes.append(len(labels)))
    rows = [(f"text {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(100)] + [("copy", "en")] * 20_000
    langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_class=101)
    assert sizes == [101]


def test_rare_words_and_tokens_of_urls_count(spark):
    """Results don't depend on which words and tokens the tasks hold."""
    hosts = ["free-warez", "garden", "houseflower", "flowershop", "rarewarez", "x--1"]
    pages = spark.createDataFrame([(i, f"http://{hosts[i % 6]}.example.io/{'get' if i % 6 in (0, 4) else 'read'}/a{i}") for i in range(60)] + [(0, None)], "page_id long, url string")
    text = spark.createDataFrame([("house " * 50 + "flower " * 20 + "shop rare warez example " * 3,)], "text string")
    found = []
    for least in (0.0, 0.05, 0.3):
        words = urlfilter.lexicon(text, "text", least)
        fitted = urlfilter.fit(pages, words, least=least)
        assert (fitted.rare is None) == (words.rare is None) == (least == 0)
        got = urlfilter.judge(pages, fitted, urlfilter.rules("allow garden.example.io/"))
        found.append(sorted((r["page_id"], str(r["host"]), str(r["rule"]), r["verdict"], round(r["score"], 9), r["host_words"]) for r in got.collect()))
    assert found[0] == found[1] == found[2]
    assert {x[3] for x in found[0] if "free-warez" in x[1]} == {"block"} and any("flower shop" in x[5] for x in found[0])


def test_altered_license_texts_by_brute_force(spark):
    """Whole texts and headers with words changed, beside the containment in every window."""
    cut = lambda t: "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in t.lower()).split()
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    sets = {k: shingles(cut(t)) for k, t in licenses.TEMPLATES.items()}
    assert {"MPL-2.0-text", "LGPL-2.1-text", "ISC-text", "GPL-notice", "Apache-2.0-text"} <= set(sets)
    rng, texts, pad = random.Random(3), [], [f"pad{i}" for i in range(300)]
    for name in sets:
        for share in (0.015, 0.12):
            words = [f"new{i}" if rng.random() < share else w for i, w in enumerate(cut(licenses.TEMPLATES[name]))]
            texts.append(" ".join(pad[: rng.randrange(300)] + words + pad))

    def held(words, name):
        m = len(cut(licenses.TEMPLATES[name])) - 4
        step = -(-m // 4)
        window = step * -(-(m + step - 1) // step)
        return any(100 * len(sets[name] & shingles(words[k : k + window + 4])) >= 80 * len(sets[name]) for k in range(0, len(words) - 4, step))

    want = {i: ",".join(sorted(k for k, s in sets.items() if 100 * len(s & shingles(w)) >= 80 * len(s) and held(w, k))) for i, w in enumerate(map(cut, texts))}
    assert sum("-text" in v for v in want.values()) >= 15 and "" in want.values()
    assert {r["doc_id"]: r["licenses"] for r in licenses.find(frame(spark, texts)).collect()} == want
