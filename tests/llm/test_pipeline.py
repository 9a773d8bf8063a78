"""The pipeline's rows against its stages written out by brute force, one after the other."""

import hashlib
import random

import numpy as np

import corpus_pipeline as P
from larkspur.llm import langid, pieces


def grams(text):
    """The set of blended n-grams; a run of other characters than letters is one boundary."""
    codes = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    run = "".join(c for i, c in enumerate(codes) if c != " " or i == 0 or codes[i - 1] != " ")
    return {run[i : i + n] for n in range(1, langid.ORDER + 1) for i in range(len(run) - n + 1)}


def languages(docs):
    """Kernel ridge regression in its dual form on all labelled texts, and the share of n-grams that the predicted language knows."""
    lettered = [d for d in docs if d["text"] and any(c.isalpha() for c in d["text"])]
    sample = sorted({(d["lang"], d["text"]) for d in lettered if d["lang"] is not None})
    names, sets = sorted({lang for lang, _ in sample}), [grams(t) for _, t in sample]
    kernel = lambda xs, ys: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in ys] for x in xs])
    k, n = kernel(sets, sets), len(sets)
    centre = np.eye(n) - 1 / n
    y = np.array([[lang == c for c in names] for lang, _ in sample], float)
    dual = np.linalg.solve(centre @ k @ centre + langid.RIDGE * n * np.eye(n), y - y.mean(0))
    counts = {c: {} for c in names}
    for (lang, _), s in zip(sample, sets, strict=True):
        for g in s:
            counts[lang][g] = counts[lang].get(g, 0) + 1
    share = lambda s, c, least: sum(counts[c].get(g, 0) >= least for g in s) / len(s)
    enough = {}
    for c in names:
        low = np.quantile([share(s, c, 2) for (lang, _), s in zip(sample, sets, strict=True) if lang == c], langid.ODD)
        enough[c] = min(low, (low + np.median([share(s, c, 1) for (lang, _), s in zip(sample, sets, strict=True) if lang != c])) / 2)
    kept = []
    for d in lettered:
        s = grams(d["text"])
        best = names[int(np.argmax((kernel([s], sets) - k.mean(0)) @ centre @ dual + y.mean(0)))]
        if share(s, best, 1) >= enough[best]:
            kept.append(d)
    return kept


def near(docs):
    """Components of pairs with a similarity of 0.8 on sets of five words; the smallest id stays."""
    words = [d["text"].lower().split() for d in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(range(len(docs)), key=lambda i: docs[i]["doc_id"])
    for a in order:
        for b in order:
            if docs[a]["doc_id"] < docs[b]["doc_id"] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                keep, other = (x, y) if docs[x]["doc_id"] < docs[y]["doc_id"] else (y, x)
                root[other] = keep
    return [d for i, d in enumerate(docs) if find(i) == i]


def cut(docs):
    """Bytes covered by a string of 50 that a document with a smaller id has too."""
    first = {}
    for d in docs:
        b = d["text"].encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d["doc_id"]), d["doc_id"])
    out = []
    for d in docs:
        b = d["text"].encode()
        gone = set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d["doc_id"]:
                gone.update(range(i, i + 50))
        text = bytes(c for i, c in enumerate(b) if i not in gone).decode()
        if text.split():
            out.append({**d, "text": text})
    return out


def clean(docs, items):
    """Without documents that hold ten words in a row of an item."""
    words = lambda t: "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in t.lower()).split()
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(words, items) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [d for d in docs if not hit(words(d["text"]))]


def corpus():
    rng = random.Random(11)
    speech = {"en": ["the", "river", "stone", "winter", "garden", "market", "people", "walking", "under", "yellow", "lamps", "while", "children", "sing", "about", "harbour", "ships", "morning"], "de": ["und", "zwischen", "häuser", "straße", "über", "jäger", "möchte", "wolken", "schiff", "kürbis", "völlig", "zwölf", "pferde", "ziehen", "durch", "königsweg", "würfel", "schnee"]}
    write = lambda lang, n: " ".join(rng.choice(speech[lang]) + (str(rng.randrange(1000)) if rng.random() < 0.5 else "") for _ in range(n))
    items = ["which of these eight planets has the largest number of known moons today", "seven short words"]
    passage = write("en", 14)
    rows = [write(lang, rng.randint(30, 80)) for lang in ("en", "de") for _ in range(24)]
    langs = ["en"] * 24 + ["de"] * 24
    for i in (3, 9, 30):
        words = rows[i].split()
        words[len(words) // 2] = "changed"
        rows += [rows[i], " ".join(words)]
        langs += [langs[i]] * 2
    for i in (1, 5, 7):
        rows[i] += "\n" + passage + " " + write("en", 4)
    rows += [write("en", 12) + " " + items[0] + " " + write("en", 9), "Seven short, words", "123 456 789", "", None, "щука и рак летели вместе над холодным озером до самого утра", passage]
    langs += ["en", "en", "en", "de", None, None, "en"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [{"doc_id": 7 * k, "text": rows[i], "lang": langs[i], "source": f"s{i % 3}", "n_chars": len(rows[i] or "")} for k, i in enumerate(order)], items


def test_rows_by_brute_force(spark, tmp_path):
    import sentencepiece

    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = languages(docs)
    one = near(known)
    shorter = cut(one)
    left = clean(shorter, items)
    # Every stage has something to do.
    assert len(docs) > len(known) > len(one) >= len(shorter) > len(left) > 40 and any(a["text"] != b["text"] for a, b in zip(sorted(one, key=lambda d: d["doc_id"]), sorted(shorter, key=lambda d: d["doc_id"]), strict=False))
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {d["doc_id"]: (d["lang"], d["source"], len(ids := model.encode(d["text"])), hashlib.sha256(d["text"].encode()).hexdigest(), ids) for d in left}
    got = {r["doc_id"]: tuple(r)[1:] for r in P.run(spark, str(tmp_path)).collect()}
    assert got == want
