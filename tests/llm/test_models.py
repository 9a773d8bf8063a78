"""The two learned classifiers against their formulas written out another way, and on held-out rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_ridge_is_the_dual_form_of_the_kernel():
    """With every text a landmark, outputs are those of kernel ridge regression on the centred kernel matrix."""
    rng = np.random.default_rng(3)
    make = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(12))
    texts, labels = [make("abcdef") for _ in range(20)] + [make("defghi") for _ in range(20)] + [make("ghijkl") for _ in range(20)], ["a"] * 20 + ["b"] * 20 + ["c"] * 20
    more = [make("abcdef"), make("defghi"), make("aghijkl"), "abc"]
    model = langid.solve(langid.presence(texts), labels, landmarks=60)

    def grams(text):
        """The set of blended n-grams; a run of other characters is one boundary."""
        codes = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        run = "".join(c for i, c in enumerate(codes) if c != " " or i == 0 or codes[i - 1] != " ")
        return {run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1)}

    own, new = [grams(t) for t in texts], [grams(t) for t in more]
    kernel = lambda xs, ys: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in ys] for x in xs])
    n, k = len(own), kernel(own, own)
    centre = np.eye(n) - 1 / n
    y = np.array([[lab == c for c in "abc"] for lab in labels], float)
    dual = np.linalg.solve(centre @ k @ centre + langid.RIDGE * n * np.eye(n), y - y.mean(0))
    want = (kernel(new, own) - k.mean(0)) @ centre @ dual + y.mean(0)
    assert np.abs(model.outputs(langid.presence(more)) - want).max() < 0.02  # hashed flags can meet


def test_discriminant_by_inverse_and_determinant():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{rng.integers(0, 9 if i % 2 else 500)}" for _ in range(int(rng.integers(5, 60)))) for i in range(80)]
    x, y = quality.statistics(pa.array(texts)), np.arange(80) % 2
    model = quality.solve(np.array([(y == k).sum() for k in (0, 1)], float), np.stack([x[y == k].sum(0) for k in (0, 1)]), np.stack([x[y == k].T @ x[y == k] for k in (0, 1)]))
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (cov[0] + cov[1]) / 2
    odds = 0
    for k, sign in ((0, -1), (1, 1)):
        c = 0.88 * cov[k] + 0.1 * pooled + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-8))
        d = x - x[y == k].mean(0)
        odds = odds + sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-odds)), atol=1e-6)


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op4_string_kernel_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert total > 100 and right >= 0.97 * total
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op8_quadratic_discriminant(spark, SF).join(labels, "doc_id").where("held_out AND quality IS NOT NULL")
    right, total = found.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count(F.lit(1))).first()
    assert total > 50 and right >= 0.95 * total
