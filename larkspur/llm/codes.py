"""Vector code compression: product quantisation in exact integers, screened by a float32 matrix product.

A component x counts as the integer floor(1024 x).  Vectors are cut into
``PARTS`` equal consecutive parts; each part's codebook starts as that part of
the ``ENTRIES`` vectors with the smallest ids.  ``fit`` repeats ``ROUNDS`` times:
every part goes to its nearest entry, then every entry becomes the floor of its
parts' mean (entries without parts stay).  A round reads all vectors once;
every task sends sums and counts of fixed size.  ``encode`` assigns once more.

The nearest entry minimises |c|² - 2 x·c.  ``nearest`` computes this for all
entries by one float32 matrix product and bounds what rounding can have changed:
for m components, with unit u = 2⁻²⁴, a product of rounded inputs summed in any
order, fused or not, errs by at most gamma(m + 2) |x| |c| (gamma(k) = k u / (1 - k u)),
and the last operations by a few u of their operands.  Every entry whose interval
reaches down to the smallest upper end is evaluated again in int64; of equal
distances the lowest index wins.  A lone survivor is the nearest beyond doubt.

Rows whose vector is null or holds a null or non-finite component are dropped.
The length of all is that of the vector with the smallest id that can be cut;
rows that can't (another length, none at all, components so large that a
squared distance leaves 64 bits) stay with null code and error and teach
nothing.  Null ids come after all others; rows of one id are ordered by their
vectors, equal rows are alike and all stay.  With fewer vectors than ``ENTRIES``
the codebooks are shorter; an empty table gives an empty result.  Extra columns
pass through ``encode``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tables import free, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in one matrix product: 8 MB of float32 for each part.
ROWS = 8192
#: Labels whose sums are broadcast, at most; more of them are joined by a shuffle.
BROADCAST_LABELS = 50_000

UNIT = 2.0**-24


def usable(vector: str | Column) -> Column:
    """Whether the vector is there with finite components only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad


def largest(width: int) -> int:
    """Integers up to this size keep every sum of squared differences below 2**62."""
    return int((2.0**62 / max(width, 1)) ** 0.5 / 2)


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be cut, their integers): components are floor(1024 x), exact in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    ok = sizes == width
    if not width or not ok.any():
        return np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    at = np.flatnonzero(ok)
    x = np.floor(values[starts[at][:, None] + np.arange(width)] * SCALE)
    small = (np.abs(x) <= largest(width)).all(axis=1)
    return at[small], x[small].astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row; both exact, ties to the lowest index."""
    m = x.shape[1]
    gamma = (m + 2) * UNIT / (1 - (m + 2) * UNIT)
    norm_x = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    square = (book.astype(np.float64) ** 2).sum(axis=1)
    norm_c = np.sqrt(square) * (1 + 1e-12)
    rough = x.astype(np.float32) @ book.astype(np.float32).T
    rough *= np.float32(-2)
    rough += square.astype(np.float32)
    most = norm_c.max()
    # The product's error twice, the rounding of |c|², of their sum, and of the comparison below.
    error = (2 * gamma + 8 * UNIT) * norm_x * most + 4 * UNIT * most**2 + 1e-30
    low = rough.min(axis=1)
    bound = np.nextafter((low.astype(np.float64) + 2 * error).astype(np.float32), np.float32(np.inf))
    row, entry = np.nonzero(rough <= bound[:, None])
    exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
    order = np.lexsort((entry, exact, row))
    first = order[np.searchsorted(row, np.arange(len(x)))]  # rows ascend in ``row`` and stay so in the order
    return entry[first], exact[first]


def cut(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def start(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """The first codebooks, (PARTS, entries, part width): ENTRIES rows at most come to the driver."""
    n, scaled = F.size("v"), lambda x: x.cast("double") * SCALE
    most = F.floor(F.sqrt(2.0**62 / n.cast("double")) / 2)
    rows = df.where(usable(vector)).select(F.col(key).alias("k"), F.col(vector).alias("v")).where((n > 0) & (n % PARTS == 0))
    rows = rows.where(F.forall("v", lambda x: (scaled(x) >= -most) & (scaled(x) < most + 1)))
    order = [F.col("k").asc_nulls_last(), F.col("v")]
    lead = rows.orderBy(*order).select(n.alias("n")).first()
    if lead is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    found = rows.where(n == lead["n"]).orderBy(*order).limit(ENTRIES).collect()
    x = np.floor(np.array([r["v"] for r in found], np.float64) * SCALE).astype(np.int64)
    return np.stack(cut(x))


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id", rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after the rounds."""
    books = start(df, vector, key)
    if not books.size:
        return books
    rows = df.where(usable(vector)).select(F.col(vector).alias("v"))
    for _ in range(rounds):
        total = moments(rows, books)
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
    return books


def moments(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Sums of components, and last the count, of what goes to each entry: (PARTS, entries, part width + 1)."""
    parts, entries, m = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, m + 1), np.int64)
        for batch in blocks(batches):
            _, x = integers(batch.column(0), parts * m)
            for p, part in enumerate(cut(x)) if len(x) else ():
                to, _ = nearest(part, books[p])
                order = np.argsort(to, kind="stable")
                used, at = np.unique(to[order], return_index=True)
                total[p, used, :-1] += np.add.reduceat(part[order], at, axis=0)
                total[p, :, -1] += np.bincount(to, minlength=entries)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

    out = np.zeros(books.size + parts * entries, np.int64)
    found = rows.mapInArrow(sums, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(parts, entries, m + 1)


def encode(df: DataFrame, books: np.ndarray, vector: str = "embedding", out: tuple[str, str] = ("code", "error")) -> DataFrame:
    """Rows with usable vectors, without them, with hex digits of the entries' indexes and the summed squared distance."""
    parts, _, m = books.shape
    rest = [c for c in df.columns if c not in (vector, *out)]
    src = df.where(usable(vector)).select(F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"), F.col(vector).alias("v"))
    schema = src.select("rest", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    for f in schema.fields[1:]:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            at, x = integers(batch.column(1), parts * m)
            code, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            if len(at):
                found = [nearest(part, books[p]) for p, part in enumerate(cut(x))]
                digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
                code[at] = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                error[at] = sum(f[1] for f in found)
            gone = np.ones(batch.num_rows, bool)
            gone[at] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, mask=gone)], names=["rest", "code", "error"])

    coded = src.mapInArrow(run, schema)
    return coded.select(*(F.col("rest").getField(c).alias(c) for c in rest), F.col("code").alias(out[0]), F.col("error").alias(out[1]))


def decode(books: np.ndarray, code: str) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    """sha256 of all integers in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error", limit: int = BROADCAST_LABELS) -> DataFrame:
    """Adds the sum of errors over rows of equal label, nulls together.

    Sums are made before anything moves, so a hot label costs nothing; up to
    ``limit`` labels come back by broadcast, more by a join that adaptive
    execution splits where one label is hot.
    """
    key, total = free("key", coded.columns), free("total", [*coded.columns, "key", "key_"])
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(total))
    few = sums.limit(limit + 1).count() <= limit
    joined = coded.drop(out).join(F.broadcast(sums) if few else sums, F.col(label).eqNullSafe(F.col(key)))
    return joined.withColumn(out, F.col(total)).drop(key, total)


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a usable vector."""
    books = fit(df, vector, key)
    coded = written(encode(df.select(key, label, vector), books, vector), "codes")
    return with_label_error(coded, label).select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The same by all distances, in DuckDB; for vectors of one length, of which the first ENTRIES have ids of their own."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (SELECT x.vec_id, x.p, arg_min(b.e, (list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e,
            min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM cut x JOIN book{k} b ON b.p = x.p GROUP BY x.vec_id, x.p)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT n.p, n.e, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM near{k} n JOIN cut x ON x.vec_id = n.vec_id AND x.p = n.p) GROUP BY p, e, i),
            mean{k} AS (SELECT p, e, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT ORDER BY i) AS v FROM sums{k} GROUP BY p, e),
            book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    body = ",\n".join(steps)
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) r(p)),
    book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut QUALIFY e < {ENTRIES}),
    {body},
    done AS (SELECT k.vec_id, any_value(k.label) AS label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error FROM kept k JOIN near{rounds} n ON n.vec_id = k.vec_id GROUP BY k.vec_id)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM done"""
