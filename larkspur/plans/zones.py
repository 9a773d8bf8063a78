"""Support and resistance zones, and the levels that trades take from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur.operators import zones
from larkspur.plans.registry import query
from larkspur.sources import bars


def found(lookback: int, most: int) -> str:
    """Common table expressions up to ``zone``: peaks, their suppression and the clusters are recursions over ranks."""
    return f"""tail AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS i, high_c::DOUBLE AS high, low_c::DOUBLE AS low, close_c::DOUBLE AS close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM bars) WHERE k <= {lookback}),
    size AS (SELECT ticker, count(*) AS n, median(close) AS mid FROM tail GROUP BY ticker),
    true_range AS (SELECT ticker, i, greatest(high - low, abs(high - p), abs(low - p)) AS t FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY i) AS p FROM tail)),
    atr AS (SELECT ticker, i, CASE WHEN count(*) OVER w = 14 THEN sum(t) OVER w / 14 * 0.8::DOUBLE END AS a FROM true_range WINDOW w AS (PARTITION BY ticker ORDER BY i ROWS 13 PRECEDING)),
    wide AS (SELECT ticker, median(coalesce(a, f)) AS t FROM (SELECT *, first_value(a IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM atr) GROUP BY ticker),
    tol AS (SELECT ticker, n, CASE WHEN t > 0 THEN t ELSE mid * 0.005::DOUBLE END AS tol FROM wide JOIN size USING (ticker)),
    line AS (SELECT ticker, 'resistance' AS kind, i, high AS x FROM tail UNION ALL SELECT ticker, 'support', i, -low FROM tail),
    runs AS (SELECT ticker, kind, r, min(i) AS a, max(i) AS z, any_value(x) AS x FROM (SELECT *, sum(turn) OVER (PARTITION BY ticker, kind ORDER BY i) AS r FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY ticker, kind ORDER BY i) THEN 0 ELSE 1 END AS turn FROM line)) GROUP BY ticker, kind, r),
    tops AS (SELECT ticker, kind, (a + z) // 2 AS p, x, row_number() OVER (PARTITION BY ticker, kind ORDER BY x DESC, (a + z) // 2 DESC) AS o FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS c FROM runs WINDOW w AS (PARTITION BY ticker, kind ORDER BY r)) WHERE x > b AND x > c),
    kept AS (SELECT ticker, kind, o, [p] AS got FROM tops WHERE o = 1 UNION ALL
      SELECT k.ticker, k.kind, t.o, CASE WHEN len(list_filter(k.got, lambda q: abs(q - t.p) < 4)) = 0 THEN list_append(k.got, t.p) ELSE k.got END FROM kept k JOIN tops t ON t.ticker = k.ticker AND t.kind = k.kind AND t.o = k.o + 1),
    points AS (SELECT ticker, kind, p, v, row_number() OVER (PARTITION BY ticker, kind ORDER BY v, p) AS o FROM (SELECT t.ticker, t.kind, t.p, abs(t.x) AS v FROM tops t JOIN (SELECT ticker, kind, arg_max(got, o) AS got FROM kept GROUP BY ticker, kind) k ON t.ticker = k.ticker AND t.kind = k.kind AND list_contains(k.got, t.p))),
    grown AS (SELECT ticker, kind, o, 1 AS c, v AS s, 1 AS n, v, p FROM points WHERE o = 1 UNION ALL
      SELECT g.ticker, g.kind, q.o, CASE WHEN near THEN g.c ELSE g.c + 1 END, CASE WHEN near THEN g.s + q.v ELSE q.v END, CASE WHEN near THEN g.n + 1 ELSE 1 END, q.v, q.p
      FROM grown g JOIN points q ON q.ticker = g.ticker AND q.kind = g.kind AND q.o = g.o + 1 JOIN tol t ON t.ticker = g.ticker, LATERAL (SELECT q.v - g.s / g.n <= t.tol AS near)),
    groups AS (SELECT ticker, kind, min(v) AS low, max(v) AS high, max(s) / max(n) AS mid, count(*) AS touches, max(p) AS last_touch FROM grown GROUP BY ticker, kind, c HAVING count(*) >= 2),
    met AS (SELECT g.ticker, g.kind, g.low, count(*) AS tests, count(*) FILTER (CASE WHEN g.kind = 'support' THEN b.close > g.high ELSE b.close < g.low END) AS rejections FROM groups g JOIN tol t ON t.ticker = g.ticker JOIN tail b ON b.ticker = g.ticker AND b.i >= t.n - 120 AND b.low <= g.high AND b.high >= g.low GROUP BY g.ticker, g.kind, g.low),
    scored AS (SELECT g.*, coalesce(tests, 0) AS tests, coalesce(rejections, 0) AS rejections, touches * (0.35::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - (n - 1 - last_touch)::DOUBLE / greatest(1, n - 1)::DOUBLE)) + 1) + 0.75::DOUBLE * coalesce(rejections, 0) AS score
      FROM groups g JOIN tol USING (ticker) LEFT JOIN met m ON m.ticker = g.ticker AND m.kind = g.kind AND m.low = g.low),
    zone AS (SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY score DESC, mid) AS place FROM scored QUALIFY place <= {most})"""


@query(f"""SELECT * FROM (WITH RECURSIVE {found(100, 2)}
SELECT ticker, kind, low, high, mid::DECIMAL(18,4) AS mid, touches::INT AS touches, tests::INT AS tests, rejections::INT AS rejections, last_touch::INT AS last_touch, score::DECIMAL(18,4) AS score FROM zone)""")
def support_resistance(spark: SparkSession, sf: str) -> DataFrame:
    """The two best zones of each ticker and kind."""
    return zones.detect(bars(spark, sf)).withColumns({c: X.dec(F.col(c)) for c in ("mid", "score")})


#: What a trade's level may be: between the outer level and the entry, the best by score.
_PICK = "(SELECT z.mid FROM zone z WHERE z.ticker = t.ticker AND z.kind = '{}' AND z.mid BETWEEN least({}, entry) AND greatest({}, entry) ORDER BY z.place LIMIT 1)"
_LOW, _HIGH = "CASE WHEN is_long THEN stop ELSE target END", "CASE WHEN is_long THEN target ELSE stop END"


@query(f"""SELECT * FROM (WITH RECURSIVE {found(300, 8)},
  trades AS (SELECT ticker, NOT (ticker LIKE '%1' OR ticker LIKE '%3') AS is_long, c AS entry, CASE WHEN is_long THEN c * (1 - 1.0::DOUBLE * 0.2::DOUBLE) ELSE c * (1 - -1.0::DOUBLE * 0.2::DOUBLE) END AS stop, CASE WHEN is_long THEN c * (1 + 1.0::DOUBLE * 0.3::DOUBLE) ELSE c * (1 + -1.0::DOUBLE * 0.3::DOUBLE) END AS target
    FROM (SELECT ticker, arg_max(close_c, d)::DOUBLE AS c FROM bars GROUP BY ticker)),
  chosen AS (SELECT t.*, coalesce({_PICK.format("support", _LOW, _LOW)}, (SELECT max(z.mid) FROM zone z WHERE z.ticker = t.ticker AND z.kind = 'support' AND z.mid < entry), (SELECT max(z.mid) FROM zone z WHERE z.ticker = t.ticker AND z.kind = 'support' AND z.mid < target)) AS support,
    coalesce({_PICK.format("resistance", _HIGH, _HIGH)}, (SELECT min(z.mid) FROM zone z WHERE z.ticker = t.ticker AND z.kind = 'resistance' AND z.mid > entry), (SELECT min(z.mid) FROM zone z WHERE z.ticker = t.ticker AND z.kind = 'resistance' AND z.mid > target)) AS resistance FROM trades t)
SELECT ticker, is_long, entry, stop::DECIMAL(18,4) AS stop, target::DECIMAL(18,4) AS target, support::DECIMAL(18,4) AS support, resistance::DECIMAL(18,4) AS resistance FROM chosen)""")
def pick_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Support and resistance for a trade in every ticker, half of them short."""
    b = bars(spark, sf)
    last = b.groupBy("ticker").agg(F.max_by("close_c", "d").cast("double").alias("c"))
    short = F.col("ticker").endswith("1") | F.col("ticker").endswith("3")
    side = F.when(short, -1.0).otherwise(1.0)
    trades = last.select("ticker", (~short).alias("is_long"), F.col("c").alias("entry"), (F.col("c") * (1 - side * 0.2)).alias("stop"), (F.col("c") * (1 + side * 0.3)).alias("target"))
    got = zones.levels(trades, zones.detect(b, lookback=300, most=8))
    one = lambda c: X.dec(F.get(F.col(c), 0))  # noqa: E731  with an entry there is one level of a kind at most
    return got.select("ticker", "is_long", "entry", X.dec(F.col("stop")).alias("stop"), X.dec(F.col("target")).alias("target"), one("supports").alias("support"), one("resistances").alias("resistance"))
