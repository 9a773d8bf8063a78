"""Support and resistance zones: swing points of each key's last bars, clustered by price.

A key's bars are one array of at most ``lookback`` elements; every step is an
expression over it, so nothing leaves the JVM. The expressions are SQL texts that are put together and
parsed once: built as columns, node by node, they take seconds of the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "ticker string, kind string, low double, high double, mid double, touches int, tests int, rejections int, last_touch int, score double"


def _indexes(first: int, last: str) -> str:
    """first..last; empty if last comes before first."""
    return f"if({last} >= {first}, sequence({first}, {last}), cast(array() AS array<int>))"


def let(name: str, value: str, body: str) -> str:
    """``body`` of a value that is worked out once, however often the body names it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def peaks(x: str, distance: int) -> str:
    """Places of an array's strict local maxima (plateaus: middle, rounded down), higher ones first keeping others ``distance`` away; of equal ones the later."""
    starts = f"filter({_indexes(0, 'size(px) - 1')}, i -> i = 0 OR get(px, i) != get(px, i - 1))"
    tops = f"filter({_indexes(1, 'size(ps) - 2')}, k -> get(px, get(ps, k)) > get(px, get(ps, k) - 1) AND get(px, get(ps, k)) > get(px, get(ps, k + 1)))"
    by_height = f"array_sort(transform({tops}, k -> named_struct('depth', -get(px, get(ps, k)), 'back', -cast(floor((get(ps, k) + get(ps, k + 1) - 1) / 2) AS int))))"
    ordered = let("px", x, let("ps", starts, by_height))
    return f"array_sort(aggregate({ordered}, cast(array() AS array<int>), (kept, t) -> if(exists(kept, q -> abs(q + t.back) < {distance}), kept, concat(kept, array(-t.back)))))"


def prominence(x: str, p: str) -> str:
    """How far the peak at ``p`` stands above the higher of the two lowest points between it and higher ground."""
    higher = f"filter({_indexes(0, 'size(mx) - 1')}, i -> get(mx, i) > get(mx, {p}))"
    lo, hi = f"coalesce(array_max(filter(mh, i -> i < {p})) + 1, 0)", f"coalesce(array_min(filter(mh, i -> i > {p})), size(mx))"
    lowest = f"greatest(array_min(slice(mx, {lo} + 1, {p} - {lo} + 1)), array_min(slice(mx, {p} + 1, {hi} - {p})))"
    return let("mx", x, let("mh", higher, f"get(mx, {p}) - {lowest}"))


def clusters(points: str, tolerance: str) -> str:
    """Points (x, p) by x in groups: the next one joins while it is within the tolerance of the running mean."""
    kind = "array<struct<low:double,high:double,total:double,touches:int,last_touch:int>>"
    last = "try_element_at(gs, -1)"
    more = f"named_struct('low', {last}.low, 'high', c.x, 'total', {last}.total + c.x, 'touches', {last}.touches + 1, 'last_touch', greatest({last}.last_touch, c.p))"
    new = "named_struct('low', c.x, 'high', c.x, 'total', c.x, 'touches', 1, 'last_touch', c.p)"
    near = f"size(gs) > 0 AND c.x - {last}.total / {last}.touches <= {tolerance}"
    return f"aggregate(array_sort({points}), cast(array() AS {kind}), (gs, c) -> if({near}, concat(slice(gs, 1, size(gs) - 1), array({more})), concat(gs, array({new}))))"


def median(x: str) -> str:
    """Of an array; null if it is empty."""
    return let("so", f"array_sort({x})", "(get(so, cast(floor((size(so) - 1) / 2) AS int)) + get(so, cast(floor(size(so) / 2) AS int))) / 2")


def tolerance(bars: str, period: int, multiple: float) -> str:
    """The median of the average true range, the first full one standing for those before it; a two-hundredth of the median close without any."""
    high, low, before = f"get({bars}, i).high", f"get({bars}, i).low", f"get({bars}, i - 1).close"
    true = f"transform({_indexes(0, f'size({bars}) - 1')}, i -> greatest({high} - {low}, if(i > 0, abs({high} - {before}), null), if(i > 0, abs({low} - {before}), null)))"
    full = f"transform({_indexes(period - 1, 'size(tr) - 1')}, i -> aggregate(slice(tr, i - {period} + 2, {period}), 0D, (a, t) -> a + t) / {period} * {multiple}D)"
    usual = let("fu", let("tr", true, full), f"if(size(fu) > 0, {median(f'concat(array_repeat(get(fu, 0), {period - 1}), fu)')}, null)")
    return let("us", usual, f"if(us > 0, us, {median(f'transform({bars}, b -> b.close)')} * 0.005D)")


def _of_kind(bars: str, tol: str, kind: str, most: int, distance: int, least: int, floor: float | None, tested: int, recency: float, rejection: float) -> str:
    """The best zones of one kind from bars (d, high, low, close by day)."""
    side, sign, beyond = ("high", "", "b.close < g.low") if kind == "resistance" else ("low", "-", "b.close > g.high")
    line = f"transform({bars}, b -> {sign}b.{side})"
    at = peaks(line, distance) if floor is None else let("li", line, f"filter({peaks('li', distance)}, r -> {prominence('li', 'r')} >= {floor}D)")
    found = clusters(f"transform({at}, p -> named_struct('x', get({bars}, p).{side}, 'p', p))", tol)
    span = f"cast(size({bars}) - 1 AS double)"
    fresh = f"least(1D, greatest(0D, 1 - ({span} - g.last_touch) / greatest(1D, {span})))"
    score = f"g.touches * ({recency}D * {fresh} + 1) + {rejection}D * rej"
    zone = f"named_struct('order', -sc, 'mid', g.total / g.touches, 'kind', '{kind}', 'low', g.low, 'high', g.high, 'touches', g.touches, 'tests', size(ov), 'rejections', rej, 'last_touch', g.last_touch, 'score', sc)"
    over = "filter(la, b -> b.low <= g.high AND b.high >= g.low)"
    each = let("ov", over, let("rej", f"size(filter(ov, b -> {beyond}))", let("sc", score, zone)))
    zones = let("la", f"slice({bars}, greatest(size({bars}) - {tested}, 0) + 1, {tested})", f"transform(filter({found}, g -> g.touches >= {least}), g -> {each})")
    return f"slice(array_sort({zones}), 1, {most})"


def detect(bars: DataFrame, lookback: int = 100, most: int = 2, distance: int = 4, least: int = 2, multiple: float = 0.8, prominence: float | None = None, period: int = 14, tested: int = 120, recency: float = 0.35, rejection: float = 0.75) -> DataFrame:
    """Zones of each ticker from its last ``lookback`` bars, by kind and falling score."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("d"))
    tail = bars.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= lookback)
    bar = F.struct("d", *(F.col(f"{c}_c").cast("double").alias(c) for c in ("high", "low", "close")))
    rows = tail.groupBy("ticker").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    kinds = ", ".join(_of_kind("bs", "tol", k, most, distance, least, prominence, tested, recency, rejection) for k in ("resistance", "support"))
    found = F.expr(let("bs", "bars", let("tol", tolerance("bs", period, multiple), f"concat({kinds})")))
    return rows.select("ticker", F.explode(found).alias("z")).select("ticker", *(F.col("z").getField(f.split()[0]).alias(f.split()[0]) for f in SCHEMA.split(", ")[1:]))


def _in(mid: Column, a: Column, b: Column) -> Column:
    return mid.between(F.least(a, b), F.greatest(a, b))


def pick(trades: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds the middles of the best support and resistance for each trade (ticker, is_long, entry, stop, target).

    Of a long trade the support lies between stop and entry and the resistance
    between entry and target, of a short one the other way round; without the
    outer level, on the right side of the entry; without an entry, anywhere.
    """
    t = trades.join(_lists(zones), "ticker", "left")
    low = F.when(F.col("is_long"), F.col("stop")).otherwise(F.col("target"))
    high = F.when(F.col("is_long"), F.col("target")).otherwise(F.col("stop"))
    entry = F.col("entry")

    def best(kind: str, bound: Column, side) -> Column:  # noqa: ANN001
        fits = lambda z: F.when(entry.isNull(), F.lit(True)).when(bound.isNull(), side(z["mid"])).otherwise(_in(z["mid"], bound, entry))
        return F.try_element_at(F.filter(F.col(kind), fits), F.lit(1))["mid"]

    return t.withColumns({"pick_support": best("supports", low, lambda m: m < entry), "pick_resistance": best("resistances", high, lambda m: m > entry)}).drop("supports", "resistances").withColumnsRenamed({"pick_support": "support", "pick_resistance": "resistance"})


def _lists(zones: DataFrame) -> DataFrame:
    """(ticker, supports, resistances): the zones of each side as a list by falling score, then rising middle."""
    ranked = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("score")).alias("s"), "mid")))), lambda z: F.struct(z["mid"].alias("mid")))
    return zones.groupBy("ticker").agg(ranked("support").alias("supports"), ranked("resistance").alias("resistances"))


def levels(trades: DataFrame, zones: DataFrame) -> DataFrame:
    """``pick``, then the nearest zone on the right side of the entry, or else of the target; for trades
    without an entry all zones, only those between stop and target if there are any: (..., supports, resistances), lists of middles."""
    t = pick(trades, zones).join(_lists(zones), "ticker", "left")
    entry, target = F.col("entry"), F.col("target")
    mids = lambda c: F.coalesce(F.transform(F.col(c), lambda z: z["mid"]), F.array().cast("array<double>"))
    under, over = (lambda x: F.array_max(F.filter(mids("supports"), lambda m: m < x))), (lambda x: F.array_min(F.filter(mids("resistances"), lambda m: m > x)))
    support = F.coalesce(F.col("support"), under(entry), under(target))
    resistance = F.coalesce(F.col("resistance"), over(entry), over(target))
    band = F.col("stop").isNotNull() & target.isNotNull()
    inside = lambda c: F.filter(mids(c), lambda m: _in(m, F.col("stop"), target))
    some = band & ((F.size(inside("supports")) > 0) | (F.size(inside("resistances")) > 0))
    one = lambda x: F.when(x.isNull(), F.array().cast("array<double>")).otherwise(F.array(x))
    free = lambda c: F.when(some, inside(c)).otherwise(mids(c))
    of = lambda x, c: F.when(entry.isNotNull(), one(x)).otherwise(free(c))
    return t.select(*trades.columns, of(support, "supports").alias("supports"), of(resistance, "resistances").alias("resistances"))
