"""URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes over host and path tokens.

``lexicon`` counts the words of a text column, ``fit`` the tokens of URLs.  Of
both the tasks hold those with at least ``MIN_SHARE`` of all occurrences, of
which there can't be more than 1 / MIN_SHARE, whatever the input.  The rarer
ones are in written tables and come in by joins: words with the substrings of
the distinct runs of letters in hosts, tokens with the rare tokens of each URL.
They count like the frequent ones.  A host is cut
at other characters than letters and digits and each run of letters is split by
Viterbi into the words of greatest joint probability (unknown words: a tenth
for each letter, so that a name of unknown parts stays whole).

There are no labelled URLs, so the classes are learned from positive and
unlabelled ones. URLs with a seed word in their host are positive; all others
are unlabelled. First these count as allowed; then, ``ROUNDS`` times, every
unlabelled URL counts for both classes by the share that the last model gives it.
It has no seed, so it is judged by the words
that keep company with seeds elsewhere: hosts of such words are blocked without
a seed of their own. Counts cover all URLs in every round.

Rules come before the classifier: a rule is a host suffix and a path prefix;
of those that fit, the longest wins.

Null URLs and those without ``://`` have an empty host and path, no tokens and
the verdict of the prior alone.  URLs of any length, repeated rows and extra
columns of any name are fine; columns that have the names of the results are
replaced. Of equal segmentations the one with the longer last word counts, of
equal classes (a score of one half) the blocked one. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.llm.tables import written

#: Least share of a word or token in all occurrences for the tasks to hold it: at most 1 / MIN_SHARE entries; rarer ones are joined.
MIN_SHARE = 1e-5
#: Rounds in which unlabelled URLs count for both classes.
ROUNDS = 2
#: Shares of a URL are counted in these parts.
PARTS = 1_000_000
#: Words that mark a host's URLs as blocked in training, whether they are set apart in it or found by segmentation.
SEEDS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "casino", "crack", "cracked", "doubleclick", "escort", "gambling", "jackpot", "keygen", "lottery", "malware", "nude", "payday", "pharma",
    "phish", "phishing", "pills", "poker", "popup", "porn", "roulette", "sex", "slots", "spam", "spyware", "torrent", "track", "tracker", "tracking", "viagra", "warez", "xxx",
)
ALLOW, BLOCK = 0, 1
VERDICTS = ("allow", "block")

_RUNS = re.compile(r"[^\W\d_]+|\d+")
RESULT = ("host", "path", "rule", "verdict", "score", "host_words")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(*lines: str) -> list[Rule]:
    """From lines like ``block example.net/de/``."""
    out = []
    for line in lines:
        verdict, _, text = line.partition(" ")
        if verdict not in VERDICTS or "/" not in text:
            raise ValueError(f"not a rule: {line}")
        host, _, path = text.partition("/")
        out.append(Rule(host, "/" + path, verdict))
    return out


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles and tags."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")


@dataclass
class Lexicon:
    """Counts of words: the frequent ones here, the rare ones as a table (w, c), or None if there are none."""

    frequent: dict[str, int]
    total: int
    lengths: tuple[int, ...]  #: lengths of its words, rare or not
    rare: DataFrame | None = None


def lexicon(text: DataFrame, column: str, least: float = MIN_SHARE) -> Lexicon:
    """Counts of all words (letters only, lower case)."""
    words = text.select(F.explode(F.split(F.lower(F.col(column)), r"[^\p{L}]+")).alias("w"))
    counts = words.where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    found, totals, rare, _ = _frequent(counts, "w", ["c"], least)
    lengths = {r[0] for r in rare.select(F.length("w")).distinct().collect()} if rare is not None else set()
    return Lexicon(found, totals[0], tuple(sorted(lengths.union(map(len, found)))), rare)


def _frequent(counts: DataFrame, key: str, columns: list[str], least: float) -> tuple[dict, list[int], DataFrame | None, int]:
    """The rows with enough of the total of all columns, the totals of each column, a table of the other rows and the number of all."""
    counts = written(counts, key)
    each = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    *totals, rows = (int(x or 0) for x in counts.agg(*(F.sum(c) for c in columns), F.count(F.lit(1))).first())
    enough = (each >= least * max(1, sum(totals))) | (F.col(key) == "")  # the number of URLs stays
    kept = counts.where(enough).collect()
    found = {r[key]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in kept}
    return found, totals, counts.where(~enough) if len(found) < rows else None, rows


class Segmenter:
    """Unigram Viterbi over the words of a lexicon."""

    def __init__(self, counts: dict[str, int], total: int | None = None, lengths: tuple[int, ...] | None = None):
        total = max(1, sum(counts.values()) if total is None else total)
        self.total = total
        self.cost = {w: math.log(total) - math.log(c) for w, c in counts.items() if len(w) > 1}
        self.unknown = math.log(total) - math.log(10)
        self.lengths = sorted((set(map(len, counts)) if lengths is None else set(lengths)) - {1}, reverse=True)
        self.known: dict[str, list[str]] = {}

    def split(self, name: str, rare: dict[str, int] | None = None) -> list[str]:
        """Words of least total cost, with ``rare`` ones beside the lexicon's; of equal ones the one with the longer last word.

        A known word always costs less than an unknown one of its length, so the best unknown
        word that ends at a place is that of the least cost so far less its start's share.
        """
        more = {w: math.log(self.total) - math.log(c) for w, c in (rare or {}).items()}
        n, best, back, letter = len(name), [0.0], [0], math.log(10)
        start, least = 0, 0.0  # of the best unknown word
        for i in range(1, n + 1):
            low, at = least + self.unknown + i * letter, start
            for size in self.lengths:
                if size > i:
                    continue
                word = self.cost.get(name[i - size : i], more.get(name[i - size : i]))
                if word is not None and (best[i - size] + word < low or (best[i - size] + word == low and i - size < at)):
                    low, at = best[i - size] + word, i - size
            best.append(low)
            back.append(at)
            if low - i * letter < least:
                start, least = i, low - i * letter
        out, i = [], n
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]

    def words(self, host: str, runs: dict[str, list[str]] | None = None) -> list[str]:
        """Words of a whole host, in order; runs of digits are one word ``0``; ``runs`` are those that rare words split otherwise."""
        found = self.known.get(host)
        if found is None:
            found = [w for run in _RUNS.findall(host) for w in (["0"] if run[0].isdigit() else runs[run] if runs and run in runs else self.split(run))]
            if len(self.known) >= 50_000:
                self.known.clear()
            if len(host) <= 256:
                self.known[host] = found
        return found


def tokens(host_words: list[str], path: str) -> list[str]:
    """Features of one URL: words of the host, then those of the path, told apart by a prefix."""
    of_path = ("0" if run[0].isdigit() else run.lower() for run in _RUNS.findall(path))
    return [f"h:{w}" for w in host_words] + [f"p:{w}" for w in of_path]


@dataclass
class Model:
    """Lexicon and counts of the tokens in both classes."""

    words: dict[str, int]
    tokens: dict[str, tuple[float, float]] = field(default_factory=dict)
    totals: tuple[float, float] = (0, 0)
    documents: tuple[float, float] = (0, 0)
    smoothing: float = 1.0
    size: int = 0  #: number of tokens, rare ones with them
    total: int | None = None  #: occurrences of all words
    lengths: tuple[int, ...] | None = None  #: lengths of all words

    def scorer(self) -> Scorer:
        return Scorer(self)


@dataclass
class Fitted:
    """What tasks hold, and the tables of what they don't: splits (host, runs) that rare words change, rare tokens (token, allow, block); None if empty."""

    model: Model
    splits: DataFrame | None = None
    rare: DataFrame | None = None


class Scorer:
    def __init__(self, model: Model):
        self.segmenter = Segmenter(model.words, model.total, model.lengths)
        size = model.size + 1
        a = model.smoothing
        base = [math.log(t + a * size) for t in model.totals]
        self.unseen = base[ALLOW] - base[BLOCK]
        self.weight = {k: math.log(c[BLOCK] + a) - math.log(c[ALLOW] + a) + self.unseen for k, c in model.tokens.items()}
        n = model.documents
        self.prior = math.log(n[BLOCK] + a) - math.log(n[ALLOW] + a)

    def odds(self, found: list[str]) -> float:
        """Log odds of the blocked class by the tokens held here; others add theirs later, and those of no URL in training say nothing."""
        return self.prior + sum(self.weight.get(t, 0.0) for t in found)


def probability(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _urls(df: DataFrame, url: str) -> DataFrame:
    return df.select(host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))


def _splits(urls: DataFrame, words: Lexicon) -> DataFrame | None:
    """(host, runs) of the hosts with runs of letters that rare words split otherwise than the frequent ones alone."""
    if words.rare is None:
        return None
    shared = urls.sparkSession.sparkContext.broadcast((words.frequent, words.total, words.lengths))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, r) for h in batch.column("host").to_pylist() for r in sorted(set(_RUNS.findall(h))) if not r[0].isdigit()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in (0, 1)], names=["host", "run"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _, lengths = shared.value
        for batch in batches:
            for run in batch.column("run").to_pylist():
                subs = sorted({s for size in lengths if size > 1 for i in range(len(run) - size + 1) if (s := run[i : i + size]) not in frequent})
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(subs), pa.string()), pa.array(subs, pa.string())], names=["run", "w"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*shared.value)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                best = segmenter.split(row["run"], {x["w"]: x["c"] for x in row["x"]})
                if best != segmenter.split(row["run"]):
                    out.append((row["run"], best))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], names=["run", "words"])

    pairs = written(urls.select("host").distinct().mapInArrow(cut, "host string, run string"), "runs")
    near = pairs.select("run").distinct().mapInArrow(spread, "run string, w string").join(words.rare, "w")
    split = near.groupBy("run").agg(F.collect_list(F.struct("w", "c")).alias("x")).mapInArrow(solve, "run string, words array<string>")
    return written(pairs.join(split, "run").groupBy("host").agg(F.collect_list(F.struct("run", "words")).alias("runs")), "splits")


def _with_runs(rows: DataFrame, splits: DataFrame | None) -> DataFrame:
    """Adds the runs of ``splits``; null for hosts without any."""
    return rows if splits is None else rows.join(splits, "host", "left").select(*rows.columns, "runs")


def _hosts(batch: pa.RecordBatch) -> Iterator[tuple[str, str, dict[str, list[str]]]]:
    """(host, path, runs) of each row."""
    runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else [None] * batch.num_rows
    for host, path, found in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), runs, strict=True):
        yield host, path, {x["run"]: x["words"] for x in found or ()}


def fit(pages: DataFrame, words: Lexicon | dict[str, int], url: str = "url", seeds: tuple[str, ...] = SEEDS, least: float = MIN_SHARE, rounds: int = ROUNDS) -> Fitted:
    """Token counts over all URLs; each task sums its own before anything is shuffled."""
    if isinstance(words, dict):
        words = Lexicon(words, sum(words.values()), tuple(sorted(set(map(len, words)))))
    urls = _urls(pages, url)
    splits = _splits(urls, words)
    rows = _with_runs(urls, splits)
    if splits is not None and rounds:
        rows = written(rows, "urls")
    fitted = _counted(rows, words, seeds, least, None)
    for _ in range(rounds):
        last = Fitted(fitted.model, splits, fitted.rare)
        if fitted.rare is None:
            fitted = _counted(rows, words, seeds, least, last.model)
        else:
            judged = _judged(urls.select(F.lit(0).alias("rest"), "host", "path"), last, []).select("host", "path", "score")
            fitted = _counted(_with_runs(judged, splits), words, seeds, least, None)
    return Fitted(fitted.model, splits, fitted.rare)


def _counted(rows: DataFrame, words: Lexicon, seeds: tuple[str, ...], least: float, last: Model | None) -> Fitted:
    """Counts of one round, in parts of a URL; unlabelled URLs are shared out by a column ``score``, or by the ``last`` model, else they are allowed."""
    shared = rows.sparkSession.sparkContext.broadcast((words.frequent, words.total, words.lengths, last))  # at most 1 / MIN_SHARE words and tokens

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *lexicon, model = shared.value
        segmenter, held, marked = Segmenter(*lexicon), Counter(), set(seeds)
        scorer = model.scorer() if model else None

        def sent() -> pa.RecordBatch:
            names = sorted({t for t, _ in held})
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[t, k] for t in names], pa.int64()) for k in (ALLOW, BLOCK))], names=["token", "allow", "block"])
            held.clear()
            return out

        for batch in batches:
            scores = batch.column("score").to_pylist() if "score" in batch.schema.names else None
            for i, (host, path, runs) in enumerate(_hosts(batch)):
                found = segmenter.words(host, runs)
                names = tokens(found, path)
                if not marked.isdisjoint(found) or not marked.isdisjoint(_RUNS.findall(host)):
                    block = PARTS
                else:
                    block = round(PARTS * (scores[i] if scores else probability(scorer.odds(names)) if scorer else 0))
                for t in ("", *names):
                    held[t, BLOCK] += block
                    held[t, ALLOW] += PARTS - block
                if len(held) > 100_000:
                    yield sent()
        if held:
            yield sent()

    counts = rows.mapInArrow(count, "token string, allow long, block long").groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    found, totals, rare, size = _frequent(counts, "token", ["allow", "block"], least)
    n = found.pop("", (0, 0))  # the number of URLs
    whole = lambda c: (c[0] / PARTS, c[1] / PARTS)
    model = Model(words.frequent, {t: whole(c) for t, c in found.items()}, whole((totals[0] - n[0], totals[1] - n[1])), whole(n), size=size - (n != (0, 0)), total=words.total, lengths=words.lengths)
    return Fitted(model, None, rare)


def judge(pages: DataFrame, fitted: Fitted, order: list[Rule], url: str = "url") -> DataFrame:
    """Adds RESULT to every row: host, path, rule (or null), verdict, score of the classifier, words of the host."""
    own = [c for c in pages.columns if c not in RESULT]
    rows = pages.select(F.struct(*own).alias("rest"), host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))
    return _judged(rows, fitted, order).select(*(F.col("rest").getField(c).alias(c) for c in own), *RESULT)


def _judged(rows: DataFrame, fitted: Fitted, order: list[Rule]) -> DataFrame:
    """Rows (rest, host, path) with the rest of RESULT."""
    made = "rule string, verdict string, score double, host_words string"
    rare = fitted.rare
    if rare is not None:
        rows, made = rows.withColumn("row", F.monotonically_increasing_id()), made + ", rare array<string>"  # written below with all that is joined by it
    before, partial = rows.columns, rare is not None
    schema = StructType([*rows.schema, *StructType.fromDDL(made)])
    rows = _with_runs(rows, fitted.splits)
    shared = rows.sparkSession.sparkContext.broadcast(fitted.model)  # bounded: see MIN_SHARE
    by: dict[str, list[Rule]] = {}
    for r in sorted(order, key=lambda r: (-len(r.text), r.text)):
        by.setdefault(r.host, []).append(r)

    def rule_of(host: str, path: str) -> Rule | None:
        found, at = None, 0
        while True:  # the host itself, then each parent domain
            for r in by.get(host[at:], ()):
                if path.startswith(r.path):
                    if found is None or len(r.text) > len(found.text):
                        found = r
                    break
            at = host.find(".", at) + 1
            if not at:
                return found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for host, path, runs in _hosts(batch):
                words = scorer.segmenter.words(host, runs)
                found = tokens(words, path)
                odds = scorer.odds(found)
                score = probability(odds)
                rule = rule_of(host, path)
                left = [t for t in found if t not in scorer.weight] if partial else None
                for k, v in enumerate((rule and rule.text, rule.verdict if rule else VERDICTS[score >= 0.5], odds if partial else score, " ".join(words), left)):
                    out[k].append(v)
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string()))
            results = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in before), *results[: 5 if partial else 4]], names=schema.names)

    done = rows.mapInArrow(read, schema)
    if rare is None:
        return done
    scorer = fitted.model.scorer()
    done = written(done, "judged")
    a = fitted.model.smoothing
    weights = rare.select("token", (F.log(F.col("block") / PARTS + a) - F.log(F.col("allow") / PARTS + a) + F.lit(scorer.unseen)).alias("w"))
    hits = done.select("row", F.explode("rare").alias("token")).join(weights, "token")
    # Sorted, so that the last digit doesn't depend on the order of rows.
    sums = hits.groupBy("row").agg(F.aggregate(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda x, y: x + y).alias("more"))
    odds = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("score") + F.coalesce("more", F.lit(0.0))))
    whole = done.join(sums, "row", "left").withColumn("score", 1 / (1 + F.exp(-odds)))
    by_score = F.when(F.col("score") >= 0.5, VERDICTS[BLOCK]).otherwise(VERDICTS[ALLOW])
    return whole.withColumn("verdict", F.when(F.col("rule").isNull(), by_score).otherwise(F.col("verdict")))
