"""Quality rules: fixed base rules, then robust multivariate outliers.

Per language and source a minimum-covariance-determinant estimate of centre and
scatter is fitted to transformed statistics of the documents that pass the base
rules, and documents far from it by Mahalanobis distance are rejected.

The search is distributed. Each group begins from four robust or plain starts; a
concentration step takes the CORE of its rows that is nearest to the current
estimate and their mean and covariance as the next one. After TRIALS steps the
start with the least determinant goes on, and steps are taken until its determinant
stops falling. The rows near to the result by the usual quantile give the reweighted
estimate. The same is done per language and for the whole table, and each group's
estimate is shrunk towards its language's, and that towards the table's, as if these
were PRIOR_ROWS rows of its own: a large group keeps its own, a group of one row has
its language's, and every document is judged by one rule at every size.

A step is one aggregation: rows are binned by distance, counts and moments are summed
per (group, bin) as integers, so that reruns agree, and of the bin that the core ends
in its share is taken. Nothing is sampled, and a group's task sees its bins (a few
hundred at most), never its rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.tables import drop, fresh, materialise
from tarnfield.llm.text import SPACES, as_bytes, code_points

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group's rows that an estimate rests on, steps with all starts, and most steps in all.
CORE, TRIALS, MOST_STEPS = 0.75, 2, 30
#: Fall of the log determinant below which a search ends.
LEAST_FALL = 1e-3
#: Share of a normal's rows that the reweighted estimate rests on.
NEAR = 0.975
#: Rows that a language counts for in its groups' estimates, and the table in its languages'.
PRIOR_ROWS = 100
#: Squared distance beyond which a document goes, set between the clean and the junk
#: documents of the labels tables (figures in the README): shares of repeats have long
#: tails among the clean, so that a quantile of chi2 with 5 degrees would reject them.
CUTOFF = 40.0
#: Least standard deviation of each variable: log word length, then square roots
#: of the symbols', repeated lines' and repeated words' shares, then log words.
#: Most clean texts repeat nothing, so these stand in for a scatter of 0; each share
#: can exceed CUTOFF by itself (0.4 repeated lines or words, 0.036 symbols).
FLOORS = (0.06, 0.03, 0.1, 0.1, 0.2)
#: Estimates that may be broadcast (at 200 bytes each, 2 MB).
BROADCAST_GROUPS = 10_000
SALTS = 64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = tuple(f"v{i}" for i in range(5))
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
#: Statistics are whole numbers of this part; products are summed in two parts of SPLIT bits.
UNIT, SPLIT = 1e-6, 20
#: Fixed grids for the start's medians and quartiles.
_GRID = ((-1.0, 9.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 20.0))
_CELLS = 1000


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = upto = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def text_statistics(raw: bytes | None) -> tuple:
    """BASE and VECTOR of one text."""
    raw = raw or b""
    words = raw.split()
    n_words, word_chars = len(words), code_points(raw, SPACES)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    vector = (
        np.log((word_chars + 5.0) / (n_words + 1.0)),
        np.sqrt(n_symbols / (word_chars + 20.0)),
        np.sqrt(n_dup_lines / (len(lines) + 4.0)),
        np.sqrt(n_repeat / (n_words + 20.0)),
        np.log(n_words + 1.0),
    )
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, *(round(float(x), 6) for x in vector))


def with_statistics(df: DataFrame, text_col: str, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` columns of ``df`` with the statistics behind them, and the names these have got."""
    wanted = [*BASE, *VECTOR]
    named = dict(zip(wanted, fresh(wanted, keep)))
    at_text, text = len(keep), fresh(["text_in"], [*keep, *named.values()])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(raw) for raw in as_bytes(batch.column(at_text))]
            cols = list(zip(*rows)) or [()] * len(wanted)
            new = [pa.array(c, pa.int64() if k < len(BASE) else pa.float64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_text], *new], names=[*keep, *named.values()])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    kinds += [f"`{named[c]}` {'long' if c in BASE else 'double'}" for c in wanted]
    slim = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias(text))
    return slim.mapInArrow(run, ", ".join(kinds)), named


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (F.lit(100) * n_repeat > F.lit(MAX_REPEAT_PERCENT) * n_words)


def attach(rows: DataFrame, params: DataFrame, n_groups: int, keys: tuple[str, ...], vector: list[str] = VECTOR) -> tuple[DataFrame, str]:
    """Left join of the groups' estimates, as one struct column whose name is returned.

    ``keys`` name the columns of ``rows`` that stand for those of _KEY that ``params`` has.
    Few groups are broadcast; beyond BROADCAST_GROUPS both sides are salted, so that
    no group meets one task."""
    theirs = [c for c in _KEY if c in params.columns]
    own, salt, salt_to, *g_keys = fresh(["group", "salt", "salt_to", *(f"g_{c}" for c in theirs)], rows.columns)
    params = params.select(*(F.col(c).alias(g) for c, g in zip(theirs, g_keys)), F.struct(*(c for c in params.columns if c not in _KEY)).alias(own))
    on = F.lit(True)
    for c, g in zip(keys, g_keys):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(g))
    if n_groups <= BROADCAST_GROUPS:
        params = F.broadcast(params)
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(*vector), F.lit(SALTS)))
        params = params.withColumn(salt_to, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = on & (F.col(salt) == F.col(salt_to))
    return rows.join(params, on, "left").drop(*g_keys, salt, salt_to), own


def squared_distance(group: str, names: list[str] = VECTOR) -> Column:
    d = [F.col(c) - F.col(f"{group}.m{i}") for i, c in enumerate(names)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + d[i] * d[j] * F.col(f"{group}.a{i}{j}") * (1.0 if i == j else 2.0)
    return total


#: Level 0 is (lang, source), 1 a language (source is null), 2 the table (both are null).
_KEY = ("level", "lang", "source")
_PARAM = [*(f"m{i}" for i in range(5)), *(f"a{i}{j}" for i, j in _PAIRS)]
_PARAM_SCHEMA = "level int, lang string, source string, start int, n_fit long, logdet double, " + ", ".join(f"{c} double" for c in _PARAM)


_SUMS = [*(f"s{i}" for i in range(5)), *(f"{x}{i}{j}" for i, j in _PAIRS for x in "hl")]


def chi2_share(x: float, degrees: int) -> float:
    """P(chi2 <= x) for an odd number of degrees."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, degrees, 2):
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return out


def chi2_quantile(share: float, degrees: int) -> float:
    lo, hi = 0.0, 200.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_share(mid, degrees) < share else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of a normal's nearest ``share`` is multiplied by to be that of all."""
    return share / chi2_share(chi2_quantile(share, 5), 7)


def _table(keys: pd.DataFrame, start: np.ndarray | int, n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Estimates of many groups: the covariances, their floors added, as inverses and log determinants."""
    lifted = cov + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(lifted)
    out = keys[list(_KEY)].reset_index(drop=True)
    out["start"], out["n_fit"], out["logdet"] = start, np.asarray(n, np.int64), np.round(np.linalg.slogdet(lifted)[1], 9)
    for i in range(5):
        out[f"m{i}"] = np.round(mean[:, i], 9)
    for i, j in _PAIRS:
        out[f"a{i}{j}"] = [float(f"{v:.9e}") for v in inverse[:, i, j]]
    return out


def moment_sums(columns: str = "q", name: str = "") -> list[Column]:
    """Exact sums of five columns of whole numbers and of their products."""
    out = [F.sum(f"{columns}{i}").alias(f"{name}s{i}") for i in range(5)]
    for i, j in _PAIRS:
        product = F.col(f"{columns}{i}") * F.col(f"{columns}{j}")
        out += [F.sum(F.shiftright(product, SPLIT)).alias(f"{name}h{i}{j}"), F.sum(product.bitwiseAND(F.lit((1 << SPLIT) - 1))).alias(f"{name}l{i}{j}")]
    return out


def moments(pdf: pd.DataFrame, parts: dict[str, np.ndarray | float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and covariances of many groups from the sums under each prefix of ``parts``, weighted."""
    def total(name: str) -> np.ndarray:
        return sum(pdf[f"{p}{name}"].to_numpy(np.float64) * w for p, w in parts.items())

    n = total("n")
    mean = np.stack([total(f"s{i}") for i in range(5)], axis=1) / n[:, None] * UNIT
    cov = np.zeros((len(pdf), 5, 5))
    for i, j in _PAIRS:
        square = (total(f"h{i}{j}") * 2.0**SPLIT + total(f"l{i}{j}")) / n * UNIT**2
        cov[:, i, j] = cov[:, j, i] = square - mean[:, i] * mean[:, j]
    return n, mean, cov


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Medians, and quartile ranges as diagonal scatters, from the quartiles' cells."""
    for pdf in batches:
        width = np.array([(hi - lo) / _CELLS for lo, hi in _GRID])
        low, mid, high = (pdf[[f"{q}{i}" for i in range(5)]].to_numpy(np.float64) for q in "abc")
        sd = (high - low) * width / 1.349
        yield _table(pdf, 0, pdf["n"], np.array([lo for lo, _ in _GRID]) + (mid + 0.5) * width, sd[:, :, None] ** 2 * np.eye(5))


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Four starts of each group: its medians with the diagonal scatter, with the
    correlation of hyperbolic tangents, and with that of the spatial signs, and the
    plain moments of all its rows."""
    for pdf in batches:
        centre = pdf[[f"m{i}" for i in range(5)]].to_numpy(np.float64)
        scale = pdf[[f"a{i}{i}" for i in range(5)]].to_numpy(np.float64) ** -0.5
        n, mean, cov = moments(pdf, {"": 1.0})
        out = [_table(pdf, 0, n, centre, (scale**2 - np.square(FLOORS))[:, :, None] * np.eye(5)), _table(pdf, 3, n, mean, cov)]
        for k, name in ((1, "t"), (2, "u")):
            _, _, cov = moments(pdf.rename(columns={"n": f"{name}n"}), {name: 1.0})
            sd = np.sqrt(np.maximum(np.einsum("gii->gi", cov), 1e-12))
            out.append(_table(pdf, k, n, centre, cov * (scale / sd)[:, :, None] * (scale / sd)[:, None, :]))
        yield pd.concat(out)


def _next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The moments of the nearest CORE of the rows; of the bin that it ends in, its share."""
    for pdf in batches:
        _, mean, cov = moments(pdf, {"f_": 1.0, "e_": pdf["share"].to_numpy(np.float64)})
        yield _table(pdf, pdf["start"].to_numpy(), pdf["n"], mean, consistency(CORE) * cov)


def _reweighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and covariance of the rows near the estimate, which _blend shrinks."""
    for pdf in batches:
        n, mean, cov = moments(pdf, {"": 1.0})
        out = pdf[list(_KEY)].reset_index(drop=True)
        out["n_fit"] = n.astype(np.int64)
        for i in range(5):
            out[f"m{i}"] = mean[:, i]
        for i, j in _PAIRS:
            out[f"a{i}{j}"] = consistency(NEAR) * cov[:, i, j]
        yield out


def _blend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's estimate: the table's, moved towards its language's and then its own."""
    for pdf in batches:
        means, covs, counts = [], [], []
        for r in pdf.itertuples():
            mean = cov = None
            for own in (r.own2, r.own1, r.own0):
                if own is None:
                    continue
                n, m = own["n_fit"], np.array([own[f"m{i}"] for i in range(5)])
                c = np.zeros((5, 5))
                for i, j in _PAIRS:
                    c[i, j] = c[j, i] = own[f"a{i}{j}"]
                if mean is not None:  # scatters are within groups only, or a lone outlier would hide itself
                    m, c = ((n * x + PRIOR_ROWS * y) / (n + PRIOR_ROWS) for x, y in ((m, mean), (c, cov)))
                mean, cov = m, c
            means.append(mean)
            covs.append(cov)
            counts.append(r.own0["n_fit"] if r.own0 is not None else 0)
        if means:
            yield _table(pdf.assign(level=0), 0, np.array(counts), np.array(means), np.array(covs))


def levels(df: DataFrame, keep: list[str]) -> DataFrame:
    """Each row once for each level that it counts in, with _KEY and ``keep``."""
    none = F.lit(None).cast("string")
    keys = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, none)]
    each = F.array(*(F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, lang, source in keys))
    return df.select(F.explode(each).alias("key"), *keep).select("key.*", *keep)


def resolved(stats: DataFrame, params: DataFrame) -> DataFrame:
    """One estimate for each (lang, source) of ``stats``; none if no row passed."""
    groups = stats.select("lang", "source").distinct()
    packed = params.select(*_KEY, F.struct(*(c for c in params.columns if c not in _KEY)).alias("own"))
    group, lang, table = (packed.filter(F.col("level") == k).select(F.col("lang").alias(f"lang{k}"), F.col("source").alias(f"source{k}"), F.col("own").alias(f"own{k}")) for k in range(3))
    out = groups.join(group, F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
    out = out.join(lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(table))  # the table's is one row
    return out.select("lang", "source", "own0", "own1", "own2").mapInPandas(_blend, _PARAM_SCHEMA)


def whole(value: Column) -> Column:
    return F.round(value / UNIT).cast("long")


def concentrate(each: DataFrame, params: DataFrame, n_params: int) -> DataFrame:
    """One concentration step of every estimate of ``params``."""
    near, own = attach(each, params, n_params, _KEY)
    near = near.filter(F.col(own).isNotNull())
    near = near.withColumn("bin", F.floor(16 * F.log2(F.greatest(squared_distance(own), F.lit(1e-3)))).cast("int"))
    binned = near.groupBy(*_KEY, F.col(f"{own}.start").alias("start"), "bin").agg(F.count(F.lit(1)).alias("n"), *moment_sums())
    group = Window.partitionBy(*_KEY, "start")
    binned = binned.withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n")).withColumn("core", F.ceil(CORE * F.sum("n").over(group)))
    full, edge = F.col("before") + F.col("n") <= F.col("core"), (F.col("before") < F.col("core")) & (F.col("before") + F.col("n") > F.col("core"))
    sums = [F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).alias(f"{name}{c}") for name, here in (("f_", full), ("e_", edge)) for c in ("n", *_SUMS)]
    share = F.coalesce(F.max(F.when(edge, (F.col("core") - F.col("before")) / F.col("n"))), F.lit(0.0))
    return binned.groupBy(*_KEY, "start").agg(F.sum("n").alias("n"), share.alias("share"), *sums).mapInPandas(_next, _PARAM_SCHEMA)


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """An estimate for each (lang, source), and how many; none where no row passes the base rules.

    ``stats`` has lang, source, BASE and VECTOR, and is read once for each step.
    """
    rows = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("lang", "source", *VECTOR, *(whole(F.col(v)).alias(f"q{i}") for i, v in enumerate(VECTOR)))
    cells = [F.struct(F.lit(i).alias("dim"), F.greatest(F.lit(0), F.least(F.lit(_CELLS - 1), F.floor((F.col(f"v{i}") - lo) / ((hi - lo) / _CELLS)))).cast("int").alias("cell")) for i, (lo, hi) in enumerate(_GRID)]
    hist = rows.select("lang", "source", F.explode(F.array(*cells)).alias("x")).groupBy("lang", "source", "x.dim", "x.cell").agg(F.count(F.lit(1)).alias("n"))
    hist = levels(hist, ["dim", "cell", "n"]).groupBy(*_KEY, "dim", "cell").agg(F.sum("n").alias("n"))
    column = Window.partitionBy(*_KEY, "dim")
    hist = hist.withColumn("upto", F.sum("n").over(column.orderBy("cell"))).withColumn("all", F.sum("n").over(column))
    quartiles = [F.min(F.when((F.col("dim") == i) & (F.col("upto") >= F.ceil(F.col("all") * p)), F.col("cell"))).alias(f"{q}{i}") for i in range(5) for q, p in zip("abc", (0.25, 0.5, 0.75))]
    middle = materialise(hist.groupBy(*_KEY).agg(F.max("all").alias("n"), *quartiles).mapInPandas(_first, _PARAM_SCHEMA))
    n_groups = middle.count()
    each = levels(rows, [*VECTOR, *(f"q{i}" for i in range(5))])

    # all starts, of which the one with the least determinant goes on
    near, own = attach(each, middle, n_groups, _KEY)
    near = near.withColumns({f"z{i}": (F.col(v) - F.col(f"{own}.m{i}")) * F.sqrt(f"{own}.a{i}{i}") for i, v in enumerate(VECTOR)})
    near = near.withColumn("length", F.greatest(F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(5))), F.lit(1e-9)))
    near = near.withColumns({f"t{i}": whole(F.tanh(f"z{i}")) for i in range(5)} | {f"u{i}": whole(F.col(f"z{i}") / F.col("length")) for i in range(5)})
    sums = moment_sums() + moment_sums("t", "t") + moment_sums("u", "u")
    firsts = [F.first(f"{own}.{c}").alias(c) for c in _PARAM]
    begun = near.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), *firsts, *sums)
    params = materialise(begun.mapInPandas(_starts, _PARAM_SCHEMA))
    drop(middle)
    for _ in range(TRIALS):
        last, params = params, materialise(concentrate(each, params, 4 * n_groups))
        drop(last)
    columns = [c for c in params.columns if c not in _KEY]
    least = params.groupBy(*_KEY).agg(F.min(F.struct("logdet", *(c for c in columns if c != "logdet"))).alias("p"))
    last, params = params, materialise(least.select(*_KEY, *(F.col(f"p.{c}") for c in columns)).withColumn("done", F.lit(False)))
    drop(last)

    # until determinants stop falling
    for _ in range(MOST_STEPS - TRIALS):
        moving = params.filter("not done").drop("done")
        n_moving = moving.count()
        if not n_moving:
            break
        step = concentrate(each, moving, n_moving)
        step = step.select(*(F.col(c).alias(f"n_{c}") for c in _KEY), F.struct(*columns).alias("new"))
        both = params.join(step, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in _KEY], "left")
        falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - LEAST_FALL, F.lit(False))
        both = both.select(*_KEY, *(F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns), (~falls).alias("done"))
        last, params = params, materialise(both)
        drop(last)

    near, own = attach(each, params.drop("done"), n_groups, _KEY)
    near = near.filter(squared_distance(own) <= chi2_quantile(NEAR, 5))
    summed = near.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), *moment_sums())
    kind = "level int, lang string, source string, n_fit long, " + ", ".join(f"{c} double" for c in _PARAM)
    out = materialise(resolved(stats, summed.mapInPandas(_reweighted, kind)).drop("level", "start", "logdet"))
    drop(params)
    return out, out.count()


def judged(rows: DataFrame, params: DataFrame, n_groups: int, lang: str = "lang", source: str = "source", named: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with base_failed, distance (null: no row of the table passes the base rules) and kept."""
    named = named or {c: c for c in (*BASE, *VECTOR)}
    vector = [named[c] for c in VECTOR]
    failed = base_failed(F.col(named["n_words"]), F.col(named["n_repeat_words"]))
    out, group = attach(rows, params, n_groups, (lang, source), vector)
    distance = F.when(F.col(group).isNotNull(), F.sqrt(F.greatest(squared_distance(group, vector), F.lit(0.0))))
    far = F.coalesce(distance > CUTOFF**0.5, F.lit(False))
    new = fresh(["base_failed", "distance", "kept"], rows.columns)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), failed.alias(new[0]), F.round(distance, 6).alias(new[1]), (~failed & ~far).alias(new[2]))


def quality_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, BASE, base_failed, distance, kept.

    A null text has no words and fails. Null languages and sources form groups of
    their own. Every document has a distance, if any of the table passes. Repeated rows are judged each (and counted each in the fit); an
    empty table gives an empty result; further columns are ignored.
    """
    stats, _ = with_statistics(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), "text", ["doc_id", "lang", "source"])
    stats = materialise(stats)
    params, n_groups = fit(stats)
    return judged(stats, params, n_groups).select("doc_id", *BASE, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns as they are.

    The statistics are computed twice (once to fit, once beside the text), which
    costs less than moving every text through a join."""
    stats, _ = with_statistics(docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), "text", ["lang", "source"])
    slim = materialise(stats)
    params, n_groups = fit(slim)
    whole, named = with_statistics(docs, "text", docs.columns)
    out = judged(whole, params, n_groups, named=named)
    return out.filter(F.col(out.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
