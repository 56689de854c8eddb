"""Soft-membership mixing to target weights; DataFrame operations only.

1. A naive Bayes classifier over words and runs of marks in ``2**BITS`` hashed buckets is fitted on a bounded number of rows of a
   labelled table. It counts rows that have a word, not the word's occurrences, and uses only words whose
   share of a domain's rows is far from that domain's share of all different words by row (``least_z`` standard deviations).
   Without that choice the many words that tell nothing outweigh the few that do. Words come at a rate per
   different word of a text (a Poisson model), so that a telling word says less in a long text, where one is to be expected.
   The evidence is then calibrated: on labelled rows that its counts are not from, a multinomial logistic regression from the
   classifier's scores to the domains is fitted by Newton steps. Uncalibrated, a text without any telling word keeps much of the
   other domains' mass, and their targets can't be met.
2. Every row gets a posterior over the domains.
3. Document rates r >= 0 minimise (S(r) - T)' M (S(r) - T), where S_d(r) = sum of r * tokens * posterior_d over
   all rows, T_d = weight_d * all tokens and M is the inverse of the Gram matrix of the posteriors, so that
   correlated domains don't slow the descent. Accelerated projected gradient steps start from r = 1 and are scaled by
   each row's tokens (a diagonal metric, in which the projection is still max(0, .)); in that metric the
   largest eigenvalue is one, and so is the step. A step needs only the D totals S_d, which Spark
   aggregates; a row's rate is a fold over the steps' D-vectors, so no table is rewritten between steps.
4. A row is then repeated floor(rate) times, and once more with the rest as probability (by a hash of its id).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import durable

BITS = 16


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _buckets(text: Column) -> Column:
    """Hash buckets of a text's features: runs of letters and digits, and runs of other marks."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << BITS)).cast("int"))


def _constant(values: list, kind: str) -> Column:
    """An array literal of a bounded list."""
    return F.expr(f"cast(array({', '.join(f'{v}D' if isinstance(v, float) else str(v) for v in values)}) as array<{kind}>)")


@dataclass
class DomainModel:
    """Domains in order, log priors, the buckets in use, their log-likelihood ratios by domain, and what each different word of
    a text takes off by domain: how many more of these features a domain has a word than all rows have. ``calibration``
    has a row a domain: its coefficients of the scores of all domains, of the logarithm of 1 and the number of different words, and a constant."""

    domains: list[str]
    prior: list[float]
    buckets: list[int]
    weights: list[list[float]]
    per_word: list[float]
    calibration: list[list[float]] | None = None


def fit_domains(docs: DataFrame, labelled: DataFrame, domain: str = "domain", text: str = "text", id_col: str = "doc_id", fit_rows: int = 10_000, most_words: int = 2000, least_z: float = 6.0, least_rows: int = 5, shrink: float = 10.0) -> DomainModel:
    """Counts of rows by word and domain over at most ``fit_rows`` labelled rows (those with the least hash
    of their id). Rows with a null id or domain are not used; an id with two domains counts for the first.

    A word is used if at least ``least_rows`` rows have it and a domain's count of it is ``least_z`` standard
    deviations off what its share of all words lets expect; at most ``most_words`` are, those furthest off. Counts are shrunk
    to the domains' shares as if ``shrink`` more rows had the word. Both bounds, of rows and of words, hold the model's size; texts are read whole.
    A third of the rows, by hash, is for the calibration alone: its scores, a few numbers a row, go to the driver."""
    chosen = labelled.select(F.col(id_col).alias("__id"), F.col(domain).cast("string").alias("__domain")).dropna().groupBy("__id").agg(F.min("__domain").alias("__domain"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    apart = F.pmod(F.xxhash64(F.lit(31), "__id"), F.lit(3)) == 0
    every = durable(rows.select("__domain", apart.alias("__apart"), F.array_distinct(_buckets(F.col("__text"))).alias("__b")).withColumn("__n", F.size("__b")))
    rows = every.where("not __apart")
    counted = rows.groupBy("__domain").agg(F.count(F.lit(1)).alias("rows"), F.sum("__n").alias("n")).orderBy("__domain").collect()  # one row a domain
    total = sum(r["n"] for r in counted)
    names, prior = [r["__domain"] for r in counted], [float(np.log(r["rows"] / sum(x["rows"] for x in counted))) for r in counted]
    share = [max(r["n"], 1) / max(total, 1) for r in counted]
    if len(names) < 2:
        return DomainModel(names, [0.0] * len(names), [], [[] for _ in names], [0.0] * len(names))
    counts = rows.select("__domain", F.explode("__b").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("__domain") == d).alias(f"c{k}") for k, d in enumerate(names)))
    off = F.greatest(*(F.abs(F.col(f"c{k}") - F.col("n") * q) / F.sqrt(F.col("n") * q * (1 - q)) for k, q in enumerate(share)))
    told = counts.where(F.col("n") >= least_rows).withColumn("off", off).where(F.col("off") >= least_z)
    weight = [F.log((F.col(f"c{k}") + shrink * q) / (F.col("n") + shrink) / q).alias(f"w{k}") for k, q in enumerate(share)]
    table = told.select("bucket", "n", "off", *weight).orderBy(F.desc("off"), "bucket").limit(most_words).collect()
    per_word = [float(sum(r["n"] * np.expm1(r[f"w{k}"]) for r in table)) / max(total, 1) for k in range(len(names))]
    model = DomainModel(names, prior, [r["bucket"] for r in table], [[round(r[f"w{k}"], 6) for r in table] for k in range(len(names))], per_word)
    held = every.where("__apart and __n > 0").select("__domain", F.monotonically_increasing_id().alias("__row"), F.lit(1).cast("long").alias("__n"), F.col("__b").alias("__own"))
    told = _scores(held, model, ["__row", "__domain"]).where(F.col("__domain").isin(names)).collect()  # fit_rows at most
    if told:
        features = np.array([[r[f"__s{k}"] - r["__u"] * per_word[k] for k in range(len(names))] + [np.log1p(r["__u"])] for r in told])
        model.calibration = calibrated(features, np.array([names.index(r["__domain"]) for r in told]), prior).tolist()
    return model


def calibrated(features: np.ndarray, domain: np.ndarray, prior: list[float], ridge: float = 0.1, most_steps: int = 50) -> np.ndarray:
    """Coefficients by domain of the features and a constant: a multinomial logistic regression with ridge (on features scaled to one), which
    starts from the priors and takes Newton steps, halved where they don't help."""
    n, d = len(features), len(prior)
    scale = np.maximum(np.abs(features).max(axis=0), 1e-9)
    x, y = np.c_[features / scale, np.ones(n)], np.eye(d)[domain]
    pull = np.append(np.full(x.shape[1] - 1, ridge / n), 1e-6)
    w = np.zeros((d, x.shape[1]))
    w[:, -1] = prior

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w.T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return -float(np.log(np.maximum((p * y).sum(axis=1), 1e-300)).mean()) + float((pull * w**2).sum()) / 2, p

    now, p = loss(w)
    for _ in range(most_steps):
        slope = (p - y).T @ x / n + pull * w
        curve = np.einsum("na,nkl,nb->kalb", x, p[:, :, None] * (np.eye(d) - p[:, None, :]), x, optimize=True) / n
        step = np.linalg.solve(curve.reshape(w.size, w.size) + np.diag(np.tile(pull, d)) + 1e-9 * np.eye(w.size), slope.ravel()).reshape(w.shape)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step))[0] > now:
            size /= 2
        if size <= 1e-6 or now - new[0] < 1e-9:
            break
        w, (now, p) = w - size * step, new
    return np.c_[w[:, :-1] / scale, w[:, -1]]


def _scores(rows: DataFrame, model: DomainModel, row_key: list[str]) -> DataFrame:
    """``row_key``, tokens, __u (different features) and __s0, ... (sums of the telling words' weights) of rows with __n and __own.

    A row's weights are added up where it is read, from literals of ``most_words`` values at most: no row is made for a word."""
    buckets = _constant(model.buckets, "int")
    told = rows.select(*row_key, "__n", F.size("__own").alias("__u"), F.array_intersect("__own", buckets).alias("__told"))
    told = told.select(*row_key, "__n", "__u", F.transform("__told", lambda b: F.array_position(buckets, b).cast("int")).alias("__at"))
    own = lambda w: F.aggregate("__at", F.lit(0.0), lambda done, k: done + F.element_at(_constant(w, "double"), k))
    sums = told.select(*row_key, "__n", "__u", *(own(w).alias(f"__s{k}") for k, w in enumerate(model.weights)))
    return sums.groupBy(*row_key).agg(F.sum("__n").alias("tokens"), F.sum("__u").alias("__u"), *(F.sum(f"__s{k}").alias(f"__s{k}") for k in range(len(model.domains)))).where("tokens > 0")


def posteriors(docs: DataFrame, model: DomainModel, row_key: list[str], text: str = "text") -> DataFrame:
    """``row_key``, ``tokens`` (words) and ``posterior`` (array over the model's domains) by distinct row key.

    A text without telling words has the prior. Evidence is summed up where the text is read; only a few
    numbers for each row are shuffled."""
    d = len(model.domains)
    own = F.array_distinct(_buckets(F.col(text)))
    sums = _scores(docs.select(*row_key, F.size(_words(F.col(text))).cast("long").alias("__n"), own.alias("__own")), model, row_key)
    score = [F.col(f"__s{k}") - F.col("__u") * F.lit(model.per_word[k]) for k in range(d)]
    if model.calibration:
        logit = [sum((F.lit(c) * x for c, x in zip(w, [*score, F.log1p("__u")])), F.lit(w[-1])) for w in model.calibration]
    else:
        logit = [s + F.lit(model.prior[k]) for k, s in enumerate(score)]
    top = F.greatest(*logit) if d > 1 else logit[0]
    odds = [F.exp(x - top) for x in logit]
    return sums.select(*row_key, "tokens", F.array(*(o / sum(odds[1:], odds[0]) for o in odds)).alias("posterior"))


def momentum(step: int) -> float:
    """How far a step goes on in the direction of the last one, by the step's number from 0, counted anew whenever the totals get further off."""
    return max(0.0, (step - 1) / (step + 2))


def rates(steps: list[np.ndarray]) -> Column:
    """The accelerated projected-gradient fold, from r = 1: y = r + m * (r - last r), r = max(0, y - step . posterior).
    A step holds a number for each domain and its momentum m. struct<r, y>: the rate, and the point from which the next step goes."""
    begin = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return begin
    d = len(steps[0]) - 1
    history = F.from_json(F.lit(str([[float(v) for v in s] for s in steps])), "array<array<double>>")

    def fold(state: Column, s: Column) -> Column:
        parts = [s[k] * F.col("posterior")[k] for k in range(d)]
        r = F.greatest(F.lit(0.0), state["y"] - sum(parts[1:], parts[0]))
        return F.struct(r.alias("r"), (r + s[d] * (r - state["r"])).alias("y"))

    return F.aggregate(history, begin, fold)


def rate(steps: list[np.ndarray]) -> Column:
    return rates(steps)["r"]


@dataclass
class Outcome:
    """The totals reached as shares of all tokens; how the steps ended; how far off the totals are (in the metric), and a bound
    that no rates of zero or more get below: above zero, it proves the targets out of reach."""

    reached: np.ndarray
    ended: str
    off: float = 0.0
    least_off: float = 0.0


def fit_rates(members: DataFrame, targets: list[float], most_steps: int = 40, tolerance: float = 1e-3) -> tuple[list[np.ndarray], Outcome]:
    """The steps whose fold gives each row's rate, and their outcome: ``on target``, every domain's share within ``tolerance`` of
    its target; ``out of reach``, proven so, after ``most_steps`` or as soon as no more than a twentieth could be gained; or ``unsettled`` after ``most_steps``.

    The proof is a vector v with v . posterior >= 0 for all rows and v . target < 0: totals are sums of posteriors times rates of
    zero or more, so none can be the target. Each step's slope gives such a vector, raised by the least of its products with a posterior."""
    d, t = len(targets), F.col("tokens").cast("double")
    goal = np.array(targets, float) / sum(targets)
    p = [F.col("posterior")[k] for k in range(d)]
    gram = members.agg(F.sum(t).alias("all"), *(F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d))).first()
    total = gram["all"] or 0.0
    if not total:
        return [], Outcome(goal, "on target")
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / total + np.eye(d) * 1e-6
    metric = np.linalg.inv(g)
    steps: list[np.ndarray] = []
    slope, since, last, least_off = np.zeros(d), 0, np.inf, 0.0
    while True:
        state = members.select(rates(steps).alias("__s"), t.alias("__t"), *(p[k].alias(f"__p{k}") for k in range(d)))
        product = sum((F.lit(float(slope[k])) * F.col(f"__p{k}") for k in range(d)), F.lit(0.0))
        sums = state.agg(*(F.sum(F.col(f"__s.{x}") * F.col("__t") * F.col(f"__p{k}")).alias(f"{x}{k}") for x in "ry" for k in range(d)), F.min(product).alias("least")).first()
        reached, ahead = (np.array([sums[f"{x}{k}"] for k in range(d)]) / total for x in "ry")
        gap = float((reached - goal) @ metric @ (reached - goal))
        proof = slope + max(0.0, -sums["least"])  # posteriors add up to one
        if proof.any():
            least_off = max(least_off, float(-(goal @ proof) / np.sqrt(proof @ g @ proof)))
        near = np.abs(reached - goal).max() <= tolerance
        if near or len(steps) >= most_steps or 0 < gap**0.5 <= 1.05 * least_off:
            return steps, Outcome(reached, "on target" if near else "out of reach" if least_off > 0 else "unsettled", gap**0.5, least_off)
        if gap > last:  # too far: go on from here without momentum
            steps[-1][d], since, ahead = 0.0, 0, reached
        slope, since, last = metric @ (reached - goal), since + 1, gap
        steps.append(np.append(metric @ (ahead - goal), momentum(since)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], row_key: tuple[str, ...] = ("doc_id",), text: str = "text", id_col: str = "doc_id", **fit: float) -> DataFrame:
    """One row for each distinct row key that has words: the key, tokens, posterior (map by domain), rate, and the same in
    all rows, ``reached`` (the expected share of all tokens by domain under the rates), ``on_target`` and ``ended`` (see ``fit_rates``).

    ``targets`` are weights by domain; a domain without a target has weight 0, targets of domains that no
    labelled row has are left out and the others rescaled. Rows without words are not in the result (their
    rate has no effect on totals). With no usable labels every rate is 1 and the posterior is empty."""
    model = fit_domains(docs, labelled, text=text, id_col=id_col, **fit)
    key = list(row_key)
    if not model.domains or not sum(targets.get(n, 0) for n in model.domains):
        words = docs.select(*key, F.size(_words(F.col(text))).cast("long").alias("__n")).where("__n > 0")
        return words.groupBy(*key).agg(F.sum("__n").alias("tokens")).select(*key, "tokens", F.expr("cast(map() as map<string,double>)").alias("posterior"), F.lit(1.0).alias("rate"), F.expr("cast(map() as map<string,double>)").alias("reached"), F.lit(False).alias("on_target"), F.lit("no domains").alias("ended"))
    members = durable(posteriors(docs, model, key, text))
    steps, found = fit_rates(members, [float(targets.get(n, 0)) for n in model.domains])
    names = F.array(*(F.lit(n) for n in model.domains))
    return members.withColumn("rate", rate(steps)).select(*key, "tokens", F.map_from_arrays(names, F.col("posterior")).alias("posterior"), "rate", F.map_from_arrays(names, _constant([float(v) for v in found.reached], "double")).alias("reached"), F.lit(found.ended == "on target").alias("on_target"), F.lit(found.ended).alias("ended"))


def copies(rate_col: Column, *keys: Column) -> Column:
    """floor(rate), and one more with the rest as probability, by a hash of the key."""
    chance = F.pmod(F.xxhash64(F.lit(29), *keys), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate_col) + (chance < rate_col - F.floor(rate_col)).cast("int")).cast("int")


def apply_rates(docs: DataFrame, rates: DataFrame, row_key: tuple[str, ...] = ("doc_id",), copy_col: str | None = None) -> DataFrame:
    """``docs`` with each row repeated by its rate; a row without a rate stays once. Null keys match. A row's
    copies are numbered from 1 in ``copy_col``, where that is given."""
    other = rates.select(*(F.col(k).alias(f"__{k}") for k in row_key), F.col("rate").alias("__rate"))
    same = [docs[k].eqNullSafe(other[f"__{k}"]) for k in row_key]
    joined = docs.join(other, same, "left")
    times = F.when(F.col("__rate").isNull(), F.lit(1)).otherwise(copies(F.col("__rate"), *(docs[k] for k in row_key)))
    out = joined.withColumn("__times", times).where("__times > 0")
    numbered = [F.col("__copy").alias(copy_col)] if copy_col else []
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*(docs[c] for c in docs.columns if c != copy_col), *numbered)
