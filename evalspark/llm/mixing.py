"""Soft-membership mixing: document rates whose expected tokens per domain match target weights.

A classifier trained on labelled documents gives every document posteriors over the domains (naive Bayes on hashed
words, with a temperature chosen by log loss). A document counts towards every domain by its posterior. Nonnegative
rates w minimise

    1/2 sum_d ((sum_i w_i n_i p_id - T_d) / N)^2  +  mu/2 sum_i (n_i / N) (w_i - 1)^2

by accelerated projected gradient in the metric of the token counts: a step changes a rate by its posteriors times the
domains' misses. The misses of all steps so far therefore fix every rate, and a step is one Spark job that sums
``domains`` numbers over a narrow stored table. Nothing per document leaves the tasks.

Such steps settle slowly where domains are hard to tell apart and where rates met a bound on the way. At the optimum a rate
is w_i = 1 - p_i . pull within its bounds, with one pull a domain that is its miss / mu. Newton steps in the pulls, from
those nearest to the settled rates, go on until this holds: the cost is then within a proven bound of the least one.

The rates are expected copies. ``copies`` rounds them by a hash of the row, so a rerun gives the same.

Edge cases. Null and empty texts have no tokens, the prior as posteriors and no influence on the totals. Domains
without labelled documents get no posterior but their target stays, so the miss is reported. Targets are never scaled: with ``max_rate``
a domain that has too little misses its own target, and the others keep theirs. Misses of a hundredth of all tokens or
more, or of a tenth of the target, are logged. Without any token every rate is 1. Repeated rows get equal rates. Columns
of the input stay; those named like an output are replaced.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_ids, stored
from .jaccard import word_hashes

log = logging.getLogger(__name__)

BUCKETS = 1 << 12
MU = 1e-6
TEMPERATURES = [0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 4.0]
OWN = ["n_tokens", "domain", "posteriors", "rate", "copies", "converged"]


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # log probability of each bucket in each domain, domains x buckets
    prior: np.ndarray  # log share of each domain; minus infinity without labelled documents
    temperature: float = 1.0

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and their mean log probability in each domain times the root of their number."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes, sums = np.zeros(len(raw), np.int64), np.zeros((len(raw), len(self.domains)))
        for i, data in enumerate(raw):
            slots = (word_hashes(data)[1] % np.uint64(self.weights.shape[1])).astype(np.int64)
            sizes[i] = len(slots)
            if len(slots):
                sums[i] = self.weights[:, slots].sum(1) / np.sqrt(len(slots))
        return sizes, sums

    def posteriors(self, evidence: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = evidence * (temperature or self.temperature) + self.prior
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def labelled(docs: DataFrame, labels: DataFrame, domain: str) -> DataFrame:
    """(text, domain) of all documents that occur in ``labels``."""
    ids = labels.where("doc_id is not null").select("doc_id").distinct()
    return join_ids(docs, ids, "doc_id", "left_semi").select("text", F.col(domain).cast("string").alias("domain"))


def train(rows: DataFrame, domains: list[str], buckets: int = BUCKETS) -> Classifier:
    """Count hashed words per domain (one bounded row per domain and task), then choose the temperature."""
    at = {d: k for k, d in enumerate(domains)}

    def count(batches):
        tally, docs = np.zeros((len(domains), buckets), np.int64), np.zeros(len(domains), np.int64)
        for batch in batches:
            for text, domain in zip(batch.column("text").to_pylist(), batch.column("domain").to_pylist()):
                if domain in at:
                    slots = word_hashes((text or "").encode("utf-8", "surrogatepass"))[1] % np.uint64(buckets)
                    tally[at[domain]] += np.bincount(slots.astype(np.int64), minlength=buckets)
                    docs[at[domain]] += 1
        k, b = np.nonzero(tally)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((k, np.arange(len(domains))))), pa.array(np.concatenate((b, np.full(len(domains), -1)))), pa.array(np.concatenate((tally[k, b], docs)))],
            names=["domain", "slot", "n"])

    sums = rows.mapInArrow(count, "domain bigint, slot bigint, n bigint").groupBy("domain", "slot").agg(F.sum("n").alias("n")).collect()
    tally, docs = np.ones((len(domains), buckets)), np.zeros(len(domains))
    for r in sums:  # at most domains * (buckets + 1) rows
        if r["slot"] < 0:
            docs[r["domain"]] += r["n"]
        else:
            tally[r["domain"], r["slot"]] += r["n"]
    with np.errstate(divide="ignore"):
        prior = np.log(docs / docs.sum()) if docs.sum() else np.full(len(domains), -np.log(len(domains)))
    model = Classifier(domains, np.log(tally / tally.sum(1, keepdims=True)), prior)

    def losses(batches):
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            picks = [at.get(d, -1) for d in batch.column("domain").to_pylist()]
            known = np.flatnonzero(np.array(picks) >= 0)
            _, x = model.evidence([batch.column("text")[int(i)].as_py() for i in known])
            for k, t in enumerate(TEMPERATURES):
                p = model.posteriors(x, t)[np.arange(len(known)), np.array(picks)[known]] if len(known) else np.zeros(0)
                total[k] -= np.log(np.maximum(p, 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["k", "loss"])

    loss = {r["k"]: r["loss"] for r in rows.mapInArrow(losses, "k bigint, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    if loss:
        model.temperature = TEMPERATURES[min(loss, key=lambda k: (round(loss[k], 6), k))]
    return model


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(n, p): words and posteriors of every document, nothing else."""

    def measure(batches):
        for batch in batches:
            n, x = model.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(model.posteriors(x).tolist(), pa.list_(pa.float64()))], names=["n", "p"])

    return docs.select("text").mapInArrow(measure, "n bigint, p array<double>")


@dataclass
class Solution:
    pulls: np.ndarray  # of the domains on the rates
    max_rate: float
    targets: np.ndarray
    misses: np.ndarray
    converged: bool
    steps: int = 0  # gradient steps
    finishing: int = 0  # Newton steps

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents with posteriors p."""
        return np.clip(1.0 - p @ self.pulls, 0.0, self.max_rate)


def replay(p: np.ndarray, steps, momentum, scale: float, natural: np.ndarray, mu: float, max_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and look-ahead rates after the given steps; every rate starts at 1, within its bounds.

    A document's step is divided by the share that its domains have of the corpus. Rates of a rare domain move its total
    little, so they take larger steps, and all domains come near their targets in about as many of them.
    """
    w = np.full(len(p), min(1.0, max_rate))
    ahead = w
    size = scale / (p @ natural + mu)
    for miss, m in zip(steps, momentum):
        new = np.clip(ahead - size * (p @ miss + mu * (ahead - 1.0)), 0.0, max_rate)
        ahead, w = new + m * (new - w), new
    return w, ahead


def solve(
    members: DataFrame, weights: list[float], mu: float = MU, max_rate: float = float("inf"), max_steps: int = 400, tolerance: float = 1e-4
) -> Solution:
    """Fit the rates to target weights (shares of the domains, in the classifier's order). ``members`` should be stored.

    Gradient steps end when the total of each domain changes by less than ``tolerance`` of all tokens, and by less than a
    hundredth of a small target, in two steps running, or after ``max_steps``. What they leave is done by ``_finish``, without a
    bound on its steps; ``converged`` says that the result is the optimum.
    """
    d = len(weights)
    share = np.array(weights, float) / sum(weights)

    def expected(batches):
        for batch in batches:
            n, p = _arrays(batch, d)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(n @ p)], names=["k", "s"])

    own = _sums(members, expected, d)
    tokens = own.sum()
    if not tokens:
        return Solution(share * 0, max_rate, share * 0, share * 0, True)
    natural = own / tokens
    targets = share

    def moments(batches):
        total = np.zeros((d, d))
        for batch in batches:
            n, p = _arrays(batch, d)
            total += (p * (n / (p @ natural + mu))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int64()), pa.array(total.ravel())], names=["k", "s"])

    curvature = _sums(members, moments, d * d).reshape(d, d) / tokens
    size = 1.0 / (float(np.linalg.eigvalsh(curvature)[-1]) + 1.0)
    steps: list[np.ndarray] = []
    momentum: list[float] = []
    t, last, still = 1.0, None, 0
    near = tolerance * np.minimum(1.0, 100 * np.maximum(targets, 1e-6))
    while len(steps) < max_steps:

        def totals(batches):
            out = np.zeros(2 * d)
            for batch in batches:
                n, p = _arrays(batch, d)
                w, ahead = replay(p, steps, momentum, size, natural, mu, max_rate)
                out[:d] += (n * ahead) @ p
                out[d:] += (n * w) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * d), pa.int64()), pa.array(out)], names=["k", "s"])

        both = _sums(members, totals, 2 * d) / tokens
        reached = both[d:]
        moved = reached * 0 if last is None else reached - last
        still = still + 1 if last is not None and (np.abs(moved) < near).all() else 0
        if still == 2:
            break
        if float((both[:d] - targets) @ moved) > 0:  # momentum starts anew when it carries the totals past their targets
            t = 1.0
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        steps.append(both[:d] - targets)
        momentum.append((t - 1) / following)
        t, last = following, reached

    def fitting(batches):  # least squares of the settled rates, without those at a bound
        out = np.zeros(d + d * d)
        for batch in batches:
            n, p = _arrays(batch, d)
            w = replay(p, steps, momentum, size, natural, mu, max_rate)[0]
            free = n * ((w > 0) & (w < max_rate))
            out[:d] += (free * (1.0 - w)) @ p
            out[d:] += ((p * free[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int64()), pa.array(out)], names=["k", "s"])

    fit = _sums(members, fitting, d + d * d) / tokens
    pulls = np.linalg.solve(fit[d:].reshape(d, d) + mu * np.eye(d), fit[:d])
    pulls, misses, converged, finishing = _finish(members, pulls, targets, tokens, mu, max_rate, near, tolerance)
    return Solution(pulls, max_rate, targets, misses, converged, len(steps), finishing)


def _finish(members: DataFrame, pulls: np.ndarray, targets: np.ndarray, tokens: float, mu: float, max_rate: float, near: np.ndarray, tolerance: float):
    """(pulls, misses, whether they are the optimum, steps) by Newton steps on the dual cost, a smooth concave function.

    Its slope is misses - mu * pulls; half its square bounds how far the cost is from the least one, and with it how far the
    totals are from the best ones. The steps end when the slope is below ``near`` and another step would change the rates
    by less than a thousandth of ``tolerance``, as a root mean square by tokens. A step is halved until the function gains by it.
    """
    d = len(pulls)

    def measured(at: np.ndarray, origin: np.ndarray):
        """Gain of the dual cost over ``origin``, slope and curvature at some pulls, misses."""

        def part(batches):
            out = np.zeros(1 + d + d * d)
            for batch in batches:
                n, p = _arrays(batch, d)
                before, after = (1.0 - p @ x for x in (origin, at))
                w0, w = np.clip(before, 0.0, max_rate), np.clip(after, 0.0, max_rate)
                out[0] += n @ ((1.0 - after) * w - (1.0 - before) * w0 + 0.5 * ((w - 1.0) ** 2 - (w0 - 1.0) ** 2))
                out[1 : 1 + d] += (n * w) @ p
                free = n * ((after > 0.0) & (after < max_rate))
                out[1 + d :] += ((p * free[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int64()), pa.array(out)], names=["k", "s"])

        sums = _sums(members, part, 1 + d + d * d) / tokens
        misses = sums[1 : 1 + d] - targets
        gain = sums[0] - (at - origin) @ targets - 0.5 * mu * (at - origin) @ (at + origin)
        return gain, misses - mu * at, sums[1 + d :].reshape(d, d) + mu * np.eye(d), misses

    steps = 0
    _, slope, curvature, misses = measured(pulls, pulls)
    while True:
        move = np.linalg.solve(curvature, slope)
        promise = float(slope @ move)
        if (np.abs(slope) < near).all() and promise <= (tolerance / 1000) ** 2:
            return pulls, misses, True, steps
        length = 1.0
        while True:
            gain, *there = measured(pulls + length * move, pulls)
            steps += 1
            if gain >= 1e-4 * length * promise:
                break
            length /= 2
            if length < 1e-12:  # rounding hides the gain
                return pulls, misses, False, steps
        pulls, (slope, curvature, misses) = pulls + length * move, there


def _arrays(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("n").to_numpy().astype(float), batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(members: DataFrame, part, size: int) -> np.ndarray:
    """Sum of the tasks' vectors; each task sends one vector."""

    def once(batches):
        total = None
        for vector in part(batches):
            s = vector.column("s").to_numpy()
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["k", "s"])

    out = np.zeros(size)
    for r in members.mapInArrow(once, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r["k"]] = r["s"]
    return out


def mix(docs: DataFrame, model: Classifier, found: Solution) -> DataFrame:
    """Add n_tokens, domain (the likeliest), posteriors, rate, copies and converged (of the fit) to every document."""
    kept = docs.drop(*OWN)
    with_seed = kept.withColumn("copies", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", "text")]), F.lit(1 << 20)) / (1 << 20))
    fields = T.StructType.fromDDL("n_tokens bigint, domain string, posteriors array<double>, rate double, copies bigint, converged boolean").fields

    def rated(batches):
        for batch in batches:
            n, x = model.evidence(batch.column("text").to_pylist())
            p = model.posteriors(x)
            rate = found.rates(p)
            copies = np.floor(rate + batch.column("copies").to_numpy()).astype(np.int64)
            names = [c for c in batch.schema.names if c != "copies"]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in names), pa.array(n), pa.array([model.domains[k] for k in p.argmax(1)]),
                pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rate), pa.array(copies), pa.array([found.converged] * len(rate), pa.bool_())], names=[*names, *OWN])

    return with_seed.mapInArrow(rated, T.StructType(kept.schema.fields + fields))


def tokens_by_domain(members: DataFrame, domains: int) -> list[float]:
    """Expected tokens of every domain."""

    def totals(batches):
        for batch in batches:
            n, p = _arrays(batch, domains)
            yield pa.RecordBatch.from_arrays([pa.array(range(domains), pa.int64()), pa.array(n @ p)], names=["k", "s"])

    return _sums(members, totals, domains).tolist()


def mix_to_targets(
    docs: DataFrame, labelled_rows: DataFrame, targets: dict[str, float] | list[str], max_rate: float = float("inf"), smoothing: float = 0.9
) -> tuple[DataFrame, Solution]:
    """Train, measure, solve and rate: the documents with their rates, and how the fit went.

    ``targets`` are weights of the domains; a bare list of domains gets its own expected tokens, raised to the power
    ``smoothing``, so that small domains gain a little. A listed domain without tokens gets no share.
    """
    domains = sorted(targets)
    model = train(labelled_rows, domains)
    members = stored(memberships(docs, model), "memberships")
    if isinstance(targets, dict):
        weights = [targets[d] for d in domains]
    else:
        tokens = tokens_by_domain(members, len(domains))
        weights = [x**smoothing if x > 0 else 0.0 for x in tokens] if any(tokens) else [1.0] * len(domains)
    found = solve(members, weights, max_rate=max_rate)
    if not found.converged:
        log.warning("the rates still moved after %d and %d steps", found.steps, found.finishing)
    for d, target, miss in zip(domains, found.targets, found.misses):
        if abs(miss) >= 0.01 or abs(miss) > 0.1 * target:
            log.warning("domain %s has %.5f of all tokens for a target of %.5f", d, target + miss, target)
    return mix(docs, model, found), found
