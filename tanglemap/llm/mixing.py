"""Soft-membership mixing to target weights.

A classifier learnt from a labelled table gives each document posteriors over
domains. Projected-gradient least squares then fits nonnegative document rates
whose expected token totals by domain match the targets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tanglemap.llm.common import unpacked
from tanglemap.llm.decontam import WORD_BYTES
from tanglemap.llm.shingles import word_hashes
from tanglemap.scratch import Table, cut

FEATURES = 1 << 16
RATIO_BINS = 16
EXTRA = 4 * RATIO_BINS
FIT_ROWS = 6_000
CHUNK_BYTES = 1 << 20
NEWTON_STEPS = (1.0, 0.5, 0.2, 0.05)
GRADIENT_STEPS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
SYMBOL = np.ones(256, dtype=bool)
SYMBOL[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x20, 0x0A, 0x09, 0x0D, 0x2C, 0x2E]] = False


def _ratios(raw: bytes, words: np.ndarray, distinct: int) -> list[int]:
    """Categorical features: share of symbols, of distinct words, of distinct lines; length."""
    lines = raw.split(b"\n")
    symbols = float(SYMBOL[np.frombuffer(raw, dtype=np.uint8)].mean()) if raw else 0.0
    shares = [symbols, distinct / max(1, len(words)), len(set(lines)) / len(lines), np.log2(1 + len(words)) / 16]
    return [FEATURES + i * RATIO_BINS + min(RATIO_BINS - 1, int(s * RATIO_BINS)) for i, s in enumerate(shares)]


def features(raws: Sequence[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number of words and its distinct feature indexes, sorted."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        joined = np.frombuffer(b" ".join([*group, b""]).translate(WORD_BYTES), dtype=np.uint8)
        starts, hashes = word_hashes(joined)
        index = (hashes % np.uint64(FEATURES)).astype(np.int32)
        ends = np.cumsum([len(r) + 1 for r in group])
        edges = np.concatenate([[0], np.searchsorted(starts, ends)])
        for raw, a, b in zip(group, edges[:-1], edges[1:], strict=True):
            own = np.unique(index[a:b])
            yield int(b - a), np.concatenate([own, _ratios(raw, index[a:b], len(own))]).astype(np.int32)

    for raw in raws:
        group.append(raw or b"")
        size += len(group[-1])
        if size >= CHUNK_BYTES:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


@dataclass
class DomainClassifier:
    """Multinomial logistic regression on feature presence."""

    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posteriors(self, index: Sequence[np.ndarray]) -> np.ndarray:
        if not self.domains:
            return np.zeros((len(index), 0))
        at = np.concatenate([[0], np.cumsum([len(i) for i in index])[:-1]]).astype(int)
        logits = np.add.reduceat(self.weights[np.concatenate(index)], at, axis=0) + self.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", fit_rows: int = FIT_ROWS, steps: int = 150, decay: float = 0.3) -> DomainClassifier:
    """Learns from documents that the labelled table names (both sides non-null). The fit
    uses about ``fit_rows`` of them at most, chosen by a hash of the id; they reach the driver
    as feature indexes, not as texts. Adam on the mean log loss, with weight decay."""
    named = labels.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).filter("id is not null and domain is not null")
    share = min(1.0, fit_rows / max(1, named.count()))
    named = named.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).join(named, "id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [i for _, i in features(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["domain", "index"])

    rows = sample.select("raw", "domain").mapInArrow(index, "domain string, index array<int>").toArrow()
    names = rows.column("domain").to_pylist()
    domains = sorted(set(names))
    width, k = FEATURES + EXTRA, len(domains)
    model = DomainClassifier(domains, np.zeros((width, k), dtype=np.float32), np.zeros(k, dtype=np.float32))
    if k < 2:
        return model
    lists = rows.column("index").combine_chunks()
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    at, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    target = np.zeros((len(names), k), dtype=np.float32)
    target[np.arange(len(names)), [domains.index(n) for n in names]] = 1
    used, flat = np.unique(flat, return_inverse=True)
    scale = np.repeat(1.0, len(used)).astype(np.float32)
    w, b = np.zeros((len(used), k), dtype=np.float32), np.log(target.mean(axis=0))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        logits = np.add.reduceat((w * scale[:, None])[flat], at, axis=0) + b
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (e / e.sum(axis=1, keepdims=True) - target) / len(names)
        spread = np.repeat(error, sizes, axis=0)
        grad = np.stack([np.bincount(flat, weights=spread[:, j], minlength=len(used)) for j in range(k)], axis=1) + decay / len(names) * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = (w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        b = b - 0.5 * error.sum(axis=0)
    model.weights[used], model.bias = w, b.astype(np.float32)
    return model


@dataclass
class Rates:
    """A rate for each document from its posterior: from a rate of 1, each move takes
    ``posterior . move`` away, but never goes below the floor, which is 1 for documents that
    are ``sure`` or more likely of a ``wanted`` domain, else 0."""

    wanted: np.ndarray  # by domain, bool
    sure: float
    moves: list[np.ndarray] = field(default_factory=list)
    target: dict[str, float] = field(default_factory=dict)  # tokens by domain
    reached: dict[str, float] = field(default_factory=dict)

    def floor(self, p: np.ndarray) -> np.ndarray:
        return (p[:, self.wanted].sum(axis=1) >= self.sure).astype(float)

    def of(self, p: np.ndarray) -> np.ndarray:
        rate = np.ones(len(p))
        if self.moves:
            floor = self.floor(p)
            for move in self.moves:
                rate = np.maximum(floor, rate - p @ move)
        return rate


def domain_posteriors(docs: DataFrame, model: DomainClassifier, *, text_col: str = "text", keep: Sequence[str] | None = None, rates: Rates | None = None) -> DataFrame:
    """Columns ``_row``, ``n_tokens`` (words), ``posterior`` (array, in the order of the
    model's domains) and ``_rate``, what ``rates`` of :func:`fit_rates` make of it (1 without).
    A null or empty text has no tokens and the posterior of its bare bias."""
    names = list(keep or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text_col).cast("binary").alias("_raw"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, index = [], []
            for n, i in features(batch.column(1).to_pylist()):
                counts.append(n)
                index.append(i)
            p = shared.value.posteriors(index).astype(float) if index else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rates.of(p) if rates else np.ones(len(p)))],
                ["_row", "n_tokens", "posterior", "_rate"],
            )

    schema = rows.select("_row").schema.add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType())).add("_rate", "double")
    return rows.mapInArrow(score, schema)


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(float), np.array(batch.column(1).flatten().to_numpy(), dtype=float).reshape(-1, k)


def fit_rates(scored: DataFrame, domains: Sequence[str], weights: Mapping[str, float], *, total: float | None = None, sure: float = 0.5, steps: int = 40, tolerance: float = 1e-4) -> Rates:
    """Projected-gradient least squares: nonnegative rates whose expected token totals by
    domain, the sum of rate x tokens x posterior, come nearest to the targets. The misfit is
    measured by the domains' token Gram matrix, so no unit or rare domain dominates.

    ``weights``: target share by domain (others 0). ``total``: tokens aimed at; by default the
    least with which no domain of positive weight has fewer tokens than now. ``sure``:
    documents at least so likely of the domains of positive weight keep a rate of 1 or more;
    above 1 there is no such floor. Each iteration is one pass over (tokens, posterior) that
    tries steps of several lengths, along the gradient and along Newton's direction for the
    documents above their floors, and returns one row of sums for each; the best is taken,
    until none improves. Rates are recomputed from the moves, so nothing is stored by
    document and a lost task is simply run again. Targets that floors keep out of reach show
    in ``reached`` beside ``target``."""
    k = len(domains)
    goal = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    rates = Rates(goal > 0, sure)

    def sums(moves: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token totals after each of some next moves, and the Gram matrix of what is above its floor."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(moves), k + k * k))
            for batch in batches:
                tokens, p = _matrix(batch, k)
                rate, floor = rates.of(p), rates.floor(p)
                for i, move in enumerate(moves):
                    moved = np.maximum(floor, rate - p @ move) if move.any() else rate
                    free = (moved > floor) * tokens
                    out[i, :k] += (tokens * moved) @ p
                    out[i, k:] += ((p * free[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["i", "x"])

        rows = scored.select("n_tokens", "posterior").mapInArrow(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(moves) * (k + k * k))
        for r in rows:
            out[r["i"]] = r["x"]
        return [(row[:k], row[k:].reshape(k, k)) for row in out.reshape(len(moves), -1)]

    every, rates.sure = rates.sure, 2.0  # no floor: the Gram matrix of all documents
    now, gram = sums([np.zeros(k)])[0]
    rates.sure = every
    goal = goal / goal.sum() if goal.sum() else goal
    if total is None:
        total = max([n / g for n, g in zip(now, goal, strict=True) if g > 0], default=0.0)
    target = goal * total
    metric, free = np.linalg.pinv(gram) if k else gram, gram
    loss = lambda totals: float((totals - target) @ metric @ (totals - target))
    begun = loss(now)
    for _ in range(steps):
        misfit = now - target
        if np.abs(misfit).max(initial=0) <= tolerance * max(1.0, total):
            break
        newton = np.linalg.pinv(free) @ misfit
        tried = [*(newton * x for x in NEWTON_STEPS), *(metric @ misfit * x for x in GRADIENT_STEPS)]
        found = sums(tried)
        best = min(range(len(tried)), key=lambda i: loss(found[i][0]))
        if loss(now) - loss(found[best][0]) <= tolerance / 10 * begun:
            break  # floors keep some targets out of reach
        rates.moves.append(tried[best])
        now, free = found[best]
    rates.target, rates.reached = dict(zip(domains, target.tolist(), strict=True)), dict(zip(domains, now.tolist(), strict=True))
    return rates


@dataclass
class Mixture:
    """What :func:`fit_mixture` learnt; ``rates`` tells targets and totals reached."""

    model: DomainClassifier
    rates: Rates


def _drawn(docs: DataFrame, names: Sequence[str], id_col: str, text_col: str, seed: int) -> DataFrame:
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(1 << 30))
    return docs.select(*[F.col(f"`{c}`") for c in names], draw.alias("_draw"), F.col(f"`{text_col}`").alias("_text"))


def fit_mixture(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sure: float = 0.5, fit_rows: int = FIT_ROWS, total: float | None = None) -> Mixture:
    """The classifier, from the labelled table, and rates over all documents. With no label at
    all there are no domains and every rate is 1."""
    model = fit_classifier(docs, labels, id_col=id_col, text_col=text_col, domain_col=domain_col, fit_rows=fit_rows)
    if not model.domains:
        return Mixture(model, Rates(np.zeros(0, dtype=bool), sure))
    sums = cut(domain_posteriors(docs.select(F.col(f"`{text_col}`").alias("_text")), model, text_col="_text").select("n_tokens", "posterior"))
    return Mixture(model, fit_rates(sums, model.domains, weights, total=total, sure=sure))


def apply_mixture(docs: DataFrame, mixture: Mixture, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, seed: int = 29) -> DataFrame:
    """The documents (columns ``keep``, or all) with ``n_tokens``, ``p_<domain>`` for each
    domain, ``rate`` (expected copies) and ``copies``: the rate rounded up or down by a hash of
    the id and the text, so that on average it is the rate."""
    names = list(keep or docs.columns)
    out = domain_posteriors(_drawn(docs, names, id_col, text_col, seed), mixture.model, text_col="_text", keep=[*names, "_draw"], rates=mixture.rates)
    return _copied(out, names, mixture.model.domains)


def _copied(out: DataFrame, names: Sequence[str], domains: Sequence[str]) -> DataFrame:
    whole = F.floor("_rate")
    copies = (whole + (F.col("_row._draw") < (F.col("_rate") - whole) * float(1 << 30)).cast("long")).cast("long")
    posteriors = {f"p_{d}": F.col("posterior")[i] for i, d in enumerate(domains)}
    return out.select(*unpacked(out, names, n_tokens=F.col("n_tokens"), **posteriors, rate=F.col("_rate"), copies=copies))


def _rated(scored: DataFrame, rates: Rates, k: int) -> DataFrame:
    """Rows of :func:`domain_posteriors` with the ``_rate`` that ``rates`` make of their posteriors."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _matrix(batch.select(["n_tokens", "posterior"]), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(p))], [*batch.schema.names, "_rate"])

    rows = scored.select("_row", "n_tokens", "posterior")
    return rows.mapInArrow(rate, rows.select("*").schema.add("_rate", "double"))


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", keep: Sequence[str] | None = None, seed: int = 29, sure: float = 0.5, fit_rows: int = FIT_ROWS, total: float | None = None) -> DataFrame:
    """:func:`fit_mixture` and :func:`apply_mixture` in one. Documents that are more likely
    than not of domains that are wanted keep a rate of 1 or more, so a slight doubt of the
    classifier removes nothing; copies follow the rates. Texts are scored once and the other
    columns stored with their scores, unless the texts themselves are kept: then they are
    scored two times, so that they need not be stored.

    A null text has no tokens; null ids and unlabelled documents take part; labels without a document
    or with a null domain are ignored. Repeated rows have equal rates and copies; so have
    ties in anything but id and text. An empty table gives none."""
    names = list(keep or docs.columns)
    if text_col.lower() in map(str.lower, names):
        mixture = fit_mixture(docs, labels, weights, id_col=id_col, text_col=text_col, domain_col=domain_col, sure=sure, fit_rows=fit_rows, total=total)
        return apply_mixture(docs, mixture, id_col=id_col, text_col=text_col, keep=keep, seed=seed)
    model = fit_classifier(docs, labels, id_col=id_col, text_col=text_col, domain_col=domain_col, fit_rows=fit_rows)
    if not model.domains:
        return apply_mixture(docs, Mixture(model, Rates(np.zeros(0, dtype=bool), sure)), id_col=id_col, text_col=text_col, keep=keep, seed=seed)
    scored = domain_posteriors(_drawn(docs, names, id_col, text_col, seed), model, text_col="_text", keep=[*names, "_draw"]).drop("_rate")
    scored = Table(scored, "mixing-scored").read()
    return _copied(_rated(scored, fit_rates(scored, model.domains, weights, total=total, sure=sure), len(model.domains)), names, model.domains)


def quality_domains(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` as domains: toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))
