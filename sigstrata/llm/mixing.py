"""Mixing to target weights with soft membership, in DataFrame functions alone.

A labelled table says which domain some documents belong to. A naive Bayes classifier over hashed words,
fitted on at most FIT_ROWS labelled rows, gives every document its posterior over domains. Each document d
has a nonnegative rate r_d (how often it is used); the expected tokens of domain k are
sum_d r_d * n_d * p_dk. Projected gradient least squares fits the rates from r = 1 on:

    z_d <- z_d - sum_k p_dk * (S e)_k,    r_d = max(floor, z_d),    e = expected - target tokens by domain,

which is projected gradient (the projection is made when the rates are read) on 1/2 e'Se in the metric that
weights documents by their tokens. S is the inverse Gram matrix of the documents off the floor, so that a few
rounds suffice; a step that does not lessen the residual is halved. Each round is one aggregation of K sums
and K(K+1)/2 products over the table of posteriors. The sum of all steps is a vector of K numbers, so the rates
are a short expression of the posteriors, and nothing is collected or shuffled but those sums.

The budget says how many tokens the mix has, as a multiple of those at hand. With a floor of 0 any weights can be met:
documents of domains with more than their weight are thinned, others repeated. With a floor of 1 no document goes, so
the weights can only be met in more tokens than there are: at least max_k have_k / weight_k, and somewhat more as
soft members of scarce domains bring tokens of others with them. Then the budget is found from the data, from
that bound on. Shares that are missed by more than OFF are logged as a warning, or refused where that is asked for.

Null and empty texts have no tokens, uniform evidence (posterior = prior) and rates like others. Labels that
are null or contradict each other are not learned from. Domains without labelled documents, or without
tokens, keep what they have. Repeated rows are rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigstrata.llm.common import discard, row

BUCKETS = 4096
FIT_ROWS = 8_000
ROUNDS = 40
#: The fit ends when token shares are this close to the targets.
CLOSE = 1e-6
#: A share that is off by more is told.
OFF = 0.01
#: With a floor the budget starts so far above its lower bound, and grows by GROWTH where it is too small, so often at most.
ABOVE, GROWTH, TRIES = 1.02, 1.1, 12
SHARPNESS = 4.0
#: Weights of the production mix.
TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the label table: toxic first, then by quality."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    named = labels.select("doc_id", name.alias("domain")).where("doc_id is not null and domain is not null")
    one = named.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("high"))
    return one.where("domain = high").select("doc_id", "domain")


def words(text: Column) -> Column:
    """The words of a text: runs of other than ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def numbers(values) -> Column:
    """A literal array, folded to one constant by the optimizer."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


class Classifier:
    """Log-likelihood ratios of buckets by domain, and log priors."""

    def __init__(self, names: list[str], weights: np.ndarray, prior: np.ndarray):
        self.names, self.weights, self.prior = names, weights, prior

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame, names: list[str], rows: int = FIT_ROWS) -> Classifier:
        """labelled: (doc_id, domain). At most `rows` of it are broadcast; BUCKETS * K counts come back."""
        known = labelled.where(F.col("domain").isin(names))
        sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__id"), "domain")
        joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
        each = joined.select("domain", F.explode(F.array_distinct(F.transform(words(F.col("text")), bucket))).alias("b"))
        counts = np.zeros((len(names), BUCKETS))
        for r in each.groupBy("domain", "b").count().collect():
            counts[names.index(r.domain), r.b] = r["count"]
        size = np.zeros(len(names))
        for r in known.groupBy("domain").count().collect():
            size[names.index(r.domain)] = r["count"]
        rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        return cls(names, np.log(rate) - np.log(rate).mean(axis=0), np.log((size + 1) / (size + 1).sum()))

    def evidence(self, text: Column) -> Column:
        """struct<n, ids>: the number of words, and their distinct buckets."""
        ids = F.transform(words(text), bucket)
        return F.struct(F.size(ids).cast("double").alias("n"), F.array_distinct(ids).alias("ids"))

    def posterior(self, evidence: Column) -> Column:
        """Log joint of each domain, tempered by the root of distinct buckets so that long texts stay soft."""
        ids = evidence["ids"]
        scale = F.lit(SHARPNESS) / F.sqrt(F.greatest(F.size(ids), F.lit(1)).cast("double"))
        tables = [numbers(w) for w in self.weights]

        def total(table: Column) -> Column:
            return F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))

        return F.array(*[F.lit(float(x)) + scale * total(t) for x, t in zip(self.prior, tables, strict=True)])

    def apply(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with n (words, double) and p (posteriors, in the order of names) of a text column."""
        out = rows.withColumn("evidence", self.evidence(F.col(text)))
        out = out.withColumn("log_p", self.posterior(F.col("evidence")))
        out = out.withColumn("raw_p", F.transform("log_p", lambda x: F.exp(x - F.array_max("log_p"))))
        total = F.aggregate("raw_p", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("p", F.transform("raw_p", lambda x: x / total)).withColumn("n", F.col("evidence.n"))
        return out.drop("evidence", "log_p", "raw_p")


class Rates:
    """Fitted rates: max(floor, 1 - sum_k move_k * p_k), an expression over p."""

    def __init__(self, floor: float, move: np.ndarray):
        self.floor, self.move = floor, move

    def point(self) -> Column:
        """1 less the steps, before the projection."""
        step = sum((F.lit(float(x)) * F.element_at("p", k + 1) for k, x in enumerate(self.move)), F.lit(0.0))
        return F.lit(1.0) - step

    def column(self) -> Column:
        return F.greatest(F.lit(self.floor), self.point())

    @classmethod
    def fit(cls, scored: DataFrame, weights: np.ndarray, floor: float = 0.0, budget: float | None = None, rounds: int = ROUNDS, strict: bool = False) -> Rates:
        """scored: n and p of every document. Targets: weights of budget times all tokens.

        A round is one aggregation: the residual, and the Gram matrix of the documents that are not at the floor.
        Without a budget it is 1 for floors below 1, and else the least tried one that meets the weights.
        strict: shares that are off by more than OFF raise a ValueError.
        """

        def told(rates: Rates, got: np.ndarray) -> Rates:
            miss = np.abs(got / got.sum() - share).max() if got.sum() else 1.0
            if miss > OFF:
                said = f"the rates do not meet the weights {np.round(share, 4).tolist()}: shares are off by up to {miss:.4f}"
                if strict:
                    raise ValueError(said)
                logging.getLogger(__name__).warning(said)
            return rates

        k = len(weights)
        p = [F.element_at("p", i + 1) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]

        def tokens(rates: Rates) -> tuple[np.ndarray, np.ndarray]:
            free = F.when(F.col("z") >= floor, F.col("n")).otherwise(0.0)
            got = scored.withColumn("z", rates.point()).withColumn("r", F.greatest(F.lit(floor), F.col("z"))).agg(
                *[F.coalesce(F.sum(F.col("n") * F.col("r") * x), F.lit(0.0)) for x in p],
                *[F.coalesce(F.sum(free * p[i] * p[j]), F.lit(0.0)) for i, j in pairs],
            ).first()
            gram = np.zeros((k, k))
            for (i, j), x in zip(pairs, got[k:], strict=True):
                gram[i, j] = gram[j, i] = x
            return np.array(got[:k], dtype=float), gram

        def descend(target: np.ndarray) -> tuple[Rates, np.ndarray, bool]:
            """Rates, the tokens by domain that they give, and whether those are the target."""
            now, (got, gram), best = start, first, None
            size, scale = np.inf, 1.0
            for left in range(rounds, -1, -1):
                miss = float(np.linalg.norm(got - target))
                if miss < size:
                    best, size, scale = (now, got, gram), miss, 1.0
                else:  # a step too far: half of it, from the best point
                    scale /= 2
                if size < CLOSE * target.sum() or scale < 1e-3 or not left:
                    break
                at, reached, g = best
                step = np.linalg.solve(g + 1e-6 * (np.trace(g) + 1.0) * np.eye(k), reached - target)
                now = cls(floor, at.move + scale * step)
                got, gram = tokens(now)
            return best[0], best[1], size < CLOSE * target.sum()

        start = cls(floor, np.zeros(k))
        first = tokens(start)
        have = first[0] / max(floor, 1.0)  # all rates are max(floor, 1) at the start
        total = have.sum()
        share = np.where(have > 0, weights, 0.0)
        if not total or not share.sum():
            return start
        share = share / share.sum()
        if budget is not None or floor < 1:
            rates, got, _ = descend((1.0 if budget is None else budget) * total * share)
            return told(rates, got)
        least = floor * float((have[share > 0] / share[share > 0]).max())
        best, shares = start, first[0]
        for i in range(TRIES):
            rates, got, met = descend(least * ABOVE * GROWTH**i * share)
            if met:
                return rates
            # of equals, the one of fewest tokens
            if np.abs(got / got.sum() - share).max() < np.abs(shares / shares.sum() - share).max() - CLOSE:
                best, shares = rates, got
        return told(best, shares)


def mix_documents(docs: DataFrame, labels: DataFrame, write, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain, and the rate. write(df) makes a table that is read again."""
    targets = targets or TARGETS
    names = sorted(targets)
    model = Classifier.fit(docs, domains(labels), names)
    scored = write(model.apply(docs.select("doc_id", "text")).select("doc_id", "n", "p"))
    rates = Rates.fit(scored, np.array([targets[n] for n in names]))
    return scored.select(
        "doc_id", F.col("n").cast("long").alias("n_tokens"),
        *[F.element_at("p", i + 1).alias(f"p_{n}") for i, n in enumerate(names)], rates.column().alias("rate"),
    )


def mixed(
    docs: DataFrame, labels: DataFrame, write, targets: dict[str, float] | None = None, floor: float = 0.0, budget: float | None = None, strict: bool = False,
) -> DataFrame:
    """docs with each row repeated by its rate: the whole part, and one more with the chance of the rest.

    The chance is a hash of doc_id and text, so that a rerun repeats the same rows. See Rates.fit for floor and budget.
    Posteriors for the fit are written without texts; those of the result are computed anew beside the text.
    """
    targets = targets or TARGETS
    names = sorted(targets)
    model = Classifier.fit(docs, domains(labels), names)
    scored = write(model.apply(docs.select("text")).select("n", "p"))
    rates = Rates.fit(scored, np.array([targets[n] for n in names]), floor, budget, strict=strict)
    discard(scored)
    chance = F.shiftrightunsigned(F.xxhash64(F.col("row.doc_id"), F.col("row.text"), F.lit("mix")), 11).cast("double") / float(1 << 53)
    copies = F.floor(rates.column() + chance).cast("int")
    out = model.apply(row(docs), "row.text").withColumn("copies", copies)
    # explode_outer, as a filter on copies would be pushed below the posteriors and compute them again and again
    out = out.withColumn("copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.where("copy is not null").select("row.*")
