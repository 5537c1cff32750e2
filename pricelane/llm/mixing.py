"""Mixing documents to target token weights of domains with soft membership.

A classifier learned from a labelled table gives each document a posterior over domains. Document rates
are then fitted so that the expected tokens of each domain - the sum over documents of rate * tokens *
posterior - match the targets: nonnegative least squares by projected gradient. The projection is lazy:
gradients add up in one number per domain, the pull, and a document's rate is what the pulls and its
posterior give, projected into the allowed range. So the state of the fit is a number per domain, and a
step is one narrow scan without a shuffle of rows. A scan also sums up how the totals of two domains move
together (over documents whose rate is not at an end of its range), and the gradient is scaled by these;
a step is halved until it lowers the objective. The fit ends when the totals are where the least squares
want them, after a few scans, not after a number of steps.

Everything runs as DataFrame expressions. The classifier is naive Bayes over binned features of the
text and over all words that are frequent in some domain and unusual for it. A labelled document is not
guessed at: its label is its posterior.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pricelane.llm.text import ascii_lower
from pricelane.llm.work import written

BINS = 16
#: Rows that are only thinned out go for sure if this part of their posterior is one domain's that is too large.
SURE = 0.5


class Classifier(NamedTuple):
    domains: list[str]
    evidence: dict[str, list[float]]  # logarithms of odds by domain, of each telling word
    prior: list[float]  # logarithms, by domain
    tables: list[list[list[float]]]  # logarithms, by domain, feature and bin


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of `labels` (doc_id, quality, toxic): toxic, good or poor. Several rows of a
    document count as its worst; rows without a doc_id or without both labels are left out."""
    rows = labels.filter("doc_id IS NOT NULL").groupBy("doc_id") \
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good") \
        .when(F.col("quality").isNotNull(), "poor")
    return rows.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


def word_list(text: Column) -> Column:
    """Runs of letters (a-z and all beyond ASCII) of a text in lower case."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x60\\x7b-\\x7f]+"), "")


def measured(docs: DataFrame, *kept: str | Column) -> DataFrame:
    """`kept` columns, words, tokens (the number of words), and shape: counts that features need."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = [F.length("body"), F.regexp_count("body", F.lit(r"[!-/:-@\[-`{-~]")),
              F.regexp_count("body", F.lit("[0-9]")), F.regexp_count("body", F.lit("[A-Z]")),
              F.regexp_count("body", F.lit("\n"))]
    return docs.select(*kept, text.alias("body")).select("*", word_list(F.col("body")).alias("words")) \
        .select("*", F.size("words").cast("long").alias("tokens"), F.array(*(c.cast("long") for c in counts)).alias("shape"))


def bins() -> list[Column]:
    """The features of the shape of a measured() row, as bins from 0 to BINS - 1."""
    tokens, chars = F.greatest("tokens", F.lit(1)), F.greatest(F.col("shape")[0], F.lit(1))
    share = lambda part, of: F.sqrt(part / of) * BINS
    values = [F.log2(tokens), share(F.col("shape")[1], chars), share(F.col("shape")[2], chars),
              share(F.col("shape")[3], chars), share(F.col("shape")[4], tokens),
              (F.size(F.array_distinct("words")) / tokens) * BINS, F.col("shape")[0] / tokens]
    return [F.greatest(F.lit(0), F.least(F.floor(v), F.lit(BINS - 1))).cast("int") for v in values]


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], rows_per_domain: int = 1000,
          min_docs: int = 8, least: float = 2.0) -> Classifier:
    """A classifier from `docs` (doc_id, text) and `labelled` (doc_id, domain).

    rows_per_domain: at most so many documents of each domain, chosen by a hash of their ids, are read.
    Priors come from all labelled rows. A word is evidence for a domain if at least `min_docs` of its
    documents have it and the logarithm of its odds against the other domains is at least `least`, or
    against it if it is so frequent elsewhere.
    """
    known = labelled.filter(F.col("domain").isin(domains))
    counts = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}  # one per domain
    sample = None
    for domain in domains:
        part = known.filter(F.col("domain") == domain).orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id") \
            .limit(rows_per_domain)
        sample = part if sample is None else sample.unionAll(part)
    sample = F.broadcast(sample.select(F.col("doc_id").alias("sample_id"), "domain"))  # bounded above
    known_docs = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("sample_id"))
    rows = written(measured(known_docs, "domain"), "labelled")

    seen = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    total = sum(seen.values())
    found = rows.select("domain", F.explode(F.array_distinct("words")).alias("word")) \
        .groupBy("word").agg(F.count("*").alias("all"), *(
            F.count_if(F.col("domain") == d).alias(f"in_{i}") for i, d in enumerate(domains))) \
        .filter(F.col("all") >= min_docs)
    odds = []
    for i, domain in enumerate(domains):
        own, n = F.col(f"in_{i}"), seen.get(domain, 0)
        logs = F.log((own + 0.5) / (n + 1)) - F.log((F.col("all") - own + 0.5) / (total - n + 1))
        odds.append(F.when(F.greatest(own, F.col("all") - own) >= min_docs, F.when(F.abs(logs) >= least, logs)))
    telling = found.select("word", *(F.coalesce(o, F.lit(0.0)).alias(f"odds_{i}") for i, o in enumerate(odds))) \
        .filter(" OR ".join(f"odds_{i} <> 0" for i in range(len(domains))))
    # words of at least min_docs documents of the bounded sample
    evidence = {r[0]: list(r[1:]) for r in telling.collect()}

    bin_counts = rows.select("domain", F.posexplode(F.array(*bins())).alias("feature", "bin")) \
        .groupBy("domain", "feature", "bin").count().collect()  # domains * features * BINS at most
    features = len(bins())
    table = [[[1.0] * BINS for _ in range(features)] for _ in domains]
    for r in bin_counts:
        table[domains.index(r.domain)][r.feature][r.bin] += r["count"]
    prior = [math.log((counts.get(d, 0) + 1) / (sum(counts.values()) + len(domains))) for d in domains]
    tables = [[[math.log(x / sum(row)) for x in row] for row in own] for own in table]
    return Classifier(domains, evidence, prior, tables)


def posteriors(docs: DataFrame, model: Classifier, sharpness: float = 0.5) -> DataFrame:
    """doc_id, tokens, lot (a hash of the row) and p, the posterior of each domain.

    sharpness: the power of the likelihood of the shape, below 1 as its features depend on each other.
    """
    lot = F.xxhash64("doc_id", "text").alias("lot")
    telling = sorted(model.evidence)
    met = F.array_intersect("words", F.lit(telling or [""])) if telling else F.array().cast("array<string>")
    # a place among the telling words, few of which a text holds
    places = F.transform(met, lambda w: F.array_position(F.lit(telling or [""]), w).cast("int"))
    rows = measured(docs, "doc_id", lot).select("doc_id", "lot", "tokens", F.array(*bins()).alias("bins"), places.alias("met"))

    def said(k: int) -> Column:
        odds = F.lit([model.evidence[w][k] for w in telling] or [0.0])
        return F.aggregate("met", F.lit(0.0), lambda total, place: total + F.element_at(odds, place))

    logs = []
    for k, (prior, tables) in enumerate(zip(model.prior, model.tables)):
        terms = [F.element_at(F.lit(t), F.col("bins")[i] + 1) for i, t in enumerate(tables)]
        logs.append(F.lit(prior) + sharpness * sum(terms[1:], terms[0]) + said(k))
    named = rows.select("doc_id", "lot", "tokens", *(x.alias(f"log_{i}") for i, x in enumerate(logs)))
    top = F.greatest(*(F.col(f"log_{i}") for i in range(len(logs))), F.lit(-1e300))
    weights = [F.exp(F.col(f"log_{i}") - top) for i in range(len(logs))]
    return named.select("doc_id", "lot", "tokens", F.array(*weights).alias("w")).select(
        "doc_id", "lot", "tokens", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def with_labels(rows: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """The rows of posteriors(), with the label of a labelled document as its p. Several labels of a
    document count alike."""
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id") \
        .agg(F.array(*(F.count_if(F.col("domain") == d) / F.count("*") for d in domains)).alias("known")) \
        .select(F.col("doc_id").alias("known_id"), F.lit(0).cast("long").alias("spread"), "known")
    # rows without a doc_id meet nothing and are spread by their texts
    spread = F.when(F.col("doc_id").isNull(), F.col("lot")).otherwise(0)
    met = rows.join(known, (F.col("doc_id") == F.col("known_id")) & (spread == F.col("spread")), "left")
    return met.select("doc_id", "lot", "tokens", F.coalesce("known", "p").alias("p"))


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a positive definite system of as many equations as there are domains."""
    rows = [[*row, value] for row, value in zip(matrix, right)]
    for i, row in enumerate(rows):
        for other in rows[i + 1:]:
            factor = other[i] / row[i]
            other[i:] = [x - factor * y for x, y in zip(other[i:], row[i:])]
    found = [0.0] * len(rows)
    for i in reversed(range(len(rows))):
        found[i] = (rows[i][-1] - sum(rows[i][k] * found[k] for k in range(i + 1, len(rows)))) / rows[i][i]
    return found


def fitted_rates(rows: DataFrame, weights: list[float], total: float | None = None, max_rate: float = 4.0,
                 ridge: float = 1e-6, enough: float = 1e-4, strict: bool = False) -> Column:
    """The rate of a row of `rows` (tokens, p) as an expression of p.

    weights: target shares of the domains. total: tokens to aim at, as a share of all tokens; None: as
    many as the domain of the largest weight fills without repeats or losses. If `max_rate` is 1 at most
    besides, rows are only thinned out: those whose likeliest domain is that one have the rate `max_rate`,
    and the others are fitted to the targets of the other domains; a domain with less than its target is
    not thinned, and nothing else is held back for it, and no domain's pull exceeds 1 / SURE. Rates lie between 0 and `max_rate`; `ridge` draws the pulls to 0.
    Ends when each domain's total is within `enough` of its target, or of what the least squares come to
    where rates within their range cannot meet the targets; `strict` raises an error then.
    """
    size, cap = len(weights), float(max_rate)
    share = [w / sum(weights) for w in weights]
    main = share.index(max(share))
    thinning = total is None and max_rate <= 1
    held = F.col("p")[main] >= F.array_max("p") if thinning else F.lit(False)

    def pulled(pull: list[float]) -> Column:
        return sum((F.col("p")[k] * pull[k] for k in range(1, size)), F.col("p")[0] * pull[0])

    def rate_of(pulled: Column, held: Column) -> Column:
        return F.when(held, F.lit(cap)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(cap), 1 - pulled)))

    start = rows.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col("p")[k]) for k in range(size))).first()
    if not start[0]:
        return F.least(F.lit(1.0), F.lit(cap))
    mass = [x / start[0] for x in start[1:]]
    if total is None:
        total = max(mass[main], 1e-9) / share[main]
    target = [s * total for s in share]
    scale = [max(t, 1e-9) for t in target]
    # totals that no rate in the range can reach would pull without end
    fitted = [k for k in range(size) if not thinning or (k != main and cap * mass[k] > target[k])]
    most = 1 / SURE if thinning else math.inf

    def scan(pull: list[float]):
        """Totals by domain, how two of them move together, and the objective at `pull`."""
        at = rows.select("tokens", "p", pulled(pull).alias("pulled"), held.alias("held"))
        rate = rate_of(F.col("pulled"), F.col("held"))
        free = F.when(~F.col("held") & (F.col("pulled") > 1 - cap) & (F.col("pulled") < 1), F.col("tokens")).otherwise(0.0)
        # the integral of the rate over the pull
        cost = F.when(F.col("held"), -cap * F.col("pulled")).when(F.col("pulled") >= 1, 0.0) \
            .when(F.col("pulled") > 1 - cap, (1 - F.col("pulled")) * (1 - F.col("pulled")) / 2) \
            .otherwise(cap * cap / 2 + cap * (1 - cap - F.col("pulled")))
        pairs = [(k, m) for k in range(size) for m in range(k + 1)]
        sums = at.agg(*(F.sum(F.col("tokens") * rate * F.col("p")[k]) for k in range(size)),
                      *(F.sum(free * F.col("p")[k] * F.col("p")[m]) for k, m in pairs), F.sum(F.col("tokens") * cost)).first()
        sums = [x / start[0] for x in sums]
        moved = [[0.0] * size for _ in range(size)]
        for (k, m), x in zip(pairs, sums[size:-1]):
            moved[k][m] = moved[m][k] = x
        drawn = sum(ridge * s * x * x for s, x in zip(scale, pull)) / 2
        return sums[:size], moved, sums[-1] + drawn + sum(t * x for t, x in zip(target, pull))

    pull = [0.0] * size
    now, moved, objective = scan(pull)
    while True:
        slope = {k: ridge * scale[k] * pull[k] + target[k] - now[k] for k in fitted}
        free = [k for k in fitted if pull[k] < most or slope[k] > 0]
        if not free or max(abs(slope[k]) / scale[k] for k in free) <= enough:
            break
        step = solved([[moved[k][m] + (ridge * scale[k] if k == m else 0.0) for m in free] for k in free],
                      [-slope[k] for k in free])
        length = 1.0
        while length > 1e-9:
            tried = list(pull)
            for k, x in zip(free, step):
                tried[k] = min(most, pull[k] + length * x)
            gain = sum(slope[k] * (tried[k] - pull[k]) for k in free)
            found = scan(tried)
            if found[2] <= objective + 1e-4 * min(gain, 0.0):
                break
            length /= 2
        else:
            break  # no lower value that numbers of this precision can tell
        pull, (now, moved, objective) = tried, found
    if strict and max(abs(n - t) / s for n, t, s in zip(now, target, scale)) > 100 * enough:
        raise ValueError(f"rates up to {cap} give the shares {now} of the tokens instead of {target}")
    return rate_of(pulled([float(f"{x:.12g}") for x in pull]), held)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_rate: float = 4.0,
          **options) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, lot, tokens, p (by
    domain in the order of `targets`), domain (the likeliest), rate, copies.

    copies: the rate rounded up or down by a hash of doc_id and text, with the rate as its mean, so
    repeated rows are treated alike. A null text is empty and has no tokens; rows without a doc_id are
    rated by their text. Labelled documents have their label as p. Without labelled rows all domains are
    equally likely. An empty table gives no rows.
    """
    domains = list(targets)
    model = train(docs, labelled, domains)
    rows = written(with_labels(posteriors(docs, model), labelled, domains), "posteriors")
    rate = fitted_rates(rows, [targets[d] for d in domains], max_rate=max_rate, **options)
    chance = F.pmod(F.xxhash64("lot", F.lit(12)), F.lit(1 << 32)) / float(1 << 32)
    first = F.array_position("p", F.array_max("p")).cast("int")
    return rows.withColumn("rate", rate).select(
        "doc_id", "lot", "tokens", "p", F.element_at(F.lit(domains), first).alias("domain"), "rate",
        (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"))


def sampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_rate: float = 1.0,
            **options) -> DataFrame:
    """The rows of `docs`, each as often as mixed() says, with all their columns."""
    copies = mixed(docs, labelled, targets, max_rate, **options).filter("copies > 0") \
        .select(F.col("doc_id").alias("mix_id"), F.col("lot").alias("mix_lot"), "copies").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select("*", F.xxhash64("doc_id", "text")).toDF(*names, "mix_own")
    ids = F.col(names[docs.columns.index("doc_id")])
    met = own.join(copies, ids.eqNullSafe(F.col("mix_id")) & (F.col("mix_own") == F.col("mix_lot")))
    return met.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .select(*names).toDF(*docs.columns)
