"""Toxicity by weak supervision.

Voters are rules of different kinds. A lexicon voter has entries that occur in
texts marked toxic far beyond chance: four lists of words, one of word
beginnings, one of pairs of neighbouring words. Entries are mined from each fold
of the training rows on its own and vote on texts of other folds only, so that a
voter never sees the label of the text that it votes on; near copies of a text
count once. Pattern voters look at shouting, repeated marks and drawn-out
letters, and the stored label is a voter like the others. A generative label
model explains the votes by one hidden class: EM estimates how often each voter
fires in either class, which are the accuracies, and the correlations that
remain between voters within a class, which lower the weight of voters that
repeat each other. The posterior can thus overrule a stored label. Entries are
then mined anew from the posterior labels of all folds, and a logistic
regression over them, trained on the posterior, scores every text.

Labels are read from rows that `train` selects, `sample` at most (those with
the smallest hash of doc_id); their texts are written once. Null and empty texts
get the score of a text without hits. Several labels of a document count as the
largest. Repeated rows give repeated results; rows without doc_id are scored
but never learnt from. Without toxic labels every score is 0. An empty table
gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import carried, discard, row_and, small_batches, uncarried, written

PREFIXES = (4, 5, 6)
#: Kinds of entries: words, their beginnings, pairs of words.
FAMILIES, FOLDS = 2 + len(PREFIXES), 2
#: Voters: lists of words, then beginnings, pairs, shouting, repeated marks, drawn-out letters, the stored label.
LISTS = 4
VOTERS = LISTS + 6
#: Standard deviations by which an entry's toxic texts exceed chance, and how many there are at least; words of the runs that tell near copies.
BEYOND, LEAST, RUN = 4.0, 4, 3
SLICE = 1 << 19


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, word beginnings and word pairs of each row, their rows and their families."""
    starts, ends, ranges = K.words(data, offsets, K.ALNUM_WORDS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(ranges))
    hashes, rows = [K.span_hashes(data, starts, ends)], [row]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(K.mix64(K.span_hashes(data, starts[long], starts[long] + n) + K.U64(n)))
        rows.append(row[long])
    beside = row[1:] == row[:-1]
    hashes.append(K.mix64(K.gram_hashes(hashes[0], 2)[beside] + K.U64(2)))
    rows.append(row[1:][beside])
    family = np.repeat(np.arange(FAMILIES), [len(h) for h in hashes])
    return np.concatenate(hashes), np.concatenate(rows), family


def _marks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by pattern voters: shouting; repeated marks; drawn-out letters."""
    upper = (raw >= 0x41) & (raw <= 0x5A)
    lower = (raw >= 0x61) & (raw <= 0x7A)
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    twice = same & np.isin(raw, [0x21, 0x3F, 0x2A])
    drawn = same & (upper | lower)
    drawn[1:] &= same[:-1]
    u, low, t, d = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (upper, lower, twice, drawn))
    return np.stack([u > low + 10, t >= 3, d >= 1], 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the smallest hash of their runs of words, which near copies share as often as they share runs."""
    for batch in batches:
        least = []
        for _, _, data, offsets in K.text_slices(batch, "text", SLICE):
            data = K.LOWER[data]
            starts, ends, ranges = K.words(data, offsets, K.ALNUM_WORDS)
            values = K.span_hashes(data, starts, ends)
            for s, e in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
                least.append(int(K.signed(K.gram_hashes(values[s:e], min(RUN, max(e - s, 1)))).min(initial=np.iinfo(np.int64).max)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "copy"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by family, fold and label, summed for each slice."""
    for batch in batches:
        toxic, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        for lo, hi, data, offsets in K.text_slices(batch, "text", SLICE):
            h, row, family = _features(K.LOWER[data], offsets)
            part = fold[lo:hi][row]
            order = np.lexsort((row, part, h))
            h, row, family, part = h[order], row[order], family[order], part[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, bad, family, part = h[new], toxic[lo:hi][row[new]] == 1, family[new], part[new]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(first)
            total = np.diff(np.append(at, len(h)))
            tox = np.add.reduceat(bad, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(h[at])), pa.array(family[at].astype(np.int32)), pa.array(part[at].astype(np.int32)), pa.array(tox), pa.array(total - tox)], ["feature", "family", "fold", "toxic", "clean"])


def _hits(lexicon: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of each distinct lexicon entry in each row."""
    if not len(lexicon):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, row, _ = _features(data, offsets)
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    ok = lexicon[at] == h
    pair = np.unique(row[ok].astype(np.int64) * len(lexicon) + at[ok])
    return pair // len(lexicon), pair % len(lexicon)


def _vote(lexicon: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in K.text_slices(batch, "text", SLICE):
                row, entry = _hits(lexicon, K.LOWER[raw], offsets)
                marks = _marks(raw, offsets)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                entries = [entry[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in (0, 2, 3)), pa.array(entries, pa.list_(pa.int32())), pa.array([x.tolist() for x in marks], pa.list_(pa.bool_()))], ["doc_id", "toxic", "fold", "entries", "marks"])

    return rows


def list_of(feature: np.ndarray, family: np.ndarray) -> np.ndarray:
    """The voter of each entry: words by their hash, beginnings, pairs."""
    return np.where(family == 0, (feature.view(K.U64) % K.U64(LISTS)).astype(int), np.where(family < FAMILIES - 1, LISTS, LISTS + 1))


def votes_of(entries: list[np.ndarray], fold: np.ndarray, voter: np.ndarray, mined: np.ndarray, marks: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Texts by voters: which fire. voter: that of each entry; mined: entries by folds, where each was found."""
    v = np.zeros((len(entries), VOTERS), bool)
    elsewhere = mined.sum(1)[:, None] > mined  # entries by folds: found in another one
    for i, e in enumerate(entries):
        v[i, voter[e[elsewhere[e, fold[i]]]]] = True
    v[:, LISTS + 2 : LISTS + 5] = marks
    v[:, LISTS + 5] = toxic
    return v


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # P(a voter fires) by class (clean, toxic) and voter
    share: np.ndarray  # what correlated voters keep of their weight

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) from the votes, those that don't fire included."""
        yes = np.log(self.fires[1] / self.fires[0]) * self.share
        no = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.share
        logit = np.log(self.prior / (1 - self.prior)) + votes @ yes + ~votes @ no
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _model(v: np.ndarray, p: np.ndarray, share: np.ndarray) -> LabelModel:
    """What the votes say if the texts are toxic with these probabilities."""
    prior = float(np.clip((p.sum() + 1) / (len(p) + 2), 1e-3, 1 - 1e-3))
    sides = np.stack([1 - p, p])
    return LabelModel(prior, (sides @ v + 0.5) / (sides.sum(1)[:, None] + 1.0), share)


def _shares(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One over one and the correlations that a voter has with others within a class, where they are no noise."""
    together = np.zeros((v.shape[1],) * 2)
    for q in (1 - p, p):
        weight = q / max(q.sum(), 1e-9)
        d = (v - weight @ v) * np.sqrt(weight)[:, None]
        cov = d.T @ d
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        together = np.maximum(together, np.abs(cov / scale / scale[:, None]) * (scale > 1e-3) * (scale > 1e-3)[:, None])
    np.fill_diagonal(together, 0)
    return 1 / (1 + np.where(together > 0.3, together, 0).sum(1))


def fit_label_model(votes: np.ndarray, rounds: int = 30, correlated: bool = True) -> tuple[LabelModel, np.ndarray]:
    """EM over the votes; it begins with half a say of the stored label and half of any lexicon voter.

    The classes are found first; voters that fire together within them more often
    than chance then share their weight, and EM goes on with that. Returns the
    model and the posterior of each text.
    """
    v = votes.astype(float)
    p, share = np.clip(0.5 * v[:, -1] + 0.5 * v[:, : LISTS + 2].max(1), 0.05, 0.95), np.ones(v.shape[1])
    for again in (False, True)[: 1 + correlated]:
        share = _shares(v, p) if again else share
        for _ in range(rounds):
            model = _model(v, p, share)
            p = model.posterior(votes)
    return model, p


def fit_linear(entries: list[np.ndarray], size: int, target: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels: weights of the lexicon's entries, then the intercept."""
    row = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    col = np.concatenate([np.asarray(e, int) for e in entries]) if len(row) else np.zeros(0, int)
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, w[col], len(entries)) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(entries)
        g = np.append(np.bincount(col, r[row], size), r.sum()) + ridge * np.append(w[:-1], 0)
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def _score(lexicon: np.ndarray, weights: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, raw, offsets in K.text_slices(batch, "text", SLICE):
                row, entry = _hits(lexicon, K.LOWER[raw], offsets)
                z = np.bincount(row, weights[:-1][entry], hi - lo) + weights[-1]
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    return rows


def _mined(learn: DataFrame, by: list[str], precision: float) -> list:
    """Rows (feature, family, and by) of the features whose toxic texts exceed chance: LEAST at least, a share of precision, and BEYOND deviations."""
    base = {tuple(r)[:-2]: (r.bad, r.n) for r in learn.groupBy(*by).agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for k, (bad, n) in base.items():
        here = F.lit(True)
        for c, x in zip(by, k, strict=True):
            here = here & (F.col(c) == x)
        rate = F.when(here, bad / n).otherwise(rate)
    counted = learn.mapInArrow(_count, "feature long, family int, fold int, toxic long, clean long").groupBy("feature", "family", *by).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n, bad = F.col("toxic") + F.col("clean"), F.col("toxic")
    beyond = bad - n * rate >= BEYOND * F.sqrt(n * rate * (1 - rate))
    return counted.where((bad >= LEAST) & (bad >= precision * n) & beyond).select("feature", "family", *by).collect()


def _in_order(rows: list) -> np.ndarray:
    return np.array(sorted({r.feature for r in rows}, key=lambda x: x % (1 << 64)), np.int64)


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int, precision: float) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon's entries and their weights, the intercept last."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(train)
    chosen = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    learn = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    learn = written(learn.mapInArrow(_sketch, "doc_id long, text string, toxic int, fold int, copy long"), "learn")
    ones = learn.groupBy("copy").agg(F.min("doc_id").alias("doc_id"))
    once = lambda df: df.join(F.broadcast(ones.select("doc_id").distinct()), "doc_id", "left_semi")
    lexicon, weights = np.zeros(0, K.U64), np.array([-40.0])
    if not learn.where("toxic = 1").isEmpty():
        seen_as = "doc_id long, toxic int, fold int, entries array<int>, marks array<boolean>"
        rows = _mined(once(learn), ["fold"], precision)
        features = _in_order(rows)
        place = {x: i for i, x in enumerate(features.tolist())}
        family, mined = np.zeros(len(features), int), np.zeros((len(features), FOLDS), int)
        for r in rows:
            family[place[r.feature]] = r.family
            mined[place[r.feature], r.fold] = 1
        seen = learn.mapInArrow(_vote(features.view(K.U64)), seen_as).collect()
        votes = votes_of([np.array(r.entries, int) for r in seen], np.array([r.fold for r in seen]), list_of(features, family), mined, np.array([r.marks for r in seen], bool), np.array([r.toxic == 1 for r in seen]))
        _, posterior = fit_label_model(votes)
        # rows of one document differ in their texts at most: the largest posterior speaks for it
        of: dict[int, float] = {}
        for r, x in zip(seen, posterior.tolist(), strict=True):
            of[r.doc_id] = max(of.get(r.doc_id, 0.0), x)
        told = spark.createDataFrame(list(of.items()), "doc_id long, posterior double")
        again = learn.drop("toxic").join(F.broadcast(told), "doc_id").select("doc_id", "text", (F.col("posterior") >= 0.5).cast("int").alias("toxic"), "fold")
        if not again.where("toxic = 1").isEmpty():
            lexicon = _in_order(_mined(once(again), [], precision)).view(K.U64)
            seen = again.mapInArrow(_vote(lexicon), seen_as).collect()
            weights = fit_linear([np.array(r.entries, int) for r in seen], len(lexicon), np.array([of[r.doc_id] for r in seen]))
    discard(learn)
    return lexicon, weights


def with_toxicity(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 20_000, precision: float = 0.7) -> DataFrame:
    """row (the whole row of docs), score, predicted: one row for each row of docs, in one pass without a shuffle.

    labels: doc_id, toxic; train: which labels may be learnt from, in terms of
    doc_id; sample: how many of them at most, which bounds the lexicon too;
    precision: least share of toxic texts among those with a lexicon entry.
    """
    lexicon, weights = fit(docs, labels, train, sample, precision)
    return carried(docs).mapInArrow(_score(lexicon, weights), row_and(docs, "score double, predicted int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, **parameters) -> DataFrame:
    """doc_id, score, predicted of each document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_toxicity(ids, labels, train, **parameters).select("row.doc_id", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, train: Column, **parameters) -> DataFrame:
    """The rows of docs that aren't called toxic, with all their columns."""
    return uncarried(with_toxicity(docs, labels, train, **parameters).where("predicted = 0"))
