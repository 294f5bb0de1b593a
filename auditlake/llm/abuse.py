"""Problem 10: abusive, hateful, threatening or sexual passages, by multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.codes import BASES, codepoints, mix, powers
from auditlake.session import spread, written

_U = np.uint64
BITS = 18
#: Labelled rows, one a document and reviewer, that the model is fitted on at most (those of the smallest hashes).
SAMPLE_LABELS = 16_000
#: Characters handled at once; longer texts are handled in windows cut at white space.
WINDOW_CHARS = 1 << 19

#: Words that start with a positive weight, before labels are seen.
PRIOR_WORDS = (
    "idiot moron imbecile cretin retard scumbag asshole bastard bitch whore slut wanker dumbass dimwit loser swine vermin subhuman "
    "fuck fucked fucking shit cunt porn nude nudes naked horny pussy cock tits blowjob anal milf masturbate strangle hanged "
    "arschloch fresse verpiss hurensohn ficken nackte abschaum connard salope ordure foutre gueule vermine crétin baisent "
    "mierda puto puta imbécil desnudas follando cerdo mueras"
).split()
PRIOR_WEIGHT = 1.5
#: A sentence below this score counts as none of a document's passages; else many harmless ones add up in long texts.
PASSAGE = 0.4
#: Share of a feature's log-odds over documents that its weight starts from.
HOLD = 1.0
#: Log-odds up to this size, beyond their standard error, count as none: sentences of many ordinary words would else add them up.
SLACK = 0.7

#: Characters written instead of a letter.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
MASKS = "*#%@$"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: the letter it stands for (0: none); and a mask of 1 letter, 2 space, 4 line break, 8 end mark, 16 mask mark."""
    stands = np.zeros(0x110000, np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            stands[c], kind[c] = ord(ch.lower()[0]), 1
        elif ch.isspace():
            kind[c] = 2 | 4 * (ch in "\n\r  ")
    for a, b in LEET.items():
        stands[ord(a)] = ord(b)
    for c in ".!?…。":
        kind[ord(c)] |= 8
    for c in MASKS:
        kind[ord(c)] |= 16
    return stands, kind


@cache
def _char_hash() -> np.ndarray:
    stands, _ = _tables()
    return np.where(stands > 0, mix(stands.astype(_U)), _U(0))


_NUMBER, _MASKED = _U(11), _U(13)


def _feature(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> _U(64 - BITS)).astype(np.int32)


def word_feature(word: str) -> int:
    """The unigram feature of a plain word."""
    return int(features([word])[2][0])


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences and their features: text of each sentence, sentence and id of each feature, first and last character of each sentence.

    Words are runs without white space; marks within them are skipped (s-h-y is shy), digits and signs stand for
    letters, letters repeated three times or more count once; a word with several mask signs also has the feature
    'masked'. Features are words, pairs of neighbours and pairs with one word between, within a sentence.
    """
    stands, kind = _tables()
    cp, starts = codepoints(texts)
    kinds = kind[cp]
    where = np.flatnonzero((kinds & 2) == 0)
    none = np.zeros(0, np.int64)
    if not len(where):
        return none, none, none.astype(np.int32), none, none
    owner = np.searchsorted(starts, where, "right") - 1
    first = np.append(True, (np.diff(where) > 1) | (np.diff(owner) > 0))
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(where))
    # Three or more single letters in a row are one spaced-out word.
    single = np.concatenate([[False], (end - begin == 1) & (kinds[where[begin]] & 1 > 0), [False]])
    up, down = np.flatnonzero(single[1:] & ~single[:-1]), np.flatnonzero(~single[1:] & single[:-1])
    for a, b in zip(up[down - up >= 3].tolist(), down[down - up >= 3].tolist(), strict=True):
        inner = np.arange(a + 1, b)
        first[begin[inner[owner[begin[inner]] == owner[begin[a]]]]] = False
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(where))
    letter = stands[cp[where]]
    # Of three or more equal letters in a row only the first stays.
    token = np.cumsum(first)
    used = np.flatnonzero(letter)
    same = np.append(False, (letter[used][1:] == letter[used][:-1]) & (token[used][1:] == token[used][:-1]))
    run = np.flatnonzero(~same)
    size = np.diff(np.append(run, len(used)))
    long_run = np.repeat(size >= 3, size)
    used = used[~(long_run & same)]
    count = np.bincount(token[used] - 1, minlength=len(begin))
    edge = np.append(0, np.cumsum(count))
    nth = np.arange(len(used)) - np.repeat(edge[:-1], count)
    total = np.zeros(len(used) + 1, _U)
    np.cumsum(_char_hash()[cp[where[used]]] * powers(BASES[0], int(nth.max(initial=0)) + 1)[nth], out=total[1:])
    h = mix(total[edge[1:]] - total[edge[:-1]])
    letters = np.add.reduceat(kinds[where] & 1, begin, dtype=np.int64)
    inner = ~first & ~np.append(first[1:], True)  # marks around a word are emphasis
    masks = np.add.reduceat(((kinds[where] & 16) >> 4) * inner, begin, dtype=np.int64)
    h = np.where(letters > 0, h, _NUMBER)
    masked = (letters >= 1) & (masks >= 2)
    # Sentences end at a word's closing mark, a line break or the text's end.
    closes = (kinds[where[end - 1]] & 8) > 0
    breaks = np.append(0, np.cumsum((kinds & 4) > 0))
    gap = breaks[where[begin[1:]]] > breaks[where[end[:-1] - 1]]
    new = np.append(True, closes[:-1] | gap | (owner[begin[1:]] != owner[begin[:-1]]))
    sentence = np.cumsum(new) - 1
    s_begin = np.flatnonzero(new)
    s_end = np.append(s_begin[1:], len(begin)) - 1
    kept = np.flatnonzero(count > 0)
    hk, sk = h[kept], sentence[kept]
    parts_s, parts_f = [sk], [_feature(hk)]
    for step, salt in ((1, 3), (2, 5)):
        ok = sk[step:] == sk[:-step]
        parts_s.append(sk[step:][ok])
        parts_f.append(_feature((hk[:-step] * _U(salt) + mix(hk[step:]))[ok]))
    extra = sentence[masked]
    parts_s.append(extra)
    parts_f.append(np.full(len(extra), _feature(np.array([_MASKED]))[0], np.int32))
    own = owner[begin[s_begin]]
    return own, np.concatenate(parts_s), np.concatenate(parts_f), where[begin[s_begin]] - starts[own], where[end[s_end] - 1] + 1 - starts[own]


def _windows(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    while at < len(text):
        stop = min(len(text), at + WINDOW_CHARS)
        if stop < len(text):
            cut = max(text.rfind(c, at, stop) for c in " \n\t")
            stop = cut + 1 if cut > at else stop
        yield at, text[at:stop]
        at = stop


def _slices(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    owners: list[int] = []
    offsets: list[int] = []
    parts: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for at, part in _windows(text) if text else ():
            if parts and size + len(part) > WINDOW_CHARS:
                yield owners, offsets, parts
                owners, offsets, parts, size = [], [], [], 0
            owners.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, offsets, parts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Sentence weights; a document's score is the noisy-or of its sentences that score PASSAGE or more."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentences(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, score, first and last character of each sentence."""
        own, s, f, a, b = features(texts)
        z = self.bias + np.bincount(s, self.weights[f], minlength=len(own))
        return own, _sigmoid(z), a, b

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        clean = np.zeros(len(texts))
        for owners, _, parts in _slices(texts):
            own, p, _, _ = self.sentences(parts)
            np.add.at(clean, np.asarray(owners)[own], np.log1p(-np.where(p >= PASSAGE, np.minimum(p, 1 - 1e-9), 0.0)))
        return 1 - np.exp(clean)


def _start(prior: np.ndarray, yes: np.ndarray, seen: np.ndarray, base: float) -> np.ndarray:
    """Weights to start from: the prior's and each feature's log-odds over documents, less one standard error and SLACK."""
    rate = (yes + 2 * base) / (seen + 2)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    error = np.sqrt(1 / (yes + 2 * base) + 1 / (seen - yes + 2 * (1 - base)))
    return prior + HOLD * np.sign(odds) * np.maximum(np.abs(odds) - error - SLACK, 0)


def _base(target: np.ndarray) -> float:
    return float(np.clip(target.mean(), 0.02, 0.5)) if len(target) else 0.02


def _descend(own: np.ndarray, s: np.ndarray, at: np.ndarray, prior: np.ndarray, target: np.ndarray, docs: np.ndarray, bias: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias fitted on the documents ``docs`` (a mask) by gradient steps on the noisy-or likelihood."""
    use = docs[own[s]]
    s, at = s[use], at[use]
    n, m = len(target), len(prior)
    # Weights are held to where they start from: passages that share a document with worse ones would else be explained away.
    pairs = np.unique(own[s].astype(np.int64) * m + at)
    w0 = _start(prior, np.bincount(pairs % m, target[pairs // m], minlength=m), np.bincount(pairs % m, minlength=m), _base(target[docs]))
    w = w0.copy()
    mine = docs[own]
    square, square_bias = np.full(m, 1e-6), 1e-6
    for _ in range(epochs):
        p = _sigmoid(bias + np.bincount(s, w[at], minlength=len(own)))
        clean = np.exp(np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))
        score = np.clip(1 - clean, 1e-6, 1)
        grad = np.where(mine, p * (target * (1 - score) / score - (1 - target))[own], 0.0)
        g = np.bincount(at, grad[s], minlength=m) - 0.2 * (w - w0)
        gb = grad.sum()
        square += g * g
        square_bias += gb * gb
        w = w + 0.2 * g / np.sqrt(square + 1.0)
        bias = bias + 0.2 * gb / np.sqrt(square_bias)
    return w, bias


@cache
def prior_weights() -> np.ndarray:
    weights = np.zeros(1 << BITS)
    for word in PRIOR_WORDS:
        weights[word_feature(word)] = PRIOR_WEIGHT
    return weights


def informative(yes: np.ndarray, seen: np.ndarray, base: float) -> np.ndarray:
    """A mask of the features that start with a weight; the others of a corpus never get one."""
    return _start(prior_weights(), yes, seen, base) != 0


def _noisy_or(own: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))


def fit_features(n: int, own: np.ndarray, s: np.ndarray, f: np.ndarray, votes: pd.DataFrame, epochs: int = 20) -> Model:
    """The model of ``n`` labelled documents: own is the document of each sentence, (s, f) sentence and feature of each occurrence.

    Reviewers err, so votes are checked first: each half of the documents is scored by a model of the other half;
    a reviewer's reliability is how often the votes agree with those scores, and a document's target is the
    posterior of its votes and its score, which counts as far as the scores agree with the votes beyond chance. The model is then
    fitted on all. One rule holds for few and many labels. No votes: the prior's model.
    """
    weights, bias = prior_weights().copy(), -4.5
    votes = votes.dropna(subset=["abusive"])
    if votes.empty or not len(s):
        return Model(weights, bias)
    text_of, yes = votes["text"].to_numpy(), votes["abusive"].to_numpy() > 0.5
    reviewer, _ = pd.factorize(votes["reviewer"].fillna(""))
    target = np.bincount(text_of, yes, minlength=n) / np.maximum(1, np.bincount(text_of, minlength=n))
    ids, at = np.unique(f, return_inverse=True)
    at = at.astype(np.int32)
    prior = weights[ids]
    half = np.arange(n) % 2 == 0
    score = np.zeros(n)
    for docs in (half, ~half):
        if docs.any():
            w, b = _descend(own, s, at, prior, target, docs, bias, epochs)
            score = np.where(docs, score, _noisy_or(own, _sigmoid(b + np.bincount(s, w[at], minlength=len(own))), n))
    said = score[text_of] > 0.5
    right = np.bincount(reviewer, said == yes) + 18
    rate = np.clip(right / (np.bincount(reviewer) + 20), 0.6, 0.98)
    chance = said.mean() * yes.mean() + (1 - said.mean()) * (1 - yes.mean())
    trust = float(np.clip(((said == yes).mean() - chance) / max(1 - chance, 1e-9), 0, 1))
    score = np.clip(score, 0.03, 0.97)
    logit = np.bincount(text_of, np.where(yes, 1, -1) * np.log(rate / (1 - rate))[reviewer], minlength=n) + trust * np.log(score / (1 - score))
    weights[ids], bias = _descend(own, s, at, prior, np.clip(1.6 * _sigmoid(logit) - 0.3, 0, 1), np.ones(n, bool), bias, epochs)
    return Model(weights, bias)


def _sentence_features(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, features) of each sentence, slice by slice."""
    for owners, _, parts in _slices(texts):
        own, s, f, _, _ = features(parts)
        order = np.argsort(s, kind="stable")
        edges = np.searchsorted(s[order], np.arange(len(own) + 1))
        for k in range(len(own)):
            yield owners[int(own[k])], f[order[edges[k] : edges[k + 1]]]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_labels: int = SAMPLE_LABELS) -> Model:
    """The model of at most ``sample_labels`` labelled rows, those of the smallest hash of document and reviewer.

    Several labels of one reviewer for a document count as one, their majority. Executors turn the sampled documents'
    texts into sentences of hashed features; what the driver gets are the sample's labels, counts of features
    (a table of fixed size), and the sampled sentences' informative features, never a text.
    """
    votes = labels.where(F.col("abusive").isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col("reviewer").cast("string").alias("reviewer"), F.col("abusive").cast("int").alias("abusive"))
    votes = votes.groupBy("d", "reviewer").agg(F.avg("abusive").alias("abusive")).orderBy(F.xxhash64("d", "reviewer"), "d", "reviewer").limit(sample_labels).toPandas()
    spark = docs.sparkSession
    labelled = np.unique(votes["d"].to_numpy(np.int64))
    sample = spark.createDataFrame(pd.DataFrame({"d": labelled}), "d long")  # at most sample_labels ids
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")).join(F.broadcast(sample), "d").groupBy("d").agg(F.min("t").alias("t"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), list(_sentence_features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.int32()))], ["d", "f"])

    sentences = written(texts.mapInArrow(featured, "d long, f array<int>"), "sentences")
    share = votes.groupby("d")["abusive"].apply(lambda v: float((v > 0.5).mean()))
    target = spark.createDataFrame(pd.DataFrame({"d": share.index.to_numpy(np.int64), "y": share.to_numpy(float)}), "d long, y double")
    counts = sentences.select("d", F.explode("f").alias("f")).distinct().join(F.broadcast(target), "d").groupBy("f").agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("seen")).toPandas()
    yes, seen = np.zeros(1 << BITS), np.zeros(1 << BITS)
    yes[counts["f"]], seen[counts["f"]] = counts["yes"], counts["seen"]
    wanted = spark.sparkContext.broadcast(np.packbits(informative(yes, seen, _base(share.to_numpy(float)))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy()
            keep = mask[flat]
            left = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
            some = left > 0
            edges = np.append(0, np.cumsum(left[some])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat[keep]))], ["d", "f"])

    rows = sentences.mapInArrow(pick, "d long, f array<int>").toArrow().combine_chunks()
    place = {int(d): k for k, d in enumerate(labelled)}
    found = pd.DataFrame({"d": rows["d"].to_numpy(), "k": np.arange(len(rows))}).sort_values(["d", "k"], kind="stable")
    own = np.searchsorted(labelled, found["d"].to_numpy(np.int64))
    lists = rows["f"].combine_chunks().take(pa.array(found["k"].to_numpy())) if len(rows) else pa.array([], pa.list_(pa.int32()))
    s = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    votes["text"] = [place[int(d)] for d in votes["d"]]
    return fit_features(len(labelled), own.astype(np.int32), s.astype(np.int32), lists.flatten().to_numpy(), votes)


def fit(texts: Sequence[str], votes: pd.DataFrame, epochs: int = 20) -> Model:
    """train() of texts at hand; ``votes`` has text (index), reviewer and abusive (0 or 1)."""
    found = list(_sentence_features(texts))
    own = np.array([k for k, _ in found], np.int64)
    size = np.array([len(f) for _, f in found], np.int64)
    flat = np.concatenate([f for _, f in found]) if found else np.zeros(0, np.int32)
    share = votes.dropna(subset=["abusive"]).groupby("text")["abusive"].mean()
    pairs = np.unique(np.repeat(own, size) << BITS | flat) if len(flat) else np.zeros(0, np.int64)
    pairs = pairs[np.isin(pairs >> BITS, share.index.to_numpy())]
    feature = pairs & ((1 << BITS) - 1)
    y = share.reindex(pairs >> BITS).to_numpy(float)
    mask = informative(np.bincount(feature, y, minlength=1 << BITS), np.bincount(feature, minlength=1 << BITS), _base(share.to_numpy(float)))
    keep = mask[flat]
    s = np.repeat(np.arange(len(own)), size)[keep]
    _, s = np.unique(s, return_inverse=True)
    return fit_features(len(texts), own[np.unique(np.repeat(np.arange(len(own)), size)[keep])], s, flat[keep], votes, epochs)


def _broadcast(spark: SparkSession, model: Model):
    return spark.sparkContext.broadcast(model)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, score) of every document: the noisy-or of its sentences that could be a passage.

    Null and empty texts score 0; very long texts are scored whole, in windows; repeated rows give one row each;
    other columns are ignored. One pass without a shuffle.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(text).cast("string").alias("__text__"))
    fields = [f for f in source.schema.fields if f.name != "__text__"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    shared = _broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = shared.value.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(result)], [f.name for f in fields] + ["score"])

    return spread(source).mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, begin, finish, score, sentence) of every sentence that scores ``least`` or more; offsets in characters."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    shared = _broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for owners, offsets, parts in _slices(texts):
                own, p, a, b = shared.value.sentences(parts)
                for k in np.flatnonzero(p >= least).tolist():
                    part = int(own[k])
                    rows.append((ids[owners[part]], int(a[k]) + offsets[part], int(b[k]) + offsets[part], round(float(p[k]), 6), parts[part][a[k] : b[k]]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "begin", "finish", "score", "sentence"])

    return spread(source).mapInArrow(run, "doc_id long, begin long, finish long, score double, sentence string")
