"""Operator 12, toxicity by a linear-chain conditional random field.

Tokens are tagged clean or toxic.  The field's features are a word and its
beginnings; its chain ties neighbouring tags.  It is trained on labelled tokens in
windows, by the exact gradient of the likelihood; forward-backward marginals are
added up over a document, and a logistic curve fitted on labelled documents that
the field has not seen turns the sum into a score.  Offending spans come with
their places in the text (code points) and probabilities.

Where only whole documents are labelled, tokens get their labels from those: in a
toxic document the tokens whose features tell toxic from clean documents best are
toxic, all others, and all tokens of clean documents, are clean.

Learning reads at most about ``SAMPLE`` documents of each label, chosen by hash,
and ``WINDOWS`` windows of theirs; every text is counted once however often it is
repeated.  Scoring reads whole texts, and its cost does not depend on the sample.

Defined cases: null and empty texts have no tokens and the score of such texts;
labels that are null or contradict each other are left out; with one label only,
every score is that label, and without any it is 0; rows that repeat are scored
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, growing, load, scan, stored
from .langid import fold

#: Documents of each label and windows that the model is fitted on, about.
SAMPLE, WINDOWS = 10_000, 60_000
#: Tokens of a window.
WIDTH = 16
#: Toxic documents in which a feature must occur, and its least evidence.
LEAST, EVIDENCE = 3, 8.0
#: Share of the best evidence in its document that makes a token toxic.
SHARE = 0.4
#: Steps, step size and ridge of the training.
STEPS, RATE, RIDGE = 150, 0.2, 0.1
#: Tokens without features between two others that are looked at one by one.
NEAR = 3
#: Words whose emissions a task remembers.
REMEMBERED = 500_000

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word in lower case, and its beginnings of three to six letters."""
    low = word.lower()
    return ["=" + low, *(low[:k] for k in range(3, min(6, len(low)) + 1))]


# -- labelled documents and tokens ----------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, size: int) -> DataFrame:
    """``(_text, _label, _part)``: about ``size`` distinct texts of each label.
    The labels are chosen by hash from their own table, so only the chosen keys,
    not texts, meet the documents; ``_part`` is 0 for a fourth that tests."""
    given = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    given = given.groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")
    numbers = {r["_label"]: r["count"] for r in given.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, size / max(1, numbers.get(1, 0))).otherwise(size / max(1, numbers.get(0, 0)))
    drawn = F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    # At most about 2 * size keys: small enough to be sent to every task.
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(given.where(drawn)), "_key")
    found = found.where("_text is not null").groupBy(F.xxhash64("_text").alias("_hash"), "_text").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most"))
    return found.where("_label = _most").select("_text", "_label", F.pmod("_hash", F.lit(4)).cast("int").alias("_part"))


def evidence(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """How strongly a feature speaks for a toxic document: twice the gain in log
    likelihood of its own rates in toxic and clean documents over one rate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
        held = (Counter(), Counter())
        for text, label in scan(batches, "_text", "_label"):
            held[label].update({f for word in set(WORD.findall(text)) for f in features(word)})
            if len(held[0]) + len(held[1]) > REMEMBERED:
                yield from emit(((f, n * side, n * (1 - side)) for side in (0, 1) for f, n in held[side].items()), schema)
                held = (Counter(), Counter())
        yield from emit(((f, n * side, n * (1 - side)) for side in (0, 1) for f, n in held[side].items()), schema)

    rows = sample.select("_text", "_label").mapInArrow(count, "feature string, a long, b long")
    a, b = F.col("a"), F.col("b")
    log = lambda n, of, rest, all_: F.when(n > 0, n * F.log(n * all_ / (of * rest))).otherwise(0.0)
    gain = 2 * (log(a, a + b, F.lit(toxic), F.lit(toxic + clean)) + log(b, a + b, F.lit(clean), F.lit(toxic + clean)))
    summed = rows.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((a >= LEAST) & (a * clean > 2 * b * toxic))
    return {r["feature"]: r["gain"] for r in summed.select("feature", gain.alias("gain")).where(F.col("gain") >= EVIDENCE).collect()}


def windows_of(sample: DataFrame, known: dict[str, float]) -> DataFrame:
    """Labelled tokens in windows: ``(tags, sizes, features)`` with the number of
    features of each token and all features in a row.  A text gives the windows
    that hold a feature, or its first one."""
    ids = {f: i for i, f in enumerate(known)}
    sent = sample.sparkSession.sparkContext.broadcast((ids, known))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gain = sent.value
        schema = pa.schema([("tags", pa.list_(pa.int8())), ("sizes", pa.list_(pa.int8())), ("features", pa.list_(pa.int32()))])

        def rows() -> Iterator[tuple]:
            for text, label in scan(batches, "_text", "_label"):
                words = WORD.findall(text)
                held = [[f for f in features(w) if f in number] for w in words]
                strength = [max((gain[f] for f in own), default=0.0) for own in held]
                bar = SHARE * max(strength, default=0.0)
                chosen = sorted({i // WIDTH for i, own in enumerate(held) if own}) or [0]
                for w in chosen:
                    at = slice(w * WIDTH, (w + 1) * WIDTH)
                    if held[at]:
                        yield ([int(label == 1 and 0 < s >= bar) for s in strength[at]], [len(x) for x in held[at]], [number[f] for x in held[at] for f in x])

        yield from emit(rows(), schema)

    return sample.select("_text", "_label").mapInArrow(cut, "tags array<byte>, sizes array<byte>, features array<int>")


# -- the field ---------------------------------------------------------------


def forward_backward(emission: np.ndarray, length: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of padded sequences (rows): the marginals of the toxic tag, the marginals
    of neighbouring tags added up (2 x 2), and the summed log partition.

    ``emission`` is the log potential of a toxic tag against a clean one,
    ``chain`` that of a tag after a tag."""
    n, width = emission.shape
    both = np.stack((np.zeros_like(emission), emission), axis=2)
    ahead, back = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    ahead[:, 0] = both[:, 0]
    for t in range(1, width):
        ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + chain[0], ahead[:, t - 1, 1:] + chain[1]) + both[:, t]
    for t in range(width - 2, -1, -1):
        after = both[:, t + 1] + back[:, t + 1]
        step = np.logaddexp(chain[:, 0] + after[:, :1], chain[:, 1] + after[:, 1:])
        back[:, t] = np.where((t + 1 < length)[:, None], step, 0.0)
    last = ahead[np.arange(n), length - 1]
    partition = np.logaddexp(last[:, 0], last[:, 1])
    inside = np.arange(width) < length[:, None]
    marginal = np.where(inside, np.exp(ahead[:, :, 1] + back[:, :, 1] - partition[:, None]), 0.0)
    joint = ahead[:, :-1, :, None] + chain + (both + back)[:, 1:, None, :] - partition[:, None, None, None]
    joint = np.where(inside[:, 1:, None, None], np.exp(np.minimum(joint, 0.0)), 0.0).sum(axis=(0, 1))
    return marginal, joint, float(partition.sum())


def fit_field(tags: list[np.ndarray], sizes: list[np.ndarray], held: list[np.ndarray], n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the features, the bias of the toxic tag and the chain, by
    gradient steps with a moving scale per weight (Adam) on the ridged likelihood."""
    n, width = len(tags), max(map(len, tags))
    length = np.array([len(x) for x in tags])
    inside = np.arange(width) < length[:, None]
    tag = np.zeros((n, width))
    tag[inside] = np.concatenate(tags)
    token = np.repeat(np.arange(n * width).reshape(n, width)[inside], np.concatenate(sizes))
    feature = np.concatenate(held).astype(np.int64)
    pairs = np.zeros((2, 2))
    both = tag.astype(np.int64)
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = ((both[:, :-1] == a) & (both[:, 1:] == b) & inside[:, 1:]).sum()
    weight = np.zeros(n_features + 5)  # the features, the bias, the chain
    weight[n_features] = -2.0
    mean, scale = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        emission = np.bincount(token, weight[feature], n * width).reshape(n, width) + weight[n_features]
        marginal, joint, _ = forward_backward(np.where(inside, emission, 0.0), length, weight[-4:].reshape(2, 2))
        wrong = (marginal - tag) * inside
        slope = RIDGE * weight
        slope[:n_features] += np.bincount(feature, wrong.ravel()[token], n_features)
        slope[n_features] += wrong.sum()
        slope[-4:] += (joint - pairs).ravel()
        mean = 0.9 * mean + 0.1 * slope
        scale = 0.99 * scale + 0.01 * slope**2
        weight -= RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-9)
    return weight[:n_features], float(weight[n_features]), weight[-4:].reshape(2, 2)


class _Emissions(dict):
    """The summed feature weights of a word; None without a known feature."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float | None:
        if len(self) > REMEMBERED:
            self.clear()
        own = [self.weights[f] for f in features(word) if f in self.weights]
        self[word] = found = sum(own) if own else None
        return found


@dataclass
class Model:
    """``certain`` is the score of every text where only one label was seen."""

    weights: dict[str, float]
    bias: float
    chain: np.ndarray
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    certain: float | None = None

    def __post_init__(self) -> None:
        # A run of k tokens without features is the k-th power of one matrix;
        # with its two eigenvalues that is two matrices, whatever k is.
        step = np.exp(self.chain) * np.exp([0.0, self.bias])
        large, small = np.linalg.eigvals(step).real[np.argsort(-np.linalg.eigvals(step).real)]
        main = (step - small * np.eye(2)) / (large - small)
        self.ratio, self.main, self.rest = small / large, main.tolist(), (np.eye(2) - main).tolist()
        self.step = np.exp(self.chain).tolist()

    def _jump(self, tokens: int) -> tuple[float, float, float, float]:
        """From a tag to a tag over ``tokens`` tokens without features and one step."""
        if not tokens:
            return (*self.step[0], *self.step[1])
        r = self.ratio**tokens
        (a, b), (c, d) = [[m + r * x for m, x in zip(p, q)] for p, q in zip(self.main, self.rest)]
        (e, f), (g, h) = self.step
        return (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h)

    def marginals(self, emissions: list[float | None]) -> list[tuple[int, float]]:
        """(place, probability of the toxic tag) of the tokens with features and
        of those between near ones."""
        own = [i for i, x in enumerate(emissions) if x is not None]
        if not own:
            return []
        places = [own[0]]
        for i in own[1:]:
            places += [*range(places[-1] + 1, i), i] if i - places[-1] <= NEAR + 1 else [i]
        toxic = [min(60.0, max(-60.0, self.bias + (emissions[i] or 0.0))) for i in places]
        toxic = np.exp(toxic).tolist()
        # The first place: nothing before it, or tokens of which the first has no chain.
        x, y = self._start(places[0]) if places[0] else (1.0, 1.0)
        jumps = [self._jump(i - j - 1) for j, i in zip(places, places[1:])]
        ahead = []
        for k, bad in enumerate(toxic):
            if k:
                jump = jumps[k - 1]
                x, y = x * jump[0] + y * jump[2], x * jump[1] + y * jump[3]
            y *= bad
            x, y = x / (x + y), y / (x + y)
            ahead.append((x, y))
        out, after = [], len(emissions) - 1 - places[-1]
        x, y = self._end(after)
        for k in range(len(places) - 1, -1, -1):
            clean, bad = ahead[k][0] * x, ahead[k][1] * y
            out.append((places[k], bad / (clean + bad)))
            if k:
                jump = jumps[k - 1]
                y *= toxic[k]
                x, y = jump[0] * x + jump[1] * y, jump[2] * x + jump[3] * y
                x, y = x / (x + y), y / (x + y)
        return out[::-1]

    def _start(self, tokens: int) -> tuple[float, float]:
        """Weights of the tags (chain included) after the first ``tokens`` tokens."""
        first = (1.0, float(np.exp(min(60.0, max(-60.0, self.bias)))))
        jump = self._jump(tokens - 1)
        x, y = first[0] * jump[0] + first[1] * jump[2], first[0] * jump[1] + first[1] * jump[3]
        return x / (x + y), y / (x + y)

    def _end(self, tokens: int) -> tuple[float, float]:
        """What the last ``tokens`` tokens say about the tag before them."""
        if not tokens:
            return 1.0, 1.0
        r = self.ratio**tokens
        x, y = (sum(m + r * z for m, z in zip(p, q)) for p, q in zip(self.main, self.rest))
        return x / (x + y), y / (x + y)

    def score(self, marginals: list[tuple[int, float]], tokens: int) -> float:
        if self.certain is not None:
            return self.certain
        return float(1.0 / (1.0 + np.exp(-np.dot(self.curve, facts(marginals, tokens)))))


def facts(marginals: list[tuple[int, float]], tokens: int) -> tuple[float, float, float]:
    """What a document's score depends on: the expected number of toxic tokens
    and the number of all, as logarithms."""
    return 1.0, float(np.log(sum(p for _, p in marginals) + 0.01)), float(np.log(tokens + 10.0))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps; a document's
    length alone never speaks for a toxic one."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    if w[2] > 0:
        return fit_curve(x * [1, 1, 0], y)
    return tuple(w.tolist())


# -- the operator --------------------------------------------------------------


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", size: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """A model from the documents that ``labels`` calls toxic (1) or clean (0)."""
    sample = stored(labelled_sample(docs, labels, text, key, label, size), "labelled-texts")
    counted = sample.groupBy((F.col("_part") == 0).alias("tests"), "_label").count().collect()
    numbers = {(r["tests"], r["_label"]): r["count"] for r in counted}
    whole = {side for _, side in numbers}
    if len(whole) < 2:
        return Model({}, 0.0, np.array([[0.0, -1.0], [-1.0, 0.0]]), certain=float(1 in whole))
    apart = numbers.get((True, 0), 0) and numbers.get((True, 1), 0) >= 5
    own = sample.where("_part <> 0") if apart else sample
    toxic, clean = (own.where(F.col("_label") == side).count() for side in (1, 0))
    known = evidence(own, toxic, clean)
    cut = stored(windows_of(own, known), "labelled-windows")
    n = cut.count()
    if n > windows:
        cut = cut.where(F.pmod(F.xxhash64("tags", "sizes", "features"), F.lit(1 << 30)) < int(windows / n * (1 << 30)))
    rows = cut.toArrow()
    lists = [[np.array(x, dtype=np.int64) for x in rows.column(c).to_pylist()] for c in ("tags", "sizes", "features")]
    order = sorted(range(len(lists[0])), key=lambda i: tuple(x[i].tobytes() for x in lists))  # whatever order the rows came in
    weights, bias, chain = fit_field(*([x[i] for i in order] for x in lists), len(known))
    model = Model(dict(zip(known, weights.tolist())), bias, chain)
    tested = sample.where("_part = 0") if apart else sample
    seen = _found(tested, model, "_text", ("_label",)).select("_label", "_toxic", "_tokens").toArrow().to_pandas().sort_values(["_label", "_toxic", "_tokens"])
    x = np.stack((np.ones(len(seen)), np.log(seen["_toxic"] + 0.01), np.log(seen["_tokens"] + 10.0)), axis=1)
    model.curve = fit_curve(x, seen["_label"].to_numpy(dtype=np.float64))
    return model


def _found(docs: DataFrame, model: Model, text: str, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, the expected number of toxic tokens, the tokens, the score and
    the offending spans of every row."""
    source = docs.select(*(F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)), F.col(f"`{text}`").alias("_text"))
    own = source.columns[:-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*own).schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        emissions = _Emissions(field.weights)
        for batch in batches:
            found = []
            for (body,) in scan([batch], "_text"):
                words = WORD.findall(body or "")
                said = list(map(emissions.__getitem__, words))
                marginals = field.marginals(said) if said.count(None) < len(said) else []
                spans = _spans(body, marginals)
                found.append((float(sum(p for _, p in marginals)), len(words), field.score(marginals, len(words)), spans))
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else ((),) * 4, (pa.float64(), pa.int64(), pa.float64(), pa.list_(span)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *columns], names=[*own, "_toxic", "_tokens", "_score", "_spans"])

    done = source.mapInArrow(tag, f"{fields + ', ' if own else ''}_toxic double, _tokens long, _score double, _spans array<struct<start:long,end:long,probability:double>>")
    return done.toDF(*keys, "_toxic", "_tokens", "_score", "_spans")


def _spans(body: str | None, marginals: list[tuple[int, float]], least: float = 0.5) -> list[dict]:
    """Neighbouring tokens that are likely toxic, as one span each."""
    wanted = {i: p for i, p in marginals if p >= least}
    out, last = [], -2
    if wanted:
        for i, match in enumerate(WORD.finditer(body)):
            if i in wanted:
                if i == last + 1:
                    out[-1] = {"start": out[-1]["start"], "end": match.end(), "probability": max(out[-1]["probability"], wanted[i])}
                else:
                    out.append({"start": match.start(), "end": match.end(), "probability": wanted[i]})
                last = i
    return out


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``score`` and ``spans`` (start, end and probability of offending
    passages) of every row."""
    found = _found(docs, model, text, keys)
    return found.toDF(*(f"_k{i}" for i in range(len(keys))), "_toxic", "_tokens", "_score", "_spans").select(*(f"_k{i}" for i in range(len(keys))), "_score", "_spans").toDF(*keys, "score", "spans")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    found = score_toxicity(docs, model)
    held: Column = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return found.select("doc_id", held, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"))
