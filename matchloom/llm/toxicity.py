"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The unit is a short string: a chunk between white space without its punctuation and
look-alike digits, a run of single letters put together, or a window of a longer
chunk. Two strings are compared by their common subsequences of three characters,
each weighted by DECAY per character that it spans beyond three, and normalised; so
a letter between, a gap or a lost letter costs little. Landmarks are strings from
labelled sentences; the machine is linear in the kernel values to them, hence its
numerator is one table over subsequences and a string costs a few hundred lookups.

Only documents are labelled. The strings of toxic documents that make them so are
found by how much more often their character runs occur in toxic documents: Spark
counts runs and strings over whole texts, and the driver gets bounded pools of
strings. The machine is then fitted in rounds, each with the clean strings that the
one before scored highest. A document's score is that of its highest string,
calibrated on whole texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from matchloom.llm.common import durable, pick, saved, surely

DECAY = 0.6
ALPHABET = 48
WIDTH = 16
STEP = 5
#: Most characters that a common subsequence may span.
SPAN = 9
#: Decision values below this one are all alike.
FLOOR = -0.9
#: Labelled documents used for fitting, per label.
DOCUMENTS = {1: 1200, 0: 2400}
#: Strings that the machine is fitted on, drawn from all strings of these documents: landmarks, insults, clean strings at first,
#: and the pool of clean strings (those most like insults and as many others) from which each round takes its hard ones.
LANDMARKS = 160
POSITIVES = 1_500
NEGATIVES = 6_000
POOL = 36_000
ROUNDS = 3
#: Least that the third-best run of a string must tell (see fit) for the string to count as an insult.
LEAST_TOLD = 15.0
SURELY_TOLD = 100.0
CUT = 0.3
CACHE = 500_000
#: Look-alikes within words, as text: fixed values.
ALIKE = str.maketrans("013457@$!", "oieastasi")
LETTERS = re.compile(r"[^\W\d_]+")


def units(chunk: str) -> list[str]:
    """The strings of one chunk: its letters in lower case between marks of start and end, cut into windows."""
    low = chunk.lower()
    if not low.isalpha():
        if not LETTERS.search(low):
            return []
        low = "".join(LETTERS.findall(low.strip(".,;:!?\"'()[]{}").translate(ALIKE)))
    word = f"^{low}$"
    if len(word) <= WIDTH:
        return [word]
    return [word[i:i + WIDTH] for i in range(0, len(word) - WIDTH + STEP, STEP)]


def spaced(words: list[str]) -> list[str]:
    """Words spelled with spaces: runs of at least three single letters, put together."""
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
    return out


def chunks(text: str) -> set[str]:
    words = text.split()
    found = set(words)
    if sum(len(w) == 1 for w in found) > 0:
        found.update(spaced(words))
    return found


_CODE = np.array([i - 97 if 97 <= i <= 122 else {94: 26, 36: 27}.get(i, 28 + i % (ALPHABET - 28)) for i in range(128)])


def codes(strings: list[str]) -> np.ndarray:
    """Character codes of strings of one length, one row per string."""
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 28 + points % (ALPHABET - 28)).astype(np.int32)


_AT = np.array([(i, j, k) for i in range(WIDTH) for j in range(i + 1, WIDTH) for k in range(j + 1, min(WIDTH, i + SPAN))])
_WEIGHT = (DECAY ** (_AT[:, 2] - _AT[:, 0] - 2.0)).astype(np.float32)
_BY_LENGTH = [np.flatnonzero(_AT[:, 2] < n) for n in range(WIDTH + 1)]


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subsequences of three characters of strings of one length, and their weights."""
    keep = _BY_LENGTH[rows.shape[1]]
    a, b, c = _AT[keep].T
    return (rows[:, a] * ALPHABET + rows[:, b]) * ALPHABET + rows[:, c], _WEIGHT[keep]


def sizes(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Kernel of each string with itself, square root."""
    if not index.size:
        return np.ones(len(index))
    order = np.argsort(index, axis=1)
    ids, total = np.take_along_axis(index, order, 1), np.cumsum(weight[order].astype(float), axis=1)
    last = np.ones(ids.shape, bool)
    last[:, :-1] = ids[:, 1:] != ids[:, :-1]
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(ids), 1)), np.where(last, total, 0.0)[:, :-1]], axis=1), axis=1)
    return np.sqrt((np.where(last, total - before, 0.0) ** 2).sum(1))


def by_length(strings: list[str], block: int = 2_048):
    """Places and codes of strings, in blocks of one length."""
    lengths = np.array([len(s) for s in strings], int)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), block):
            yield at[i:i + block], codes([strings[k] for k in at[i:i + block]])


def kernel(strings: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel values between two lists."""
    out = np.zeros((len(strings), len(others)))
    blocks = []
    for at, rows in by_length(strings):
        index, weight = subsequences(rows)
        blocks.append((at, index.astype(np.int32), weight, np.maximum(sizes(index, weight), 1e-9)))
    table = np.zeros(ALPHABET ** 3)
    for j, o in enumerate(others):
        own, weight = subsequences(codes([o]))
        np.add.at(table, own[0], weight)
        size = np.sqrt((table[np.unique(own[0])] ** 2).sum()) or 1.0
        for at, index, w, other in blocks:
            out[at, j] = table[index] @ w / (other * size)
        table[own[0]] = 0
    return out


class Machine:
    """A table over subsequences, an intercept and a calibration."""

    def __init__(self, table: np.ndarray, intercept: float) -> None:
        self.table, self.intercept, self.slope, self.shift = table.astype(np.float32), float(intercept), 4.0, -2.0

    def decide(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), FLOOR)
        for at, rows in by_length(strings):
            index, weight = subsequences(rows)
            value = self.table[index] @ weight
            # a string's own kernel is at least that of one whose subsequences all differ
            some = np.flatnonzero(value / np.sqrt((weight.astype(float) ** 2).sum() + 1e-9) + self.intercept > FLOOR)
            if len(some):
                out[at[some]] = np.maximum(FLOOR, value[some] / np.maximum(sizes(index[some], weight), 1e-9) + self.intercept)
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(value) + self.shift, -30, 30)))


def support_vectors(strings: list[str], y: np.ndarray, landmarks: list[str], ridge: float = 3e-5) -> Machine:
    """Squared-hinge machine on Nystroem features, by Newton steps."""
    among = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([kernel(strings, landmarks) @ half, np.ones((len(strings), 1))], axis=1)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) / len(y)
    w, active = np.zeros(z.shape[1]), np.ones(len(y), bool)
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-9])
    for _ in range(30):
        zs = z[active] * cost[active, None]
        w = np.linalg.solve(zs.T @ z[active] + penalty, zs.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    alpha = half @ w[:-1]
    table = np.zeros(ALPHABET ** 3)
    for a, s in zip(alpha, landmarks):
        index, weight = subsequences(codes([s]))
        t = np.zeros(ALPHABET ** 3)
        np.add.at(t, index[0], weight)
        table += a * t / (np.sqrt((t ** 2).sum()) or 1.0)
    return Machine(table, w[-1])


def spread(strings: list[str], n: int) -> list[str]:
    """Landmarks: each next one is the string that those before it explain least (pivoted Cholesky)."""
    if len(strings) <= n:
        return strings
    among = kernel(strings, strings)
    left, rows, out = np.ones(len(strings)), [], []
    while len(out) < n and left.max() > 1e-6:
        i = int(np.argmax(left))
        row = among[i] - sum((r[i] * r for r in rows), np.zeros(len(strings)))
        rows.append(row / np.sqrt(left[i]))
        left = np.maximum(left - rows[-1] ** 2, 0)
        left[i] = 0
        out.append(strings[i])
    return out


def runs(s: str) -> set[str]:
    """Runs of four characters, and longer beginnings of a word."""
    return {s[i:i + 4] for i in range(len(s) - 3)} | {s[:n] for n in range(5, min(9, len(s)) if s[0] == "^" else 0)} or {s}


def fit(positives: list[str], negatives: list[str], pool: list[str]) -> Machine | None:
    """The machine from insults, clean strings, and the pool of further clean ones; None unless there are both."""
    if not positives or not negatives:
        return None
    landmarks = spread(positives[:4 * LANDMARKS], 2 * LANDMARKS // 3) + spread(negatives[:4 * LANDMARKS], LANDMARKS // 3)
    machine = None
    for _ in range(ROUNDS):
        y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        machine = support_vectors([*positives, *negatives], y, landmarks)
        hard = [pool[i] for i in np.argsort(-machine.decide(pool), kind="stable")[:NEGATIVES // 4]]
        negatives = list(dict.fromkeys([*negatives, *hard]))
        landmarks = list(dict.fromkeys([*landmarks, *hard[:LANDMARKS // 5]]))
    return machine


def calibrate(machine: Machine, values: list[float], labels: list[int]) -> None:
    """Logistic calibration of the decision values of whole documents."""
    x, y = np.array(values, float), np.array(labels, float)
    a, b = 4.0, -2.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum() + 1e-2 * (a - 4), (p - target).sum()])
        h = p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]]), g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    machine.slope, machine.shift = float(max(a, 0.1)), float(b)


class Scores(dict):
    """Highest decision value of each chunk that a task has met; unknown ones are evaluated together."""

    def __init__(self, machine: Machine) -> None:
        super().__init__()
        self.machine = machine

    def learn(self, found: set[str]) -> None:
        if len(self) > CACHE:
            self.clear()
        owner, strings = [], []
        for chunk in found:
            self[chunk] = FLOOR
            for u in units(chunk):
                owner.append(chunk)
                strings.append(u)
        for chunk, v in zip(owner, self.machine.decide(strings).tolist()):
            if v > self[chunk]:
                self[chunk] = v

    def texts(self, texts: list[str], together: int = 64) -> list[float]:
        out = []
        for i in range(0, len(texts), together):
            some = [chunks(t) for t in texts[i:i + together]]
            new = set().union(*some)
            new.difference_update(self)
            if new:
                self.learn(new)
                for s in some:
                    if not s <= self.keys():  # only where the memory was cleared meanwhile
                        self.learn(s - self.keys())
            out += [max(map(self.__getitem__, s), default=FLOOR) for s in some]
        return out


_SCORES: dict[str, Scores] = {}


def decider(machine: Machine, name: str):
    """Decision value of the highest string of each whole text."""
    @F.arrow_udf(T.DoubleType())
    def decision(texts: pa.Array) -> pa.Array:
        if name not in _SCORES:
            _SCORES.clear()
            _SCORES[name] = Scores(machine)
        return pa.array(_SCORES[name].texts([x or "" for x in texts.to_pylist()]), pa.float64())
    return decision


def scorer(machine: Machine | None):
    """Calibrated score of whole texts; 0 without a machine."""
    if machine is None:
        return lambda text: F.lit(0.0)
    value = decider(machine, machine_name(machine))
    bounded = lambda text: F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.lit(machine.slope) * value(text) + F.lit(machine.shift)))
    return lambda text: F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded(text)))


def remainder(ids, n: int):
    return F.pmod(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def strings_of(text: str | None) -> set[str]:
    return {u for c in chunks(text or "") for u in units(c)}


def sliced(batches, rows: int = 64):
    """Batches of few whole texts, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def reading(batches):
    """Batches (doc_id, label, text) to every distinct string of a document."""
    for batch in sliced(batches):
        found = [sorted(strings_of(t)) for t in batch.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([s for x in found for s in x], pa.string())],
                                         names=["doc_id", "label", "string"])


def run_reading(batches):
    """Batches (doc_id, label, text) to every distinct run of a document."""
    for batch in sliced(batches):
        found = [sorted(set().union(*map(runs, strings_of(t)))) for t in batch.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(1).take(at), pa.array([r for x in found for r in x], pa.string())], names=["label", "run"])


@F.arrow_udf(T.ArrayType(T.StringType()))
def marks(strings: pa.Array) -> pa.Array:
    return pa.array([sorted(runs(s)) for s in strings.to_pylist()], pa.list_(pa.string()))


def examples(texts: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Insults, clean strings and the pool from whole labelled texts (doc_id, label, text), counted by Spark.

    A run tells as much as documents have it, times the log of how much more frequent
    it is in toxic ones; a string as much as its third-best run, for one may be part of
    common words. Witnesses of a toxic document are its strings that tell most. Insults
    are witnesses that are rare in clean documents themselves, and that several
    documents share unless they tell a lot.
    """
    toxic, clean = texts.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not toxic or not clean:
        return [], [], []
    kind = texts.schema["doc_id"].dataType.simpleString()
    each = saved(texts.mapInArrow(reading, f"doc_id {kind}, label int, string string"), "strings")
    both = [F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")]
    often = texts.mapInArrow(run_reading, "label int, run string").groupBy("run").agg(*both).filter("t > 1")
    tells = F.col("t") * (F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1)))
    telling = often.select("run", tells.alias("value")).filter("value > 0")
    strings = each.groupBy("string").agg(*both)
    least = each.select("string").distinct().withColumn("runs", marks("string"))
    third = least.select("string", F.least(F.lit(3), F.size("runs")).alias("place"), F.explode("runs").alias("run")).join(telling, "run")
    third = third.groupBy("string").agg(F.max("place").alias("place"), F.sort_array(F.collect_list("value"), asc=False).alias("values"))  # at most a dozen
    third = third.select("string", F.try_element_at("values", F.col("place")).alias("worth")).filter("worth IS NOT NULL")
    strings = saved(strings.join(third, "string", "left").withColumn("worth", F.coalesce("worth", F.lit(0.0))), "worth")
    told = each.filter("label = 1").join(strings.filter(F.col("worth") >= LEAST_TOLD).select("string", "worth"), "string")
    most = told.groupBy("doc_id").agg(F.max("worth").alias("most"))
    seen = told.join(most, "doc_id").filter(F.col("worth") >= F.col("most") / 4).groupBy("string").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.join(strings, "string").filter((F.col("n") * clean > 10 * F.col("c") * toxic) & ((F.col("n") > 2) | (F.col("worth") >= SURELY_TOLD)))
    witnesses = durable(seen.select("string", "n"))
    others = durable(strings.filter("c > 0").join(witnesses, "string", "left_anti").select("string", "worth", F.crc32(F.col("string").cast("binary")).alias("h")))
    rows = lambda df, *order: [r.string for r in df.orderBy(*order).select("string").collect()]
    positives = rows(witnesses.orderBy(F.desc("n"), "string").limit(POSITIVES), F.desc("n"), "string")
    spare = rows(others.orderBy("h", "string").limit(POOL), "h", "string")
    alike = rows(others.filter("worth > 0").orderBy(F.desc("worth"), "h", "string").limit(POOL), F.desc("worth"), "h", "string")
    return positives, spare[:NEGATIVES], list(dict.fromkeys([*alike, *spare]))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4) -> Machine | None:
    """Fit on a bounded sample: at most DOCUMENTS labelled documents per label, whole texts of them.

    A document with several labels counts as toxic if one says so; of the texts that
    share a doc_id the one of smallest hash is read. Rows whose crc32(doc_id as text)
    mod ``of`` is ``held_out`` are never read.
    """
    known = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).filter(remainder(F.col("doc_id"), of) != held_out)
    chosen = None
    for label, most in DOCUMENTS.items():
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sum(DOCUMENTS) rows
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))).alias("least")
    texts = saved(texts.groupBy("doc_id", "label").agg(least).select("doc_id", "label", "least.text"), "labelled")
    machine = fit(*examples(texts))
    if machine is not None:
        name = f"{machine_name(machine)}:fitting"
        rows = texts.select("label", decider(machine, name)("text").alias("value")).collect()  # at most sum(DOCUMENTS) rows
        rows.sort()
        calibrate(machine, [r.value for r in rows], [r.label for r in rows])
    return machine


def score(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted.

    A null or empty text, or one without letters, has the lowest score. Equal texts
    have equal scores; a null doc_id counts as the empty string for held_out. Without
    labelled documents of both kinds every score is 0. Columns other than doc_id
    and text (toxic of the labels) are not read.
    """
    machine = train(docs, labels, held_out, of)
    rows = pick(docs, "doc_id", "text")
    value = scorer(machine)(F.col("text"))
    out = rows.select("doc_id", (remainder(F.col("doc_id"), of) == held_out).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def machine_name(machine: Machine | None) -> str:
    return "" if machine is None else f"{zlib.crc32(machine.table.tobytes())}:{machine.intercept}:{machine.slope}:{machine.shift}"


def keep_clean(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4, cut: float = CUT) -> DataFrame:
    """The documents that score below the cut, with all their columns and in their own names.

    A null or empty text, or one without letters, is clean. Equal rows stay or go
    together, a row with a null doc_id is judged like any other; column names may clash.
    """
    machine = train(docs, labels, held_out, of)
    rows, text = surely(docs, "text")
    return rows.filter(scorer(machine)(F.col(text)) < cut).toDF(*docs.columns)
