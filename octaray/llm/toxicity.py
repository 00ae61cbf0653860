"""Toxicity by noisy-channel deobfuscation.

A character 4-gram model is counted over all texts. Tokens that hold signs of obfuscation - digits or symbols among
letters, letters repeated three times or more, single letters set apart - become character lattices: leetspeak symbols
stand for letters, wildcards for any letter, runs for one or two letters, separators for nothing. Viterbi decoding
under the character model restores the likeliest word. A token without such signs has a lattice of one path and is
its own decoding. The document is then scored on what its own and its restored words show.

The scorer is a list of word and word-prefix features, learnt by sequential covering: of the features that are
significantly toxic on the labelled sample, the one that explains most toxic documents not yet explained is kept, until
none explains enough. A document's score is the noisy-or of its features' precisions, or a small base rate.

The labelled sample is bounded by ``max_toxic`` and ``max_clean`` (expected sizes, drawn by a hash of the id); the
character model covers every document, and every whole text is scored.

Cases: a null or empty text has no features and gets the base score; documents with several labels count as toxic if
any label is 1, those with null labels are unlabelled; without any toxic label every score is the base rate; repeated
rows score alike; an empty table gives no rows; extra columns are kept by ``score_texts`` and never looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, crc_mod, read_table, settle
from .mixing import shuffle_key

MAX_TOXIC, MAX_CLEAN = 8000, 24000
THRESHOLD = 0.7
#: What a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
WILD, SEPARATORS = "*#", ".-_~'​‌‍­"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Character classes of the model: 0 boundary, 1-26 letters, 27 any other letter.
CLASSES = 28
EDGE_LEFT, EDGE_RIGHT = "\"'([{<.,;:?%&#*-_~", "\"')]}>.,;:?%&#*-_~!$+"
SPACED = re.compile(r"(?<!\S)(?:[^\W_][ \t]){2,}[^\W_](?!\S)")
ODD = re.compile(rf"[^\W\d_].*[0-9{re.escape(''.join(LEET) + WILD)}]|[{re.escape(''.join(LEET) + WILD)}].*[^\W\d_]|([^\W\d_])\1\1|^(?:[^\W_][ \t{re.escape(SEPARATORS)}]){{2,}}[^\W_]$|[​-‍­]")
PREFIXES = (4, 5, 6)
#: Tokens and features that a reader keeps; it starts anew when it is full.
CACHE_ENTRIES = 300_000
#: Texts are looked at in slices of about so many bytes, so that a worker's memory does not follow its batch.
SLICE_BYTES = 1_000_000


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    """The texts of one-column batches, about SLICE_BYTES at a time."""
    for batch in batches:
        for part in byte_slices(batch.select([0, 0]), SLICE_BYTES):
            yield part.column(0).to_pylist()


def class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[128:] = 27
    for i, c in enumerate(LETTERS):
        table[ord(c)] = table[ord(c.upper())] = i + 1
    return table


def count_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the 28^4 class 4-grams of all texts."""

    def count(batches):
        table, total = class_table(), np.zeros(CLASSES**4, dtype=np.int64)
        for texts in _text_slices(batches):
            joined = ("\n" * 3).join(x for x in texts if x)
            data = np.frombuffer(("\n" * 3 + joined + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
            # A single long text is still many windows, which overlap by three characters.
            for at in range(0, len(data) - 3, SLICE_BYTES):
                code = table[data[at : at + SLICE_BYTES + 3]]
                gram = ((code[:-3] * CLASSES + code[1:-2]) * CLASSES + code[2:-1]) * CLASSES + code[3:]
                total += np.bincount(gram, minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["gram", "n"])

    found = docs.select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CLASSES**4, dtype=np.int64)
    total[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return total


def character_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log P(c4 | c1 c2 c3) as an array [c1 c2 c3, c4], each order smoothed by the one below it."""
    p = np.array(1 / CLASSES)
    for order in range(1, 5):
        n = counts.reshape((-1,) + (CLASSES,) * order).sum(axis=0).astype(float)
        p = (n + weight * p) / (n.sum(axis=-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32).reshape(-1, CLASSES)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Segments of a lower-case token: the strings each may stand for, with the channel's log probability."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            out.append([(c * run, 0.0)] if run < 3 else [(c, -0.7), (c + c, -0.7)])
        elif c in LEET:
            options = [(x, -1.0) for x in LEET[c]]
            for _ in range(1 if run >= 3 else run):
                out.append([*options, (c, -6.0)])
        elif c in WILD:
            for _ in range(run if run < 3 else 1):
                out.append([*((x, -4.0) for x in LETTERS), ("", -4.0)])
        elif c in SEPARATORS or c in " \t":
            out.append([("", -0.5), (c, -6.0)])
        else:
            out.append([(c, 0.0)])
        i = j
    return out


def decode(token: str, model: np.ndarray, classes: dict[str, int]) -> str:
    """The likeliest reading of the token's lattice (Viterbi over the last three classes)."""
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for options in lattice(token):
        after: dict[int, tuple[float, str]] = {}
        for state, (score, said) in states.items():
            for text, cost in options:
                s, total = state, score + cost
                for c in text:
                    k = classes.get(c, 27 if c.isalpha() else 0)
                    total += float(model[s, k])
                    s = (s * CLASSES + k) % CLASSES**3
                if s not in after or total > after[s][0]:
                    after[s] = (total, said + text)
        states = after
    return max((score + float(model[s, 0]), said) for s, (score, said) in states.items())[1]


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)] if len(word) > 2 else []


class Reader:
    """Features of texts. Readings of tokens are kept, as a cache that is emptied when it is full."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None = None):
        self.model, self.wanted, self.known, self.held = model, wanted, {}, 0
        self.classes = {c: i + 1 for i, c in enumerate(LETTERS)}

    def token(self, token: str) -> tuple:
        got = self.known.get(token)
        if got is None:
            bare = token.lstrip(EDGE_LEFT).rstrip(EDGE_RIGHT)
            found = word_features(bare)
            if ODD.search(bare):
                for word in re.findall(r"[^\W\d_]+", decode(bare, self.model, self.classes)):
                    found += word_features(word)
            wanted = self.wanted
            got = tuple(found) if wanted is None else tuple(wanted[f] for f in found if f in wanted)
            if self.held >= CACHE_ENTRIES:
                self.known.clear()
                self.held = 0
            self.known[token] = got
            self.held += 1 + len(got)
        return got

    def text(self, text: str | None) -> set:
        out: set = set()
        if text:
            low = text.lower()
            for token in set(low.split()):
                if got := self.token(token):
                    out.update(got)
            for spaced in SPACED.findall(low):
                out.update(self.token(spaced))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, fold) -> DataFrame:
    """(text, toxic) of labelled training documents; the expected number of either kind is bounded."""
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & fold(F.col("doc_id")))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = {k: min(1.0, m / max(1, n.get(k, 0))) for k, m in ((1, max_toxic), (0, max_clean))}
    drawn = shuffle_key(F.col("doc_id"), "toxicity") / float(1 << 52)
    marks = marks.filter((F.col("toxic") == 1) & (drawn < share[1]) | (F.col("toxic") == 0) & (drawn < share[0]))
    # At most about max_toxic + max_clean rows of two numbers: a proven bound.
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")


def covering(held: list[list[int]], cost: list[int], names: list[str], least: int = 3) -> tuple[list[int], int]:
    """(features kept, documents that none of them explains).

    The feature that explains most documents not yet explained, less its cost, is kept, until that is below ``least``.
    Gains only fall, so a feature is looked at again only when it leads the queue.
    """
    covers: dict[int, list[int]] = defaultdict(list)
    for doc, features in enumerate(held):
        for f in features:
            covers[f].append(doc)
    ranked = sorted(covers, key=lambda f: (len(covers[f]), -len(names[f]), names[f]), reverse=True)
    queue = [(cost[f] - len(covers[f]), rank) for rank, f in enumerate(ranked)]
    heapq.heapify(queue)
    left, kept = set(range(len(held))), []
    while queue:
        loss, rank = queue[0]
        f = ranked[rank]
        now = cost[f] - sum(doc in left for doc in covers[f])
        if now > loss:
            heapq.heapreplace(queue, (now, rank))
            continue
        if -now < least:
            break
        heapq.heappop(queue)
        kept.append(f)
        left.difference_update(covers[f])
    return kept, len(left)


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, fold=lambda doc_id: F.lit(True)) -> dict:
    """The model: character model, features with precisions, and the base rate."""
    spark = docs.sparkSession
    chars = spark.sparkContext.broadcast(character_model(count_characters(docs)))
    sample = settle(labelled_sample(docs, labels, max_toxic, max_clean, fold))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    base = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    model = {"chars": chars, "features": {}, "precision": [], "base": base if not n_toxic else 0.0}
    if not n_toxic:
        return model

    def counted(wanted):
        def count(batches):
            reader, total = Reader(chars.value, wanted and wanted.value), Counter()
            for texts in _text_slices(batches):
                for text in texts:
                    total.update(reader.text(text))
            features, n = list(total.keys()), list(total.values())
            for at in range(0, len(features), 50_000):
                kind = pa.string() if wanted is None else pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(features[at : at + 50_000], kind), pa.array(n[at : at + 50_000], pa.int64())], names=["feature", "n"])

        return count

    toxic = sample.filter("toxic = 1").select("text").mapInArrow(counted(None), "feature string, n long")
    toxic = toxic.groupBy("feature").agg(F.sum("n").alias("n")).filter("n >= 3").toArrow().to_pandas()
    wanted = spark.sparkContext.broadcast({f: i for i, f in enumerate(toxic["feature"])})
    clean = sample.filter("toxic = 0").select("text").mapInArrow(counted(wanted), "feature long, n long")
    clean = clean.groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    n1 = toxic["n"].to_numpy()
    n0 = np.zeros(len(n1), dtype=np.int64)
    n0[clean["feature"].to_numpy()] = clean["n"].to_numpy()
    # Chance makes n documents of one feature all toxic with probability base^n; allow for all features tried.
    least = (math.log(len(n1) + 1) + 2) / -math.log(base) if base < 1 else 0
    good = np.flatnonzero((n1 >= least) & (n1 >= 0.8 * (n1 + n0)))
    names = [toxic["feature"][int(i)] for i in good]
    chosen = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def shown(batches):
        reader = Reader(chars.value, chosen.value)
        for texts in _text_slices(batches):
            held = [sorted(reader.text(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], names=["held"])

    held = sample.filter("toxic = 1").select("text").mapInArrow(shown, "held array<int>").toPandas()["held"]
    kept, left = covering([list(map(int, x)) for x in held], [2 * int(n0[g]) for g in good], names)
    model["features"] = {names[f]: i for i, f in enumerate(kept)}
    model["precision"] = [float((n1[good[f]] + 0.5) / (n1[good[f]] + n0[good[f]] + 1)) for f in kept]
    model["base"] = min(0.5, (left + 0.5) / (left + n_clean + 1))
    return model


def score_texts(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model["features"], model["precision"], model["base"]))
    chars = model["chars"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, precision, base = shared.value
        reader = Reader(chars.value, features)
        for texts in batches:
            out = []
            for t in texts:
                clean = 1.0 - base
                for f in reader.text(t):
                    clean *= 1.0 - precision[f]
                out.append(1.0 - clean)
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(out, score(F.col(text)))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels, fold=lambda doc_id: crc_mod(doc_id, 3) != 1)
    scored = score_texts(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
