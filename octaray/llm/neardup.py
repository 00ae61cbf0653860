"""Near-duplicate documents by order min-hash, verified by banded alignment.

A document is the sequence of its lower-case words; its k-mers are runs of ``k`` = 5 words (shorter documents have one
k-mer of all their words), and a k-mer that occurs again is labelled with the number of its occurrence. Two documents
are linked if an alignment of their k-mer sequences, which must keep text order, matches at least 0.8 of the k-mers of
either: matches / (n_a + n_b - matches) >= 0.8. As this asks n_min / n_max >= 0.8 and bounds how far an alignment can
leave the diagonal, alignments are computed in that band only, and exactly.

Candidates: each of ``repeats`` sketches takes the ``picks`` labelled k-mers of smallest keyed hash and keeps them in
text order; documents with an equal sketch share a bucket, and a candidate pair shares two. At a similarity of 0.8 a
sketch is equal with probability of about 0.8^3, so that 20 of them miss one pair in 10^5, and fewer above, whereas a
passage that many documents share seldom gives two. Documents with equal word sequences are collapsed before, so a group
of exact copies costs one row.

In a bucket, all members are first aligned with its most famous member - the one with most bucket mates, as the original
of a group has - and links found so far give components; a second round takes the most famous member outside that
component. Of these pairs, those are not aligned whose sizes differ too much or whose sketches share too few picks: of
60 picks a pair at 0.8 shares 47 on average, with a standard deviation below 3.2, and 33 are asked for. Members of buckets that are then still of several components are
compared by an exact bound alone (``_across``), which for a large group of edited copies joins them on the traces of
their edits and not on what all of them share. So such a group costs a number of alignments in proportion to its size.
``component`` is the smallest doc_id that a document reaches by links. Keys that hold many rows (a large group's bucket,
leader, class or component) are dealt over several tasks by ``spread_join``.

Cases: null and empty texts, and texts of white space only, link with nothing; repeated rows of one id and text are one
document and get equal results; different texts under one id are documents of their own, whose rows all carry that id;
rows with a null id link with nothing and keep a null class; texts are read whole; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, only_result, read_table, settle, spread_join
from .components import connected_components
from .hashing import STEP, hash_runs, mix64

K, REPEATS, PICKS, SIMILARITY = 5, 20, 3, 0.8
#: Equal sketches that make two documents a candidate pair.
EQUAL = 2
#: Of the REPEATS * PICKS picks, at least this share must be common before a pair is aligned.
AGREE = 0.55
#: Rounds in which buckets compare with one leader before the rest is compared in full.
STARS = 2
#: Logarithm of the ratio of two bands of document sizes.
BAND = math.log(1.03)
MASK = (1 << 64) - 1
_SEEDS = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-case words of the texts, and the bounds of each text's words in that array."""
    lows = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*lows, b""]) or b"\n", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in lows), dtype=np.int64, count=len(lows))
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return hash_runs(data, start, end), bounds


def words_digest(text: str | None) -> bytes:
    """16 bytes that identify the sequence of a text's lower-case words."""
    return hashlib.blake2b(b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split()), digest_size=16).digest()


def kmer_hashes(words: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-mers in text order; a text of 1 to k-1 words has one."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    index = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], counts)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    h = np.zeros(len(index), dtype=np.uint64)
    short = np.repeat(n < k, counts)
    width = np.repeat(np.minimum(n, k), counts)
    for i in range(k):
        w = padded[index + i]
        h = np.where(short & (i >= width), h, mix64(h + STEP + w)) if short.any() else mix64(h + STEP + w)
    return h, out_bounds


def label_occurrences(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The j-th occurrence of a k-mer in a text becomes an element of its own."""
    keyed = h ^ mix64(doc.astype(np.uint64) + STEP)
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    j = np.empty(len(h), dtype=np.uint64)
    j[order] = (np.arange(len(new)) - first).astype(np.uint64)
    return np.where(j > 0, mix64(h + j * STEP), h)


def order_min_hashes(h: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, picks: int = PICKS) -> np.ndarray:
    """[text, repeat, pick]: the hashes of smallest keyed value, in text order; texts with fewer are padded with 0.

    Values below a bound that leaves about 5 picks a text are sorted; texts that it leaves too few are done in full.
    """
    n = np.diff(bounds)
    out = np.zeros((len(n), repeats, picks), dtype=np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    limit = np.full(len(n), MASK, dtype=np.uint64)
    many = n > 8 * picks
    limit[many] = ((5.0 * picks + 4) / n[many] * 2.0**64).astype(np.uint64)
    limits = limit[doc]
    for r in range(repeats):
        value = mix64(h ^ _SEEDS[r])
        at = np.flatnonzero(value <= limits)
        left = np.bincount(doc[at], minlength=len(n))
        poor = np.flatnonzero(many & (left < picks))
        if len(poor):
            more = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in poor])
            at = np.union1d(at, more)
            left = np.bincount(doc[at], minlength=len(n))
        order = np.lexsort((value[at], doc[at]))
        starts = np.concatenate([[0], np.cumsum(left)])[:-1]
        rank = np.arange(len(at)) - np.repeat(starts, left)
        chosen = order[rank < picks]
        chosen = chosen[np.lexsort((at[chosen], doc[at[chosen]]))]
        where = at[chosen]
        got = np.minimum(left, picks)
        slot = np.arange(len(where)) - np.repeat(np.concatenate([[0], np.cumsum(got)])[:-1], got)
        out[doc[where], r, slot] = h[where]
    return out


def aligned_matches(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Matches of the best order-keeping alignment, within the band that a similarity of ``least`` allows.

    Bit-parallel longest common subsequence: bit i of the state is 0 where the length rises at a[i].
    """
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    tail = int(differ[0]) if len(differ) else same
    n, m = len(a) - tail, len(b) - tail
    if not n or not m:
        return head + tail
    a, b = a[:n], b[:m]
    # matches >= least / (1 + least) * (n_a + n_b): what either may leave unmatched bounds the distance to the diagonal.
    total = 2 * (head + tail) + n + m
    need = int(np.ceil(least / (1 + least) * total - 1e-9))
    band = max(0, max(head + tail + n, head + tail + m) - need)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << n) - 1
    window = (1 << (2 * band + 1)) - 1
    state = full
    for j, x in enumerate(b.tolist()):
        mask = places.get(x)
        if mask is None:
            continue
        low = j - band
        mask &= (window << low) if low >= 0 else (window >> -low)
        u = state & mask
        if u:
            state = ((state + u) | (state - u)) & full
    return head + tail + n - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """matches / (n_a + n_b - matches), or less than that where it is below ``least``."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    m = aligned_matches(a, b, least)
    return m / (len(a) + len(b) - m)


SKETCH = "doc_id long, mark string, h1 long, h2 long, n int, picks binary, keys array<long>, kmers binary"


def sketch(docs: DataFrame, k: int = K, repeats: int = REPEATS, picks: int = PICKS) -> DataFrame:
    """Per row of (doc_id, text, mark): an identity of its word sequence, the picks' hashes, a key for each repeat, its k-mers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, 1_500_000):
                texts = part.column(1).to_pylist()
                words, bounds = word_hashes(texts)
                h, kb = kmer_hashes(words, bounds, k)
                doc = np.repeat(np.arange(len(texts)), np.diff(kb))
                labelled = label_occurrences(h, doc)
                got = order_min_hashes(labelled, kb, repeats, picks)
                ids = np.frombuffer(b"".join(map(words_digest, texts)), dtype=np.int64).reshape(-1, 2).T
                keys = np.zeros((len(texts), repeats), dtype=np.uint64)
                for p in range(picks):
                    keys = mix64(keys + got[:, :, p] + STEP)
                keys = mix64(keys ^ _SEEDS[None, :repeats])
                short = mix64(got).astype(np.uint32).reshape(len(texts), repeats * picks)
                narrow = h.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(2).cast(pa.string()),
                        *map(pa.array, ids),
                        pa.array(np.diff(kb).astype(np.int32)),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * repeats), pa.array(keys.view(np.int64).ravel())),
                        pa.array([narrow[kb[i] : kb[i + 1]].tobytes() for i in range(len(texts))], pa.binary()),
                    ],
                    names=["doc_id", "mark", "h1", "h2", "n", "picks", "keys", "kmers"],
                )

    return docs.mapInArrow(work, SKETCH)


def _needed(n_x: Column, n_y: Column, least: float) -> Column:
    """Matches that a similarity of ``least`` asks for (less a margin for rounding)."""
    return (n_x + n_y) * F.lit(least / (1 + least)) - 1e-6


def _agreeing(least: int, picks: int):
    """Whether two sketches share at least so many picks, each repeat's picks taken as a set."""

    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), dtype=np.uint32).reshape(len(a), -1, picks)
        y = np.frombuffer(b"".join(b), dtype=np.uint32).reshape(len(b), -1, picks)
        return pd.Series((x[:, :, :, None] == y[:, :, None, :]).any(axis=3).sum(axis=(1, 2)) >= least)

    return agree


def _placed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links).withColumnRenamed("id", "rep")
    return buckets.join(found, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _star(placed: DataFrame, least: float, bar: int, picks: int, first: bool) -> DataFrame:
    """(a, b): each bucket's most famous member with the members of other components.

    Fame is the number of bucket mates: the original of a group of edited copies meets more of them than they do each
    other. After the first round, the most famous member outside that member's component leads.
    """
    bucket = ["r", "key"]
    famous = F.max_by(F.struct("rep", "n", "picks", "c"), F.struct("fame", -F.col("rep"))).alias("head")
    heads = placed.groupBy(*bucket).agg(famous, F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    if not first:
        outside = spread_join(placed, heads.select(*bucket, F.col("head.c").alias("lead")), bucket).filter("c <> lead")
        heads = outside.groupBy(*bucket).agg(famous)
    pairs = spread_join(placed.select(*bucket, "rep", "n", "picks", "c"), heads, bucket).filter("c <> head.c")
    pairs = pairs.filter(F.least("n", "head.n") >= least * F.greatest("n", "head.n") - 1e-6)
    pairs = pairs.select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b"), "picks", F.col("head.picks").alias("hp"))
    pairs = pairs.dropDuplicates(["a", "b"])
    return pairs.filter(_agreeing(bar, picks)("picks", "hp")).select("a", "b")


def _labelled(docs: DataFrame) -> DataFrame:
    """(rep, c, n, h): the occurrence-labelled k-mers of (rep, c, n, kmers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("kmers").to_pylist()):
                h = np.frombuffer(body, dtype=np.uint32).astype(np.uint64)
                h = label_occurrences(h, np.zeros(len(h), dtype=np.int64)).view(np.int64)
                same = [pa.array([batch.column(x)[i].as_py()] * len(h), pa.int64()) for x in ("rep", "c", "n")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h)], names=["rep", "c", "n", "h"])

    return docs.mapInArrow(work, "rep long, c long, n long, h long")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(BAND) + 1e-9)


def _across(placed: DataFrame, kmers: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of different components that may still be linked, among the members of undecided buckets.

    An exact bound on labelled k-mers, without sketches: put every document's k-mers in one order, rare ones first. At
    the first k-mer that two documents share, neither can match more than its k-mers from there on. So pairs are joined
    on the k-mers early enough for that, which for documents away from the original of a group are the traces of their
    own edits, and not what the whole group shares. What lies early enough depends on the partner's size, which is part
    of the join key, in bands of 3 %. Where most documents of a k-mer are of one component, these are not joined with
    each other.
    """
    bucket, key = ["r", "key"], ["h", "band"]
    split = placed.groupBy(*bucket).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select(*bucket)
    left = spread_join(placed, split, bucket).groupBy("rep").agg(F.first("c").alias("c"), F.first("n").cast("long").alias("n"), F.count("*").alias("buckets"))
    left = left.filter(F.col("buckets") >= EQUAL)
    rows = settle(_labelled(left.join(kmers, "rep").select("rep", "c", "n", "kmers")))
    # K-mers that documents of one component only hold come first of all: no pair to be found shares them.
    spread = rows.groupBy("h").agg(F.count("*").alias("docs"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    spread = settle(spread.filter("lo <> hi").select("h", "docs"))
    shared = spread_join(rows.drop("c"), spread, ["h"], counts=spread.withColumnRenamed("docs", "_n"))
    whole = Window.partitionBy("rep")  # one document's k-mers
    p = F.col("n") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("docs", "h")) - 1
    # The shortest partner that a document may have asks for the fewest matches.
    early = shared.withColumn("p", p).filter(F.col("n") - F.col("p") >= least * F.col("n") - 1e-6)
    early = settle(early.select("h", "rep", "n", "p").join(placed.select("rep", "c").distinct(), "rep"))

    # The longer document is listed for every band that a partner may be in, the shorter one for its own.
    shortest = F.greatest(F.col("n") * least, F.exp(F.col("band") * F.lit(BAND)) - 1e-6)
    longer = early.withColumn("band", F.explode(F.sequence(_band(F.col("n") * least), _band(F.col("n")))))
    longer = settle(longer.filter(F.col("n") - F.col("p") >= _needed(F.col("n"), shortest, least)))
    shorter = settle(early.withColumn("band", _band(F.col("n"))).filter(F.col("n") - F.col("p") >= _needed(F.col("n"), F.col("n"), least)))
    held = longer.select(*key, "c").unionByName(shorter.select(*key, "c")).groupBy(*key, "c").agg(F.count("*").alias("m"))
    held = held.groupBy(*key).agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    held = settle(held.select(*key, "major")).hint("merge")  # one plan at every size
    x = settle(spread_join(longer, held, key)).select(*key, "major", *[F.col(i).alias(f"x_{i}") for i in ("rep", "c", "n", "p")])
    y = settle(spread_join(shorter, held, key)).select(*key, *[F.col(i).alias(f"y_{i}") for i in ("rep", "c", "n", "p")], F.col("major").alias("most"))
    one = spread_join(y, x.filter("x_c <> major"), key)
    two = spread_join(x.filter("x_c = major"), y.filter("y_c <> most"), key)
    names = ["x_rep", "y_rep"]
    fits = F.least(F.col("x_n") - F.col("x_p"), F.col("y_n") - F.col("y_p")) >= _needed(F.col("x_n"), F.col("y_n"), least)
    pairs = [j.filter((F.col("x_c") != F.col("y_c")) & (F.col("x_n") >= F.col("y_n")) & fits).select(*names) for j in (one, two)]
    return pairs[0].unionByName(pairs[1]).select(F.least(*names).alias("a"), F.greatest(*names).alias("b")).distinct()


def _verified(pairs: DataFrame, kmers: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs that align well enough. ``kmers``: rep, kmers (binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            good = [similarity(np.frombuffer(p.as_py(), dtype=np.uint32), np.frombuffer(q.as_py(), dtype=np.uint32), least) >= least for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = kmers.select(F.col("rep").alias("a"), F.col("kmers").alias("x"))
    right = kmers.select(F.col("rep").alias("b"), F.col("kmers").alias("y"))
    joined = spread_join(spread_join(pairs, left.hint("merge"), ["a"]), right.hint("merge"), ["b"], rows=pairs).select("a", "b", "x", "y")
    return joined.mapInArrow(work, "a long, b long")


@only_result
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, k: int = K, repeats: int = REPEATS, picks: int = PICKS, mark: Column | None = None) -> DataFrame:
    """doc_id, class_id (smallest id with the same words), component (smallest id reached by links), kept: one row per row.

    With ``mark``, a text that tells rows of one id apart, it is returned too, and ``first`` marks the rows of the
    component's smallest (id, mark): those that stay where one document of each group shall.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.lit("") if mark is None else mark).alias("mark"))
    rows = sketch(source, k, repeats, picks).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows)  # row numbers are fixed once they are written
    filled = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # A class is named by the number of one of its rows, so that different texts under one id are different classes.
    classes = filled.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("least"), F.min_by("keys", "row").alias("keys"))
    classes = settle(classes)

    member = classes.select("rep", F.posexplode("keys").alias("r", "key"))
    # Small tables are written first, so that Spark knows their size and spares the shuffle of the large ones.
    sizes = settle(member.groupBy("r", "key").agg(F.count("*").alias("size")).filter("size > 1"))
    shared = settle(spread_join(member, sizes, ["r", "key"], counts=sizes.withColumnRenamed("size", "_n")))
    fame = settle(shared.groupBy("rep").agg(F.sum("size").alias("fame"), F.count("*").alias("buckets")).filter(F.col("buckets") >= EQUAL).drop("buckets"))
    about = settle(rows.select(F.col("row").alias("rep"), "n", "picks", "kmers").join(fame, "rep"))
    kmers = about.select("rep", "kmers")
    buckets = settle(shared.drop("size").join(about.select("rep", "n", "picks", "fame"), "rep"))

    bar = int(AGREE * repeats * picks)
    links = tried = None
    placed = buckets.withColumn("c", F.col("rep"))
    for turn in range(STARS):
        pairs = _star(placed, least, bar, picks, turn == 0)
        pairs = settle(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = settle(_verified(pairs, kmers, least))
        tried, links = (pairs, found) if tried is None else (tried.unionByName(pairs), links.unionByName(found))
        placed = settle(_placed(buckets, links))
    pairs = settle(_across(placed, kmers, least).join(tried, ["a", "b"], "left_anti"))
    links = settle(links.unionByName(_verified(pairs, kmers, least)))

    found = connected_components(links).withColumnRenamed("id", "rep")
    named = settle(classes.select("h1", "h2", "rep", "least").join(found, "rep", "left").withColumn("group", F.coalesce("component", "rep")))
    smallest = named.groupBy("group").agg(F.min("least").alias("top"))
    named = settle(spread_join(named.select("h1", "h2", "least", "group"), smallest, ["group"])).select("h1", "h2", F.col("least.doc_id").alias("class_id"), "top")
    out = rows.select("doc_id", "mark", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2"))
    out = spread_join(out, named, ["h1", "h2"], "left").withColumn("top", F.when(F.col("doc_id").isNotNull(), F.col("top")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
    out = out.select("doc_id", "mark", own, F.coalesce("top.doc_id", "doc_id").alias("component"), "top")
    out = out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component")))
    if mark is None:
        return out.drop("mark", "top")
    return out.withColumn("first", F.col("top").isNull() | ((F.col("top.doc_id") == F.col("doc_id")) & F.col("top.mark").eqNullSafe(F.col("mark")))).drop("top")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
