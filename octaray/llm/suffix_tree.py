"""Language-model scoring by a probabilistic suffix tree.

The symbols are the bytes of the normalised text: ASCII letters in lower case, words each followed by one space, and an
end symbol. The tree's candidate states are the contexts of up to ``depth`` symbols that occur often
enough: LEAST_SHARE times the training symbols, or LEAST_ROOT times their square root where that is less, so the tree
grows with the corpus. A tree of at most MAX_ENTRIES contexts and transitions, a bound on the driver's and the workers'
memory, is broadcast; a larger one is kept whole as a table, and the grams of the texts meet its shards, one for each
two symbols that a history ends with. A context is retained if the next symbols after it diverge from those after its longest
proper suffix by more than the size of its table explains, and with it all its suffixes. Its next-symbol distribution is
smoothed towards that of the suffix, which also gets what pruned symbols had (``smoothing`` is a count for each symbol
seen). A symbol is scored in the longest retained state that ends its history.

The word-level base score needs the count of every word. Documents are dealt to blocks of about ``block_bytes`` by a
hash of the id; a block sends each of its distinct words once, with the block's training count; counts are summed by
word and sent back to the blocks. No task sees more than one row per word and block.

Cases: a null text is empty: its only token is the end; texts of any length are scored whole; repeated rows count and
score as separate documents; without training text all counts are 0 and the tree is a uniform root; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, crc_mod, read_table, settle
from .hashing import hash_runs

DEPTH, LEAST_SHARE, LEAST_ROOT, MAX_ENTRIES, SMOOTHING = 6, 2e-7, 4e-3, 8_000_000, 4.0
BLOCK_BYTES, SLICE_BYTES = 8_000_000, 1_000_000
#: Grams that a task counts in its own memory; what goes beyond is passed on, and added up by gram with all the others.
HELD_GRAMS = 1_500_000
END = 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END_HASH = np.int64(-1)


def normalised(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, which of them are scored, scored symbols up to each text's end).

    Every text is followed by ``depth`` end symbols, of which the first is scored and all are the next text's history.
    """
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    tail = b" " + bytes([END]) * depth
    raw = np.frombuffer(bytes([END]) * depth + tail.join([*data, b""]), dtype=np.uint8)
    sizes = np.fromiter((len(d) for d in data), dtype=np.int64, count=len(data)) + len(tail)
    ends = depth + np.cumsum(sizes) - depth
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~space & (raw != END)
    keep = ~space
    keep[1:] |= inside[:-1]
    scored = raw != END
    scored[ends] = True
    symbols = _LOWER[raw]
    symbols[space] = 32
    upto = np.cumsum(scored & keep)[ends] if len(ends) else np.zeros(0, dtype=np.int64)
    return symbols[keep], scored[keep], upto


def grams(symbols: np.ndarray, scored: np.ndarray, depth: int, latest_first: bool = False) -> np.ndarray:
    """At each scored symbol, it and the ``depth`` symbols before it: the symbol in the lowest byte, and above it the
    history, its latest symbol lowest or (``latest_first``) highest."""
    padded = np.concatenate([np.zeros(8, dtype=np.uint8), symbols])
    # Eight bytes from each place on, read as one number: those before the symbol, or those up to it, the last one lowest.
    wide = np.ndarray(len(symbols), "<u8" if latest_first else ">u8", padded.data, 0 if latest_first else 1, (1,)).astype(np.uint64)
    if latest_first:
        wide >>= np.uint64(8 * (8 - depth))
        wide <<= np.uint64(8)
        wide |= symbols
    else:
        wide &= _low(depth + 1)
    return wide[scored]


def _low(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def count_grams(train: DataFrame, depth: int) -> DataFrame:
    """(gram, n) over all rows of (text)."""

    def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000].view(np.int64)), pa.array(n[at : at + 200_000])], names=["gram", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, loose = [], [], 0

        def merged():
            keys, n = np.concatenate(held), np.concatenate(counts)
            held.clear()
            counts.clear()
            order = np.argsort(keys, kind="stable")  # the parts are sorted: they are merged
            keys, n = keys[order], n[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        for whole in batches:
            for part in byte_slices(whole.select([0, 0]), SLICE_BYTES):
                symbols, scored, _ = normalised(part.column(0).to_pylist(), depth)
                keys, n = np.unique(grams(symbols, scored, depth), return_counts=True)
                held.append(keys)
                counts.append(n)
                loose += len(keys)
                if loose > HELD_GRAMS // 2:
                    keys, n = merged()
                    loose = 0
                    if len(keys) > HELD_GRAMS:
                        yield from rows(keys, n)
                    else:
                        held.append(keys)
                        counts.append(n)
                del symbols, scored, keys, n
        if held:
            yield from rows(*merged())

    return train.mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _latest_first(contexts: np.ndarray, k: int) -> np.ndarray:
    """Contexts of ``k`` symbols with the latest symbol in the highest byte: a context's suffixes are its prefixes then."""
    return contexts.byteswap() >> np.uint64(64 - 8 * k)


class SuffixTree:
    """Per depth: the retained contexts, what each counts in all, what it leaves to its suffix, and its transitions.

    Contexts are held latest symbol first, and in that order, so that symbols looked up in the order of their histories
    walk through every depth's arrays from front to back.
    """

    def __init__(self, root: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
        self.root, self.levels = root, []
        for k, (contexts, totals, rest, transitions, counts) in enumerate(levels, 1):
            contexts = _latest_first(contexts, k)
            transitions = _latest_first(transitions >> np.uint64(8), k) << np.uint64(8) | transitions & _low(1)
            one, two = np.argsort(contexts), np.argsort(transitions)
            self.levels.append((contexts[one], totals[one], rest[one], transitions[two], counts[two]))

    @property
    def depth(self) -> int:
        return len(self.levels)

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """P(symbol | history) of distinct, ordered grams, latest symbol of the history first."""
        symbol, at = keys & _low(1), np.arange(len(keys))
        p = self.root[symbol.astype(np.int64)]
        history = keys
        for k, (contexts, totals, rest, transitions, counts) in enumerate(self.levels, 1):
            if not len(contexts) or not len(at):
                break
            context = history >> np.uint64(8 * (self.depth + 1 - k))
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            place = np.minimum(np.searchsorted(contexts, context[first]), len(contexts) - 1)
            # A context is retained with all its suffixes: what is unknown here is unknown at every greater depth.
            held, width = contexts[place] == context[first], np.diff(np.append(first, len(context)))
            known = np.repeat(held, width)
            at, history, symbol, context = at[known], history[known], symbol[known], context[known]
            place = np.repeat(place[held], width[held])
            gram = context << np.uint64(8) | symbol
            to = np.minimum(np.searchsorted(transitions, gram), len(transitions) - 1)
            n = np.where(transitions[to] == gram, counts[to], 0)
            p[at] = (n + rest[place] * p[at]) / totals[place]
        return p

    def log10(self, keys: np.ndarray) -> np.ndarray:
        return np.log10(self.probabilities(keys))


class TableOfLogs:
    """What ``gram_logs`` found for the grams of one block, in place of a tree."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        return self.logs[np.searchsorted(self.keys, keys.view(np.int64))]


def log10_by_text(tree: SuffixTree | TableOfLogs, depth: int, symbols: np.ndarray, scored: np.ndarray, upto: np.ndarray) -> np.ndarray:
    keys, at = np.unique(grams(symbols, scored, depth, latest_first=True), return_inverse=True)
    each = np.concatenate([[0.0], np.cumsum(tree.log10(keys)[at])])
    return np.diff(each[np.concatenate([[0], upto])])


def count_entries(counted: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE, least_root: float = LEAST_ROOT) -> DataFrame:
    """(k, key, n): from (gram, n) the frequent symbols, with ``k`` symbols before them."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, int(np.ceil(min(least_share * total, least_root * total**0.5))))
    orders = F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(int(_low(k + 1).astype(np.int64)))).alias("key")) for k in range(depth + 1)])
    return settle(counted.select("n", F.inline(orders)).groupBy("k", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def _root(symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
    root = np.full(256, 0.5)
    root[symbols.astype(np.int64)] += n
    return root / root.sum()


def grow(counted: DataFrame, n_texts: int, depth: int = DEPTH, least_share: float = LEAST_SHARE, least_root: float = LEAST_ROOT, smoothing: float = SMOOTHING) -> SuffixTree:
    """The tree from (gram, n)."""
    return _grown(count_entries(counted, depth, least_share, least_root), n_texts, depth, smoothing)


def _grown(entries: DataFrame, n_texts: int, depth: int = DEPTH, smoothing: float = SMOOTHING) -> SuffixTree:
    """The tree from ``count_entries``, whose rows of three numbers the driver receives."""
    kept = entries.toArrow()
    kind, key, count = (kept.column(c).to_numpy() for c in ("k", "key", "n"))
    entries = []
    for k in range(depth + 1):
        mine = kind == k
        order = np.argsort(key[mine])
        entries.append((key[mine][order].astype(np.uint64), count[mine][order].astype(np.float64)))
    del kept, kind, key, count
    root = _root(*entries[0])
    levels = []
    for k in range(1, depth + 1):
        grams_k, n = entries[k]
        context = grams_k >> np.uint64(8)
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(n, start) if len(start) else np.zeros(0)
        levels.append([context[start], sums, grams_k, n, start])
    retained = [np.zeros(len(x[0]), dtype=bool) for x in levels]
    for k in range(depth, 0, -1):
        contexts, sums, grams_k, n, start = levels[k - 1]
        if not len(start):
            continue
        shorter, shorter_n = entries[k - 1]
        above = shorter_n[np.searchsorted(shorter, grams_k & _low(k))]
        if k == 1:
            above_sum = np.full(len(contexts), shorter_n.sum())
        else:
            above_sum = levels[k - 2][1][np.searchsorted(levels[k - 2][0], contexts & _low(k - 1))]
        width = np.diff(np.append(start, len(n)))
        ratio = (n / np.repeat(sums, width)) / (above / np.repeat(above_sum, width))
        gain = np.add.reduceat(n * np.log(ratio), start)
        retained[k - 1] |= gain > width + 3.0
        if k > 1:
            parents = np.searchsorted(levels[k - 2][0], contexts[retained[k - 1]] & _low(k - 1))
            retained[k - 2][parents] = True
    out = []
    for k, ((contexts, sums, grams_k, n, start), keep) in enumerate(zip(levels, retained, strict=True), 1):
        width = np.diff(np.append(start, len(n))) if len(start) else np.zeros(0, dtype=np.int64)
        inside = np.repeat(keep, width)
        # A context is followed by a symbol wherever it occurs; the ends before a text are one for each text.
        shorter, shorter_n = entries[k - 1]
        at = np.minimum(np.searchsorted(shorter, contexts), len(shorter) - 1)
        full = np.where(shorter[at] == contexts, shorter_n[at], n_texts) if len(contexts) else sums
        free = smoothing * width
        out.append((contexts[keep], (full + free)[keep], (full - sums + free)[keep], grams_k[inside], n[inside].astype(np.float32)))
    return SuffixTree(root, out)


def grow_table(entries: DataFrame, n_texts: int, smoothing: float = SMOOTHING) -> DataFrame:
    """The tree that ``grow`` makes, as a table: (k, key, state, a, b), of any size.

    A state has its context for key, what it counts in all and what it leaves to its suffix; a transition its gram and count.
    """
    every = entries.select("k", "key", "n", F.shiftright("key", 8).alias("context"))
    low = F.expr("shiftleft(1L, 8 * k) - 1")
    contexts = settle(every.groupBy("k", "context").agg(F.sum("n").cast("double").alias("sums"), F.count("*").alias("width")))
    shorter = entries.select((F.col("k") + 1).alias("k"), F.col("key").alias("up_key"), F.col("n").alias("above"))
    above = contexts.select((F.col("k") + 1).alias("k"), F.col("context").alias("up_context"), F.col("sums").alias("above_sum"))
    told = every.filter("k > 0").withColumn("up_key", F.col("key").bitwiseAND(low)).join(shorter, ["k", "up_key"])
    told = told.groupBy("k", "context").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("above"))).alias("gain"))
    told = told.join(contexts, ["k", "context"]).withColumn("up_context", F.col("context").bitwiseAND(F.expr("shiftleft(1L, 8 * (k - 1)) - 1"))).join(above, ["k", "up_context"])
    # The sum of n log((n / sums) / (above / above_sum)), whose last parts are the same for all symbols of a context.
    long = told.filter(F.col("gain") + F.col("sums") * F.log(F.col("above_sum") / F.col("sums")) > F.col("width") + 3.0)
    kept = long.select(F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"), "context").select("k", F.col("context").bitwiseAND(low).alias("context")).distinct()
    kept = settle(kept)
    free = F.col("width") * smoothing
    whole = entries.select((F.col("k") + 1).alias("k"), F.col("key").alias("context"), F.col("n").alias("full"))
    states = kept.join(contexts, ["k", "context"]).join(whole, ["k", "context"], "left").withColumn("full", F.coalesce("full", F.lit(n_texts)))
    states = states.select("k", F.col("context").alias("key"), F.lit(True).alias("state"), (F.col("full") + free).alias("a"), (F.col("full") - F.col("sums") + free).alias("b"))
    moves = every.join(kept, ["k", "context"]).select("k", "key", F.lit(False).alias("state"), F.col("n").cast("double").alias("a"), F.lit(0.0).alias("b"))
    return settle(states.unionByName(moves))


def _tree_of(root: np.ndarray, tables: list[pa.Table], depth: int) -> SuffixTree:
    k, key, state, a, b = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("k", "key", "state", "a", "b"))
    levels = []
    for j in range(1, depth + 1):
        one, two = (k == j) & state, (k == j) & ~state
        levels.append((key[one].astype(np.uint64), a[one], b[one], key[two].astype(np.uint64), a[two].astype(np.float32)))
    return SuffixTree(root, levels)


def gram_logs(blocks: DataFrame, entries: DataFrame, n_texts: int, depth: int, per_task: int = 1_000_000) -> DataFrame:
    """(block, key, p): log10 P(symbol | history) of each block's distinct grams, latest symbol first, by a tree of any size.

    A shard of the tree holds the contexts that end with the same two symbols, and no task more than ``per_task`` grams
    with one shard; contexts of one symbol, at most 2^16 transitions, go to all.
    """

    def distinct(table: pa.Table) -> pa.Table:
        held = []
        for part in _table_slices(table, "text", SLICE_BYTES):
            symbols, scored, _ = normalised(part.column("text").to_pylist(), depth)
            held.append(np.unique(grams(symbols, scored, depth, latest_first=True)))
        keys = np.unique(np.concatenate(held)).view(np.int64)
        return pa.table({"block": np.full(len(keys), table.column("block")[0].as_py(), dtype=np.int64), "key": keys})

    model = grow_table(entries, n_texts)
    plain, short = entries.filter("k = 0").toArrow(), model.filter("k = 1").toArrow()  # bounded by the alphabet
    root = _root(plain.column("key").to_numpy(), plain.column("n").to_numpy())
    asked = settle(blocks.select("block", "text").groupBy("block").applyInArrow(distinct, "block long, key long"))
    latest, next_ = (F.shiftright("key", 8 * (depth - i)).bitwiseAND(F.lit(255)) for i in (0, min(1, depth - 1)))
    grams_ = asked.select("key").distinct().withColumn("shard", latest + next_ * 256)
    grams_ = settle(grams_)
    parts = settle(grams_.groupBy("shard").agg(F.ceil(F.count("*") / per_task).cast("int").alias("parts")))  # 2^16 rows at most
    left = grams_.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).select("shard", "part", "key")
    history = F.when(F.col("state"), F.col("key")).otherwise(F.shiftright("key", 8))
    right = model.filter("k > 1").withColumn("shard", history.bitwiseAND(F.lit(0xFFFF))).join(F.broadcast(parts), "shard")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select("shard", "part", "k", "key", "state", "a", "b")

    def work(some: pa.Table, rows: pa.Table) -> pa.Table:
        keys = np.sort(some.column("key").to_numpy())
        tree = _tree_of(root, [short, rows], depth)
        return pa.table({"key": keys, "p": np.log10(tree.probabilities(keys.view(np.uint64))) if len(keys) else np.zeros(0)})

    logs = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(work, "key long, p double")
    return asked.join(logs, "key").select("block", "key", "p")


def _word_hashes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the positions where they start."""
    word = (symbols != 32) & (symbols != END)
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    return hash_runs(symbols, edge[::2], edge[1::2]).view(np.int64), edge[::2]


def _table_slices(table: pa.Table, column: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        names = batch.schema.names
        yield from byte_slices(batch.select([*(n for n in names if n != column)][:1] + [column] + [*(n for n in names if n != column)][1:]), size)


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, h, n): each block's distinct words with their counts in its training rows; the end is the word -1."""

    def work(table: pa.Table) -> pa.Table:
        held, counts = [np.array([_END_HASH])], [np.zeros(1, dtype=np.int64)]
        for part in _table_slices(table, "text", SLICE_BYTES):
            symbols, _, _ = normalised(part.column("text").to_pylist(), 1)
            h, at = _word_hashes(symbols, 1)
            train = part.column("train").to_numpy(zero_copy_only=False)
            text_of = np.searchsorted(np.flatnonzero(symbols == END)[1:], at)
            keys, inverse = np.unique(h, return_inverse=True)
            held += [keys, np.array([_END_HASH])]
            counts += [np.bincount(inverse, train[text_of].astype(np.float64), len(keys)).astype(np.int64), np.array([int(train.sum())])]
        keys, inverse = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        block = np.full(len(keys), table.column("block")[0].as_py(), dtype=np.int64)
        return pa.table({"block": block, "h": keys, "n": n})

    return blocks.groupBy("block").applyInArrow(work, "block long, h long, n long")


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train: Column | None = None, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row. ``train``: which rows to learn from."""
    spark = docs.sparkSession
    train = F.coalesce(train if train is not None else F.lit(True), F.lit(False))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), train.alias("train"))
    size, n_train = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    entries = count_entries(settle(count_grams(source.filter("train").select("text"), depth)), depth)
    small = entries.count() <= max_entries
    model = spark.sparkContext.broadcast(_grown(entries, n_train, depth)) if small else None

    blocks = source.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-size // block_bytes)))))
    # The sums by word are used twice, for the blocks and for two totals; dealing the rows by word first, with all their
    # columns, lets Spark reuse that exchange, and the documents' exchange below it.
    words = block_words(blocks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h")
    totals = words.groupBy("h").agg(F.sum("n").alias("c"), F.collect_list("block").alias("blocks"))
    whole = totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("train_tokens"), F.count_if((F.col("c") > 0) & (F.size("blocks") > 0)).alias("kinds"))
    told = totals.select(F.explode("blocks").alias("block"), "h", "c")
    if not small:
        logs = gram_logs(blocks, entries, n_train, depth).select("block", F.col("key").alias("h"), F.lit(None).cast("long").alias("c"), "p")
        told = told.withColumn("p", F.lit(None).cast("double")).unionByName(logs)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if model is None:
            of_gram = pc.is_valid(right.column("p"))
            logs, right = right.filter(of_gram), right.filter(pc.invert(of_gram))
            tree = TableOfLogs(logs.column("h").to_numpy(), logs.column("p").to_numpy())
        else:
            tree = model.value
        order = np.argsort(right.column("h").to_numpy())
        keys, counts = right.column("h").to_numpy()[order], right.column("c").to_numpy()[order]
        logs = np.log10(counts + 0.5)
        out = []
        for part in _table_slices(left, "text", SLICE_BYTES):
            symbols, scored, upto = normalised(part.column("text").to_pylist(), depth)
            score = log10_by_text(tree, depth, symbols, scored, upto)
            h, at = _word_hashes(symbols, depth)
            uniq, inverse = np.unique(h, return_inverse=True)
            place = np.searchsorted(keys, uniq)
            end = int(np.searchsorted(keys, _END_HASH))
            position = np.cumsum(scored)[at] if len(at) else np.zeros(0, dtype=np.int64)
            bounds = np.concatenate([[0], np.searchsorted(position, upto, side="right")])
            base = np.diff(np.concatenate([[0.0], np.cumsum(logs[place][inverse])])[bounds]) + logs[end]
            known = np.diff(np.concatenate([[0], np.cumsum((counts[place] > 0)[inverse])])[bounds]) + int(counts[end] > 0)
            tokens = np.diff(bounds) + 1
            out.append(pa.table({"doc_id": part.column("doc_id"), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, SCORES)
    floor = F.log10(F.col("train_tokens") + 0.5 * (F.col("kinds") + 1))
    scored = scored.join(F.broadcast(whole))  # one row
    return scored.select("doc_id", "n_tokens", "n_known", "train_tokens", (F.col("base_score") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op2_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, train=crc_mod(F.col("doc_id"), 5) != 1)
    return scored.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
