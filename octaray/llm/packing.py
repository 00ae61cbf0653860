"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Texts become ids (byte-level BPE) and an end id; documents longer than a sequence are cut into full pieces, with the
remainder first. Full pieces fill a sequence alone. The other pieces are dealt evenly to shards of about ``shard_rows``
pieces; a shard is packed by ``islands`` populations that evolve apart and pass their best packing on to the next
island after each epoch. A chromosome is a list of bins. The first packing is best-fit decreasing; the others fill bin
after bin by random choices, so that parents differ. Crossover injects the fullest bins of the other parent that this
one lacks and removes the bins that hold duplicates of their pieces; mutation dissolves the emptiest bins and some
random ones. Displaced pieces first replace shorter ones in bins that they fill better, then what is left goes back by
best fit, largest first. Fitness is fewer bins first, then the mean squared fill. Evolution is seeded, so reruns agree.

The number of shards follows the number of pieces, and each shard wastes at most about one bin against a packing of
everything at once.

Cases: a null or empty text is the end id alone; texts are encoded whole; repeated rows are packed as separate
documents; an empty table gives no rows; extra columns are not read. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, read_table, settle

CAPACITY, END_ID = 1024, 2
SHARD_ROWS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 2, 8, 4
#: Share of the bins that mutation dissolves (as many again at random); pieces of the largest bin that exchanges some;
#: random choices for each place of a bin in the packings that evolution starts from.
DISSOLVED, EXCHANGED, TRIES = 0.01, 12, (10, 2, 6)
#: Encodings of words kept per Python worker; the cache is emptied when it is full.
CACHE_WORDS = 400_000
#: The vocabulary's word pattern starts anew at a space that is followed by anything but white space. In a text whose
#: spaces are all such, or its last character, the parts between spaces are encoded apart, each with its space.
OTHER_SPACE = re.compile(r" \s")
WORD_START = re.compile(r"(?= \S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the published word pattern of byte-level vocabularies of this kind.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if a piece's id is its rank: every merge makes the next id after the bytes."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if made != list(range(256, 256 + len(made))):
        return None
    return {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if i < 256 + len(made)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """(function from texts to lists of ids, known words) of a tokenizer file.

    Plain byte-level merges run several times faster through ranks, with the same ids; other files run as they are.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    before = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] == "BPE" and not spec.get("normalizer") and plain.items() <= before.items() and (ranks := byte_ranks(spec["model"])):
        import tiktoken

        encoding = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [encoding.encode_ordinary(t) for t in texts]), {}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return (lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), {}


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text. Each distinct word of the batch is encoded once."""
    encode, known = _encoder(path)
    if len(known) > CACHE_WORDS:
        known.clear()
    split, words, starts = [], set(), set()
    for t in texts:
        if not t:
            split.append(None)
            continue
        if OTHER_SPACE.search(t):
            parts = WORD_START.split(t)
            parts[1:] = [p[1:] for p in parts[1:]]
            first = parts[0]
        else:
            parts = t.split(" ")
            first = parts[0]
        split.append((first, parts[1:]))
        starts.add(first)
        words.update(parts[1:])
    new = [w for w in words if w not in known]
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        for w, e in zip(part, encode([" " + w for w in part]), strict=True):
            known[w] = array("I", e).tobytes()
    first_ids = [f for f in starts if f]
    begun = {"": b""} | {f: array("I", e).tobytes() for f, e in zip(first_ids, encode(first_ids), strict=True)}
    get = known.__getitem__
    return [b"" if s is None else begun[s[0]] + b"".join(map(get, s[1])) for s in split]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of (doc_id, text) rows. ``vocabulary``: a tokenizer file that every executor has."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for whole in batches:
            for batch in byte_slices(whole, 2_000_000):
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), vocabulary), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if piece == 0 else capacity
                        row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        for values, value in zip(out.values(), row, strict=True):
                            values.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return docs.mapInArrow(work, PIECE)


Packing = list[tuple[int, ...]]


class Pool:
    """Pieces without a bin, by length; bit n of ``mask``: some have length n."""

    def __init__(self, items, lengths: list[int]):
        self.lengths, self.at, self.mask, self.pairs = lengths, {}, 0, 0
        for i in items:
            self.add(i)

    def add(self, item: int) -> None:
        n = self.lengths[item]
        self.at.setdefault(n, []).append(item)
        self.mask |= 1 << n

    def take(self, n: int) -> int:
        here = self.at[n]
        item = here.pop()
        if not here:
            del self.at[n]
            self.mask ^= 1 << n
        return item

    def longest(self, room: int) -> int:
        """The greatest length of at most ``room``; below 1: none."""
        return (self.mask & ((2 << room) - 1)).bit_length() - 1

    def add_pairs(self, capacity: int) -> None:
        """Bit n of ``pairs``: two of the pieces had length n together when this was last called."""
        sums = 0
        for n, here in self.at.items():
            sums |= (self.mask if len(here) > 1 else self.mask ^ (1 << n)) << n
        self.pairs = sums & ((2 << capacity) - 1)

    def split(self, total: int) -> tuple[int, ...]:
        for n, here in self.at.items():
            if total - n in self.at and (2 * n != total or len(here) > 1):
                return n, total - n
        return ()

    def longest_pair(self, room: int, least: int, capacity: int) -> tuple[int, ...]:
        """The lengths of two pieces, together as long as fits and longer than ``least``; (): there are none."""
        low = (2 << room) - 1
        while (total := (self.pairs & low).bit_length() - 1) > least:
            if pair := self.split(total):
                return pair
            self.add_pairs(capacity)
        return ()


def best_fit(lengths: list[int], capacity: int, bins: Packing, items) -> Packing:
    """Each item, in order, goes to the bin that it leaves with the least space."""
    out: list = [list(b) for b in bins]
    with_space: dict[int, list[int]] = {}
    spaces = 0  # bit f: some bin has f places left

    def leave(b: int, space: int) -> int:
        if not space:
            return 0
        with_space.setdefault(space, []).append(b)
        return 1 << space

    for b, items_in in enumerate(out):
        spaces |= leave(b, capacity - sum(lengths[i] for i in items_in))
    for i in items:
        n = lengths[i]
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = with_space[space].pop()
            if not with_space[space]:
                spaces ^= 1 << space
        else:
            b, space = len(out), capacity
            out.append([])
        out[b].append(i)
        spaces |= leave(b, space - n)
    return [tuple(sorted(b)) for b in out]


def by_length(lengths: list[int], items) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def tight_fit(lengths: list[int], capacity: int, rng, tries: int) -> Packing:
    """Bin by bin: the longest piece left, then, again and again, the one or two of some random choices that fill best."""
    pool, bins = Pool(range(len(lengths)), lengths), []
    while pool.mask:
        n = pool.mask.bit_length() - 1
        inside, room = [pool.take(n)], capacity - n
        while room and (longest := pool.longest(room)) > 0:
            best = (longest,)
            for some in rng.integers(1, room + 1, tries).tolist() if longest < room else ():
                one = pool.longest(some)
                if one < 1:
                    continue
                two = pool.longest(min(room - one, one if len(pool.at[one]) > 1 else one - 1))
                if one + max(two, 0) > sum(best):
                    best = (one, two) if two > 0 else (one,)
            inside += [pool.take(n) for n in best]
            room -= sum(best)
        bins.append(tuple(sorted(inside)))
    return bins


def fitness(bins: Packing, lengths: list[int], capacity: int) -> float:
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins)) - len(bins)


def replace_dominated(bins: Packing, pool: Pool, lengths: list[int], capacity: int, rng) -> None:
    """Bins in random order give up to two pieces for one or two longer ones of the pool, those that fill them best.

    The pool is left with more and shorter pieces, which best fit places more easily. Bins of over ``EXCHANGED`` pieces
    stay as they are: small pieces fill them already.
    """
    pool.add_pairs(capacity)
    for b in rng.permutation(len(bins)).tolist():
        inside = bins[b]
        sizes = [lengths[i] for i in inside]
        space = capacity - sum(sizes)
        if not space or len(inside) > EXCHANGED:
            continue
        choices = [((), 0), *(((x,), n) for x, n in enumerate(sizes)), *(((x, y), sizes[x] + sizes[y]) for x in range(len(sizes)) for y in range(x))]
        gain, given, taken = 0, (), ()
        for out, size in choices:
            one = pool.longest(space + size)
            if one - size > gain:
                gain, given, taken = one - size, out, (one,)
            if pair := pool.longest_pair(space + size, size + gain, capacity):
                gain, given, taken = sum(pair) - size, out, pair
            if gain == space:
                break
        if gain:
            new = [pool.take(n) for n in taken]
            for x in given:
                pool.add(inside[x])
            bins[b] = tuple(sorted([*(i for x, i in enumerate(inside) if x not in given), *new]))


def crossover(one: Packing, other: Packing, lengths: list[int], capacity: int, rng) -> tuple[Packing, list[int]]:
    """(bins, displaced pieces): some of the fullest bins of ``other`` that ``one`` lacks, and the bins of ``one`` that
    hold none of their pieces."""
    held_by_both = set(one)
    lacking = sorted((b for b in other if b not in held_by_both), key=lambda b: (-sum(lengths[i] for i in b), b))
    most = max(1, len(lacking) // 2)
    injected = lacking[: int(rng.integers(max(1, most // 4), most + 1))]
    held = {i for b in injected for i in b}
    kept = [b for b in one if held.isdisjoint(b)]
    inside = held.union(*kept)
    return injected + kept, [i for b in one for i in b if i not in inside]


def mutate(bins: Packing, lengths: list[int], rng, share: float) -> tuple[Packing, list[int]]:
    """(bins, displaced pieces): the emptiest bins and as many random ones are dissolved."""
    if not bins:
        return [], []
    order = sorted(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b]))
    n = max(2, int(len(bins) * share))
    out = sorted({*order[:n], *rng.integers(0, len(bins), n).tolist()})
    gone = set(out)
    return [b for k, b in enumerate(bins) if k not in gone], [i for k in out for i in bins[k]]


def offspring(one: Packing, other: Packing, lengths: list[int], capacity: int, rng, share: float) -> Packing:
    bins, displaced = crossover(one, other, lengths, capacity, rng)
    bins, more = mutate(bins, lengths, rng, share)
    pool = Pool([*displaced, *more], lengths)
    replace_dominated(bins, pool, lengths, capacity, rng)
    return best_fit(lengths, capacity, bins, by_length(lengths, (i for here in pool.at.values() for i in here)))


def evolve(lengths: list[int], capacity: int, population: list[Packing], generations: int, size: int, seed: int, share: float = DISSOLVED) -> list[Packing]:
    """Best first. Ends early where the bins are as few as the lengths allow."""
    rng = np.random.default_rng(seed)
    population = population or [best_fit(lengths, capacity, [], by_length(lengths, range(len(lengths))))]
    least = -(-sum(lengths) // capacity)
    while len(population) < size and min(map(len, population)) > least:
        population = [*population, tight_fit(lengths, capacity, rng, TRIES[len(population) % len(TRIES)])]
    worth = [fitness(p, lengths, capacity) for p in population]
    for _ in range(generations):
        if len(population) < 2 or min(map(len, population)) <= least:
            break
        a, b = sorted(rng.choice(len(population), 2, replace=False).tolist(), key=lambda k: -worth[k])
        child = offspring(population[a], population[b], lengths, capacity, rng, share)
        value, worst = fitness(child, lengths, capacity), int(np.argmin(worth))
        if value > worth[worst] and value not in worth:
            population[worst], worth[worst] = child, value
    return [population[k] for k in sorted(range(len(population)), key=lambda k: -worth[k])]


def _numbers(bins: Packing, n: int) -> bytes:
    out = np.empty(n, dtype=np.int32)
    for b, items in enumerate(bins):
        out[list(items)] = b
    return out.tobytes()


def _bins(numbers: bytes) -> Packing:
    number = np.frombuffer(numbers, dtype=np.int32)
    out: list[list[int]] = [[] for _ in range(int(number.max()) + 1)] if len(number) else []
    for i, b in enumerate(number.tolist()):
        out[b].append(i)
    return [tuple(b) for b in out]


ISLAND = "shard long, island int, lengths array<int>, packings array<binary>"


def _epoch(capacity: int, generations: int, population: int, epoch: int):
    """One epoch of every (shard, island) row; packings: the island's own, best first, then the migrant."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packings = []
            for row in pdf.itertuples():
                lengths = list(map(int, row.lengths))
                start = [_bins(p) for p in row.packings]
                seed = (int(row.shard) * 1009 + int(row.island)) * 31 + epoch
                found = evolve(lengths, capacity, start, generations, population, seed)
                packings.append([_numbers(p, len(lengths)) for p in found[:population]])
            yield pdf.assign(packings=packings)[["shard", "island", "lengths", "packings"]]

    return work


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset."""
    names = pieces.columns
    placed = settle(pieces.withColumn("_row", F.monotonically_increasing_id()))  # numbers are fixed once they are written
    full = placed.filter(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    part = placed.filter(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_rows))
    part = part.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    # Within a shard, pieces are numbered by length, then row; a shard holds about shard_rows pieces.
    dealt = part.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("size"), "_row"))).alias("order"))
    state = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("order", lambda x: -x["size"].cast("int")).alias("lengths"), F.array().cast("array<binary>").alias("packings"))
    for epoch in range(epochs):
        if epoch:
            elite = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("packings")[0].alias("migrant"))
            state = state.join(elite, ["shard", "island"])
            state = state.select("shard", "island", "lengths", F.array_append("packings", F.col("migrant")).alias("packings"))
        state = settle(state.repartition(max(1, shards * islands // 8), "shard", "island").mapInPandas(_epoch(capacity, generations, population, epoch), ISLAND))
    best = state.select("shard", "island", "lengths", F.col("packings")[0].alias("packing"))

    def assign(key, rows: pd.DataFrame, packings: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        lengths = rows["length"].tolist()
        choices = [_bins(p) for p in packings.sort_values("island")["packing"]]
        bins = max(choices, key=lambda b: fitness(b, lengths, capacity))
        sequence, offset = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = int(key[0]) * (1 << 24) + b, at
                at += lengths[i]
        return rows.assign(sequence_id=sequence, offset=offset)[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    packed = part.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(assign, schema)
    return packed.unionByName(full.select(*names, "sequence_id", "offset"))


def pack(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pack_pieces(cut_pieces(source, vocabulary or default_vocabulary(), capacity), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
