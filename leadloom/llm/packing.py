"""Filling fixed-capacity containers with items (problem 8).

Only the histogram of item lengths decides the packing, and it has at most ``capacity`` entries however many
items there are. With one permitted size, ``pack_histogram`` runs a best-fit decreasing over it, moving whole groups
of equal bins at a time: items go to the open bins with the least sufficient room, and new bins are opened when none
has room. With several sizes, ``pack_sizes`` chooses size and contents together: for the longest length left it
compares all sizes and numbers of copies, each filled up best-fit with the lengths left, opens the bin size of least
waste for its content, and repeats the pattern as often as the items allow. In the end each bin is cut down to the
smallest permitted size that holds its contents. The resulting plan has a few entries per length. The items of a
length are numbered by a distributed count and take the plan's slots in order, so neither texts nor ids meet in one
place.

An item larger than the largest container is split: full containers of its own and a rest that is packed like
an item. Nothing else is ever split.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: word pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(column, path: str = TOKENIZER):  # noqa: ANN001, ANN201
    """Column: tokens of a text; NULL counts 0."""

    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(column)


def pack_sizes(histogram: dict[int, int], capacities: tuple[int, ...], copies: int = 16) -> list[tuple[int, int, dict[int, int]]]:
    """``pack_histogram`` for several sizes; of each size the ``copies`` largest numbers of the longest length are tried."""
    sizes = sorted(set(capacities))
    left = {n: k for n, k in histogram.items() if k}
    lengths = sorted(left)
    out: list[tuple[int, int, dict[int, int]]] = []
    while lengths:
        longest = lengths[-1]
        best: tuple[float, int, dict[int, int]] | None = None
        for size in (c for c in reversed(sizes) if c >= longest):  # of equal waste the larger size
            most = min(left[longest], size // longest)
            for each in range(most, max(0, most - copies), -1):
                held, room = {longest: each}, size - each * longest
                at = bisect_right(lengths, min(room, longest - 1)) - 1
                while at >= 0:
                    n = lengths[at]
                    held[n] = min(room // n, left[n])
                    room -= held[n] * n
                    at = min(at, bisect_right(lengths, room)) - 1 if room >= lengths[0] else -1
                if best is None or room / size < best[0]:
                    best = (room / size, size, held)
                if not room:
                    break
            if best[0] == 0:
                break
        _, _, held = best
        bins = min(left[n] // k for n, k in held.items())
        used = sum(n * k for n, k in held.items())
        out.append((next(c for c in sizes if c >= used), bins, held))
        for n, k in held.items():
            left[n] -= bins * k
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
    return out


def pack_histogram(histogram: dict[int, int], capacities: tuple[int, ...]) -> list[tuple[int, int, dict[int, int]]]:
    """[(capacity, bins, {length: items per bin})] that packs ``histogram`` (length -> items).

    Lengths must lie in 1..max(capacities). Deterministic; the number of entries is at most a few per length.
    """
    if len(set(capacities)) > 1:
        return pack_sizes(histogram, capacities)
    largest = max(capacities)
    rooms: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(largest + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = length
        while left and room <= largest:
            if not rooms[room]:
                room += 1
                continue
            bins, held = rooms[room].pop()
            each = min(room // length, max(1, left // bins))  # copies that every bin of the group can take
            if left < bins:
                rooms[room].append((bins - left, held))
                bins = left
            put = dict(held)
            put[length] = put.get(length, 0) + each
            rooms[room - each * length].append((bins, put))
            left -= each * bins
        if left:
            each = largest // length
            full, rest = divmod(left, each)
            if full:
                rooms[largest - each * length].append((full, {length: each}))
            if rest:
                rooms[largest - rest * length].append((1, {length: rest}))
    return [(largest, bins, held) for groups in rooms for bins, held in groups]


class Slots:
    """Where the n-th item of each length goes."""

    def __init__(self, plan: list[tuple[int, int, dict[int, int]]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        self.first, self.capacity, at = [], [], 0
        for capacity, bins, held in plan:
            for length, each in held.items():
                rows.setdefault(length, []).append((at, each, bins))
            self.first.append(at)
            self.capacity.append(capacity)
            at += bins
        self.bins = at
        self.table = {}
        for length, entries in rows.items():
            ends = np.cumsum([each * bins for _, each, bins in entries])
            self.table[length] = (
                ends,
                np.array([a for a, _, _ in entries], dtype="int64"),
                np.array([e for _, e, _ in entries], dtype="int64"),
            )

    def place(self, length: int, ranks: np.ndarray) -> np.ndarray:
        ends, base, each = self.table[length]
        k = np.searchsorted(ends, ranks, side="right")
        start = np.where(k > 0, ends[np.maximum(k - 1, 0)], 0)
        return base[k] + (ranks - start) // each[k]

    def size_of(self, container: np.ndarray) -> np.ndarray:
        return np.array(self.capacity, dtype="int64")[np.searchsorted(self.first, container, side="right") - 1]


def pack(
    items: DataFrame, id_col: str, length_col: str, capacities: tuple[int, ...] = (2_048,), buckets: int = 256
) -> DataFrame:
    """(container_id, capacity, n_tokens, doc_ids, parts): every container with its items in id order.

    ``parts`` gives for each id the piece number of a split item, 0 for a whole one. Items with a NULL id or
    without tokens need no container and are left out; repeated ids are packed as separate items; an empty
    table gives no container.
    """
    largest = max(capacities)
    whole = items.where(F.col(id_col).isNotNull() & (F.col(length_col) > 0)).select(
        F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("n")
    )
    pieces = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("n") / largest).cast("int")),
        lambda i: F.struct(
            F.when(F.col("n") > largest, i).otherwise(F.lit(0)).alias("part"),
            F.least(F.lit(largest), F.col("n") - (i - 1) * largest).cast("int").alias("len"),
        ),
    )
    bucket = F.pmod(F.xxhash64("id", "p.part"), F.lit(buckets)).cast("int")
    units = cut(
        whole.select("id", F.explode(pieces).alias("p"))
        .select("id", "p.part", "p.len", bucket.alias("bucket"))
    )
    counts = cut(units.groupBy("len", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["len"]: r["n"] for r in counts.groupBy("len").agg(F.sum("n").alias("n")).toLocalIterator()}
    slots = Slots(pack_histogram(histogram, capacities))
    before = Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("len", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("len", "bucket").orderBy("id", "part")
    ranked = units.withColumn("row", F.row_number().over(within) - 1).join(offsets, ["len", "bucket"]).select(
        "id", "part", "len", (F.col("offset") + F.col("row")).alias("rank")
    )

    def place(lens: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(lens), dtype="int64")
        for length, where in lens.groupby(lens).groups.items():
            at = lens.index.get_indexer(where)
            out[at] = slots.place(int(length), ranks.to_numpy()[at])
        return pd.Series(out)

    def size_of(containers: pd.Series) -> pd.Series:
        return pd.Series(slots.size_of(containers.to_numpy()))

    placed = ranked.select("id", "part", "len", F.pandas_udf(place, "long")("len", "rank").alias("container_id"))
    return (
        placed.groupBy("container_id")
        .agg(F.sum("len").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("id", "part"))).alias("held"))
        .select(
            "container_id",
            F.pandas_udf(size_of, "long")("container_id").alias("capacity"),
            "n_tokens",
            F.col("held.id").alias("doc_ids"),
            F.col("held.part").alias("parts"),
        )
    )
