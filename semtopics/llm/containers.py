"""Problem 8: filling fixed-capacity containers with items.

Method: Karmarkar-Karp multiway differencing. The items of a block start as partial
partitions of one filled window each; again and again the two partials of largest imbalance
are merged, largest window against smallest, until one partition into k near-equal windows is
left. k starts at the least possible number, ceil(total / capacity). Windows above capacity
give up items, which go where they fit best; what fits nowhere raises the window count and
is differenced again. Differencing balances windows, which wastes space where few items fill
one, so best-fit decreasing is tried on the same block as well and the smaller number of
containers wins (see README for figures).

Plan: texts are measured once (only id and length go on), hashed into blocks of about
``block_size`` items and packed block by block in Arrow groups of bounded size; the loss by
blocking is under one container a block. A text above capacity is cut into full pieces and
a rest; full pieces need no packing.

Edge cases: null and empty texts have no tokens and take no container (container_id null);
null ids are left out; ties go by id; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public pre-tokenisation pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` rank file, loaded once per worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item numbers into at most ``k`` windows of near-equal sum by multiway differencing.

    A partial holds its non-empty windows as (sum, tie, node) in ascending order; empty
    windows are implicit, and a node is an item number or a pair of nodes."""
    if k <= 1:
        return [list(range(len(sizes)))] if sizes else []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    heap = [(-sizes[i], r, [(sizes[i], r, i)]) for r, i in enumerate(order)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        largest = b[::-1]
        new, paired = largest[:free], largest[free:]  # empty windows of a are its smallest
        merged = a[len(paired) :] if paired else a
        for (s, _, x), (t, _, y) in zip(a, paired):
            tie += 1
            new.append((s + t, tie, (x, y)))
        if len(new) == 1:
            bisect.insort(merged, new[0])
        else:
            merged = sorted(merged + new)
        tie += 1
        low = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[-1][0], tie, merged))
    windows = []
    for _, _, node in heap[0][2] if heap else []:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        windows.append(items)
    return windows


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity`` by differencing; every size must be within it."""
    if not sizes:
        return []
    windows = difference(sizes, -(-sum(sizes) // capacity))
    load, spilled = [], []
    for w in windows:
        w.sort(key=lambda i: (sizes[i], i))
        total = sum(sizes[i] for i in w)
        while total > capacity:
            at = next((p for p, i in enumerate(w) if sizes[i] >= total - capacity), len(w) - 1)
            spilled.append(w.pop(at))
            total -= sizes[spilled[-1]]
        load.append(total)
    left = best_fit(sizes, capacity, spilled, windows, load)
    if left:
        windows += [[left[i] for i in w] for w in fill([sizes[i] for i in left], capacity)]
    return windows


def best_fit(sizes, capacity: int, items: list[int], windows: list[list[int]], load: list[int], grow: bool = False) -> list[int]:
    """Put items, largest first, where least room remains; returns those that fit nowhere."""
    room = sorted((capacity - total, j) for j, total in enumerate(load))
    left = []
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, j = room.pop(at)
            windows[j].append(i)
            bisect.insort(room, (free - sizes[i], j))
        elif grow:
            windows.append([i])
            bisect.insort(room, (capacity - sizes[i], len(windows) - 1))
        else:
            left.append(i)
    return left


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """The better of differencing and best-fit decreasing; differencing wins ties."""
    windows = fill(sizes, capacity)
    if len(windows) > -(-sum(sizes) // capacity):
        other: list[list[int]] = []
        best_fit(sizes, capacity, list(range(len(sizes))), other, [], grow=True)
        if len(other) < len(windows):
            windows = other
    return windows


def containers(lengths: DataFrame, capacities: dict[str, int], block_size: int = 2048) -> DataFrame:
    """(encoder_name, doc_id, piece, first_token, n_tokens, container_id) for (doc_id, n_tokens).

    ``capacities``: encoder name to capacity. A container is one (encoder_name, container_id)."""
    n_blocks = max(1, -(-lengths.count() // block_size))
    kinds = F.array(*[F.struct(F.lit(n).alias("encoder_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in sorted(capacities.items())])
    items = lengths.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).alias("block"), F.explode(kinds).alias("k")).select("doc_id", "n_tokens", "block", "k.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        capacity, first_id = int(pdf.capacity.iloc[0]), int(pdf.block.iloc[0]) << 32
        ids, sizes = pdf.doc_id.to_numpy(), pdf.n_tokens.to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        holders = np.flatnonzero(rest)
        number = np.zeros(len(sizes), np.int64)
        windows = pack([int(rest[i]) for i in holders], capacity)
        for c, w in enumerate(windows):
            number[holders[w]] = first_id + c
        out = [pd.DataFrame({"doc_id": ids[holders], "piece": full[holders], "first_token": full[holders] * capacity, "n_tokens": rest[holders], "container_id": number[holders]})]
        whole = np.repeat(np.arange(len(sizes)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        out.append(pd.DataFrame({"doc_id": ids[whole], "piece": piece, "first_token": piece * capacity, "n_tokens": capacity, "container_id": first_id + len(windows) + np.arange(len(whole))}))
        out = pd.concat(out, ignore_index=True)
        out.insert(0, "encoder_name", pdf.encoder_name.iloc[0])
        return out.astype({"piece": "int32", "first_token": "int64", "n_tokens": "int64"})

    packed = items.filter("n_tokens > 0").groupBy("encoder_name", "block").applyInPandas(run, "encoder_name string, doc_id long, piece int, first_token long, n_tokens long, container_id long")
    none = items.filter("n_tokens <= 0 or n_tokens is null").select("encoder_name", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    return packed.unionByName(none)


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """A container number for every text, or piece of a text, and every encoder."""
    limits = spark.read.parquet(f"{sf_dir}/encoder_limits.parquet").dropna().collect()  # a handful of encoders
    lengths = materialize(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), "p8-lengths")
    return containers(lengths, {r.encoder_name: r.max_tokens for r in limits if r.max_tokens > 0})


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Per encoder: containers used, tokens, least possible number and share of unused space."""
    limits = F.broadcast(spark.read.parquet(f"{sf_dir}/encoder_limits.parquet"))
    per = p8_containers(spark, sf_dir).filter("container_id is not null").groupBy("encoder_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    per = per.groupBy("encoder_name").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")).join(limits, "encoder_name")
    return per.select("encoder_name", "max_tokens", "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("max_tokens")).alias("least_containers"), (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens"))).alias("unused_share"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
