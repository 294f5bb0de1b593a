"""Problem 8: whole documents in containers of fixed token capacity, by cost-balanced packing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import spread, written

#: Where the public vocabulary files are; a parameter of every operator here.
TOKENIZER = os.environ.get("AUDITLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CAPACITY = 2048
#: Tokens that one task packs at about; more tokens make more shards, not larger ones.
SHARD_TOKENS = 1 << 21
#: Cost of n tokens of one document: LINEAR * n + QUADRATIC * n^2 (attention looks at pairs of tokens).
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Longer texts are encoded in parts, cut where the tokenizer's own pattern cuts.
PART_CHARS = 1 << 18


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    """Parts that end before a single space between letters, which is where a token ends anyway."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        while cut != -1 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; null has none. Special tokens' strings count as ordinary text."""
    if not text:
        return 0
    encode = _encoding(path).encode_ordinary
    return sum(len(encode(part)) for part in _parts(text))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t.as_py(), tokenizer) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, "doc_id long, tokens long")


def pack(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Container of each size (none above ``capacity``).

    As many containers as the tokens need are open from the start; sizes go in descending order to the container
    of the lowest cost among those with room left, and where none has room a new one is opened.
    """
    order = np.argsort(-sizes, kind="stable")
    total = int(sizes.sum())
    most = max(1, -(-total // capacity))
    room = np.full(most + len(sizes), 0, np.int64)
    room[:most] = capacity
    cost = np.zeros(len(room))
    used = most
    where = np.empty(len(sizes), np.int64)
    for k in order.tolist():
        n = int(sizes[k])
        at = int(np.argmin(np.where(room[:used] >= n, cost[:used], np.inf)))
        if room[at] < n:
            at, used = used, used + 1
            room[at] = capacity
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
        where[k] = at
    return where


def containers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(container_id, doc_id, piece, first_token, tokens): every document's place.

    A document of at most ``capacity`` tokens is one piece; a longer one is cut into full containers and a rest
    that is packed like a document. Rows are spread over shards of about ``shard_tokens`` tokens by a hash of id and
    row, so copies of one id spread as well, and each shard is packed on its own: a shard wastes less than one
    container more than the whole would. Null and empty texts are pieces of 0 tokens in some container, repeated rows are packed
    as often as they occur, ties of size keep the order of their ids, an empty table gives no containers.
    """
    counted = written(token_counts(docs, doc_id, text, tokenizer), "tokens")
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    spread = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        ids = table["doc_id"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, size = ids[order], table["tokens"].to_numpy()[order]
        full = np.maximum(0, -(-size // capacity) - 1)
        pieces = full + 1
        row = np.repeat(np.arange(len(ids)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.where(piece < full[row], capacity, size[row] - full[row] * capacity)
        rest = np.flatnonzero(tokens < capacity)
        place = np.empty(len(row), np.int64)
        place[rest] = pack(tokens[rest], capacity)
        whole = np.flatnonzero(tokens >= capacity)
        place[whole] = (int(place[rest].max()) + 1 if len(rest) else 0) + np.arange(len(whole))
        return pa.table({"container_id": place + (shard << 32), "doc_id": pa.array(ids[row], pa.int64()), "piece": piece.astype(np.int32), "first_token": piece * capacity, "tokens": tokens})

    return spread.groupBy("shard").applyInArrow(run, "container_id long, doc_id long, piece int, first_token long, tokens long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, least, fill): how full the containers are; ``least`` is the fewest that could do."""
    by = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    return by.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens")).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("fill")
    )
