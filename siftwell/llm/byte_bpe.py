"""7. Byte-level BPE encoding and decoding.

The merges of a pre-token run on a segment tree over its byte positions: a leaf holds the rank of the pair that starts
there, an inner node the leftmost minimum. A merge takes the root's pair, drops the right neighbour from the chain of live
positions and updates the leaves of the pairs that changed, each along one path to the root: O(n log n) for n bytes.

Null texts count as empty: no ids, and the digests of empty strings. Rows with the same id or text stay separate rows, a
null id stays null, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Pre-tokens whose ids a worker remembers; the memory starts anew when full.
REMEMBERED = 300_000
_NONE = 1 << 62


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ranks, n = self.ranks, len(piece)
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length()  # a leaf's key is rank, then position, so that the least key is the leftmost least rank
        mask = (1 << shift) - 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n))  # where the part ahead of it starts

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                a, b = tree[i], tree[i ^ 1]
                i >>= 1
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while (top := tree[1]) != _NONE:
            i = top & mask
            mid = end[i]
            stop = end[mid]
            end[i] = stop
            put(mid, _NONE)
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i : end[stop]])
                put(i, _NONE if r is None else r << shift | i)
            else:
                put(i, _NONE)
            if i:
                j = before[i]
                r = ranks.get(piece[j:stop])
                put(j, _NONE if r is None else r << shift | j)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for p in self.find(text):
            got = known.get(p)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = self.merge(p.encode())
                if len(p) <= 64:
                    known[p] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _encode(path: str, pattern: str, with_ids: bool):
    def run(batches):
        bpe = byte_bpe(path, pattern)
        for batch, texts in chunks(batches, "text", 4 << 20, 4096):
            n, ids_digest, decoded_digest, all_ids = [], [], [], []
            for x in texts:
                ids = bpe.encode(x) if x else []
                n.append(len(ids))
                ids_digest.append(sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded_digest.append(sha256(bpe.decode(ids)).hexdigest())
                all_ids.append(ids)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()), "decoded_sha256": pa.array(decoded_digest, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {}))

    return run


def byte_bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text); with_ids adds the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_encode(vocabulary, pattern, with_ids), schema)


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return byte_bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
