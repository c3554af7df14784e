"""1. Token counts of documents without materialised ids.

Documents are taken in blocks. A block knows its distinct pre-tokens and, per document, how often each of them occurs.
The pre-tokens of all blocks are dealt by hash; each is run through the merges once, and the counts of pieces go back to
the blocks that asked. A document's tokens are the sum of frequency times pieces.

Null texts count as empty; documents without pre-tokens have 0 tokens. Rows with the same id or text stay separate rows,
a null id stays null, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, chunks, cut

#: Bytes of text in a block, at most (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
#: Texts of these characters alone are lower-cased by str.lower and are in normal form already.
_PLAIN = re.compile(r"[\x00-ſ‐-‧€]*\Z")


class PreTokenizer:
    """The normaliser and pre-tokenizer that the vocabulary file asks for, and the count of one pre-token's pieces."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings aren't supported")
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError("this vocabulary's text rules aren't known here")
        import regex

        self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.normalizer = self.tokenizer.normalizer
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.encode_special_tokens = True

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special strings in it, which are one token each."""
        if self.split and "<|" in text:
            parts = self.split.split(text)
            return [p for part in parts for p in self._plain(part)], len(parts) - 1
        return self._plain(text), 0

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.match(text) and unicodedata.is_normalized("NFC", text) and "İ" not in text:
            return self.find(text.lower())
        return self.find(self.normalizer.normalize_str(text))

    def counts(self, pieces: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        return np.fromiter((len(x.ids) for x in found), np.int64, len(pieces))


@lru_cache(maxsize=2)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


_BLOCK = "block string, part int, ids array<bigint>, n_bytes array<bigint>, data binary, more binary"


def _to_blocks(path: str, parts: int, block_bytes: int):
    def run(batches):
        import xxhash

        t = pre_tokenizer(path)
        for batch, texts in chunks(batches, "text", block_bytes, 1 << 16):
            block, index, rows, freqs, ends, extra = uuid.uuid4().hex, {}, [], [], [], []
            for x in texts:
                found, special = t.pieces(x) if x else ([], 0)
                freq: dict[int, int] = {}
                for p in found:
                    i = index.setdefault(p, len(index))
                    freq[i] = freq.get(i, 0) + 1
                rows.append(np.fromiter(freq.keys(), np.int32, len(freq)))
                freqs.append(np.fromiter(freq.values(), np.int32, len(freq)))
                ends.append(len(freq))
                extra.append(special)
            names = list(index)
            dealt = np.fromiter((xxhash.xxh32_intdigest(p) % parts for p in names), np.int32, len(names))
            order = np.argsort(dealt, kind="stable")
            place = np.empty(len(names), np.int32)
            place[order] = np.arange(len(names), dtype=np.int32)  # pieces are numbered by the part they go to
            deltas, sorted_freqs = [], []
            for r, f in zip(rows, freqs, strict=True):
                r = place[r] if len(r) else r
                o = np.argsort(r)
                deltas.append(np.diff(r[o], prepend=0).astype(np.int32))
                sorted_freqs.append(f[o])
            data = [np.array(ends, np.int64), np.array(extra, np.int64)]
            out = {"block": [block], "part": [None], "ids": [batch.column("doc_id").to_pylist()], "n_bytes": [[len(x.encode()) if x else 0 for x in texts]], "data": [_pack(np.concatenate(data))], "more": [_pack(np.concatenate([*deltas, *sorted_freqs]) if names else np.zeros(0, np.int32))]}
            bounds = np.searchsorted(dealt[order], np.arange(parts + 1))
            for part in range(parts):
                if bounds[part] < bounds[part + 1]:
                    asked = "\n".join(names[i] for i in order[bounds[part] : bounds[part + 1]])
                    for k, v in (("block", block), ("part", part), ("ids", None), ("n_bytes", None), ("data", zstandard.ZstdCompressor(level=3).compress(asked.encode())), ("more", None)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.string()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("data", pa.binary()), ("more", pa.binary())]))

    return run


def _count_part(path: str):
    """Answers all blocks' requests of one part: each distinct pre-token is counted once."""

    def run(asked: pa.Table) -> pa.Table:
        t, known, out = pre_tokenizer(path), {}, []
        for data in asked.column("data"):
            names = zstandard.ZstdDecompressor().decompress(data.as_py()).decode().split("\n")
            new = [p for p in names if p not in known]
            known.update(zip(new, t.counts(new).tolist(), strict=True))
            out.append(_pack(np.fromiter((known[p] for p in names), np.int64, len(names)).astype(np.uint32)))
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "data": pa.array(out, pa.binary())})

    return run


def _sum_block(over: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = block.to_pylist()[0]
        got = sorted(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True))
        n = np.concatenate([np.zeros(0, np.int64), *(_unpack(d, np.uint32).astype(np.int64) for _, d in got)])
        docs = len(b["ids"])
        head, both = _unpack(b["data"], np.int64), _unpack(b["more"], np.int32)
        ends, extra = np.cumsum(head[:docs]), head[docs:]
        deltas, freq = both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)
        sums, at = extra.copy(), 0
        for i, end in enumerate(ends):
            sums[i] += int(freq[at:end] @ n[np.cumsum(deltas[at:end])]) if end > at else 0
            at = end
        return pa.table({"doc_id": pa.array(b["ids"], pa.int64()), "n_bytes": pa.array(b["n_bytes"], pa.int64()), "n_tokens": pa.array(sums, pa.int64()), "over_limit": pa.array(sums > over)})

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = cut(rows.mapInArrow(_to_blocks(vocabulary, 4 * buckets(rows), block_bytes), _BLOCK), "token-blocks", free=True)
    asked = blocks.where("part is not null").select("block", "part", "data")
    answers = asked.groupBy("part").applyInArrow(_count_part(vocabulary), "block string, part int, data binary")
    own = blocks.where("part is null").drop("part")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum_block(limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
