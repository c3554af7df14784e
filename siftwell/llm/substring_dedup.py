"""10. Substring dedup by fixed-block anchors.

Reference blocks are the runs of 10 words that start at every tenth word of a document; every rolling run of 10 words
probes them. Any window of 20 words that occurs twice holds, in its earlier occurrence, a whole reference block, so that
its later occurrences hold a hit. Hits are extended to all windows of 20 words that hold one; a window's first occurrence
(smallest document, then smallest start) stays, and neighbouring repeats join to maximal exact repeats, which are removed.

Hashes are dealt in packed blocks of rows, in which a hash that is frequent in a block of documents travels once. Runs of
10 words are compared by 32 bits within a part of the hash space, which can only add windows to look at. Windows of 20
words are matched by 96 bits and then verified: where successive windows of a document match successive windows of an
earlier one, both documents give digests of the words of that stretch, cut up at fixed places of the earlier one, and the
digests must agree. Should they not, the windows are matched again under other hashes.

Null and empty texts have no words. Rows of equal id and text are one document: they get the same result. Rows of one id
and different texts are documents of their own, in the order of a hash of the text; null ids come last. Documents of fewer
than 20 words lose nothing. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, chunks, cut
from .word_hashes import Words, inside, mix, pack, runs, unpack

WINDOW, BLOCK = 20, 10
#: Windows of a stretch that is verified at once, at most: stretches are cut at multiples of it in the earlier document.
STRETCH = 32
CHUNK_BYTES, CHUNK_ROWS = 3 << 20, 8192
_LAST = np.iinfo(np.int64).max
_SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)

_PROBES = "part int, chunk string, keys binary, ends binary, hashes binary, at binary"
_PROBES_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.string()), *[(x, pa.binary()) for x in ("keys", "ends", "hashes", "at")]])
_ANSWERS = "chunk string, keys binary, ends binary, at binary"
_ANSWERS_ARROW = pa.schema([("chunk", pa.string()), *[(x, pa.binary()) for x in ("keys", "ends", "at")]])
_MARKS = "key bigint, at binary"
_MARKS_ARROW = pa.schema([("key", pa.int64()), ("at", pa.binary())])
_MATCHES = f"{_ANSWERS}, lead_keys binary, lead_at binary"
_MATCHES_ARROW = pa.schema([*_ANSWERS_ARROW, ("lead_keys", pa.binary()), ("lead_at", pa.binary())])
#: kind: "mark", windows of a document that go, and the stretches that they match; "ask", a stretch of which a digest is wanted.
_LATER = "kind string, key bigint, at binary, stretches binary, leads binary, pos int, windows int"
_LATER_ARROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), *[(x, pa.binary()) for x in ("at", "stretches", "leads")], ("pos", pa.int32()), ("windows", pa.int32())])


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes.split: at runs of space and \x09-\x0D


def _ids(column) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in column.to_pylist()], np.int64)


def _by_doc(keys: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[tuple[int, bytes]]:
    """(key of the document, packed positions in it) from sorted positions in a chunk."""
    if not len(at):
        return []
    doc = np.searchsorted(ends, at, side="right")
    start = np.concatenate([[0], ends[:-1]])[doc]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    return [(int(keys[doc[a]]), pack((at[a:b] - start[a]).astype(np.uint32))) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]


def _name(number: int, keys: np.ndarray) -> str:
    """A chunk's name: the same whenever a task is repeated over the same rows."""
    return f"{TaskContext.get().partitionId()}-{number}-{xxhash.xxh3_64_hexdigest(keys.tobytes())}"


def _dealt(parts: int, hashes: np.ndarray, at: np.ndarray, low: np.ndarray):
    """Which hashes go to each part, and their packed positions; the gaps between positions have low as their lowest bit."""
    part = ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[p] : bounds[p + 1]]
        yield int(p), own, pack(np.diff(at[own] << 1 | low[own], prepend=0).astype(np.uint32))


def _packed_ends(ends: np.ndarray) -> bytes:
    return pack(np.diff(ends, prepend=0).astype(np.uint32))


def _ends(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint32), dtype=np.int64)


def _groups(h: np.ndarray, *then: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal hashes (h and, if given, more) together, where a new one begins in it, and the number of each one's group."""
    order = np.argsort(h, kind="stable") if more is None and not then else np.lexsort((*then, h) if more is None else (*then, more, h))
    first = np.ones(len(h), bool)
    first[1:] = h[order][1:] != h[order][:-1]
    if more is not None:
        first[1:] |= more[order][1:] != more[order][:-1]
    return order, first, np.cumsum(first) - 1 if len(h) else np.zeros(0, np.int64)


def _probe(parts: int):
    """Blocks of probes and reference blocks; runs that repeat inside the chunk travel once and are marked right here."""

    def run(batches):
        hashed = Words()
        for number, (batch, texts) in enumerate(chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS)):
            words, ends = hashed.hashes([split_words(x) for x in texts])
            keys = batch.column("key").to_numpy()
            name = _name(number, keys)
            start = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
            at = np.flatnonzero(inside(len(words), ends, BLOCK))
            h = runs(words, BLOCK)[at]
            order, first, group = _groups(h)
            reference = np.bincount(group, ((at - start[at]) % BLOCK == 0)[order]) > 0
            many = np.bincount(group) > 1
            sent = np.sort(order[first])
            flag = np.zeros(len(h), np.int64)
            flag[order[first]] = reference
            own = np.sort(at[order[many[group]]]).astype(np.uint32)
            rows = [{"part": xxhash.xxh3_64_intdigest(name) % parts, "chunk": name, "keys": pack(keys), "ends": _packed_ends(ends), "at": pack(own)}]
            for p, some, gaps in _dealt(parts, h[sent], at[sent], flag[sent]):
                rows.append({"part": p, "chunk": name, "hashes": h[sent[some]].astype(np.uint32).tobytes(), "at": gaps})
            yield pa.RecordBatch.from_pylist(rows, schema=_PROBES_ARROW)

    return run


def _opened(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of a part, with their position (and low bit) and the row they came in."""
    hashes = [np.frombuffer(x.as_buffer(), kind) for x in table.column("hashes")]
    gaps = [np.cumsum(unpack(x.as_py(), np.uint32), dtype=np.int64) for x in table.column("at")]
    return np.concatenate(hashes), np.concatenate(gaps), np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])


def _answers(table: pa.Table, row: np.ndarray, at: np.ndarray) -> list[dict]:
    """Packed positions for each row that has some, under its chunk; rows are in order."""
    names = table.column("chunk").to_pylist()
    cuts = np.searchsorted(row, np.arange(len(names) + 1))
    return [{"chunk": names[i], "at": pack(at[cuts[i] : cuts[i + 1]].astype(np.uint32))} for i in range(len(names)) if cuts[i] < cuts[i + 1]]


def _answer_probes(asked: pa.Table) -> pa.Table:
    """Marks the runs that more than one chunk holds, where one of them is a reference block; passes on what chunks tell of themselves."""
    own = pc.is_null(asked.column("hashes"))
    out = asked.filter(own).select(_ANSWERS_ARROW.names).cast(_ANSWERS_ARROW)
    asked = asked.filter(pc.invert(own))
    if asked.num_rows:
        h, at, row = _opened(asked, np.uint32)
        order, _, group = _groups(h)
        reference = np.bincount(group, (at & 1)[order]) > 0
        hit = np.zeros(len(h), bool)
        hit[order] = ((np.bincount(group) > 1) & reference)[group]
        out = pa.concat_tables([out, pa.Table.from_pylist(_answers(asked, row[hit], at[hit] >> 1), schema=_ANSWERS_ARROW)])
    return out


def _of_chunk(answers: pa.Table) -> pa.Table:
    """Packed positions by document, from all answers to a chunk."""
    head = answers.filter(answers.column("keys").is_valid())
    keys, ends = unpack(head.column("keys")[0].as_py(), np.int64), _ends(head.column("ends")[0].as_py())
    at = np.unique(np.concatenate([unpack(x.as_py(), np.uint32) for x in answers.column("at")]).astype(np.int64))
    marks = _by_doc(keys, ends, at)
    return pa.Table.from_pydict({"key": [m[0] for m in marks], "at": [m[1] for m in marks]}, schema=_MARKS_ARROW)


_SECOND = "kind string, part int, chunk string, ids binary, keys binary, ends binary, hashes binary, more binary, at binary, lead_keys binary, lead_at binary, doc_id bigint, key bigint, n_words bigint, kept_sha256 string, text string"
_SECOND_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.string()), *[(x, pa.binary()) for x in ("ids", "keys", "ends", "hashes", "more", "at", "lead_keys", "lead_at")], ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def window_hashes(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of every window, from hashes of words; another seed gives others."""
    own = mix(words + np.uint64(seed)) if seed else words
    return runs(own, WINDOW), (runs(own, WINDOW, _SECOND_BASE) >> np.uint64(32)).astype(np.uint32)


def _extend(parts: int, seed: int, hashes):
    """From documents with their marks: results of unmarked ones, texts of the others, and their windows that hold a mark."""

    def run(batches):
        hashed = Words()
        for number, (batch, texts) in enumerate(chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS)):
            rows = []
            marks = batch.column("marks").to_pylist()
            split = [split_words(x) for x in texts]
            keys, ids = batch.column("key").to_numpy(), _ids(batch.column("doc_id"))
            own_ids = batch.column("doc_id").to_pylist()
            some = [i for i, m in enumerate(marks) if m and len(split[i]) >= WINDOW]
            for i in set(range(len(texts))).difference(some):
                rows.append({"kind": "result", "doc_id": own_ids[i], "key": int(keys[i]), "n_words": len(split[i]), "kept_sha256": sha256(b" ".join(split[i])).hexdigest()})
            for i in some:
                rows.append({"kind": "text", "doc_id": own_ids[i], "key": int(keys[i]), "text": texts[i]})
            if some:
                numbers, ends = hashed.numbers([split[i] for i in some])
                begin = np.concatenate([[0], ends[:-1]])
                marked = np.zeros(len(numbers) + 1, np.int64)  # windows that start in [mark - 10, mark] hold the mark
                for k, i in enumerate(some):
                    at = np.concatenate([unpack(m, np.uint32) for m in marks[i]]).astype(np.int64) + begin[k]
                    np.add.at(marked, np.maximum(at - (WINDOW - BLOCK), begin[k]), 1)
                    np.add.at(marked, at + 1, -1)
                ok = inside(len(numbers), ends, WINDOW) & (np.cumsum(marked)[: max(0, len(numbers) - WINDOW + 1)] > 0)
                at = np.flatnonzero(ok)
                h, more = (x[at] for x in hashes(hashed.of(numbers), seed))
                doc = np.searchsorted(ends, at, side="right")
                own_keys, doc_ids = keys[some], ids[some]
                place = at - begin[doc]
                order, first, group = _groups(h, place, own_keys[doc], doc_ids[doc], more=more)
                lead = order[first][group]
                same = (own_keys[doc[order]] == own_keys[doc[lead]]) & (doc_ids[doc[order]] == doc_ids[doc[lead]]) & (place[order] == place[lead])
                by_place = np.argsort(order[~same])
                later, ahead = order[~same][by_place], lead[~same][by_place]
                if not all((numbers[at[later] + k] == numbers[at[ahead] + k]).all() for k in range(WINDOW)):  # words of windows of one hash
                    rows.append({"kind": "clash"})
                name, packed_keys, packed_ends = _name(number, keys), pack(own_keys), _packed_ends(ends)
                rows.append({"kind": "chunk", "chunk": name, "keys": packed_keys, "ends": packed_ends, "at": pack(at[later].astype(np.uint32)), "lead_keys": pack(own_keys[doc[ahead]]), "lead_at": pack(place[ahead].astype(np.uint32))})
                sent = np.sort(order[first])
                for p, own, gaps in _dealt(parts, h[sent], at[sent], np.zeros(len(sent), np.int64)):
                    rows.append({"kind": "windows", "part": p, "chunk": name, "ids": pack(np.diff(doc_ids, prepend=0)), "keys": packed_keys, "ends": packed_ends, "hashes": h[sent[own]].tobytes(), "more": more[sent[own]].tobytes(), "at": gaps})
            yield pa.RecordBatch.from_pylist(rows, schema=_SECOND_ARROW)

    return run


def _answer_windows(asked: pa.Table) -> pa.Table:
    """The windows of each chunk that occur earlier in another, and where."""
    h, at, row = _opened(asked, np.uint64)
    more = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in asked.column("more")])
    at >>= 1
    doc_id, key, start = (np.empty(len(h), np.int64) for _ in range(3))
    bounds = np.searchsorted(row, np.arange(asked.num_rows + 1))
    for i, head in enumerate(asked.select(["ids", "keys", "ends"]).to_pylist()):
        own, ends = slice(bounds[i], bounds[i + 1]), _ends(head["ends"])
        doc = np.searchsorted(ends, at[own], side="right")
        doc_id[own], key[own] = np.cumsum(unpack(head["ids"], np.int64))[doc], unpack(head["keys"], np.int64)[doc]
        start[own] = at[own] - np.concatenate([[0], ends[:-1]])[doc]
    order, first, group = _groups(h, start, key, doc_id, more=more)
    lead = np.empty(len(h), np.int64)
    lead[order] = order[first][group]
    later = np.flatnonzero((doc_id != doc_id[lead]) | (key != key[lead]) | (start != start[lead]))
    names = asked.column("chunk").to_pylist()
    cuts = np.searchsorted(row[later], np.arange(len(names) + 1))
    out = []
    for i in np.flatnonzero(np.diff(cuts)):
        own = later[cuts[i] : cuts[i + 1]]
        out.append({"chunk": names[i], "at": pack(at[own].astype(np.uint32)), "lead_keys": pack(key[lead[own]]), "lead_at": pack(start[lead[own]].astype(np.uint32))})
    return pa.Table.from_pylist(out, schema=_MATCHES_ARROW)


def _later_of_chunk(matches: pa.Table) -> pa.Table:
    """The windows that go, by document, with the stretches that they match, and what is asked of the documents that they match.

    What a chunk matched within itself it has compared word by word.
    """
    head = matches.filter(matches.column("keys").is_valid())
    keys, ends = unpack(head.column("keys")[0].as_py(), np.int64), _ends(head.column("ends")[0].as_py())
    at, lead_at = (np.concatenate([unpack(x.as_py(), np.uint32) for x in matches.column(c)]).astype(np.int64) for c in ("at", "lead_at"))
    lead = np.concatenate([unpack(x.as_py(), np.int64) for x in matches.column("lead_keys")])
    inside_it = np.repeat(matches.column("keys").is_valid().to_numpy(), [len(unpack(x.as_py(), np.uint32)) for x in matches.column("at")])
    order = np.argsort(at, kind="stable")
    at, lead_at, lead, inside_it = at[order], lead_at[order], lead[order], inside_it[order]
    if not len(at):
        return _LATER_ARROW.empty_table()
    doc = np.searchsorted(ends, at, side="right")
    place = at - np.concatenate([[0], ends[:-1]])[doc]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(at) != 1) | (np.diff(lead_at) != 1) | (lead[1:] != lead[:-1])
    new |= lead_at % STRETCH == 0
    new[1:] |= inside_it[1:] != inside_it[:-1]
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    first, windows = first[~inside_it[first]], windows[~inside_it[first]]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
        own = slice(*np.searchsorted(first, [a, b]))
        stretches = np.stack([place[first[own]], lead_at[first[own]], windows[own]], 1).astype(np.uint32)
        rows.append({"kind": "mark", "key": int(keys[doc[a]]), "at": pack(place[a:b].astype(np.uint32)), "stretches": pack(stretches), "leads": pack(lead[first[own]])})
    asked = np.unique(np.stack([lead[first], lead_at[first], windows], 1), axis=0)
    asks = pa.table({"kind": pa.array(["ask"] * len(asked)), "key": asked[:, 0], "at": pa.nulls(len(asked), pa.binary()), "stretches": pa.nulls(len(asked), pa.binary()), "leads": pa.nulls(len(asked), pa.binary()), "pos": asked[:, 1].astype(np.int32), "windows": asked[:, 2].astype(np.int32)}, schema=_LATER_ARROW)
    return pa.concat_tables([pa.Table.from_pylist(rows, schema=_LATER_ARROW), asks])


#: kind: "result" of a document, or "digest" of the words of a stretch of the document lead.
_RESULT = "kind string, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, lead bigint, pos int, windows int, one bigint, two bigint"
_RESULT_ARROW = pa.schema([("kind", pa.string()), *[(x, pa.int64()) for x in ("doc_id", "n_words", "n_removed")], ("kept_sha256", pa.string()), ("kept", pa.string()), ("lead", pa.int64()), ("pos", pa.int32()), ("windows", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])


def _digests(words: list[bytes], stretches: list[tuple[int, int, int, int]]) -> dict:
    """Digests of (place in words, lead, place in lead, windows) as columns."""
    stretches = list(dict.fromkeys(stretches))
    halves = [blake2b(b" ".join(words[at : at + n + WINDOW - 1]), digest_size=16).digest() for at, _, _, n in stretches]
    told = dict.fromkeys(zip([s[1:] for s in stretches], halves, strict=True))  # a document tells the same once
    stretches, halves = [(0, *s) for s, _ in told], [h for _, h in told]
    return {"kind": ["digest"] * len(halves), "lead": [s[1] for s in stretches], "pos": [s[2] for s in stretches], "windows": [s[3] for s in stretches], "one": [int.from_bytes(h[:8], "little", signed=True) for h in halves], "two": [int.from_bytes(h[8:], "little", signed=True) for h in halves]}


def _remove(with_text: bool):
    def run(batches):
        for batch, texts in chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
            out = []
            for text, doc_id, key, marks, asks in zip(texts, *(batch.column(c).to_pylist() for c in ("doc_id", "key", "marks", "asks")), strict=True):
                words = split_words(text)
                cover = np.zeros(len(words) + 1, np.int64)
                told = [(a["pos"], key, a["pos"], a["windows"]) for a in asks or []]
                for m in marks or []:
                    at = unpack(m["at"], np.uint32).astype(np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
                    told += [(int(s[0]), int(lead), int(s[1]), int(s[2])) for s, lead in zip(unpack(m["stretches"], np.uint32).reshape(-1, 3), unpack(m["leads"], np.int64), strict=True)]
                gone = np.cumsum(cover)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append({"kind": ["result"], "doc_id": [doc_id], "n_words": [len(words)], "n_removed": [int(gone.sum())], "kept_sha256": [sha256(kept).hexdigest()], "kept": [kept.decode() if with_text else None]})
                out.append(_digests(words, told))
            sizes = [len(x["kind"]) for x in out]
            yield pa.RecordBatch.from_pydict({f.name: pa.array([v for x, n in zip(out, sizes, strict=True) for v in x.get(f.name, [None] * n)], f.type) for f in _RESULT_ARROW}, schema=_RESULT_ARROW)

    return run


def substring_dedup(docs: DataFrame, with_text: bool = False, hashes=window_hashes) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text); with_text adds the kept words of documents that repeats were looked for in (else null)."""
    parts = buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    probes = rows.mapInArrow(_probe(parts), _PROBES)
    answers = probes.groupBy("part").applyInArrow(_answer_probes, _ANSWERS)
    marks = cut(answers.groupBy("chunk").applyInArrow(_of_chunk, _MARKS), "repeat-marks", free=True)
    per_doc = marks.groupBy("key").agg(F.collect_list("at").alias("marks"))
    joined = rows.join(per_doc, "key", "left").select("doc_id", "key", "text", "marks")
    seed, verified = 0, False
    while not verified:
        second = cut(joined.mapInArrow(_extend(parts, seed, hashes), _SECOND), "repeat-windows", free=True)
        asked = second.where("kind = 'windows'").select("part", "chunk", "ids", "keys", "ends", "hashes", "more", "at")
        own = second.where("kind = 'chunk'").select(*_MATCHES_ARROW.names)
        matches = asked.groupBy("part").applyInArrow(_answer_windows, _MATCHES).unionAll(own)
        later = cut(matches.groupBy("chunk").applyInArrow(_later_of_chunk, _LATER), "repeat-stretches", free=True)
        gone = later.where("kind = 'mark'").groupBy("key").agg(F.collect_list(F.struct("at", "stretches", "leads")).alias("marks"))
        # a stretch of a document is asked for once, so that no document is asked more than its length allows
        asks = later.where("kind = 'ask'").select("key", "pos", "windows").distinct().groupBy("key").agg(F.collect_list(F.struct("pos", "windows")).alias("asks"))
        texts = second.where("kind = 'text'").select("doc_id", "key", "text").join(gone, "key", "left").join(asks, "key", "left")
        found = cut(texts.mapInArrow(_remove(with_text), _RESULT), "repeat-results", free=True)
        digests = found.where("kind = 'digest'").groupBy("lead", "pos", "windows").agg(*[f(c).alias(f"{n}_{c}") for c in ("one", "two") for f, n in ((F.min, "min"), (F.max, "max"))])
        differ = digests.where("min_one <> max_one or min_two <> max_two").select(F.lit(1).alias("x"))
        verified = differ.unionAll(second.where("kind = 'clash'").select(F.lit(1).alias("x"))).isEmpty()
        seed += 1
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    plain = second.where("kind = 'result'").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.lit(None).cast("string").alias("kept")] if with_text else []))
    return found.where("kind = 'result'").select(*names).unionAll(plain)


def op10_substring_dedup(spark, sf_dir):
    from .common import table

    return substring_dedup(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB: every window of 20 words, numbered in the order of its occurrences.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d WHERE len(w) > 0),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos WHERE g.pos IS NULL GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
