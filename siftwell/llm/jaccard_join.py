"""3. N-gram Jaccard join by PartEnum signatures.

Sets of shingles are put into bands of equal sizes, each up to 1.25 times the one before, so that sets that link lie in one
band or in neighbours; a set takes part in its own band's instance and the next one's. Two sets of an instance that link
differ in at most k elements. The instance splits the domain of shingles into a little more than (k + 1) / 2 partitions, so
that linked sets differ by at most one element in some of them, and each of these into three again; a signature is a
partition, two of its three parts (every choice of two is one), and what a set has in them. One element that differs spares
one of the three choices. Sets of equal signature are candidates; as there are more partitions than k asks for, linked sets
agree on several signatures, and candidates must share that many before they are compared exactly.

Equal sets are one class and are compared once. What is sought are the components of the links, so pairs that earlier links
connect aren't compared again. A signature that more than 16 classes share gives no pairs: its classes are first compared
with one of them, and those that stay unconnected are compared in blocks of classes, the largest component's with all others'
and these among themselves, in which only links that connect something leave the task.

A class is named by half of a digest of its set. Sets of one name whose other halves differ are told apart: but for one of
them, each is a class of its own, and is compared with all sets, as its signatures stand under the common name.

Null texts and texts without words have no shingles and link with nothing; a text of fewer than five words is one shingle.
Rows of equal id and text are one document. A null id is no smallest id, unless a component has no other. Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, chunks, cut, done, join_hot
from .components import components
from .word_hashes import Words, inside, mix, pack, runs, unpack

#: Words in a shingle; sets link at this Jaccard similarity, as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: First-level partitions, as a multiple of half the elements by which linked sets can differ, and one: what is more than 1
#: lets linked sets share several signatures.
SLACK = 1.1
#: The choices of two of a partition's three parts.
CHOICES = ((0, 1), (0, 2), (1, 2))
#: Classes that a signature pairs off directly, all with all: some eight pairs for each class at most.
PAIRED = 16
#: Rounds in which every class asks two candidates; what is apart after them is compared pair by pair.
ROUNDS = 2
#: Classes in a block of a large group.
BLOCK = 256
CHUNK_BYTES, CHUNK_ROWS = 3 << 20, 4096
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_LOWER).split() if text else []


class Shingles:
    """The distinct shingles of texts, as hashes."""

    def __init__(self):
        self.words = Words()

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All sets in a row, each in order, and where each ends."""
        words, ends = self.words.hashes([split_words(x) for x in texts])
        n = np.diff(ends, prepend=0)
        at = np.flatnonzero(inside(len(words), ends, SHINGLE)) if len(words) >= SHINGLE else np.zeros(0, np.int64)
        doc = np.searchsorted(ends, at, side="right")
        h = runs(words, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        if len(short):
            whole = [mix(runs(words[ends[i] - n[i] : ends[i]], int(n[i])) + np.uint64(n[i]))[0] for i in short]
            doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        return h[new], np.cumsum(np.bincount(doc[new], minlength=len(texts)))


def bands(largest: int) -> np.ndarray:
    """The last size of each band, up to the one after that which holds the largest."""
    last = [1]
    while last[-1] < largest or len(last) < 2 or last[-2] < largest:
        last.append((last[-1] + 1) * DENOMINATOR // NUMERATOR)
    return np.array(last, np.int64)


def least_shared(partitions: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many signatures sets share that differ by k elements: each spares a partition one choice, or the last one."""
    return 3 * partitions - 2 * np.minimum(k, partitions) - np.maximum(k - partitions, 0)


def signatures(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets, the set of each, and how many of them any linked set shares at least with each set."""
    n = np.diff(ends, prepend=0)
    last = bands(int(n.max(initial=1)))
    band = np.searchsorted(last, n)
    owner = np.repeat(np.arange(len(n)), n)
    found, owners, need = [], [], np.full(len(n), np.iinfo(np.int64).max)
    for step in (0, 1):
        instance = band + step
        k = 2 * last[instance] * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        partitions = np.where(k == 0, 1, np.ceil(SLACK * (k + 1) / 2).astype(np.int64))
        base = np.concatenate([[0], np.cumsum(partitions)])
        seed = mix(instance.astype(np.uint64) + np.uint64(1))
        at = mix(sets ^ seed[owner])
        where = 3 * (base[owner] + (at % partitions[owner].astype(np.uint64)).astype(np.int64)) + ((at >> np.uint64(48)) % np.uint64(3)).astype(np.int64)
        content = np.zeros(3 * base[-1], np.uint64)
        np.add.at(content, where, mix(sets + np.uint64(0x51ED270B)))
        size = np.bincount(where, minlength=3 * base[-1]).reshape(-1, 3)
        content = content.reshape(-1, 3)
        chosen = np.stack([content[:, i] + content[:, j] for i, j in CHOICES], 1)
        filled = np.stack([size[:, i] + size[:, j] > 0 for i, j in CHOICES], 1)
        of = np.repeat(np.arange(len(n)), partitions)
        empty = 3 * partitions - np.bincount(of, filled.sum(1), len(n)).astype(np.int64)
        least = least_shared(partitions, k) - empty  # signatures with elements that a linked set has too
        keep = (filled | (least < 1)[of][:, None]) & (n > 0)[of][:, None]
        place = 3 * (np.arange(base[-1]) - base[of])[:, None] + np.arange(3)
        found.append(mix(chosen ^ mix(seed[of][:, None] + place.astype(np.uint64)))[keep])
        owners.append(np.broadcast_to(of[:, None], keep.shape)[keep])
        need = np.minimum(need, np.maximum(least, 1))
    return np.concatenate(found), np.concatenate(owners), need


_FIRST = "part int, classes binary, hashes binary, owners binary, doc_id bigint, key bigint, n bigint, need bigint, other bigint"
_FIRST_ARROW = pa.schema([("part", pa.int32()), *[(x, pa.binary()) for x in ("classes", "hashes", "owners")], *[(x, pa.int64()) for x in ("doc_id", "key", "n", "need", "other")]])


def class_of(own: bytes) -> tuple[int, int]:
    """The name of a class and what tells it from others of that name, from its set's elements in order."""
    digest = blake2b(own, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _classes(sets: np.ndarray, ends: np.ndarray, name) -> tuple[np.ndarray, np.ndarray]:
    each = np.array([name(sets[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64).reshape(-1, 2)
    return each[:, 0], each[:, 1]


def _sign(parts: int, name):
    """Documents with their class, and packed signatures of the sets new in a chunk."""

    def run(batches):
        shingles = Shingles()
        for batch, texts in chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
            sets, ends = shingles.sets(texts)
            n = np.diff(ends, prepend=0)
            classes, others = _classes(sets, ends, name)
            rows = [{"part": int(k % parts), "doc_id": d, "key": int(k), "n": int(m), "classes": int(c).to_bytes(8, "little", signed=True) if m else None, "other": int(o)} for d, k, m, c, o in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), n, classes, others, strict=True)]
            _, first = np.unique(np.stack([classes, others], 1), axis=0, return_index=True)
            first = np.sort(first[n[first] > 0])
            if len(first):
                starts = ends - n
                own = np.concatenate([sets[starts[i] : ends[i]] for i in first])
                h, owner, need = signatures(own, np.cumsum(n[first]))
                part = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                sent = h.astype(np.uint32)
                order = np.lexsort((sent, owner, part))
                part, sent, owner = part[order], sent[order], owner[order]
                # of a set's signatures that look alike in their part, one counts
                alike = (part[1:] == part[:-1]) & (owner[1:] == owner[:-1]) & (sent[1:] == sent[:-1])
                need = np.maximum(need - np.bincount(owner[1:][alike], minlength=len(first)), 1)
                for i, least in zip(first, need, strict=True):
                    rows[i]["need"] = int(least)
                bounds = np.searchsorted(part, np.arange(parts + 1))
                packed = pack(classes[first])
                for p in np.flatnonzero(np.diff(bounds)):
                    o = slice(bounds[p], bounds[p + 1])
                    rows.append({"part": int(p), "classes": packed, "hashes": sent[o].tobytes(), "owners": pack(np.diff(owner[o], prepend=0).astype(np.uint16))})
            yield pa.RecordBatch.from_pylist(rows, schema=_FIRST_ARROW)

    return run


_SECOND = "kind string, a bigint, b bigint, n bigint, key bigint, doc_id bigint, other bigint, groups array<bigint>"
_SECOND_ARROW = pa.schema([("kind", pa.string()), *[(x, pa.int64()) for x in ("a", "b", "n", "key", "doc_id", "other")], ("groups", pa.list_(pa.int64()))])


def _column(kind: str, **of) -> pa.Table:
    size = len(next(iter(of.values())))
    return pa.table([pa.array([kind] * size, pa.string()), *[pa.array(of[f.name], f.type) if f.name in of else pa.nulls(size, f.type) for f in list(_SECOND_ARROW)[1:]]], schema=_SECOND_ARROW)


def _pair(paired: int):
    return lambda asked: _paired(asked, paired)


def _paired(asked: pa.Table, paired: int) -> pa.Table:
    """doc: documents (key, doc_id, n, class a, and b: how many signatures it must share, told once in a chunk) passed on; pair: a < b share n signatures of this part;
    star: a is the head of n large groups that have b; large: class b is in these large groups."""
    here = asked.column("hashes").is_valid()
    docs = asked.filter(pc.invert(here))
    out = [_column("doc", a=[None if x is None else int.from_bytes(x, "little", signed=True) for x in docs.column("classes").to_pylist()], n=docs.column("n").combine_chunks(), key=docs.column("key").combine_chunks(), b=docs.column("need").combine_chunks(), other=docs.column("other").combine_chunks(), doc_id=docs.column("doc_id").combine_chunks())] if docs.num_rows else []
    asked = asked.filter(here)
    if asked.num_rows:
        part = asked.column("part")[0].as_py()
        h, cls = [], []
        for x in asked.select(["classes", "hashes", "owners"]).to_pylist():
            classes = unpack(x["classes"], np.int64)
            h.append(np.frombuffer(x["hashes"], np.uint32))
            cls.append(classes[np.cumsum(unpack(x["owners"], np.uint16), dtype=np.int64)])
        h, cls = np.concatenate(h), np.concatenate(cls)
        order = np.lexsort((cls, h))
        h, cls = h[order], cls[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls = h[new], cls[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        known, local = np.unique(cls, return_inverse=True)
        pairs = []
        for s in np.unique(size[(size > 1) & (size <= paired)]):
            group = local[first[size == s][:, None] + np.arange(s)]
            i, j = np.triu_indices(s, 1)
            pairs.append((group[:, i] * len(known) + group[:, j]).ravel())
        if pairs:
            both, n = np.unique(np.concatenate(pairs), return_counts=True)
            out.append(_column("pair", a=known[both // len(known)], b=known[both % len(known)], n=n))
        stars, large = [], []
        for at, s in zip(first[size > paired], size[size > paired], strict=True):
            members = cls[at : at + s]
            head = members[np.argmin(mix(members.view(np.uint64)))]
            stars.append(np.stack([np.full(s, head), members], 1)[members != head])
            large.append(np.stack([members, np.full(s, int(h[at]) << 20 | part)], 1))
        if stars:
            each = np.concatenate(large)
            each = each[np.lexsort((each[:, 1], each[:, 0]))]
            cuts = np.flatnonzero(np.concatenate([[True], each[1:, 0] != each[:-1, 0]]))
            out.append(_column("large", b=each[cuts, 0], groups=pa.ListArray.from_arrays(pa.array(np.append(cuts, len(each)), pa.int32()), pa.array(each[:, 1], pa.int64()))))
            both, n = np.unique(np.concatenate(stars), axis=0, return_counts=True)
            out.append(_column("star", a=both[:, 0], b=both[:, 1], n=n))
    return pa.concat_tables(out) if out else _SECOND_ARROW.empty_table()


def _load(batches):
    """class and the packed set of documents (class, text)."""
    shingles = Shingles()
    for batch, texts in chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
        sets, ends = shingles.sets(texts)
        n = np.diff(ends, prepend=0)
        yield pa.RecordBatch.from_pydict({"class": batch.column("class"), "set": pa.array([sets[e - m : e].tobytes() for e, m in zip(ends, n, strict=True)], pa.binary())})


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * same >= NUMERATOR * (len(x) + len(y) - same)


def _verify(batches):
    for batch in batches:
        sets = ((np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)) for c in "xy")  # views, not copies
        ok = [_links(x, y) for x, y in zip(*sets, strict=True)]
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    joined = pairs.select("a", "b").join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    joined = joined.join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b")
    return cut(joined.mapInArrow(_verify, "a bigint, b bigint"), "jaccard-links", free=True)


def _blocks(asked: pa.Table) -> pa.Table:
    """Links between the classes of two blocks that connect components which nothing in these blocks connected before."""
    rows = asked.to_pylist()
    one = rows[0]["one"]
    other = rows[0]["two"]
    root = {r["component"]: r["component"] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    owner = np.repeat(np.arange(len(rows)), [len(r["groups"]) for r in rows])
    group = np.array([g for r in rows for g in r["groups"]], np.int64)
    order = np.argsort(group, kind="stable")
    owner, group = owner[order], group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    shared = np.zeros((len(rows), len(rows)), np.int32)
    for at, end in zip(first, [*first[1:], len(group)], strict=True):
        shared[np.ix_(owner[at:end], owner[at:end])] += 1
    need = np.array([r["need"] for r in rows])
    side = np.array([r["own"] for r in rows])
    ok = np.triu(shared >= np.maximum(need[:, None], need[None, :]), 1)
    if one != other:
        ok &= side[:, None] != side[None, :]
    sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
    i, j = np.nonzero(ok)
    found = []
    for k in np.argsort(-shared[i, j], kind="stable"):
        p, q = int(i[k]), int(j[k])
        a, b = find(rows[p]["component"]), find(rows[q]["component"])
        if a != b and _links(sets[p], sets[q]):
            root[max(a, b)] = min(a, b)
            found.append((rows[p]["class"], rows[q]["class"]))
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _large_links(stars: DataFrame, known: DataFrame, needs: DataFrame, sets: DataFrame, block: int) -> DataFrame | None:
    """Links between classes of large groups that known (class, component) leaves apart.

    Only classes in as many large groups as they must share with a linked one take part. Those that heads of large groups
    connect are a cluster; clusters of several components are compared in pairs of blocks.
    """
    own = needs.where("large >= need").join(known, "class", "left").select("class", "need", "groups", F.coalesce("component", "class").alias("component"))
    if own.isEmpty():
        return None
    near = components(stars.join(own.select(F.col("class").alias("b")), "b", "left_semi").select("a", "b"))
    own = own.join(near.select(F.col("id").alias("class"), F.col("component").alias("cluster")), "class")
    # the largest component's classes are in blocks of their own, which need no comparing among themselves
    sizes = own.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).where(F.col("main")["n"] < F.col("n"))
    main = main.select("cluster", F.col("main")["component"].alias("main"), F.ceil(F.col("main")["n"] / block).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("main")["n"]) / block).cast("int").alias("others"))
    full = own.join(main, "cluster").join(sets, "class")
    mine = F.col("component") == F.col("main")
    full = full.withColumn("own", F.when(mine, F.pmod(F.xxhash64("class"), F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(F.xxhash64("class"), F.col("others"))).cast("int"))
    each = full.withColumn("with", F.explode(F.sequence(F.when(mine, F.col("blocks")).otherwise(0), F.col("blocks") + F.col("others") - 1)))
    each = each.select("cluster", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "class", "component", "need", "groups", "set")
    return cut(each.groupBy("cluster", "one", "two").applyInArrow(_blocks, "a bigint, b bigint"), "jaccard-links", free=True)


#: Names that sets of different elements share, at most; 64 bits of a digest give some three among 10^10 sets.
SHARED_NAMES = 100_000
#: Sets that are compared with all others in one pass.
ODD_BLOCK = 256


def _odd_links(rows: DataFrame, odd: DataFrame, sets_of, name) -> DataFrame:
    """Links between sets that share their class's name with another one (odd: class, key, name, other) and all sets."""
    kept = {r["name"]: r["kept"] for r in odd.select("name", "kept").distinct().limit(SHARED_NAMES + 1).collect()}
    if len(kept) > SHARED_NAMES:
        raise ValueError("too many sets share their names: the digest is broken")
    sets = sets_of(odd.select("class", "key"))
    blocks = odd.agg(F.ceil(F.count("*") / ODD_BLOCK)).first()[0]
    found = None
    for i in range(blocks):
        block = sets.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == i).select("class", "set").collect()
        asked = [(r["class"], np.frombuffer(r["set"], np.uint64)) for r in block]

        def run(batches, asked=asked):
            shingles = Shingles()
            for batch, texts in chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
                own, ends = shingles.sets(texts)
                pairs = []
                for a, b, c, o in zip([0, *ends[:-1]], ends, *_classes(own, ends, name), strict=True):
                    cls = int(c) if kept.get(int(c), o) == o else odd_class(int(c), int(o))
                    pairs += [(cls, x) for x, elements in asked if b > a and x != cls and _links(own[a:b], elements)]
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        some = rows.select("text").mapInArrow(run, "a bigint, b bigint")
        found = some if found is None else found.unionAll(some)
    return cut(found.distinct(), "jaccard-odd-links")


def odd_class(name: int, other: int) -> int:
    """The class of a set that shares its name with another one."""
    return int.from_bytes(blake2b(f"{name}:{other}".encode(), digest_size=8).digest(), "little", signed=True)


def jaccard_components(docs: DataFrame, paired: int = PAIRED, block: int = BLOCK, name=class_of) -> DataFrame:
    """doc_id, n_shingles, component_id, key (of id and text) and kept (one key of each component) of every row of docs (doc_id, text)."""
    parts = buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    second = cut(rows.mapInArrow(_sign(parts, name), _FIRST).groupBy("part").applyInArrow(_pair(paired), _SECOND), "jaccard-candidates", free=True)
    members = second.where("kind = 'doc'").select(F.col("a").alias("class"), "key", "doc_id", "n", F.col("b").alias("need"), "other")
    large = second.where("kind = 'large'").select(F.col("b").alias("class"), "groups")
    pairs = second.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n"))
    stars = second.where("kind = 'star'").groupBy("a", "b").agg(F.sum("n").alias("n"))

    # sets that have their name from a digest that another one's starts with too
    shared = members.where("class is not null").groupBy(F.col("class").alias("name")).agg(F.min("other").alias("kept"), F.max("other").alias("last")).where("kept <> last").drop("last")
    shared = cut(shared, "jaccard-shared-names")
    odd = None
    if not shared.isEmpty():
        own = F.udf(odd_class, "bigint")
        members = members.join(F.broadcast(shared.limit(SHARED_NAMES)), F.col("class") == F.col("name"), "left").withColumn("class", F.when(F.col("other") != F.col("kept"), own("class", "other")).otherwise(F.col("class")))
        members = cut(members, "jaccard-members")
        odd = members.where("other <> kept").groupBy("class", "name", "kept").agg(F.min("key").alias("key"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = rows.join(wanted, "key").dropDuplicates(["class"]).select("class", "text")
        return cut(texts.mapInArrow(_load, "class bigint, set binary"), "jaccard-sets", free=True)

    # candidates: pairs that share enough signatures, if those of large groups, which aren't counted here, all count
    # and of each class's documents the one of smallest id, and how many there are
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("first")
    of = members.where("class is not null").select("class", "key", "need", first).unionByName(large, allowMissingColumns=True)
    groups = F.flatten(F.collect_list("groups"))  # no more than the class has signatures
    needs = of.groupBy("class").agg(F.min("key").alias("key"), F.min("need").alias("need"), F.min("first").alias("first"), F.count("key").alias("docs"), groups.alias("groups"))
    needs = needs.withColumn("large", F.size("groups"))
    needs = cut(needs, "jaccard-classes")
    a, b = (needs.select(F.col("class").alias(x), F.col("need").alias(f"need_{x}"), F.col("large").alias(f"large_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(F.col("n") + F.least("large_a", "large_b") >= F.greatest("need_a", "need_b")).select("a", "b", "n")
    near = cut(near, "jaccard-pairs")

    # the sets of classes that have a candidate
    in_large = needs.where("large >= need").select("class")
    ends = near.select(F.col("a").alias("class")).unionAll(near.select(F.col("b").alias("class")))
    wanted = ends.unionAll(in_large).distinct().join(needs.select("class", "key"), "class")
    sets = sets_of(wanted)

    # in each round every class asks the candidate that it shares most with, and the one that comes first in a random order,
    # which many others ask too, so that they all become connected; pairs within a component are dropped before the next
    order = F.xxhash64(F.col("b"), F.lit(1))
    both = lambda x: x.unionAll(x.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    picked = lambda x, rank: x.groupBy("a").agg(F.max(F.struct(rank.alias("rank"), "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    once = lambda x: x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    chosen = lambda x: once(picked(both(x), F.col("n")).unionAll(picked(both(x), order)))
    heads = picked(stars.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"), F.col("n"))
    for x in "ab":
        heads = heads.join(in_large.select(F.col("class").alias(x)), x, "left_semi")
    asked = cut(chosen(near), "jaccard-asked")
    links = _verified(once(asked.unionAll(heads)), sets)
    if odd is not None:
        links = links.unionAll(_odd_links(rows, odd, sets_of, name))
    known = components(links).withColumnRenamed("id", "class")
    for turn in range(ROUNDS):
        at = lambda x: known.select(F.col("class").alias(x), F.col("component").alias(f"at_{x}"))  # noqa: B023, E731
        apart = near.join(asked, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
        last, near = near, cut(apart.where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b", "n"), "jaccard-pairs")
        done(last)
        if near.isEmpty():
            break
        asked = near.select("a", "b") if turn + 1 == ROUNDS else cut(chosen(near), "jaccard-asked")
        more = _verified(asked, sets)
        if not more.isEmpty():
            links = links.unionAll(more)
            known = components(links).withColumnRenamed("id", "class")
    # and last the classes of large groups that are still apart
    last = _large_links(stars, known, needs, sets, block)
    if last is not None and not last.isEmpty():
        known = components(links.unionAll(last)).withColumnRenamed("id", "class")

    # components' smallest ids go by classes, so that documents are joined once; those of very large classes stay where they are
    of_class = cut(needs.select("class", "first", "docs").join(known, "class", "left").withColumn("component", F.coalesce("component", "class")), "jaccard-components")
    smallest = of_class.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("classes")).select("component", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("kept_key"), "classes")
    placed = join_hot(of_class.select("class", "component", "docs"), cut(smallest, "jaccard-smallest"), "component", "classes").drop("component")
    out = join_hot(members, cut(placed, "jaccard-placed"), "class", "docs", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", F.coalesce(F.col("key") == F.col("kept_key"), F.lit(True)).alias("kept"))


def op3_jaccard_join(spark, sf_dir):
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: The same rows in DuckDB: shingles as text, pairs by shared shingles, components by reachability.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
