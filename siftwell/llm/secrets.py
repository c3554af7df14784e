"""8. Secret scans, with built-in functions alone.

Base rules find assignments, access keys and hexadecimal strings. Beyond them, candidate strings are judged by their
Shannon entropy: a window slides over its characters, the counts of the characters in it and the sum of c*log2(c) change by
one character in and one out, and a candidate in which a window of one class of characters (hexadecimal, letters and
digits, base 64) reaches the threshold of that class is a secret. What base spans leave uncovered of it is added, unless the
allow-list knows its form. All of it takes time in proportion to a text's length, but for sorting its spans.

Null texts count as empty and have no spans; their digest is that of an empty string. Rows with the same id or text stay
separate rows, a null id stays null, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, digest, free_name, leaves, piece, scan, spans_of, uncovered

# The base rules. Possessive quantifiers match as greedy ones do here, in linear time and constant stack.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"

#: Candidates of the entropy scan.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Characters in a window.
WINDOW = 20
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Class of characters -> (its characters, least entropy in bits of a window of them: 99% of random windows have more).
CLASSES = {
    "hexadecimal": (_DIGITS + "abcdef", 2.9),
    "upper-case hexadecimal": (_DIGITS + "ABCDEF", 2.9),
    "mixed hexadecimal": (_DIGITS + "abcdefABCDEF", 3.1),
    "lower-case": (_LOWER + _DIGITS, 3.4),
    "upper-case": (_UPPER + _DIGITS, 3.4),
    "alphanumeric": (_UPPER + _LOWER + _DIGITS, 3.64),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/=_-", 3.64),
}
#: Forms that are no secrets: without a digit, words joined by marks, UUIDs, numbers, dates, paths of words, repeated marks.
ALLOWED = (
    r"\A[^0-9]*+\z",
    r"\A[0-9+/_=-]*+\z",
    r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    r"\A[A-Za-z]*+[0-9]{0,4}+\z",
    r"\A(?:[A-Za-z]++[/_+=-]++|[0-9]++[/_+=-]++)*+(?:[A-Za-z]++|[0-9]++)?+\z",
)


#: Bits of a count, counts in a word, and the unit of the terms that are summed, so that sums are exact.
_COUNT_BITS, _UNIT = 5, 1 << 40
_PER_WORD = 60 // _COUNT_BITS


def best_entropies(s: Column, alphabets: Sequence[str], window: int = WINDOW) -> Column:
    """struct<best_0,...>: for each alphabet, the highest entropy, in bits, of a window of that many successive characters of it in s; 0 where there is none.

    One fold over the characters serves all alphabets. It keeps the counts of the characters in the window, packed into a
    few numbers, and the sum of c*log2(c): a character that enters and one that leaves each change one count and one term.
    A window counts for an alphabet in which as many characters in a row have been.
    """
    if window >= 1 << _COUNT_BITS:
        raise ValueError("counts of longer windows don't fit")
    known = "".join(sorted(set("".join(alphabets))))
    words = -(-len(known) // _PER_WORD)
    long = lambda x: F.lit(x).cast("long")
    most = long((1 << 62) - 1)
    looked_up = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    places = range(len(known))
    word_of = looked_up([-1, *[i // _PER_WORD for i in places]], "int")
    shift_of = looked_up([0, *[i % _PER_WORD * _COUNT_BITS for i in places]], "int")
    one_of = looked_up([0, *[1 << i % _PER_WORD * _COUNT_BITS for i in places]], "long")
    in_alphabets = looked_up([0, *[sum((c in a) << k for k, a in enumerate(alphabets)) for c in known]], "int")
    terms = looked_up([round(c * _log2(c) * _UNIT) if c > 1 else 0 for c in range(window + 2)], "long")

    def coded(code: Column) -> Column:
        at = lambda values: F.element_at(values, code + 1)
        return F.struct(at(word_of).alias("word"), at(shift_of).alias("shift"), at(one_of).alias("one"), at(in_alphabets).alias("of"))

    def count(acc: Column, x: Column) -> Column:
        own = F.lit(0).cast("long")
        for k in range(words):
            own = F.when(x["word"] == k, acc[f"w{k}"]).otherwise(own)
        return F.call_function("shiftright", own, x["shift"]).bitwiseAND((1 << _COUNT_BITS) - 1).cast("int")

    def judged(acc: Column) -> list[Column]:
        """For each alphabet the least sum of a window, of which the highest entropy follows."""
        return [F.when(acc[f"run_{k}"] >= window, F.least(acc[f"least_{k}"], acc["sum"])).otherwise(acc[f"least_{k}"]).alias(f"least_{k}") for k in range(len(alphabets))]

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        packed = [(acc[f"w{k}"] + F.when(new["word"] == k, new["one"]).otherwise(long(0)) - F.when(old["word"] == k, old["one"]).otherwise(long(0))).alias(f"w{k}") for k in range(words)]
        term = lambda n: F.element_at(terms, n + 1)
        more = F.when(new["word"] >= 0, term(count(acc, new) + 1) - term(count(acc, new))).otherwise(long(0))
        less = F.when(old["word"] >= 0, term(count(acc, old)) - term(count(acc, old) - 1)).otherwise(long(0))
        total = acc["sum"] + F.when((new["word"] == old["word"]) & (new["shift"] == old["shift"]), long(0)).otherwise(more - less)
        runs = [F.when(F.call_function("getbit", new["of"], F.lit(k)) == 1, acc[f"run_{k}"] + 1).otherwise(0).alias(f"run_{k}") for k in range(len(alphabets))]
        return F.struct(*packed, total.alias("sum"), *runs, *judged(acc))

    def finished(acc: Column) -> Column:
        return F.struct(*[F.when(x < most, F.lit(_log2(window)) - x / float(_UNIT * window)).otherwise(F.lit(0.0)).alias(f"best_{k}") for k, x in enumerate(judged(acc))])

    def folded(codes: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(0), window), codes)
        steps = F.zip_with(codes, F.slice(gone, F.lit(1), F.size(codes)), lambda new, old: F.struct(coded(new).alias("new"), coded(old).alias("old")))
        start = F.struct(*[long(0).alias(f"w{k}") for k in range(words)], long(0).alias("sum"), *[F.lit(0).alias(f"run_{k}") for k in range(len(alphabets))], *[most.alias(f"least_{k}") for k in range(len(alphabets))])
        return F.aggregate(steps, start, step, finished)

    return bind(F.transform(F.split(s, ""), lambda c: F.instr(F.lit(known), c)), folded)


def window_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of a window of that many successive characters of the alphabet in s; 0 where there is none."""
    return best_entropies(s, [alphabet], window)["best_0"]


def _log2(x: int) -> float:
    return math.log2(x)


def _mark(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))


def written(spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def spans_in(text: Column, window: int = WINDOW) -> Column:
    """struct<base,found> of a text: arrays of spans (start, order, end, kind, text) by start, then kind."""
    has_digit = F.regexp_like(text, F.lit("[0-9]"))
    assign = F.filter(spans_of(text, ASSIGN, F.regexp_like(text, F.lit("[:=]"))), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 8)
    access = F.filter(spans_of(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["text"]) >= 16)
    every = F.array_sort(F.concat(_mark(assign, "assign", 1), _mark(access, "access", 2), _mark(spans_of(text, HEX), "hex", 3)))

    def random(x: Column) -> Column:
        found = F.lit(False)
        for k, (_, least) in enumerate(CLASSES.values()):
            found = found | (x[f"best_{k}"] >= least)
        return found

    def judged(s: Column) -> Column:
        mixed = F.regexp_like(s["text"], F.lit("[A-Za-z]")) & F.regexp_like(s["text"], F.lit("[0-9]"))  # all parts of others are allowed
        covered = F.regexp_like(s["text"], F.lit(r"\A[0-9a-f]{32,}+\z"))  # by a base span
        return mixed & ~covered & bind(best_entropies(s["text"], [a for a, _ in CLASSES.values()], window), random)

    def rest(likely: Column, base: Column) -> Column:
        """The parts of likely candidates that no base span covers and whose form isn't allowed."""

        def part(x: Column) -> Column:
            own = F.get(likely, x["i"].cast("int"))
            text = F.substring(own["text"], (x["start"] - own["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), text.alias("text"))

        return F.filter(F.transform(uncovered(likely, base), part), lambda x: ~F.regexp_like(x["text"], F.lit("|".join(ALLOWED))))

    def both(base: Column) -> Column:
        likely = F.filter(spans_of(text, CANDIDATE, has_digit), judged)
        return F.struct(base.alias("base"), bind(likely, lambda x: F.when(F.size(x) > 0, _mark(rest(x, base), "entropy", 4)).otherwise(F.slice(base, 1, 0))).alias("found"))

    return bind(every, both)


def secret_spans(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, base and found: arrays of spans (start, order, end, kind, text) by start, then kind."""
    name = free_name(docs, "spans")
    return docs.withColumn(name, spans_in(F.col("text").cast("string"), window)).select(*keep, F.col(name)["base"].alias("base"), F.col(name)["found"].alias("found"))


def masked(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """text with every span (sorted by start; they may overlap) replaced."""

    def done(own: Column, cut_up: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(text).cast("long").alias("end")))
        left = uncovered(whole, own)
        # what stays, and one mark for each run of spans that overlap or touch at no gap
        reach = lambda ends: F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(-1).cast("long")).alias("before")))
        ends = scan(F.transform(own, lambda s: s["end"]), F.lit(0).cast("long"), F.greatest)
        marks = F.transform(F.filter(bind(ends, reach), lambda s: s["start"] >= s["before"]), lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("kind"), F.lit(by).alias("text")))
        kept = F.transform(left, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("kind"), piece(cut_up, x["start"], x["end"]).alias("text")))
        return F.array_join(F.transform(F.array_sort(F.concat(marks, kept)), lambda x: x["text"]), "")

    return F.when(F.size(spans) > 0, bind(spans, lambda own: bind(leaves(text), lambda cut_up: done(own, cut_up)))).otherwise(text)


def op8_secret_scan(spark, sf_dir):
    from .common import table

    rows = secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "found"))
    return rows.select("doc_id", of("assign"), of("access"), of("hex"), digest(written(F.col("base"))).alias("base_sha256"), F.array_join(written(every), ",").alias("spans"))
