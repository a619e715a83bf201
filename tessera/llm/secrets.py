"""Secrets in texts, in DataFrame operations only.

Three patterns give the base: assignments to names like ``password``, access keys and long hexadecimal runs. To these are
added long runs of key characters that look random: two character Markov models, one of random strings and one of ordinary
identifiers and words, are compared by the log of their likelihood ratio.

The models are trained from labelled samples. Unless others are given, random strings are digests in hexadecimal and
base 64, and ordinary ones are the words of at most SAMPLE_DOCS documents (those whose ids hash lowest) and identifiers
made of a word list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Values of assignments shorter than 6 characters are dropped after matching.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
# Words of which ordinary identifiers are made.
NAMES = "get set user name count index list table value key file path read write open close buffer config session request response handler server client event data type default parent child node query result error message format version update create delete".split()

#: A bound on the documents whose words are ordinary samples, and on the random strings made.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 4000
#: Runs of this length are scored, and are secrets if the ratio is so large in all, and so large a character.
LEAST_CHARS, LEAST_RATIO, LEAST_EACH = 20, 12.0, 0.6
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}"
#: What a run that does not look random is cut at, to look at its parts.
PART = rf"[A-Za-z0-9+]{{{LEAST_CHARS},}}"

SPAN = "array<struct<kind:int,start:int,end:int>>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def accumulated(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(at, item)`` gives out for all items in a row, as one array of type ``kind``.

    ``step`` returns the next ``at``, an int from 0 on, and an array. Arrays are copied when they grow, so items are taken in
    sections of the square root of their number, which bounds the copies by that root times the items.
    """
    none = F.array().cast(kind)

    def within(size: Column, items: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
        sections = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")), lambda i: F.slice(items, i * width + 1, width))

        def one(state: Column, item: Column) -> Column:
            at, out = step(state["at"], item)
            return F.struct(at.cast("int").alias("at"), F.concat(state["out"], out).alias("out"))

        def section(state: Column, own: Column) -> Column:
            done = lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out"))
            return F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("out")), one, done)

        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(sections, first, section, lambda s: s["out"]))

    return let(items, lambda x: F.when(F.size(x) > 0, within(F.size(x), x)).otherwise(none))


def spans(text: Column, pattern: str, kind: int, keep=None, rest=None) -> Column:
    """The matches of ``pattern`` for which ``keep(match)`` holds, as spans of code points. Texts without one cost one look.

    ``split`` gives what stands between the matches; lengths of both add up to positions. Of a match that is not kept,
    ``rest(match)`` gives spans from its beginning on.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast(SPAN)

    def item(gap: Column, match: Column) -> Column:
        parts = [F.char_length(gap).alias("gap"), F.char_length(match).alias("n"), (keep(match) if keep else F.lit(True)).alias("ok")]
        return F.struct(*parts, *([match.alias("own")] if rest else []))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = (at + x["gap"]).cast("int"), (at + x["gap"] + x["n"]).cast("int")
        other = none
        if rest:
            moved = lambda s: F.struct(s["kind"].alias("kind"), (start + s["start"]).alias("start"), (start + s["end"]).alias("end"))
            other = F.transform(rest(x["own"]), moved)
        return end, F.when(x["ok"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))).otherwise(other)

    items = let(found, lambda f: F.zip_with(F.slice(between, F.lit(1), F.size(f)), f, item))
    return F.when(text.rlike(pattern), accumulated(items, step, SPAN)).otherwise(none)


def cut(text: Column, found: Column, shown: Callable[[Column], Column]) -> Column:
    """The text with what ``found`` covers replaced. ``found`` is in order of start; for each of them ``shown(piece)`` says what
    stands there, of a piece with ``to`` and ``end``, the places it still covers, and ``apart``, whether it touches none before.

    A substring is found by a walk from the text's beginning, so pieces are first cut in sections, and then from these.
    """

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        end = F.greatest(at, s["end"])
        piece = F.struct(at.alias("from"), F.greatest(at, s["start"]).alias("to"), end.alias("end"), (s["start"] >= at).alias("apart"))
        return end, F.array(piece)

    def joined(pieces: Column) -> Column:
        size = F.size(pieces)
        width = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))

        def section(own: Column) -> Column:
            base = F.get(own, F.lit(0))["from"]
            whole = F.substring(text, base + 1, F.element_at(own, -1)["to"] - base)
            inside = lambda w: F.array_join(F.transform(own, lambda p: F.concat(F.substring(w, p["from"] - base + 1, p["to"] - p["from"]), shown(p))), "")
            return let(whole, inside)

        sections = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")), lambda i: let(F.slice(pieces, i * width + 1, width), section))
        return F.concat(F.array_join(sections, ""), F.substring(text, F.element_at(pieces, -1)["end"] + 1, F.char_length(text)))

    pieces = accumulated(found, step, "array<struct<from:int,to:int,end:int,apart:boolean>>")
    return F.when(F.size(found) > 0, let(pieces, joined)).otherwise(text)


def training_samples(docs: DataFrame) -> DataFrame:
    """Labelled samples (sample, random): digests, and words and identifiers."""
    spark = docs.sparkSession
    digests = spark.range(SAMPLE_STRINGS).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    forms = [F.col("hex"), F.base64(F.unhex("hex")), F.translate(F.base64(F.unhex("hex")), "+/=", "-_"), F.upper(F.translate(F.base64(F.unhex("hex")), "+/=", "AZ7"))]
    random = digests.select(F.explode(F.array(*forms)).alias("sample"), F.lit(True).alias("random"))
    order = F.xxhash64("doc_id")
    last = docs.select(order.alias("h")).filter("h is not null").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    chosen = docs.filter(order <= (last if last is not None else 0)).orderBy(order, "text").limit(SAMPLE_DOCS)
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z_-]{3,}"), F.lit(0))).alias("sample"))
    names = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "a string, b string")
    styles = [F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat_ws("-", "a", "b"), F.upper(F.concat_ws("_", "a", "b")), F.concat_ws("/", "a", "b")]
    return random.unionByName(words.unionByName(names.select(F.explode(F.array(*styles)).alias("sample"))).withColumn("random", F.lit(False)))


def codes_of(run: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of(a, b)`` for the codes of each two neighbouring characters, in one pass along the run."""
    neighbours = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), of)
    return let(F.transform(F.split(run, ""), lambda c: F.ascii(c)), neighbours)


def ratios(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(b | a) of random strings less that of ordinary ones, at 128 a + b; the models have 128 ** 2 counts at most."""
    own = samples.filter(F.char_length("sample") > 1).select("random", F.explode(codes_of(F.col("sample"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pair"))
    counts = own.select("random", "pair.a", "pair.b").filter("a < 128 and b < 128").groupBy("random", "a", "b").count().collect()
    chars = sum(chr(c).isalnum() or chr(c) in "+/_=-" for c in range(128))
    count: dict = {}
    total: dict = {}
    for random, a, b, n in counts:
        count[random, a, b] = n
        total[random, a] = total.get((random, a), 0) + n
    def logp(random: bool, a: int, b: int) -> float:
        return log((count.get((random, a, b), 0) + smoothing) / (total.get((random, a), 0) + smoothing * chars))

    return [logp(True, a, b) - logp(False, a, b) for a in range(128) for b in range(128)]


def ratio(run: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of an ASCII run."""
    values = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    return F.aggregate(codes_of(run, lambda a, b: F.get(values, a * 128 + b)), F.lit(0.0), lambda s, x: s + x)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, text (null: empty) and spans, an array of (kind, start, end) by
    start, then kind, of which kind counts in KINDS and positions are code points, the end exclusive.

    ``samples`` (sample, random) trains the models. Matches of one kind don't overlap. Runs are looked for in what base spans
    leave of a text; of a run that does not look random as a whole, the parts between / = - and _ are judged by themselves.
    A null or empty text has none; repeated rows are scanned each; of an empty table nothing is returned; other columns are
    ignored, whatever they are called. Texts are scanned whole, in time that grows as their length, and as the number of
    matches to the power 1.5.
    """
    table = ratios(samples if samples is not None else training_samples(docs.select("doc_id", "text")))
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    text = F.col("__text")
    long_enough = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    random_enough = lambda m: ratio(m, table) >= F.greatest(F.lit(LEAST_RATIO), LEAST_EACH * F.char_length(m))
    parts = lambda m: spans(m, PART, 3, random_enough)
    base = F.concat(spans(text, ASSIGN, 0, long_enough), spans(text, ACCESS, 1), spans(text, HEX, 2))
    found = rows.withColumn("__base", ordered(base))
    found = found.withColumn("__bare", cut(text, F.col("__base"), lambda p: F.repeat(F.lit(" "), p["end"] - p["to"])))
    found = found.withColumn("__markov", spans(F.col("__bare"), CANDIDATE, 3, random_enough, parts))
    whole = F.when(F.size("__markov") > 0, ordered(F.concat("__base", "__markov"))).otherwise(F.col("__base"))
    return found.select(*keep, text.alias("text"), whole.alias("spans"))


def ordered(found: Column) -> Column:
    """Spans by start, then kind."""
    key = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(key), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of spans replaced by ``mark``; overlapping spans share one."""
    return cut(text, found, lambda p: F.when(p["apart"], mark).otherwise(""))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: reduce(lambda out, i: F.when(k == i, KINDS[i]).otherwise(out), range(len(KINDS)), F.lit(""))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, from ``find_secrets``."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
