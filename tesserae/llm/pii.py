"""Personal data: base patterns, and unseen identifiers by bootstrapped contextual extraction.

Only DataFrame functions run. Base kinds are matched by regular expressions, leftmost and
without overlap, one kind at a time; matches that fail their check (parts of an address, Luhn
sum, number of digits) are dropped without another try. The expressions use possessive
repetition and look-behinds where that changes no match, so that long runs of one class
cost linear time and no stack.

Bootstrapping: identifier-like values are instances, and what stands around them is their
lexical pattern, of three sorts: a word with an assignment sign and quote before a value (six
or more characters with a digit), and, for values of eight or more characters with a letter
and a digit that follow no sign, the two words before or the two words after. Values of 32 or more hexadecimal
digits are seeds, and so are values after a sign that a base kind matches; between bare words the
latter speak against a pattern, since addresses stand anywhere in prose. Over the bipartite graph of
patterns and instances, counted over all documents, patterns get the share of their
occurrences that instances support, and instances the probability that some pattern of theirs
holds (of two words, those with support and a confidence of ``TELLING`` or more), in ``ROUNDS`` rounds. Patterns of at least ``MIN_CONFIDENCE`` with ``MIN_SUPPORT`` seeds
then mark all their instances (kind ``secret``), seeds or not, unless a base span overlaps; of
marked values that overlap, the one that starts first and is longest stays.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows
get equal spans, each its own row. Null ids are kept. Columns other than id and text are not
read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The base expressions, in possessive form (see the tests for the plain ones).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
ADDRESS = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: A word, an assignment sign with an optional quote, and a value: groups 1 to 3.
INSTANCE = r"""(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]*+)([\x20]?[=:]{1,2}[\x20]?["']?)((?=[A-Za-z._+/@-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9._+/@-]{5,}+)"""
SEED = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9]+(?:\.[0-9]+){3}|\+?[0-9-]{9,19})$"
HEX = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
_VALUE = r"(?=[A-Za-z._+/@-]*+[0-9])(?=[0-9._+/@-]*+[A-Za-z])[A-Za-z0-9+][A-Za-z0-9._+/@-]{7,}+"
#: Two words and a value that no sign follows: groups 1 to 3.
BEFORE = rf"""(?<![\p{{L}}\p{{N}}_])(\p{{L}}++)\x20(\p{{L}}++)\x20["']?({_VALUE})(?!\x20?["']?\x20?[=:])"""
#: A value that no sign explains, and two words: groups 1 to 3.
_FREE = r"""(?<![A-Za-z0-9._+/@-])(?<![=:]|[=:]["'\x20]|[=:]\x20["'])"""
AFTER = rf"""{_FREE}({_VALUE})["']?\x20(\p{{L}}++)\x20(\p{{L}}++)(?![\p{{N}}_])"""
#: TELLING: confidence from which on two words tell of their values.
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, TELLING = 3, 0.7, 3, 0.4
#: Offsets are summed in chunks of this many matches, so that texts with very many matches stay cheap.
CHUNK = 256


def running_sum(lengths: Column) -> Column:
    """Sums of what stands before each element; two levels, so no step copies more than a chunk or the chunks."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))

    def scan(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda acc, v: F.struct((acc.at + v).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    def whole(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(parts, scan(sums, F.lit(0)), scan))

    return F.when(F.size(lengths) > 0, F.element_at(F.transform(F.array(chunks), whole), 1)).otherwise(F.array().cast("array<int>"))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, from the matches and what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
        sizes = F.transform(m, lambda p: F.char_length(p))
        before = running_sum(F.zip_with(F.slice(between, 1, F.size(m)), sizes, lambda b, s: b + s))
        rows = F.arrays_zip(before.alias("before"), F.slice(between, 1, F.size(m)).alias("gap"), sizes.alias("size"), m.alias("match"))
        return F.transform(rows, lambda r: F.struct((r["before"] + r["gap"]).cast("long").alias("start"), (r["before"] + r["gap"] + r["size"]).cast("long").alias("end"), r["match"].alias("match")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(found), placed), 1)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Does the digit string pass Luhn's check?"""
    ds = F.transform(F.reverse(F.split(value, "(?<=.)(?=.)")), lambda d: d.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(ADDRESS)
    if kind == "card":
        size = F.char_length(digits(match))
        return F.when((size >= 13) & (size <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end>> of one base kind."""
    passed = F.filter(places(text, PATTERNS[kind]), lambda p: _passes(kind, p.match))
    return F.transform(passed, lambda p: F.struct(p.start.alias("start"), p.end.alias("end")))


def instances(text: Column) -> Column:
    """array<struct<pattern, value, seed, other, start, end>>: values with a word and a sign before them, or two words on a side."""

    def row(pattern: Column, value: Column, seed: Column, other: Column, start: Column) -> Column:
        return F.struct(F.lower(pattern).alias("pattern"), value.alias("value"), seed.alias("seed"), other.alias("other"), start.alias("start"), (start + F.char_length(value)).alias("end"))

    def assigned(p: Column) -> Column:
        word, sign, value = (F.regexp_extract(p.match, INSTANCE.replace(r"(?<![\p{L}\p{N}_])", "^"), k) for k in (1, 2, 3))
        return row(F.concat(word, F.translate(sign, " ", "")), value, value.rlike(SEED), F.lit(False), p.end - F.char_length(value))

    def between(value: Column, pattern: Column, start: Column) -> Column:
        return row(pattern, value, value.rlike(HEX), value.rlike(SEED) & ~value.rlike(HEX), start)

    def before(p: Column) -> Column:
        one, two, value = (F.regexp_extract(p.match, BEFORE.replace(r"(?<![\p{L}\p{N}_])", "^"), k) for k in (1, 2, 3))
        return between(value, F.concat(one, F.lit(" "), two, F.lit(" _")), p.end - F.char_length(value))

    def after(p: Column) -> Column:
        value, one, two = (F.regexp_extract(p.match, AFTER.replace(_FREE, "^"), k) for k in (1, 2, 3))
        return between(value, F.concat(F.lit("_ "), one, F.lit(" "), two), p.start)

    return F.concat(F.transform(places(text, INSTANCE), assigned), F.transform(places(text, BEFORE), before), F.transform(places(text, AFTER), after))


def scored_patterns(found: DataFrame) -> DataFrame:
    """pattern, confidence, support: of the pattern-instance graph over all documents."""
    seeded = found.groupBy("pattern", F.xxhash64("value").alias("instance")).agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max("other").alias("other"))
    edges = common.written(seeded)
    belief = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for _ in range(ROUNDS):
        told = edges.join(belief, "instance")
        confidence = told.groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / F.sum("n")).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("support"))
        held = edges.join(confidence, "pattern").groupBy("instance")
        sure = ~F.col("pattern").contains(" ") | (F.col("confidence") >= TELLING) & (F.col("support") >= MIN_SUPPORT)
        told_by_patterns = F.when(F.max("other"), 0.0).otherwise(1 - F.exp(F.sum(F.when(sure, F.log1p(-0.9 * F.col("confidence"))).otherwise(0.0))))
        belief = held.agg(F.greatest(F.max(F.col("seed").cast("double")), told_by_patterns).alias("belief"))
        belief = common.written(belief)
    told = edges.join(belief, "instance")
    return told.groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / F.sum("n")).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("support"))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, one array of spans for each base kind, and ``secret`` spans, for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        *(base_spans(text, kind).alias(kind) for kind in KINDS),
        instances(text).alias("instances"),
    )
    scanned = common.written(scanned)
    found = scanned.where(F.size("instances") > 0).select("doc_id", "text_key", F.explode("instances").alias("i")).select("doc_id", "text_key", "i.*")
    held = scored_patterns(found).where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)).select("pattern")
    # Rows that repeat an id and a text have equal spans: one copy of them is enough. Values reach to the end of a run, so those that overlap end alike.
    new = found.join(held, "pattern").groupBy("doc_id", "text_key", "end").agg(F.min("start").alias("start"))
    new = new.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("new"))
    new = new.withColumnsRenamed({"doc_id": "new_id", "text_key": "new_key"})
    both = scanned.join(new, F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_key") == F.col("new_key")), "left")
    base = F.concat(*KINDS)
    free = F.filter(F.coalesce("new", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))
    return both.select("doc_id", *KINDS, free.alias("secret"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s.start.cast("string"), F.lit(":"), s.end.cast("string")))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    out = found_spans(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(KINDS).cast("binary"), 256).alias("base_sha256"),
        listed((*KINDS, "secret")).alias("spans"),
        F.size(F.concat(*KINDS, "secret")).cast("long").alias("n_spans"),
    )
