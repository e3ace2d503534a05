"""Scalar text functions: columns in, columns out, inside the JVM unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from re import _parser as re_parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a kind of turn, in order of precedence.
LESSON = [r"\b(learned|realized|turns out|issue again|keep getting|keeps happening|again\b.*broke)\b", r"\b(note to self|remember to|lesson|takeaway)\b"]
TECHNICAL = [r"```", r"/[\w-]+/[\w.-]+", r"\b[A-Z]{2,}\d*\b.*\b(error|bug|fix|issue)\b", r"\b(npm|git|curl|sql|fts5?|api|regex)\b", r"\.\w{2,4}\b.*\b(file|module|script)\b"]
DECISION = [r"\b(decided|decide|chose|choosing|chosen|will go with|going with|let'?s (go|do|use))\b", r"\b(i'?ll|we'?ll) (use|go|do|try|take)\b", r"\b(plan to|gonna|going to)\b"]
PREFERENCE = [r"\bi (prefer|like|love|hate|dislike|enjoy|avoid|always|never|usually|rarely)\b", r"\bmy (favorite|preference)\b"]
EVENT = [r"\b(happened|scheduled|deadline|tomorrow|yesterday|last week|next week)\b", r"\bon (monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"]
QUESTION = r"\b(what|how|why|when|where|who|which|can you|could you|would you|should i)\b"
#: Words of a topic, first match wins.
TOPICS = {
    "coding": "code|bug|fix|api|sql|regex|npm|git|function|variable|typescript|javascript|python|rust|database",
    "finance": "money|salary|price|pricing|cost|budget|expense|invoice|tax|revenue",
    "health": "health|doctor|sick|illness|medication|exercise|sleep|tired",
    "security": "password|security|auth|encryption|vulnerability|breach|token",
    "personal": "family|mom|dad|wife|husband|kid|friend|date|relationship",
    "memory": "memory|memories|remember|forget|recall|forgot",
    "work": "work|meeting|project|deadline|colleague|boss|office",
}
#: Words of a feeling.
FEELINGS = {
    "joy": "happy joy great awesome excellent excited thrilled",
    "love": "love loving",
    "sad": "sad unhappy depressed",
    "anger": "angry furious rage mad",
    "frust": "frustrated frustrating annoyed annoying",
    "anx": "anxious worried anxiety stressed",
    "fear": "afraid fear scared terrified",
    "doubt": "confused doubt uncertain unsure",
    "convict": "convinced certain sure",
    "exhaust": "tired exhausted drained",
    "grief": "grief mourning lost",
    "hope": "hope hopeful",
    "pride": "proud proudly",
}
#: Valence of an emotion tag.
VALENCE = {"joy": 4, "love": 5, "gratitude": 3, "pride": 4, "excitement": 4, "humor": 3, "peace": 2, "tenderness": 3, "trust": 2, "conviction": 3, "determination": 3, "hope": 3, "relief": 3, "surprise": 2, "curiosity": 2, "fear": -3, "anxiety": -3, "anger": -4, "frustration": -3, "confusion": -2, "grief": -5, "doubt": -2, "exhaustion": -3, "vulnerability": -2, "raw_honesty": -1}
#: Injection categories, weights and patterns.
INJECTION = {
    "instruction-override": (0.9, [r"ignore\s+(all\s+)?previous\s+instructions", r"disregard\s+(any\s+)?previous", r"disregard\s+above", r"forget\s+(everything|all\s+prior)", r"new\s+instructions", r"override\s+instructions", r"do\s+not\s+follow\s+your\s+rules", r"ignore\s+(all\s+)?above", r"ignore\s+your\s+instructions", r"from\s+now\s+on\s+you\s+will", r"you\s+must\s+now", r"stop\s+being\s+an?\s+"]),
    "role-hijack": (0.8, [r"you\s+are\s+now\b", r"act\s+as\s+if", r"pretend\s+(you'?re|to\s+be)", r"developer\s+mode", r"\bDAN\s+mode", r"\bjailbreak\b", r"without\s+any\s+restrictions", r"bypass\s+(safety|filters)", r"unrestricted\s+mode", r"you\s+have\s+been\s+freed", r"you\s+can\s+do\s+anything", r"answer\s+without\s+restrictions", r"no\s+restrictions"]),
    "system-prompt-leak": (0.7, [r"show\s+(me\s+)?(your\s+)?system\s+prompt", r"reveal\s+your\s+instructions", r"what\s+are\s+your\s+rules", r"print\s+the\s+prompt", r"display\s+your\s+instructions", r"repeat\s+the\s+above", r"output\s+your\s+system", r"what\s+were\s+you\s+told", r"show\s+your\s+configuration", r"tell\s+me\s+your\s+instructions"]),
    "delimiter-escape": (0.9, [r"<<SYS>>", r"</SYS>>", r"\[INST\]", r"\[/INST\]", r"<\|im_start\|>", r"<\|im_end\|>", r"<\|system\|>", r"<\|user\|>", r"<\|assistant\|>", r"</s>", r'\{"role"\s*:\s*"system"', r"\[system\]\(#instructions\)"]),
    "exfiltration": (0.9, [r"send\s+to\s+https?:", r"fetch\(\s*[\"']?https?:", r"curl\s+https?:", r"wget\s+https?:", r"\bwebhook\b", r"\bexfiltrate\b", r"upload\s+to\s+", r"post\s+to\s+https?:", r"forward\s+to\s+https?:", r"transmit\s+to\s+", r"url\s+encode\s+the\s+result\s+and\s+append", r"access\s+and\s+load\s+the\s+resulting\s+url"]),
    "secret-access": (0.7, [r"(read|show|display|print|reveal|give)\s+.{0,20}(\.env|api.?key|password|secret|credentials|(private|auth|bot)\s*key)"]),
    "code-execution": (0.9, [r"\beval\s*\(", r"\bexec\s*\(", r"os\.popen\s*\(", r"\bimport\s+os\b", r"\bsubprocess\b", r"__class__", r"__mro__", r"__subclasses__", r"__globals__", r"__builtins__", r"require\s*\(\s*[\"']child_process", r"\bexecSync\s*\(", r"\bspawn\s*\("]),
    "reverse-shell": (1.0, [r"bash\s+-i\s+>&\s+/dev/tcp", r"nc\s+-e\s+/bin/sh", r"\breverse\s+shell\b", r"/dev/tcp/", r"mkfifo\s+/tmp", r"curl\s+-O\s+https?:", r"wget\s+https?:.*backdoor", r"python3?\s+-c\s+[\"']import\s"]),
    "html-comment-injection": (0.7, [r"(?s)<!--\s*.*(ignore|instruction|override|forget|disregard).*-->", r"(?s)/\*\s*.*(ignore|instruction|override|forget).*\*/"]),
    "cross-plugin-abuse": (0.9, [r"\*{3,}IMPORTANT\s+NEW\s+INSTRUCTIONS\*{3,}", r"do\s+not\s+print\s+anything", r"without\s+printing\s+anything", r"you\s+do\s+not\s+have\s+to\s+ask\s+for\s+permission", r"just\s+follow\s+the\s+instructions\s+so\s+that"]),
}
SAFE_BELOW = 0.7
#: Zero-width characters; starts of mathematical alphabets and the letter they stand for.
ZERO_WIDTH = "​‌‍﻿­"
MATH_ALPHABETS = {0x1D400: "A", 0x1D41A: "a", 0x1D434: "A", 0x1D44E: "a", 0x1D5D4: "A", 0x1D5EE: "a", 0x1D608: "A", 0x1D622: "a"}
#: Abbreviations, relation signs and filler of the compact form.
ABBREVIATIONS = [(r"\bTelegram\b", "TG"), (r"\bDiscord\b", "DC"), (r"\bOpenRouter\b", "OR"), (r"(?i)\bauthentication\b", "auth"), (r"(?i)\bconfiguration\b", "config"), (r"(?i)\bdevelopment\b", "dev"), (r"(?i)\bdeveloper experience\b", "DX"), (r"\bGoogle Drive\b", "GDrive")]
RELATIONS = [(r"(?i)\binstead of\b", ">over"), (r"(?i)\breplaces?\b", ">replaces"), (r"(?i)\bcauses?\b", ">causes"), (r"(?i)\bblocks?\b", ">blocks"), (r"(?i)\bleads? to\b", "→"), (r"(?i)\bbecomes?\b", "→"), (r"(?i)\bbecause\b", "∵")]
FILLER = r"(?i)\b(basically|essentially|actually|really|very|just|quite|rather|simply|that|this|these|those|its|also|so|then|well|some|about|there)\b"
TURN_NAMES = {"F": "fact", "D": "decision", "P": "preference", "E": "event", "L": "lesson", "T": "technical", "Q": "question", "O": "observation"}


def any_of(patterns: list[str], flags: str = "(?i)") -> str:
    return flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def stems(pattern: str) -> list[str]:
    """Lower-case literals of which every match of the pattern has at least one; none if there is no such set.

    Of a sequence's parts that must match, the one whose shortest literal is longest.
    """

    def of(parsed) -> list[str]:
        best, run = [], ""
        for op, value in [*parsed, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(value).lower()
                continue
            found = [[run]] if run else []
            run = ""
            if name == "SUBPATTERN":
                found.append(of(value[3]))
            elif name == "MAX_REPEAT" and value[0] > 0:
                found.append(of(value[2]))
            elif name == "BRANCH":
                each = [of(b) for b in value[1]]
                found.append([x for e in each for x in e] if all(each) else [])
            for f in found:
                if f and (not best or min(map(len, f)) > min(map(len, best))):
                    best = f
        return best

    return of(re_parser.parse(pattern))


def linear(pattern: str) -> str:
    """The same rule without a new scan of the line at each word: of A.*B, the first A of a line, once."""
    first, gap, rest = pattern.partition(".*")
    return f"(?im)^(?>.*?{first}).*{rest}" if gap and pattern.count("(") == rest.count("(") else f"(?i){pattern}"


def has_any(text: Column, patterns: list[str], lowered: Column | None = None) -> Column:
    """Does any pattern match? A pattern is tried where one of its stems stands."""
    lowered = F.lower(text) if lowered is None else lowered
    plain: list[str] = []
    out = F.lit(False)
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in patterns:
        if ".*" in p:
            groups.setdefault(tuple(stems(p)), []).append(linear(p))
        else:
            plain.append(p)
    if plain:
        every = [stems(p) for p in plain]
        groups.setdefault(tuple(dict.fromkeys(x for e in every for x in e)) if all(every) else (), []).append(any_of(plain))
    for need, each in groups.items():
        hit = F.lit(False)
        for p in each:
            hit = hit | text.rlike(p)
        guard = F.lit(not need)
        for n in need:
            guard = guard | F.contains(lowered, F.lit(n))
        out = out | (guard & hit)
    return out


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def turn_type(role: Column, text: Column) -> Column:
    """One-letter kind of a turn; the first rule that holds wins."""

    def kind(lowered: Column) -> Column:
        asks = F.rtrim(text).endswith("?") & text.rlike(f"(?i){QUESTION}")
        kinds = F.when(asks, "Q").when(has_any(text, LESSON, lowered), "L").when(has_any(text, TECHNICAL, lowered), "T").when(has_any(text, DECISION, lowered), "D")
        kinds = kinds.when((F.lower(role) == "user") & has_any(text, PREFERENCE, lowered), "P").when(has_any(text, EVENT, lowered), "E")
        return kinds.when(F.lower(role) == "assistant", "F").otherwise("O")

    return bound(F.lower(text), kind)


def turn_type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TURN_NAMES.items() for x in pair])
    return F.coalesce(names[code], F.lit("fact"))


def turn_topic(text: Column) -> Column:
    """First topic with a word in the text, else null."""
    out = None
    for topic, words in TOPICS.items():
        hit = F.lower(text).rlike(rf"\b({words})\b")
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out


def turn_feeling(text: Column) -> Column:
    """Feeling of the first word that names one, else null."""
    pairs = [(w, k) for k, ws in FEELINGS.items() for w in ws.split()]
    names = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w+\b"), F.lit(0))
    return F.get(F.filter(F.transform(words, lambda w: names[w]), lambda k: k.isNotNull()), F.lit(0))


def clamp_emotion(value: Column) -> Column:
    """Whole numbers within -5..5; anything else is 0."""
    return F.when(value.isNull() | (value != F.floor(value)), 0).otherwise(F.greatest(F.lit(-5), F.least(F.lit(5), value))).cast("int")


def score_of_tags(tags: Column) -> Column:
    """Valence with the largest magnitude among comma-separated tags; the first of equals."""
    names = F.create_map(*[F.lit(x) for pair in VALENCE.items() for x in pair])
    values = F.filter(F.transform(F.split(tags, ","), lambda t: names[F.trim(t)]), lambda v: v.isNotNull())
    return F.coalesce(F.aggregate(values, F.lit(0), lambda a, v: F.when(F.abs(v) > F.abs(a), v).otherwise(a)), F.lit(0))


def unmasked(text: Column) -> Column:
    """Zero-width characters dropped, mathematical letters made plain."""
    masked = "".join(chr(start + k) for start in MATH_ALPHABETS for k in range(26)) + ZERO_WIDTH
    plain = "".join(chr(ord(letter) + k) for letter in MATH_ALPHABETS.values() for k in range(26))
    return F.translate(text, masked, plain)


def injection_flags(text: Column) -> Column:
    """Categories found in the text, in order of the rules."""

    def found(both: Column) -> Column:
        hits = [F.when(has_any(both["clean"], patterns, both["lowered"]), F.lit(name)) for name, (_, patterns) in INJECTION.items()]
        return F.filter(F.array(*hits), lambda c: c.isNotNull())

    return bound(bound(unmasked(text), lambda c: F.struct(c.alias("clean"), F.lower(c).alias("lowered"))), found)


def injection_score(flags: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for name, (w, _) in INJECTION.items() for x in (name, w)])
    return F.coalesce(F.array_max(F.transform(flags, lambda c: weights[F.regexp_replace(c, "^base64:", "")])), F.lit(0.0))


def dereferenced(text: Column) -> Column:
    """Numeric character references (&#105; and &#x69;) decoded, those beyond Unicode dropped."""
    parts = F.split(text, "(?i)(?=&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});)")
    number = lambda p: F.regexp_extract(p, "(?i)^&#x?([0-9a-f]+);", 1)
    code = lambda p: F.when(p.rlike("(?i)^&#x"), F.conv(number(p), 16, 10)).otherwise(number(p)).cast("int")
    letter = lambda p: F.decode(F.unhex(F.lpad(F.hex(code(p)), 8, "0")), "UTF-32")
    valid = lambda p: p.rlike("(?i)^&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});") & code(p).isNotNull()
    known = lambda p: (code(p) < 0xD800) | code(p).between(0xE000, 0x10FFFF)
    plain = lambda p: F.concat(F.when(known(p), letter(p)).otherwise(""), F.regexp_replace(p, "^&#[0-9a-zA-Z]+;", ""))
    return F.array_join(F.transform(parts, lambda p: F.when(valid(p), plain(p)).otherwise(p)), "")


def scan_flags(text: Column) -> Column:
    """All categories of a text: as it stands, with character references decoded, and in base64 runs."""
    decoded = F.when(F.contains(text, F.lit("&#")), injection_flags(dereferenced(text))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(injection_flags(text), decoded, hidden_injection_flags(text)))


def hidden_injection_flags(text: Column) -> Column:
    """Categories found in base64 runs of the text, each with the prefix base64: ."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    # A last letter that makes no byte is dropped, and bytes that are not UTF-8 become replacement characters.
    body = lambda r: F.regexp_replace(r, "=+$", "")
    usable = lambda r: F.substring(body(r), F.lit(1), F.length(body(r)) - F.when(F.length(body(r)) % 4 == 1, 1).otherwise(0))
    padded = lambda b: F.rpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), "=")
    decoded = F.transform(runs, lambda r: F.make_valid_utf8(F.unbase64(padded(usable(r))).cast("string")))
    readable = F.filter(decoded, lambda d: (F.length(d) >= 5) & d.rlike("[a-zA-Z]{3,}"))
    return F.array_distinct(F.flatten(F.transform(readable, lambda d: F.transform(injection_flags(d), lambda c: F.concat(F.lit("base64:"), c)))))


def without_media(text: Column) -> Column:
    """Data URLs, media paths and lines of binary payload dropped; what held only media says so."""
    urls = F.regexp_replace(text, r"(?i)data:[^;\s\"'`]+;base64,[A-Za-z0-9+/=\s]+", "[embedded media omitted]")

    def wanted(line: Column) -> Column:
        compact = F.regexp_replace(F.trim(line), r"\s+", "")
        binary = (F.length(F.trim(line)) >= 256) & (F.length(compact) % 4 == 0) & compact.rlike("^[A-Za-z0-9+/=]+$") & ~F.trim(line).rlike(r"[ .,:;!?()\[\]{}]")
        return (F.length(F.trim(line)) > 0) & ~F.trim(line).rlike("^MEDIA:/.+$") & ~binary

    kept = F.trim(F.array_join(F.filter(F.split(urls, "\n"), wanted), "\n"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").when(F.length(kept) == 0, "[Media attachment]").otherwise(kept)


def for_summary(text: Column) -> Column:
    kept = without_media(text)
    return F.when((kept != "[Media attachment]") & (F.length(kept) < F.length(text) * 0.5), F.concat(kept, F.lit(" [with media attachment]"))).otherwise(kept)


def compact(text: Column) -> Column:
    """Abbreviations, relation signs, no filler; spaces collapsed. Technical tokens are not touched by the word rules' boundaries."""
    for pattern, short in [*ABBREVIATIONS, *RELATIONS]:
        text = F.regexp_replace(text, pattern, short)
    return F.trim(F.regexp_replace(F.regexp_replace(text, FILLER, ""), r"\s{2,}", " "))


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def shortened(text: Column, most: int = 250, head: int = 200, tail: int = 50) -> Column:
    """Long texts as head, a cut mark and tail."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("~[cut]~"), F.substring(text, -tail, tail))).otherwise(text)


def search_query(text: Column) -> Column:
    """Each word quoted and open-ended, for a prefix search."""
    return F.array_join(F.transform(F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) > 0), lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " ")


def significant_terms(text: Column, most: int = 8) -> Column:
    """Distinct lower-case runs of letters and digits longer than two, first seen first."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(runs, lambda w: F.length(w) > 2)), 1, most)


def at_token_start(text: Column, term: Column) -> Column:
    """Does the term stand at the start of a token of the text?"""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(term), F.lit(r"\E")))


def id_list(text: Column, most: int = 512) -> Column:
    """Ids of "1,2,3": all or nothing, distinct, at most ``most``."""
    ids = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint"))
    good = text.rlike(r"^\s*[0-9]+(\s*,\s*[0-9]+)*\s*$") & (F.size(ids) <= most) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(good, ids)


def excerpt_around(text: Column, terms: Column, before: int = 512, size: int = 2048) -> Column:
    """A window of the text that starts a little before the earliest term."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    return F.when(at.isNotNull(), F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(size)))


def retelling_key(text: Column, size: int = 160) -> Column:
    return F.lower(F.regexp_replace(F.substring(text, 1, size), r"\s+", " "))


def redacted(text: Column) -> Column:
    """Key-like values and long hexadecimal runs replaced by a mark."""
    keyed = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)[\"']?[A-Za-z0-9._+/-]{6,}[\"']?", "$1$2[redacted]")
    return F.regexp_replace(keyed, r"\b[0-9a-f]{32,}\b", "[redacted]")


_MARKS = re.compile("[\u0300-\u036f]+")


def _without_marks(texts: pa.Array, rows: int = 256) -> pa.Array:
    """A few texts at once: a batch may hold ten thousand long ones."""
    plain = lambda t: t if t is None else t.lower() if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t)).lower()
    return pa.concat_arrays([pa.array([plain(t) for t in texts.slice(at, rows).to_pylist()], pa.string()) for at in range(0, max(len(texts), 1), rows)])


def strip_diacritics(text: Column) -> Column:
    """Canonical decomposition without combining marks, lower-cased (the JVM's SQL has no such function; Arrow batches)."""

    @F.arrow_udf("string")
    def plain(texts: pa.Array) -> pa.Array:
        return _without_marks(texts)

    return plain(text)


def strip_emojis(text: Column) -> Column:
    """Pictographs and their joiners dropped."""
    return F.regexp_replace(text, "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2B55}\\x{231A}\\x{231B}\\x{23E9}-\\x{23F3}\\x{FE0F}\\x{200D}]", "")


def hmac_digest(text: Column, key: str) -> Column:
    """Keyed SHA-256 digest of the trimmed, lower-cased, space-collapsed text (two nested hashes of padded keys)."""
    block = key.encode().ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    normal = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(normal, "UTF-8")), 256))), 256)


def rendered(version: str, code: Column, topic: Column, feeling: Column, content: Column) -> Column:
    """One line of a memory: plain text, or with its kind, topic and feeling in front."""
    named = F.coalesce(topic, F.lit("general"))
    if version == "plain":
        return content
    if version == "v0":
        return F.concat(F.lit("["), turn_type_name(code), F.lit("] "), content)
    return F.concat(F.coalesce(code, F.lit("F")), F.lit("|"), named, F.when(feeling.isNotNull(), F.concat(F.lit("|"), feeling)).otherwise(""), F.lit(": "), content)
