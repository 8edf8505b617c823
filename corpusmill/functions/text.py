"""Text functions on columns: tokenizers, snippets, truncation, redaction, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifier tokens, CJK characters.
IDENTIFIER = r"[A-Za-z0-9_]+(?:[.:-][A-Za-z0-9_]+)*"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _windows(run: Column, size: int) -> Column:
    return F.when(
        F.length(run) >= size,
        F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substr(run, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def index_tokens(c: Column) -> Column:
    """The set of identifier tokens (lower case; ``.md`` names also without the suffix),
    single CJK characters and CJK bigrams."""
    none = F.array().cast("array<string>")
    runs = F.regexp_extract_all(_text(c), F.lit(f"{CJK}+"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.concat(_windows(r, 1), _windows(r, 2))))
    many = F.when(F.octet_length(c) > F.length(c), grams).otherwise(none)

    def of(joined: Column) -> Column:
        words = F.when(joined == "", none).otherwise(F.split(joined, " "))
        files = F.filter(words, lambda w: F.endswith(w, F.lit(".md")) | F.endswith(w, F.lit(".markdown")))
        stems = F.when(F.contains(joined, F.lit(".m")), F.transform(files, lambda w: F.regexp_replace(w, r"\.(md|markdown)$", ""))).otherwise(none)
        return F.array_distinct(F.concat(words, stems, many))

    joined = F.lower(F.array_join(F.regexp_extract_all(_text(c), F.lit(IDENTIFIER), 0), " "))
    return F.transform(F.array(joined), of)[0]  # bound, so that a text is read once


def ranking_tokens(tokens: Column) -> Column:
    """Query tokens without single CJK characters where two or more longer terms remain."""
    single = lambda t: t.rlike(f"^{CJK}$")
    longer = F.filter(tokens, lambda t: ~single(t))
    return F.when(F.size(longer) >= 2, longer).otherwise(tokens)


def metric_tokens(c: Column) -> Column:
    """Words of two or more characters that begin with a letter, numbers, CJK bigrams
    without stop words: the tokenizer of the answer metrics."""
    words = F.transform(F.regexp_extract_all(_text(c), F.lit(r"[a-zA-Z][a-zA-Z0-9_]{1,}|\d+(?:\.\d+)?"), 0), F.lower)
    runs = F.regexp_extract_all(_text(c), F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), 0)
    grams = F.filter(F.flatten(F.transform(runs, lambda r: _windows(r, 2))), lambda g: ~g.isin(*CJK_STOP))
    return F.array_distinct(F.concat(words, grams))


#: Stop words among CJK bigrams.
CJK_STOP = ("这个", "那个", "什么", "如何", "怎么", "是否", "一个", "以及", "并且")


#: What a keyword is; the suffix of a chunk reference.
KEYWORD = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)*"
CHUNK_SUFFIX = r"(?i):ch[0-9a-f]{8}(?:-\d+)?$"


def split_keywords(c: Column) -> Column:
    """CJK runs and identifiers in order, repeats (by lower case) dropped."""
    words = F.regexp_extract_all(_text(c), F.lit(KEYWORD), 0)
    lowered = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)


def retrieval_terms(c: Column) -> Column:
    """Keywords; those of more than four CJK characters as windows of four and two."""
    long = lambda w: (F.length(w) > 4) & ~w.rlike("^[A-Za-z0-9_]")
    terms = F.flatten(F.transform(split_keywords(c), lambda w: F.when(long(w), F.concat(_windows(w, 4), _windows(w, 2))).otherwise(F.array(w))))
    return F.filter(F.array_distinct(terms), lambda t: F.length(t) >= 2)


def head_and_tail(c: Column, limit: int, tail: int) -> Column:
    """Text over the limit as its head and tail around a note of what was cut."""
    cut = F.concat(
        F.substring(c, 1, limit - tail),
        F.lit("\n…[truncated "), (F.length(c) - limit).cast("string"), F.lit(" chars]…\n"),
        F.right(c, F.lit(tail)),
    )
    return F.when(F.length(c) > limit, cut).otherwise(_text(c))


def snippet(c: Column, needle: str, around: int = 40) -> Column:
    """White space squeezed; up to ``around`` characters on either side of the first hit."""
    at = F.locate(needle.lower(), F.lower(c))
    begin = F.greatest(at - around, F.lit(1))
    part = F.substr(c, begin, F.lit(2 * around + len(needle)))
    return F.when(at > 0, F.trim(F.regexp_replace(part, r"\s+", " "))).otherwise("")


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


#: What secrets look like and what replaces them: header values, keys that start with sk-, bearer tokens, values of
#: named fields in queries and in JSON, whose quotes may be escaped. Then mail addresses.
SECRETS = (
    (r"""(?i)(authorization|api-key|x-api-key)["':=]+\s*([^\s",}]+)""", "$1: [REDACTED]"),
    (r"(?i)(sk-[a-z0-9_-]+)", "[REDACTED]"),
    (r"(?i)(bearer|key)\s+([a-z0-9._-]{8,})", "$1 [REDACTED]"),
    (r"""(?i)((?:api[_-]?key|access[_-]?token|token|cookie|password|secret)\s*[\\"':=\s]+)([A-Za-z0-9._+/=-]{8,})""", "$1[REDACTED]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
)


def redact(c: Column) -> Column:
    for pattern, instead in SECRETS:
        c = F.regexp_replace(c, pattern, instead)
    return c


def fnv1a32(c: Column) -> Column:
    """FNV-1a of a text's characters in the basic plane, as eight hexadecimal digits."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    h = F.aggregate(
        chars,
        F.lit(2166136261).cast("long"),
        lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")),
    )
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def entry_key(ref: Column) -> Column:
    """The entry of a chunk reference: its chunk suffix dropped; ``#c<n>`` and ``#doc``
    stand for the file."""
    clean = F.trim(F.replace(ref, F.lit("\\"), F.lit("/")))
    path = F.substring_index(clean, "#", 1)
    anchor = F.when(F.locate("#", clean) > 0, F.substr(clean, F.locate("#", clean) + 1)).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(anchor, CHUNK_SUFFIX, ""), r"(?i):c\d+$", "")
    whole = (anchor == "") | anchor.rlike(r"(?i)^(c\d+|doc(:ch[0-9a-f]{8}(-\d+)?)?)$") | (bare == "")
    return F.when(whole, path).otherwise(F.concat_ws("#", path, bare))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(_text(c)) / 4)).cast("long")


#: Fixed value: the marks of a fenced block at the ends of lines.
FENCE_MARKS = r"(?m)^```(?:json)?\s*|\s*```$"


def balanced_json(c: Column) -> Column:
    """The first JSON object of a text, or without any its first array: from its opening bracket to the one that closes
    it, brackets in strings left out. Null where none closes or what stands between isn't JSON; keys may not repeat.
    One fold over the characters."""
    clean = F.trim(F.regexp_replace(F.trim(_text(c)), FENCE_MARKS, ""))
    brace, bracket = F.locate("{", clean), F.locate("[", clean)
    start = F.when(brace > 0, brace).otherwise(bracket)
    opening = F.substr(clean, start, F.lit(1))
    closing = F.when(opening == "{", "}").otherwise("]")
    tail = F.substr(clean, start)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        at = s["at"] + 1
        quoted = F.when(s["quoted"], s["escaped"] | (ch != '"')).otherwise(ch == '"')
        escaped = s["quoted"] & ~s["escaped"] & (ch == "\\")
        free = ~s["quoted"] & (ch != '"')
        depth = s["depth"] + F.when(free & (ch == opening), 1).when(free & (ch == closing), -1).otherwise(0)
        ends = (s["end"] == 0) & free & (ch == closing) & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), F.when(ends, at).otherwise(s["end"]).alias("end"))

    chars = F.filter(F.split(tail, ""), lambda x: x != "")
    end = F.aggregate(chars, begin, step)["end"]
    found = F.substr(tail, F.lit(1), end)
    return F.when((start > 0) & (end > 0) & F.try_parse_json(found).isNotNull(), found)
