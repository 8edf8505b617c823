"""Line-first quality rules.

Every line is judged alone for punctuation, navigation, boilerplate, symbols and
shouting. Lines that fail are removed, and a document that loses too much of its
text with them is rejected. The document-level counts of the contract come from
the same pass over the text.

Defined cases: a null text counts as empty; an empty text has all counts 0, fails
the base rule (fewer than 50 words) and is not kept; rows are judged one by one,
so repeated rows each get a row; a very long text is one row, read whole; other columns of the input are ignored; a null
``doc_id`` is carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the contract: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Fixed values of the contract: white space between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Marks that end a sentence, separators of menus, boilerplate phrases (English, German, French, Spanish).
TERMINAL = tuple(".!?…:;\"'”’»)]")
SEPARATORS = frozenset(["|", "»", "›", "•", "·", ">", "/"])
BOILERPLATE = re.compile(
    "|".join(
        (
            "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
            "use of cookies", "enable javascript", "javascript is disabled", "sign up for our newsletter",
            "subscribe to our", "click here", "log in to comment", "skip to content", "back to top",
            "share on facebook", "share on twitter", "lorem ipsum",
            "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "javascript aktivieren", "newsletter abonnieren", "zum inhalt springen", "nach oben",
            "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilisation de cookies", "activer javascript", "abonnez-vous à", "cliquez ici", "haut de page",
            "todos los derechos reservados", "términos de uso", "política de privacidad", "uso de cookies", "habilite javascript", "suscríbete a", "haga clic aquí", "volver arriba",
        )
    )
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the text a document may lose."""

    min_words_for_punctuation: int = 8
    max_separator_share: float = 0.2
    max_symbol_share: float = 0.1
    max_shout_share: float = 0.5
    max_lost_share: float = 0.3
    min_words: int = 50


def line_failure(line: str, rules: LineRules) -> str:
    """The first rule that the line breaks, or an empty string."""
    words = line.split()
    if not words:
        return ""
    chars = sum(map(len, words))
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and separators > rules.max_separator_share * len(words):
        return "navigation"
    if sum(line.count(s) for s in SYMBOLS) > rules.max_symbol_share * chars:
        return "symbols"
    if len(words) >= 4 and sum(w.endswith("!!") for w in words) > rules.max_shout_share * len(words):
        return "shouting"
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if len(words) >= rules.min_words_for_punctuation and not any(w.endswith(TERMINAL) for w in words):
        return "punctuation"
    return ""


def clean_lines(text: str, rules: LineRules) -> tuple[str, int]:
    """The text without failing lines, and the characters in words that it lost."""
    kept, lost = [], 0
    for line in text.split("\n"):
        if line_failure(line, rules):
            lost += len(line) - sum(map(line.count, BLANKS))
        else:
            kept.append(line)
    return "\n".join(kept), lost


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    codes = pairs[:-1] * len(seen) + ids[2:]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[starts + step] = True
    return int(covered.sum())


def measure(text: str, rules: LineRules) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(map(text.count, BLANKS))
    symbols = sum(text.count(s) for s in SYMBOLS)
    lines, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup += bool(line.split())
        lines.add(line)
    repeat = repeated_words(words)
    cleaned, lost = clean_lines(text, rules)
    chars = len(text) - blanks
    failed = n < rules.min_words or 100 * repeat > 50 * n
    kept = not failed and lost <= rules.max_lost_share * chars
    return n, chars, symbols, dup, repeat, lost, failed, kept, cleaned


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lost_chars long, cleaned string"
)


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row a document: the counts, the verdict and, if wanted, the cleaned text. No shuffle."""
    schema = SCHEMA if with_text else SCHEMA.removesuffix(", cleaned string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "", rules) for t in batch.column(1).to_pylist()]
            n, chars, symbols, dup, repeat, lost, failed, kept, cleaned = zip(*rows, strict=True) if rows else [()] * 9
            longs = [pa.array(x, pa.int64()) for x in (n, chars, symbols, dup, repeat)]
            flags = [pa.array(x, pa.bool_()) for x in (failed, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, *flags, pa.array(lost, pa.int64()), *([pa.array(cleaned, pa.string())] if with_text else [])],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, schema)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, their failing lines removed, with the columns of
    ``docs`` (``n_chars`` follows the text)."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows = [measure(t or "", rules) for t in batch.column(at).to_pylist()]
            texts = pa.array([r[8] for r in rows], pa.string())
            columns = list(batch.columns)
            columns[at] = texts
            if "n_chars" in batch.schema.names:
                n = batch.schema.get_field_index("n_chars")
                columns[n] = pa.array([len(r[8]) for r in rows], pa.int64()).cast(columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([r[7] for r in rows], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
