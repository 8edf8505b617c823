"""Main text of HTML pages by the maximum-scoring run of tokens.

A page becomes a line of tokens: words and tags. Words score positive and tags
negative; the weights are log odds from labelled pages, and so is the factor between them. One linear
scan finds the contiguous run with the highest sum, and its words are the main text.

What lies inside that run and isn't the article is told word by word: by the kind of an element (nav,
footer and such; a header or a menu outside an article; a form with few words for its fields, which isn't one around a page), by the words of its class,
id and role, which are weighed by a logistic fit on the same pages and count only
where one is a known name (html, body, main, article and headings never are), and by menus, blocks in a row
that are links and nothing else. Such words score next to nothing and are left out.

Defined cases: a null page counts as empty; a page without words outside
boilerplate has an empty text; broken markup is read as far as it goes (an open tag
at the end of a cut page is dropped); equal scores go to the earliest and then the
shortest run; a very long page is read whole, in time in proportion to its length; repeated rows each
get a row; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.labelled_pages import NAME_PAGES, PAGES

#: HTML's element kinds.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog button select option label".split())
#: The fields of a form. A form is boilerplate with so few words for each of its fields; others wrap a page.
FIELDS, WORDS_A_FIELD = frozenset("input select textarea button".split()), 25
#: An anchor around more words was never closed.
MOST_LINK_WORDS = 40
#: Elements that hold a whole page or text, or its headings, whatever they are called.
WHOLE = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe subscription signup login search comment comments respond replies disqus share sharing social "
    "related recommended reviews discussion guestbook disclaimer legal imprint".split()
)
#: A quote opens a value only after an equals sign; an unclosed script ends with the page, an unclosed title at the next tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<own>title|textarea)\b[^>]*>(?:(?:(?!<(?:/?head|body)\b).)*?</(?P=own)\s*>|[^<]*)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A line of so many blocks that are links and nothing else is a menu.
MENU_LINKS = 3
#: Factors of the tags' weights that are tried on the labelled pages.
FACTORS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


def name_words(attrs: str) -> set[str]:
    """The words of an element's class, id and role."""
    values = (found[1] or found[2] or found[3] or "" for found in NAMED.finditer(attrs))
    return {w for value in values for w in re.split(r"[\s_-]+", value.lower()) if w and not w.isdigit()}


def named(name: str, attrs: str) -> set[str]:
    """The words that may make an element boilerplate: none without a known name."""
    words = name_words(attrs) if attrs and name not in WHOLE else set()
    return words if words & BOILERPLATE_NAMES else set()


def is_boilerplate(name: str, attrs: str) -> bool:
    words = named(name, attrs)
    return name in BOILERPLATE or bool(words) and name_score(words, fitted_names()) < 0


def name_score(words: set[str], weights: dict[str, float]) -> float:
    return weights["#known"] + sum(weights.get(w, 0.0) for w in words)


@lru_cache(maxsize=1)
def fitted_names() -> dict[str, float]:
    """Weights of names by logistic regression over the labelled pages' elements that have
    a known one: an element is content if most of its words are. ``#known`` is
    what any known name weighs; a word that the pages don't have adds nothing."""
    sample = []
    for page in NAME_PAGES:
        within, open_ = False, []
        for found in TOKEN.finditer(page):
            whole, name = found[0], (found["name"] or "").lower()
            if whole.startswith("<!--"):
                within = whole == "<!--CONTENT-->" or within and whole != "<!--/CONTENT-->"
            elif name and found["close"]:
                while open_:
                    own, words, inside, outside = open_.pop()
                    if words:
                        sample.append((words, inside > outside))
                    if own == name:
                        break
            elif name and name not in VOID:
                open_.append([name, named(name, found["attrs"]), 0, 0])
            elif whole[0] != "<":
                for element in open_:
                    element[2 if within else 3] += len(whole.split())
    weights = {"#known": 0.0} | {w: 0.0 for words, _ in sample for w in sorted(words)}
    for _ in range(300):
        steps = Counter()
        for words, content in sample:
            error = content - 1 / (1 + math.exp(-name_score(words, weights)))
            for w in ("#known", *words):
                steps[w] += error
        for w in weights:
            weights[w] += 0.2 * (steps[w] - 0.01 * weights[w])
    return weights


HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
HIDDEN = re.compile(r"""(?:^|\s)type\s*=\s*["']?hidden""", re.I)


def contents(found: list[re.Match]) -> dict[int, tuple[int, int, bool]]:
    """For each form and anchor, by the place of its start: its words, its visible fields, and whether an article or
    a main heading lies in it. An anchor ends where the next one starts."""
    out: dict[int, tuple[int, int, bool]] = {}
    open_: dict[str, list[list[int]]] = {"form": [], "a": []}
    words = fields = heads = 0

    def close(name: str) -> None:
        if open_[name]:
            at, w, f, h = open_[name].pop()
            out[at] = words - w, fields - f, heads > h

    for at, token in enumerate(found):
        name = (token["name"] or "").lower()
        if name in open_:
            if token["close"]:
                close(name)
            else:
                if name == "a":
                    close("a")
                open_[name].append([at, words, fields, heads])
        elif name and not token["close"]:
            heads += name in ("article", "main", "h1")
            fields += name in FIELDS and not HIDDEN.search(token["attrs"])
        elif not name and token[0][0] != "<":
            words += len(token[0].split())
    for name, rest in open_.items():
        for _ in list(rest):
            close(name)
    return out


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(kind, value): ``word``, ``link`` (within an anchor that leads somewhere) and ``side`` (in boilerplate) with the decoded
    text between two tags, ``tag`` with a name (a closing one after a slash), ``mark`` with a comment."""
    every = list(TOKEN.finditer(page))
    held = contents(every)
    depth: list[tuple[str, bool, bool]] = []
    open_names: Counter[str] = Counter()
    side = links = 0

    def leave() -> str:
        nonlocal side, links
        own, bad, link = depth.pop()
        open_names[own] -= 1
        side -= bad
        links -= link
        return own

    for at, found in enumerate(every):
        whole = found[0]
        if whole.startswith("<!--"):
            yield "mark", whole
        elif found["raw"] or found["own"]:
            yield "tag", (found["raw"] or found["own"]).lower()
        elif name := (found["name"] or "").lower():
            if name == "head":
                continue
            yield "tag", found["close"] + name
            if found["close"]:
                if open_names[name] > 0:
                    while leave() != name:
                        pass
            elif name not in VOID and not found["attrs"].rstrip().endswith("/"):
                if name in ("p", "a") and depth and depth[-1][0] == name:
                    leave()
                bad = is_boilerplate(name, found["attrs"])
                inside = open_names["article"] > 0
                if name == "header" and (inside or open_names["main"] > 0) or name == "menu" and inside:
                    bad = False
                words, fields, whole_page = held.get(at, (0, 0, False))
                if name == "form" and fields and not whole_page and words <= WORDS_A_FIELD * (fields + 1):
                    bad = True
                link = name == "a" and bool(HREF.search(found["attrs"])) and words <= MOST_LINK_WORDS and not inside
                side += bad
                links += link
                open_names[name] += 1
                depth.append((name, bad, link))
        elif whole[0] != "<" or whole == "<":
            yield ("side" if side else "link" if links > 0 else "word"), html.unescape(whole)


def without_menus(line: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``line`` with the links of menus as ``side``: of ``MENU_LINKS`` neighbouring blocks or more
    that are links and nothing else; elsewhere links are words. A heading that is a link is none."""
    out, run, block, heading = list(line), [], [], False

    def end_block() -> None:
        nonlocal block, run
        kinds = {line[i][0] for i in block}
        if kinds == {"link"} and not heading:
            run.append(block)
        elif kinds:
            end_run()
        block = []

    def end_run() -> None:
        nonlocal run
        menu = len(run) >= MENU_LINKS
        for i in (i for b in run for i in b):
            out[i] = ("side" if menu else "word", line[i][1])
        run = []

    for i, (kind, value) in enumerate(line):
        if kind == "tag":
            name = value.lstrip("/")
            if name in BLOCKS:
                end_block()
                heading = name in HEADINGS and value == name
        elif value.strip():
            if kind == "side":
                continue
            block.append(i)
    end_block()
    end_run()
    return [("word" if kind == "link" else kind, value) for kind, value in out]


def marked_line(page: str) -> tuple[list[tuple[str, str]], list[bool]]:
    """The tokens of a labelled page, and whether each lies in its main text."""
    line, within, inside = [], False, []
    for kind, value in tokens(page):
        if kind == "mark":
            within = value == "<!--CONTENT-->" or within and value != "<!--/CONTENT-->"
        else:
            line.append((kind, value))
            inside.append(within)
    return without_menus(line), inside


@lru_cache(maxsize=1)
def fitted_weights() -> dict[str, float]:
    """Log odds from the labelled pages: of a word for lying in the main text, and of each tag against it,
    times the factor with which the runs meet the marked texts best (of equal ones that nearest to 1). A word in
    boilerplate weighs as little as the pages have of them within the text: it is left out anyway, and an advert inside an article doesn't end it."""
    inside, outside = Counter(), Counter()
    lines = [marked_line(page) for page in PAGES]
    for line, within in lines:
        for (kind, value), own in zip(line, within, strict=True):
            key = value if kind == "tag" else f"#{kind}"
            (inside if own else outside)[key] += 1 if kind == "tag" else len(value.split())
    odds = {k: math.log1p((outside[k] + 1) / (inside[k] + 1)) for k in inside.keys() | outside.keys() if k[0] != "#"}
    word = math.log1p((inside["#word"] + 1) / (outside["#word"] + 1))
    side = -math.log1p((inside["#side"] + 1) / (outside["#side"] + 1))

    def fit(factor: float) -> tuple[float, dict[str, float]]:
        weights = {k: -factor * v for k, v in odds.items()} | {"#word": word, "#side": side, "#tag": -factor * sum(odds.values()) / len(odds)}
        total = 0.0
        for line, within in lines:
            low, high = best_run(scores_of(line, weights))
            got = Counter(w for kind, v in line[low:high] if kind == "word" for w in v.split())
            want = Counter(w for (kind, v), own in zip(line, within, strict=True) if own and kind == "word" for w in v.split())
            total += 2 * (got & want).total() / max(1, got.total() + want.total())
        return total, weights

    fits = {f: fit(f) for f in FACTORS}
    return fits[max(FACTORS, key=lambda f: (round(fits[f][0], 9), -abs(math.log(f))))][1]


def scores_of(line: list[tuple[str, str]], weights: dict[str, float]) -> list[float]:
    """The score of each token; of line breaks in a row the first one's counts."""
    out, was = [], ""
    for kind, value in line:
        if kind == "tag":
            name = value.lstrip("/")
            out.append(0.0 if name == "br" and was == "br" else weights.get(value, weights["#tag"]))
            was = name
        else:
            out.append(weights[f"#{kind}"] * len(value.split()))
            was = "" if value.strip() else was
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous run with the highest positive sum."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str) -> str:
    line = without_menus([t for t in tokens(page) if t[0] != "mark"])
    low, high = best_run(scores_of(line, fitted_weights()))
    blocks: list[list[str]] = [[]]
    for kind, value in line[low:high]:
        if kind == "word":
            blocks[-1].append(value)
        elif kind == "tag":
            name = value.lstrip("/")
            if name in BLOCKS:
                blocks.append([])
            elif name == "br":
                blocks[-1].append(" ")
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page, from its whole ``html``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, SCHEMA)
