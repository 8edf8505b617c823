"""Chat formatting with spans found by rendering prefixes of a conversation.

The renderer is a black box: a function from a list of messages to a string. Each
turn is located by rendering the turns before it and then those with it; what the
second output adds is the turn's piece. A second rendering, with one placeholder
character as the turn's text, tells where in the piece the text lies. If the first
output is not a prefix of the second, the template rewrites history and the turn is
flagged (its piece is then what follows the common prefix).

Each turn is rendered after all turns before it, and what that gave is kept for the
next one; so a turn costs two renderings, and a conversation the square of its length.
A renderer that has an attribute ``remembers`` declares that its output for a turn
depends on so many turns before it alone; it sees no more than those, with the same
result, and the work is linear.

Rows are dealt out by ``conv_id`` and stream through sorted by turn: a task holds
the turns that the renderer remembers, for one that declares nothing those of a whole
conversation and its text.

Defined cases: a null text is empty; a null or unknown role gets a marker of its
own that carries the role's name (null: empty); rows of a conversation with equal
turns are ordered by role and text, and repeated rows are turns of their own; a
null turn comes first; rows with a null ``conv_id`` form one conversation; a very long text or
conversation is rendered whole, in one task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import stored

Message = dict[str, str]
Renderer = Callable[[list[Message]], str]

#: The template's control strings.
BEGIN, CONTEXT = "<s>", 4
MARKERS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
    "system": ("<<SYS>> ", " <</SYS>>"),
}
OTHER = ("<<ROLE ", ">> ", " <</ROLE>>")
CONTROL = re.compile(r"\\|(?:<|\[)(?=/?(?:s>|INST\]|<SYS>>|</SYS>>|<ROLE|</ROLE>>))")
PLACEHOLDER = "\ue000"


def escape(text: str) -> str:
    r"""Break up control strings with a backslash after their first character; a
    backslash of the text is doubled."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: m[0][1:], text)


def render(messages: list[Message]) -> str:
    """The template: a begin mark, then each turn between its role's markers."""
    out = [BEGIN]
    for m in messages:
        if m["role"] in MARKERS:
            head, tail = MARKERS[m["role"]]
        else:
            head, tail = OTHER[0] + escape(m["role"]).replace(">", "\\>") + OTHER[1], OTHER[2]
        out += head, escape(m["text"]), tail
    return "".join(out)


render.remembers = CONTEXT


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(before: list[Message], turn: Message, renderer: Renderer, old: str | None = None) -> tuple[str, int, int, bool, str]:
    """(piece, start of the text in it, stop, rewrites history, the whole output) of one
    turn; ``old`` is the output for ``before`` where it is known."""
    old, new = renderer(before) if old is None else old, renderer([*before, turn])
    rewrites = not new.startswith(old)
    cut = common_prefix(old, new) if rewrites else len(old)
    probe = renderer([*before, turn | {"text": PLACEHOLDER}])
    at = probe.rfind(PLACEHOLDER)
    tail = len(probe) - at - 1
    start = max(at, cut) if at >= 0 else len(new)
    stop = max(start, len(new) - tail) if at >= 0 else len(new)
    return new[cut:], start - cut, stop - cut, rewrites, new


PIECES = (
    "conv_id long, n long, role string, piece string, start long, text_start long, text_stop long, "
    "in_loss boolean, rewrites_history boolean"
)
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def format_conversations(
    conversations: DataFrame, renderer: Renderer = render, loss_role: str = "assistant", context: int | None = None
) -> DataFrame:
    """One row a turn, in order within its partition: the piece of formatted text, its
    place in the conversation's text, the span of the turn's own text in the piece,
    whether that span is under the loss mask, and whether the template rewrote history.
    ``context`` is how many turns the renderer remembers: by default what it declares,
    all where it declares nothing. The declaration is checked: at the end of each conversation the whole
    of it is rendered once, and output that differs from the pieces is an error."""
    context = getattr(renderer, "remembers", None) if context is None else context
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, number, place, first, old = None, [], 0, 0, True, None
        every: list[Message] = []
        told = hashlib.sha256()
        rewritten = False

        def check() -> None:
            """A renderer that sees a few turns alone has to write the whole conversation as it wrote the pieces."""
            if context is not None and len(every) > context and not rewritten:
                if hashlib.sha256(renderer(every).encode("utf-8", "surrogatepass")).digest() != told.digest():
                    raise ValueError(f"the renderer remembers more than the {context} turns that it declares: conversation {conv}")

        for batch in batches:
            rows = []
            for own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or own != conv:
                    check()
                    conv, before, number, place, first, old = own, [], 0, 0, False, None
                    every, told, rewritten = [], hashlib.sha256(), False
                turn = {"role": role or "", "text": text or ""}
                piece, start, stop, rewrites, new = locate(before, turn, renderer, old)
                if not number:
                    opening = renderer([])
                    if not rewrites:
                        piece, start, stop = opening + piece, start + len(opening), stop + len(opening)
                rows.append((own, number, turn["role"], piece, place, start, stop, turn["role"] == loss_role, rewrites))
                if context is not None:
                    every.append(turn)
                    told.update(piece.encode("utf-8", "surrogatepass"))
                    rewritten |= rewrites
                before.append(turn)
                if context is None or len(before) <= context:
                    old = new
                else:
                    old = None
                    before = before[len(before) - context :]
                number, place = number + 1, place + len(piece)
            yield pa.RecordBatch.from_pylist([dict(zip(PIECE_NAMES, r, strict=True)) for r in rows], schema=PIECE_SCHEMA)
        check()

    return (
        conversations.selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text")
        .repartition(n, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, PIECES)
    )


PIECE_SCHEMA = pa.schema(
    {
        "conv_id": pa.int64(), "n": pa.int64(), "role": pa.string(), "piece": pa.string(), "start": pa.int64(),
        "text_start": pa.int64(), "text_stop": pa.int64(), "in_loss": pa.bool_(), "rewrites_history": pa.bool_(),
    }
)


def _pattern() -> re.Pattern:
    known = [f"{re.escape(h)}(?P<{r}>.*){re.escape(t)}" for r, (h, t) in MARKERS.items()]
    other = rf"{re.escape(OTHER[0])}(?P<name>(?:\\.|[^>\\])*){re.escape(OTHER[1])}(?P<other>.*){re.escape(OTHER[2])}"
    return re.compile("|".join([known[0], known[2], other, known[1]]), re.S)


PIECE = _pattern()


def parse_piece(piece: str, first: bool) -> Message:
    """The role and text that a piece of the own template says, escapes undone."""
    body = piece[len(BEGIN) :] if first else piece
    found = PIECE.fullmatch(body)
    if not found:
        raise ValueError("a piece that the template did not write")
    if found["other"] is not None:
        return {"role": unescape(found["name"].replace("\\>", ">")), "text": unescape(found["other"])}
    role = next(r for r in MARKERS if found[r] is not None)
    return {"role": role, "text": unescape(found[role])}


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "rewrites_history boolean"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from what ``format_conversations``
    wrote alone: turns by parsing the pieces, the loss text by the mask's spans.
    The pieces are stored first, and each conversation's are brought together again."""
    pieces = stored(pieces, "pieces").repartition("conv_id").sortWithinPartitions("conv_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> tuple:
            turns, all_text, chars, loss, formatted, rewrites = state
            return conv, turns, all_text.hexdigest(), chars, loss.hexdigest(), formatted, rewrites

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["n"] == 0:
                    if state:
                        out.append(row())
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                piece = r["piece"]
                turn = parse_piece(piece, r["n"] == 0)
                state[0] += 1
                state[1].update(f"{turn['role']}\n{turn['text']}\n".encode("utf-8", "surrogatepass"))
                if r["in_loss"]:
                    text = unescape(piece[r["text_start"] : r["text_stop"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
                state[5] |= r["rewrites_history"]
            yield digest_batch(out)
        if state:
            yield digest_batch([row()])

    return pieces.mapInArrow(run, DIGESTS)


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")]
    )
