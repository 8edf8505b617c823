"""Templates that look back further than a few turns."""

import pytest

from corpusmill.llm.chatformat import format_conversations, read_back

TURNS = "conv_id long, turn long, role string, text string"


def conversation(spark, n):
    return spark.createDataFrame([(1, i, "ab"[i % 2], f"text {i}") for i in range(n)], TURNS)


def test_rewrites_of_the_first_turn_at_the_ninth_are_found(spark):
    def forgetting(messages):
        return "".join(f"<{m['role']}>" + ("" if i == 0 and len(messages) > 8 else m["text"]) for i, m in enumerate(messages))

    rows = format_conversations(conversation(spark, 10), forgetting).orderBy("n").collect()
    assert [r.n for r in rows if r.rewrites_history] == [8]


def test_numbers_of_turns_and_strict_roles_see_the_start(spark):
    def numbered(messages):
        assert all(m["role"] == "ab"[i % 2] for i, m in enumerate(messages))
        return "^" + "".join(f"<{i}>{m['text']}</>" for i, m in enumerate(messages))

    rows = format_conversations(conversation(spark, 12), numbered).orderBy("n").collect()
    assert "".join(r.piece for r in rows) == "^" + "".join(f"<{i}>text {i}</>" for i in range(12))
    assert [r.piece[r.text_start : r.text_stop] for r in rows] == [f"text {i}" for i in range(12)]
    assert not any(r.rewrites_history for r in rows) and [r.start for r in rows] == [sum(len(x.piece) for x in rows[:i]) for i in range(12)]


def test_a_declared_memory_gives_the_same(spark):
    def plain(messages):
        return "^" + "".join(f"<{m['role']}>{m['text']}" for m in messages)

    frame = conversation(spark, 9)
    whole = format_conversations(frame, plain).orderBy("n").collect()
    for n in (0, 1, 4):
        plain.remembers = n
        assert format_conversations(frame, plain).orderBy("n").collect() == whole


def test_a_false_declaration_is_an_error(spark):
    """A template that says it remembers four turns and rewrites the first one at the eighth."""

    def forgetful(messages):
        return ("[late]" if len(messages) > 8 else "") + "".join(f"<{m['role']}>{m['text']}</>" for m in messages)

    forgetful.remembers = 4
    rows = [(1, i, "user", f"t{i}") for i in range(10)] + [(2, i, "user", "x") for i in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="remembers more than the 4 turns"):
        format_conversations(frame, forgetful).collect()
    assert format_conversations(frame.where("conv_id = 2"), forgetful).count() == 3


def test_pieces_are_stored_before_they_are_read(spark):
    rows = [(c, i, ["user", "assistant"][i % 2], f"say {c} {i} </s>") for c in range(20) for i in range(9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    digests = read_back(format_conversations(frame))
    assert digests.inputFiles() and {r.conv_id: r.n_turns for r in digests.collect()} == dict.fromkeys(range(20), 9)
