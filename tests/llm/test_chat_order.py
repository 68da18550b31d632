import hashlib

from lexmill.llm.chat_format import format_turns, read_back


def test_equal_turns_go_by_role_and_text_before_escaping(spark):
    rows = [(1, 0, "user", t) for t in ("<|x", "<}x", "<{x", "a", "a!", "a<", "")] + [(1, 0, "<|r", "z"), (1, 0, "<}r", "y"), (1, None, None, None), (1, 0, "<\\|r", "q")]
    found = read_back(format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))).first()
    ordered = sorted(rows, key=lambda r: (r[1] is not None, (r[2] or "").encode(), (r[3] or "").encode()))
    want = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in ordered).encode()).hexdigest()
    assert (found.n_turns, found.turns_sha256) == (len(rows), want)
