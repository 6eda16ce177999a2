from cladeframe.llm import quotes as Q

MESSAGES = [
    (1, 0, "user", "Hello there my friends.\nHow are you doing today?"),
    (1, 1, "assistant", "> Hello there my friends.\n\nFine thanks, really good. And the weather is fine."),
    (1, 2, "user", "On Monday, X wrote:\n> > Hello there my friends.\n> Fine thanks, really good.\nGreat to hear that from you."),
    (1, 3, "user", "> How are you doing\n> today?\nI meant this."),
    (2, 0, "user", "> Great to hear that from you.\nAnother thread."),
    (2, 1, "assistant", None),
    (3, 0, "user", ""),
    (3, 0, "user", ""),
    (None, None, None, None),
    (4, 5, "user", "> Nobody ever wrote this passage.\nHello there my friends."),
]


def test_links_and_order(spark):
    df = spark.createDataFrame([(*m, 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, depth int")
    rows = Q.conversations(df).collect()
    assert len(rows) == len(MESSAGES)
    at = {(r.conv_id, r.turn): r for r in rows}
    link = lambda c, t: (at[c, t].how, at[c, t].parent_conv, at[c, t].parent_turn)
    assert link(1, 1) == ("quote", 1, 0) and link(1, 2) == ("quote", 1, 1) and link(1, 3) == ("quote", 1, 0)
    assert link(2, 0) == ("quote", 1, 2) and link(2, 1) == ("turn", 2, 0) and link(4, 5) == ("first", None, None)
    assert at[1, 2].body == "Great to hear that from you." and at[1, 2].n_quotes == 2
    thread = sorted((r for r in rows if (r.thread_conv, r.thread_turn) == (1, 0)), key=lambda r: r.position)
    assert [r.position for r in thread] == list(range(6)) and at[2, 1].depth == 4
    seen = set()
    for r in thread:
        assert r.how == "first" or (r.parent_conv, r.parent_turn) in seen
        seen.add((r.conv_id, r.turn))


def test_empty_and_long(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    assert Q.conversations(df.limit(0)).count() == 0
    deep = [(9, i, "user", f"> message number {i - 1} of this talk\nmessage number {i} of this talk") for i in range(70)]
    rows = Q.conversations(spark.createDataFrame(deep, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.depth for r in rows) == list(range(70))


def test_short_quotations_link_within_their_conversation(spark):
    told = [
        (1, 0, "user", "Yes."),
        (1, 1, "assistant", "我们明天见面吧。"),
        (1, 2, "user", "Something else altogether."),
        (1, 3, "assistant", "> Yes.\nGood."),
        (1, 4, "user", "> 我们明天见面吧。\nAt noon."),
        (2, 0, "user", "Another start."),
        (2, 1, "assistant", "> Yes.\nNobody here said so."),
        (2, 2, "user", "Agreed"),
        (2, 3, "assistant", "> Something else altogether. Agreed\nThe long passage decides."),
    ]
    rows = Q.conversations(spark.createDataFrame(told, "conv_id long, turn long, role string, text string")).collect()
    link = {(r.conv_id, r.turn): (r.how, r.parent_conv, r.parent_turn) for r in rows}
    assert link[1, 3] == ("quote", 1, 0) and link[1, 4] == ("quote", 1, 1)
    assert link[2, 1] == ("turn", 2, 0) and link[2, 3] == ("quote", 1, 2)
