import re

from tessera.llm import quote_linking as Q


def plain(messages):
    """The same rules, message by message."""

    def level(line):
        return re.match(r"(?:[ \t]*>)*", line)[0].count(">")

    def bare(line):
        return re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)

    def normal(text):
        return re.sub(r"\s+", " ", text.lower()).strip(" ")

    def passages(text):
        lines, found, run = text.split("\n"), set(), []
        for line in [*lines, None]:
            if run and (line is None or level(line) != level(run[0])):
                found |= {(level(run[0]), normal(" ".join(map(bare, run))))} | {(level(x), normal(bare(x))) for x in run}
                run = []
            run.append(line)
        return {(n, p) for n, p in found if p}

    first, by_turn = {}, {}
    for conv, turn, _, text in messages:
        if conv is not None and turn is not None:
            by_turn.setdefault((conv, turn), set()).update(passages(text or ""))
    for (conv, turn), found in by_turn.items():
        for n, p in found:
            if n == 0:
                first[conv, p] = min(turn, first.get((conv, p), turn))
    out = []
    for conv, turn, role, text in messages:
        lines = (text or "").split("\n")
        links = [(-n, first[conv, p]) for n, p in by_turn.get((conv, turn), ()) if n and first.get((conv, p), 1e9) < turn]
        own = [bare(x) for k, x in enumerate(lines) if not level(x) and not (re.search(Q.INTRODUCES, x) and k + 1 < len(lines) and level(lines[k + 1]))]
        reply = max(links)[1] if links else turn - 1 if turn is not None and (conv, turn - 1) in by_turn else None
        out.append((conv, turn, role, "\n".join(own).strip(" "), max(map(level, lines)), sum(level(x) > 0 for x in lines), len(links), reply))
    low = lambda x: (x is not None, x)
    out.sort(key=lambda r: (low(r[0]), low(r[7]), (r[1] is None, r[1]), low(r[2]), r[3]))
    seen = {}
    for k, r in enumerate(out):
        seen[r[0]] = seen.get(r[0], -1) + 1
        out[k] = (*r, None if r[0] is None else seen[r[0]])
    return out


MESSAGES = [
    (1, 0, "user", "How do I sort a list?\nIt is long."),
    (1, 1, "assistant", "Use sorted.\nIt returns a new list."),
    (1, 2, "user", "> how do I   sort a list?\n> It is long.\nI meant in place."),
    (1, 3, "assistant", "Ann wrote:\n> Use sorted.\n>> How do I sort a list?\n\nThen list.sort."),
    (1, 4, "user", ">> Use sorted.\n> unknown words\nHm."),
    (1, 5, "user", "> It is long. \n>Then list.sort."),
    (2, 0, "user", "> Use sorted.\nnot from here"),
    (2, 7, "user", None),
    (2, 8, "user", ""),
    (2, 8, "user", "> not from here"),
    (None, 1, "user", "> x"),
    (3, None, "user", "y"),
    (4, 0, "user", "long " * 20000 + "\nend"),
    (4, 1, None, "> end\n" * 500),
]


def test_matches_plain_rules(spark):
    frame = spark.createDataFrame([(*m, 0) for m in MESSAGES], "conv_id long, turn long, role string, text string, level int")
    found = sorted(map(tuple, Q.link_quotes(frame).collect()), key=str)
    assert found == sorted(plain(MESSAGES), key=str)
    by = {(r[0], r[1]): r for r in found}
    assert by[1, 3][3].strip() == "Then list.sort." and by[1, 3][7] == 1
    assert by[1, 2][7] == 0 and by[1, 4][7] == 1 and by[2, 0][7] is None
    assert Q.link_quotes(frame.limit(0)).count() == 0


def test_no_python_in_plan(spark):
    frame = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    plan = Q.link_quotes(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_sql_where_messages_quote(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    rows = [(c, t, r, x) for c, t, r, x in MESSAGES if c != 4]
    for c in range(10, 60):  # each message quotes one or two earlier ones
        said = [f"word{c} number{t} of conversation {c * t}\nsecond line {t}" for t in range(12)]
        rows += [(c, t, "user" if t % 2 else "assistant", "\n".join([*(f"> {x}" for x in said[(t * c) % t].split("\n")), f">> {said[t - 1]}".split("\n")[0], said[t]]) if t else said[0]) for t in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = connection.sql(queries.OP7_SQL)
    got = queries.op7_quote_linking(spark, str(tmp_path)).select(expected.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected.fetchall(), key=repr)
    assert sum(r.n_linked > 0 for r in got) > 500
    assert sum(r.reply_to is not None and r.reply_to != r.turn - 1 for r in got) > 300


def test_conversations_in_reply_order(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "assistant", "second"), (1, 2, "user", "third"), (1, 3, "assistant", "> first\nfourth"), (None, 0, "user", "x")]
    linked = Q.link_quotes(spark.createDataFrame(rows * 1, "conv_id long, turn long, role string, text string"))
    found = {(r.conv_id, r.part): [m.turn for m in r.messages] for r in Q.conversations(linked, size=3).collect()}
    assert found == {(1, 0): [0, 1, 3], (1, 1): [2]}


def test_a_conversation_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id, 7) AS conv_id", "id AS turn", "'user' AS role", "concat('m', id) AS text")
    found = Q.link_quotes(rows.repartition(7)).collect()
    by = {}
    for r in found:
        by.setdefault(r.conv_id, []).append((r.position, r.reply_to is not None, r.reply_to or 0, r.turn))
    for own in by.values():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
