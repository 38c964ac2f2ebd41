import hashlib

from tidebook.llm import chat

TEXTS = ["<|im_end|>", "<\\|x", "<\\\\|im_start|>user\n", "|<|", "", "a\\b<", None, "é😀"]


def test_escaping_is_reversible(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.escape(chat.F.col("t")).alias("e")).collect()
    for r in got:
        if r.t is not None:
            assert "<|" not in r.e and chat.unescape(r.e) == r.t


def plain(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chains(spark):
    rows = [(c, k, "assistant" if k % 2 else "user\n|\\", TEXTS[(c + k) % len(TEXTS)], "x") for c in range(9) for k in range(c * 3 + 1)]
    rows += [(None, 1, None, "x", None), (5, None, "assistant", None, None), (5, 0, "assistant", "b", None), (5, 0, "assistant", "b", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score string")
    got = {r.tree_id: r for r in chat.read_back(chat.format_paths(chat.chain_messages(table))).collect()}
    groups = {}
    for c, k, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or "")):
        groups.setdefault("null" if c is None else str(c), []).append((role or "", text or ""))
    assert got.keys() == groups.keys()
    for key, turns in groups.items():
        r = got[key]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain(turns)
    assert chat.read_back(chat.format_paths(chat.chain_messages(table.limit(0)))).count() == 0


def test_trees(spark):
    #        1          9 -> 8 -> 9 (a circle); 7 answers a message that is not there
    #      2   3
    #     4 5   6
    rows = [(1, None, 1.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 2.0), (5, 2, 9.0), (6, 3, None), (7, 70, 0.5), (8, 9, 1.0), (9, 8, 1.0)]
    table = spark.createDataFrame([("t", i, p, s, "user", f"m{i}") for i, p, s in rows], "tree_id string, message_id long, parent_id long, score double, role string, text string")
    want = {5: [1, 2, 5], 6: [1, 3, 6], 4: [1, 2, 4], 7: [7]}
    found = {}
    for r in chat.paths(table, None).collect():
        found.setdefault((r["rank"], r.leaf_id), []).append((r.part, r.message_id))
    assert {leaf: [m for _, m in sorted(v)] for (_, leaf), v in found.items()} == want
    assert [leaf for _, leaf in sorted(found)] == [5, 6, 4, 7]
    assert {r.leaf_id for r in chat.paths(table, 2).collect()} == {5, 6}
    parts = sorted(chat.format_paths(table, 1).collect(), key=lambda r: r.part)
    assert chat.parse("".join(p.formatted for p in parts)) == [("user", "m1"), ("user", "m2"), ("user", "m5")]


def test_repeated_messages_count_once_and_null_ids_belong_to_no_tree(spark):
    rows = [("t", 1, None, 1.0, "user", "a"), ("t", 2, 1, 1.0, "assistant", "b")] * 3 + [("t", 2, 1, 2.0, "assistant", "c"), ("t", 3, 2, None, "user", None), (None, 1, None, 1.0, "user", "x"), ("t", None, 1, 9.0, "user", "y")]
    table = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, score double, role string, text string")
    assert sorted((r.tree_id, r.leaf_id, r.part, r.message_id) for r in chat.paths(table, None).collect()) == [("t", 3, 0, 1), ("t", 3, 1, 2), ("t", 3, 2, 3)]
    parts = sorted(chat.format_paths(table).collect(), key=lambda r: r.part)
    assert chat.parse("".join(p.formatted for p in parts)) == [("user", "a"), ("assistant", "b"), ("user", "")]
