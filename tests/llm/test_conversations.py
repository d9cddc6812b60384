"""The prefix trie against a dictionary of prefixes, and chat formatting against its turns: hot, long, turnless and odd conversations."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowmill.llm import chat, trie

KIND = "conv_id long, turn long, role string, text string, node string"


def expected(rows):
    """Nodes by brute force: every prefix of every rebuilt conversation is a key."""
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members, end = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        turns = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        end[turns].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(end[node]))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]), leaves[node], saved[node], digest(node)) for node, m in members.items())


def nodes(spark, rows, parts=7):
    table = spark.createDataFrame(rows, KIND).repartition(parts)
    conv = F.col("conv_id")
    turns = trie.turn_rows(table)
    again, ids = trie.branched(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, most=8)
    return trie.prefix_trie(again, ids, ["turn"])


def random_rows(seed):
    rng, rows = random.Random(seed), []
    for c in range(120):
        for t in range(rng.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "é", None, "long text"]), "x"))
    rows += [(500 + 5 * k, t, "user", f"same {t}", "x") for k in range(60) for t in range(4)]  # one hot conversation
    rows += [(7, t, "user", f"turn {t}", "x") for t in range(3000)]  # one with most rows
    rows += [(-3, 0, "user", "below zero", "x"), (9001, None, "user", "no number", "x"), (9001, 1, "user", "one", "x"), (None, 1, "user", "nobody's", "x")]
    rows += [(9002, 1, "user", "tie b", "x"), (9002, 1, "user", "tie a", "x"), (9002, 1, "user", "tie a", "x"), (9004, 0, "user", "alone", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_prefixes(spark, seed):
    rows = random_rows(seed)
    random.Random(seed).shuffle(rows)
    found = nodes(spark, rows).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found) == expected(rows)
    assert sorted(r.preorder for r in found) == list(range(len(found)))
    by_place = {r.preorder: r for r in found}
    for r in found:  # intervals nest, and a node's interval begins with itself
        assert all(r.preorder <= by_place[p].preorder and by_place[p].subtree_end <= r.subtree_end for p in (r.preorder, r.subtree_end - 1))


def test_trie_of_nothing(spark):
    assert nodes(spark, []).collect() == []
    assert nodes(spark, [(None, 1, "user", "nobody's", "x")]).collect() == []


def canonical(spark, rows, layouts=None):
    table = spark.createDataFrame(rows, "conv_id long, json string, layout string").select("conv_id", F.parse_json("json").alias("record"), "layout")
    return chat.canonical_turns(table.repartition(5))


def turns_of(df):
    found = defaultdict(list)
    for r in df.orderBy("conv_id", *chat.ORDER[:-1], "role", "text").collect():
        found[r.conv_id].append((r.layout, r.role, r.text))
    return dict(found)


ODD = ["<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", r"<\\|<||<|<|n|>", "a\nb<|n|>\n", "", "<", "|", "\\", "é<|🙂|>", "<" * 30 + "|" * 30]


def test_layouts_by_fingerprint(spark):
    rows = [
        (1, json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}], "id": 9}), "x"),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}), "x"),
        (3, json.dumps({"prompt": "p", "completion": "c"}), "x"),
        (4, json.dumps({"system": "s", "prompt": "p", "response": None}), "x"),
        (5, json.dumps({"instruction": "i", "input": "more", "output": "o"}), "x"),
        (6, json.dumps({"instruction": "i", "input": "", "output": "o"}), "x"),
        (7, json.dumps({"question": "q", "answer": 4}), "x"),
        (8, json.dumps({"role": "user", "text": "second", "turn": 2}), "x"),
        (8, json.dumps({"role": "user", "text": "first", "turn": None}), "x"),
        (8, json.dumps({"role": None, "text": None, "turn": 3}), "x"),
        (9, json.dumps({"messages": [], "source": "web"}), "x"),
        (10, json.dumps({"prompt": "p", "messages": [{"role": "user", "content": "u"}]}), "x"),
        (11, "[1, 2]", "x"),
        (12, None, "x"),
    ]
    found = turns_of(canonical(spark, rows))
    assert found == {
        1: [("messages", "system", "s"), ("messages", "user", "")],
        2: [("shares", "user", "q"), ("shares", "assistant", "a"), ("shares", "tool", "t")],
        3: [("completion", "user", "p"), ("completion", "assistant", "c")],
        4: [("response", "system", "s"), ("response", "user", "p"), ("response", "assistant", "")],
        5: [("instruction", "user", "i\n\nmore"), ("instruction", "assistant", "o")],
        6: [("instruction", "user", "i"), ("instruction", "assistant", "o")],
        7: [("question", "user", "q"), ("question", "assistant", "4")],
        8: [("turn row", "user", "first"), ("turn row", "user", "second"), ("turn row", "", "")],
        9: [("messages", None, None)],
        **{k: [(None, None, None)] for k in (10, 11, 12)},
    }
    report = {r.paths: r.n for r in chat.layout_report(spark.createDataFrame(rows, "conv_id long, json string, x string").select(F.parse_json("json").alias("record"))).collect()}
    assert report["completion\nprompt"] == 1 and report[""] == 2 and report["role\ntext\nturn"] == 3


def test_formats_are_read_back(spark):
    rng = random.Random(3)
    convs = {c: [(rng.choice(["user", "assistant", "odd\nrole", "<|im_end|>", ""]), rng.choice(ODD) + rng.choice(ODD)) for _ in range(rng.randint(1, 12))] for c in range(60)}
    convs[99] = [("assistant", "w" * 70_000 + "<|im_end|>"), ("user", "é" * 50_000)]
    convs[100] = [("assistant", f"turn {i}") for i in range(3000)]
    rows = [(c, json.dumps({"role": role, "text": text, "turn": i}), "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    stored = chat.store_chat(canonical(spark, rows))
    back = defaultdict(list)
    for r in chat.read_back(stored).orderBy("conv_id", "place").collect():
        back[r.conv_id].append((r.role, r.text))
        assert r.piece.count("<|im_start|>") == r.piece.count("<|im_end|>") == 1
        assert r.loss == (r.text if r.role == "assistant" else "")
    assert dict(back) == convs
    for r in chat.conversation_digests(stored).collect():
        turns = convs[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_repeated_records_keep_their_turns_together(spark):
    record = json.dumps({"prompt": "p", "completion": "c"})
    stored = chat.store_chat(canonical(spark, [(1, record, "x"), (1, record, "x"), (None, record, "x")]))
    found = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.conversation_digests(stored).collect()}
    once = "user\np\nassistant\nc\n"
    assert found == {1: (4, hashlib.sha256((once * 2).encode()).hexdigest()), None: (2, hashlib.sha256(once.encode()).hexdigest())}
    assert chat.conversation_digests(chat.store_chat(canonical(spark, []))).collect() == []
