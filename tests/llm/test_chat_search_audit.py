"""Operators 11 to 13 against brute force written from their definitions."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from cellweave.llm import audit, chat, lexical

DOCS = "doc_id long, text string, lang string"


def test_escape_is_reversible():
    hard = ["", "\\", "\\\\", "</turn>", "\\</turn>", "<turn assistant>", "a>b", "<turn", "<turn <turn ", "</turn>\n", "\\n", "end\\", "\x00\ud7ff\u2028", r"\### Assistant: </turn> ok"]
    rng = random.Random(1)
    hard += ["".join(rng.choice(["\\", "<", "/", "turn", " ", ">", "\n", "x", "</turn>", "<turn "]) for _ in range(12)) for _ in range(400)]
    for role in hard:
        for text in rng.sample(hard, 8):
            piece, a, b = chat.format_turn(role, text)
            assert chat.parse_turn(piece) == (role, text)
            assert chat.unescape(piece[a:b]) == text
    for bad in ("", "<turn user>x", "<turn user>x</turn>", "<turn user>a</turn>\nb</turn>\n", "x<turn user>a</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse_turn(bad)


TURNS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "</turn>"), (1, 2, "assistant", "<turn user>no"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
    (2, 0, "user", "no answer"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b"), (None, 0, "assistant", "who"), (4, None, None, "x"), (4, 0, "assistant", "\u00e9" * 70_000),
]


def brute_turns(rows):
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {k: [(r, t) for _, r, t in sorted(v)] for k, v in of.items()}


def test_digests_read_back(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as piece", "1 as pos")
    folder, manifest = chat.write_examples(frame)
    got = {r.conv_id: r for r in chat.conversation_digests(spark, folder, manifest).collect()}
    want = brute_turns(TURNS)
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.format_turn(r, t)[0]) for r, t in turns)
        assert got[conv].n_examples == sum(r == "assistant" for r, _ in turns)


def test_examples_are_prefixes_with_one_target(spark):
    folder, manifest = chat.write_examples(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.example): r for r in chat.example_texts(spark, folder, manifest).collect()}
    n = 0
    for conv, turns in brute_turns(TURNS).items():
        targets = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        for k, i in enumerate(targets):
            row = got[conv, k]
            assert row.text == "".join(chat.format_turn(*t)[0] for t in turns[: i + 1])
            assert chat.unescape(row.text[row.loss_start : row.loss_end]) == turns[i][1]
            assert row.n_context == i
            n += 1
    assert n == len(got)


def test_an_example_is_whole_in_its_row(spark):
    """What is written for an assistant turn holds all turns before it; no other row is needed to train on it."""
    folder, _ = chat.write_examples(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    stored = {(r.conv_id, r.pos): r for r in spark.read.parquet(f"{folder}/files").collect()}
    for conv, turns in brute_turns(TURNS).items():
        for i, (role, text) in enumerate(turns):
            row = stored[conv, i]
            assert row.context == ("".join(chat.format_turn(*t)[0] for t in turns[:i]) if role == "assistant" else None)
            if role == "assistant":
                assert chat.unescape((row.context + row.piece)[row.loss_start : row.loss_end]) == text


def test_one_conversation_over_many_batches(spark):
    """A conversation longer than every batch keeps its order; what a later example stores is its own turn only."""
    rows = spark.range(5000).selectExpr("9 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text").repartition(7)
    folder, manifest = chat.write_examples(rows)
    assert manifest.count() == 1
    (row,) = chat.conversation_digests(spark, folder, manifest).collect()
    assert row.n_turns == 5000 and row.n_examples == 2500
    assert row.loss_sha256 == hashlib.sha256("".join(f"turn {i}" for i in range(1, 5000, 2)).encode()).hexdigest()
    assert spark.read.parquet(f"{folder}/files").selectExpr("sum(length(piece))").head()[0] == row.formatted_chars


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs if d is not None]
    terms = [x for x in terms if x[1]]
    n_docs, all_terms = len(terms), sum(len(x[1]) for x in terms)
    df = {}
    for _, ws in terms:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, ts in asked.items():
        found = []
        for d, ws in terms:
            m = 50 + (50 * len(ws) * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * ws.count(t)) // (1000 * ws.count(t) + 20 * m)) for t in ts if t in df)
            if score > 0:
                found.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_varbytes():
    for values in ([], [0], [0, 127, 128, 16383, 16384, 2**31, 2**62], list(range(3000))):
        data, lengths = lexical.varbytes(np.array(values, np.int64))
        assert lexical.from_varbytes(data.tobytes()).tolist() == values
        assert lengths.sum() == len(data)


@pytest.mark.parametrize("shard_docs,window", [(1 << 16, 1 << 14), (7, 3)])
def test_search_against_brute_force(spark, monkeypatch, shard_docs, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["\u00c9t\u00e9", "\u00e9t\u00e9", "MiXed", "x\u3000y", "a-b", "\u00d6l"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "W1 w1\x00w1\nw2"), (3, "w1 w2 w3"), (None, "w1"), (204, "w5 " * 5000), (205, docs[7][1]), (206, docs[7][1])]
    items = [(0, "w1 W2 w2 etwas"), (1, " ".join(words)), (2, None), (3, "nothing here"), (4, "\u00e9t\u00e9 \u00c9T\u00c9"), (4, "x\u3000y"), (None, "w1"), (5, "MIXED, a b")]
    want = brute_search(docs, items, 10)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as shard", "'x' as term").repartition(5)
    index = lexical.LexicalIndex.build(frame)
    if shard_docs < 100:  # the constant does not reach Python workers: shards are as small through a small table's partitions
        index = lexical.LexicalIndex.build(frame.repartition(40))
    got = lexical.LexicalIndex(spark, index.folder).search(spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(map(tuple, got.collect())) == want


def test_windows_and_full_shards_inside_one_process(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 4)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 50)
    rng = random.Random(3)
    docs = [(1000 - i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))) for i in range(50)]
    shard = lexical.ShardBuilder(0)
    for d, t in docs:
        shard.add(d, t.encode())
    assert shard.full()
    rows = [r for batch in shard.rows(3) for r in batch.to_pylist()]
    held = lexical.Postings(rows[0]["places"], rows[0]["counts"], 50, rows[0]["total"])
    held.packed = {r["term"]: (r["places"], r["counts"]) for r in rows[1:]}
    df = {r["term"].decode(): r["docs"] for r in rows[1:]}
    for k in (1, 5, 60):
        weights = [math.floor(1000 * math.log(102 / (2 * df[t] + 1))) for t in "abc"]
        got = [(int(held.docs[p]), s) for s, p in held.top([b"a", b"b", b"c", b"zz"], [*weights, 9], k)]
        assert got == [(d, s) for _, _, d, s in brute_search(docs, [(0, "a b c")], k)]


def brute_audit(docs, labels, letters="ABCDE"):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    texts = {}
    for d, t, _ in docs:
        if d is not None:
            texts[t or ""] = min(d, texts.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and texts[t] < d}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, steps, shapley = [r for r in rows if r[0] == part], [], dict.fromkeys(letters, 0)
        for order in permutations(letters):
            live = own
            for i, f in enumerate(order):
                gone = [r for r in live if f in r[1]]
                live = [r for r in live if f not in r[1]]
                shapley[f] += len(gone)
                fails = sum(f in r[1] for r in own)
                steps.append((part, "".join(order), i + 1, len(live), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_against_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long, "de"), (0, "same", "fr"), (9, "same", None), (9, "same", None), (5, None, "en"), (6, "", ""), (7, "A" * 40, "en"), (8, "x " * 300, "en"), (10, long + " #", "en"),
        (11, "\u00e9\u3000A " * 220, "de"), (None, long, "en"), (None, "same", "fr"), (12, long + " | same", "de"), (12, long + " | same", "de"), (13, long + " B" * 3 + "C" * 90, "en"), (14, "\x1c\x85\xa0" * 10, "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (9, 1, 1), (12, 1, None), (13, None, 1), (None, 1, 1), (99, 1, 1)]
    frames = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as part", "1 as mask", "7 as n"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as good")
    got = audit.audit_orders(audit.failure_cells(*frames))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in audit.adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == 1 + sum(1 for _ in audit.adjacent_swaps(n))


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 2, 1), ("p", 2, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = sorted(map(tuple, audit.audit_orders(cells, "XY").collect()))
    assert got == [("p", "XY", 1, 9, 2, 0, 0, 2, 1, 2), ("p", "XY", 2, 5, 4, 2, 4, 0, 0, 10), ("p", "YX", 1, 5, 6, 0, 4, 2, 1, 10), ("p", "YX", 2, 5, 0, 2, 0, 0, 0, 2)]
    with pytest.raises(ValueError):
        audit.audit_orders(cells, "ABCDEFGHI")
