"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from netquarry.llm import turntrie


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(convs):
    """convs: {conv_id: list of (role, text)}"""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(turns[d - 1])
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, who in members.items()), key=repr)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2] if t[0] else (False, 0))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def rows(seed, n=260):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(rng.randint(1, 7)):
            out.append((c, turn, rng.choice(["user", None, "system"]), rng.choice(["hi", "", None, "é🙂 text", "long " * 30])))
    for c in range(1000, 1160):  # copies of one conversation, far more than a range holds
        out += [(c, t, "user", "same") for t in range(8)]
    out += [(3000, None, "system", "first of all"), (3000, 0, "user", "x"), (None, 1, "user", "nobody"), (3100, 5, None, None)]
    out += [(4000, t, "user", f"{t}") for t in range(700)] + [(4001, t, "user", f"{t}") for t in range(650)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_nodes_equal_brute_force_over_many_ranges(spark, monkeypatch, parts):
    monkeypatch.setattr(turntrie, "RUN", 23)
    monkeypatch.setattr(turntrie, "ENDS", 5)
    monkeypatch.setattr(turntrie, "RANGE", 1 << 30)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        data = rows(parts)
        frame = spark.createDataFrame([(*r, "clash", 1) for r in data], "conv_id long, turn long, role string, text string, turns string, depth int").repartition(5)
        found = turntrie.trie(turntrie.rebuilt(turntrie.conversations(frame, "conv_id", "turn", "role", "text")))
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(plain_rebuilt(data))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_turns_turnless_conversations_and_no_rows(spark):
    data = [(7, 1, "user", "a"), (7, 1, "user", "a"), (107, 0, "user", "b"), (207, 0, "user", "b")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    convs = turntrie.conversations(frame, "conv_id", "turn", "role", "text")
    assert sorted((tuple(r) for r in turntrie.trie(convs).collect()), key=repr) == brute({7: [("user", "a")] * 2, 107: [("user", "b")], 207: [("user", "b")]})
    assert sorted((tuple(r) for r in turntrie.trie(turntrie.rebuilt(convs)).collect()), key=repr) == brute(plain_rebuilt(data))
    assert turntrie.trie(turntrie.conversations(frame.limit(0), "conv_id", "turn", "role", "text")).collect() == []


def test_merging_orders_runs_and_gives_the_shared_turns():
    rng = random.Random(2)
    turn = lambda: bytes([rng.randrange(3)]) * turntrie.TURN
    every = [(b"".join(turn() for _ in range(rng.randrange(6))), c) for c in range(500)]
    for k in (1, 2, 3, 7, 64):
        runs = []
        for i in range(k):
            run = sorted(every[i::k])
            runs.append([(p, c, [], turntrie.shared_turns(run[j - 1][0], p, 0) if j else 0) for j, (p, c) in enumerate(run)])
        got = list(turntrie.merged([*runs, []]))
        assert [r[:2] for r, _ in got] == sorted(every)
        assert [s for _, s in got] == [0] + [turntrie.shared_turns(a[0], b[0], 0) for a, b in zip(sorted(every), sorted(every)[1:])]
    assert list(turntrie.merged([])) == []
