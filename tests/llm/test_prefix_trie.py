"""The trie of prefixes against a plain one: shared openings, equal conversations, blocks of any size, hot sequences."""

import hashlib
import random
import zlib

import pytest

from factloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, n string, depth string, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(parts)


def plain(sequences):
    """Nodes of {conv_id: [(role, text), ...]} by a dictionary of prefixes."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        ends = sorted(c for c in convs if len(sequences[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below), sum(m not in inner for m in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def gathered(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = sequences.get(c - c % 100, [])[:h] + own[h:]
    return out


def found(spark, rows, parts=3):
    nodes = prefix_trie.prefix_trie(queries.rebuilt(prefix_trie.conversation_turns(frame(spark, rows, parts))))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.select(*columns).collect()), key=str)


def corpus(rng, n):
    rows = []
    for c in rng.sample(range(1000), n):
        size = rng.choice([1, 2, 3, 3, 4, 5, 8])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "a", "bé𝄞", "", None])) for t in range(size)]
    return rows


@pytest.mark.parametrize(("seed", "block_rows", "n"), [(1, 1 << 16, 90), (2, 3, 90), (3, 1, 40)])
def test_equals_a_plain_trie(spark, monkeypatch, seed, block_rows, n):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rows = corpus(random.Random(seed), n)
    hot = [(2000 + c, t, "user", x) for c in range(30) for t, x in enumerate(["hot", "hotter", "bé𝄞", "x", "y", "z", "last"][: 7 if c % 3 else 5])]
    rows += [*hot, (None, 0, "user", "a"), (7000, None, "user", "first"), (7000, 0, "user", "second")]
    assert found(spark, rows, 7) == plain(rebuilt(gathered(rows)))


def test_few_conversations(spark):
    assert found(spark, []) == []
    for rows in ([(3, 0, "user", "a")], [(0, 0, "user", "a"), (1, 0, "user", "a")], [(5, t, "user", "a") for t in range(9)] + [(6, t, "user", "a") for t in range(7)]):
        assert found(spark, rows) == plain(rebuilt(gathered(rows)))


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "gone") for c in range(201, 230)] + [(300, 0, "user", "a"), (300, 1, "user", "b")]
    expected = plain(rebuilt(gathered(rows)))
    assert [x for x in expected if x[1] == 0][0][7] != prefix_trie.NO_ENDS
    assert found(spark, rows) == expected


def test_long_conversations(spark):
    rows = [(100 + c, t, "user", f"{t if t < 250 + c else -c}") for c in range(4) for t in range(300)]
    assert found(spark, rows) == plain(rebuilt(gathered(rows)))


def test_crc32_in_sql():
    import duckdb

    for x in (0, 7, 123456, -5):
        assert duckdb.sql(f"SELECT {queries._CRC32.format(x=x)}").fetchall()[0][0] == zlib.crc32(str(x).encode())
