"""Prefix tries and structure repair of conversations, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import queries, repair, trie
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, ties, repeated rows and conversations, a long one, ids of several families, columns whose names clash."""
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 1, "user", "No"), (1, None, "system", "First."), (1, None, None, None)]
    rows += [(2, 5, None, "x."), (2, 9, "assistant", None), (2, 7, "", ""), (3, None, "tool", " \t"), (4, 0, "user", "é🙂!"), (100, 0, "s", "."), (100, 1, "u", "?"), (100, 2, "a", "!")]
    rows += [(103, 0, "user", "alone"), (2000, 3, "User", "Q."), (None, 0, "user", "none."), (None, 1, "assistant", "none."), (5, 0, "user", "long " * 40_000 + ".")]
    rows += [(c, t, ("user", "assistant")[t % 2], f"shared {t}.") for c in range(300, 360) for t in range(6)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 7}." if t > 3 else f"common {t}.") for c in range(400, 460) for t in range(8)]
    rows += [(7, t, random.Random(t).choice(["user", "assistant", "system"]), f"t{t % 90}.") for t in range(400)]
    return spark.createDataFrame([(*r, i, "x", "y") for i, r in enumerate(rows)], SCHEMA + ", key long, sequence string, report string").repartition(3)


def plain(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


# -- tries ------------------------------------------------------------------


def plain_nodes(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own[c].append((t is not None, t or 0, sha(f"{len(role)}:{role}{text}")[:32], role, text))
    own = {c: [r[3:] for r in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return Counter(
        (min(m)[0], len(k), min(members[k[:-1]])[0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(str(c) for c, ends in sorted(m) if ends)))
        for k, m in members.items()
    )


#: Small bounds, so that heavy levels, several shards and long lists of members occur on small tables.
SMALL = {"most_below": 3, "levels": 2, "shard_turns": 40, "id_block": 7}


@pytest.mark.parametrize("options", [{}, SMALL])
def test_prefixes(odd, table, options):
    for rows in (odd, table):
        assert Counter(map(tuple, trie.shared_prefixes(rows, **options).collect())) == plain_nodes(plain(rows))


def test_prefixes_where_nothing_is_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.shared_prefixes(empty).count() == 0
    assert trie.shared_prefixes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    # Every conversation is without turns: the root alone, which is its own leaf.
    lone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6][:3]
    rows = [(c, 0, "user", "x") for c in lone]
    found = trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, found)) == plain_nodes(rows) and len(found) == 1 and found[0].n_leaves == 1


def test_bits_are_level_ordered(spark):
    """A ones-then-zero code of each node, breadth first, from which parents and levels come back."""
    parent, degree, levels = trie.shape(np.packbits([1, 1, 0, 1, 0, 1, 1, 0, 0, 0, 0]).tobytes(), 6)
    assert parent.tolist() == [0, 0, 0, 1, 2, 2] and degree.tolist() == [2, 1, 2, 0, 0, 0] and levels == [0, 1, 3, 6]
    paths = trie.rebuilt(trie.sequences(trie.turn_rows(spark.read.parquet(f"{SF}/conversations.parquet"))))
    _, distinct = trie._distinct(paths, 10)
    built = trie.tries(trie._split(distinct, 2, 1)[0], 3).collect()
    assert len({r.shard for r in built}) == len(built) > 1
    for r in built:
        parent, degree, levels = trie.shape(r.louds, r.nodes)
        assert levels[-1] == r.nodes == len(parent) == len(r.labels) // trie.LABEL + 1 and (np.bincount(parent[1:], minlength=r.nodes) == degree).all()
        assert (np.diff(parent) >= 0).all() and len(r.tops) == degree[0]


# -- repair -----------------------------------------------------------------


def plain_plan(turns):
    """Least (cost, audit), edit by edit."""
    allowed, done = re.compile(r"s?(ua)*u?"), re.compile(r"(s?(ua)+)?")
    states = {(0, ""): (0, "")}  # place and the roles' last two: the rest does not matter
    best = None
    order = [(0, "")]
    while order:
        order.sort(key=lambda k: states[k])
        place, roles = order.pop(0)
        cost, audit = states[place, roles]
        if place == len(turns) and done.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
            continue
        steps = [(place, roles + r, 3, "I") for r in "ua"]
        if place < len(turns):
            initial, must_go, cut = turns[place]
            steps.append((place + 1, roles, 4, "D"))
            if not must_go:
                steps += [(place + 1, roles + r, 3 + 3 * cut, "R") for r in "ua"] + [(place + 1, roles + initial, 3 * cut, "K")] * bool(initial)
        for at, grown, price, letter in steps:
            if allowed.fullmatch(grown):
                state = (at, grown if len(grown) < 3 else "ua"[: 2 - (grown[-1] == "u")])
                if state not in states or (cost + price, audit + letter) < states[state]:
                    states[state] = (cost + price, audit + letter)
                    if state not in order:
                        order.append(state)
    return best


def test_plans_are_the_cheapest_and_first():
    draw = random.Random(3)
    for _ in range(1500):
        turns = [(draw.choice(["s", "u", "u", "a", "a", "t", ""]), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 7))]
        turns = [(i, gone, cut and not gone) for i, gone, cut in turns]
        assert repair.cheapest(turns) == plain_plan(turns), turns


def plain_repair(rows):
    damaged, ids = [], {r[0] for r in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c in ids:
        own = sorted((r for r in damaged if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, sha(f"{len(r[2])}:{r[2]}{r[3]}")[:32]))
        seen, turns, faults = set(), [], Counter()
        for _, _, role, text in own:
            last = text.rstrip(repair.SPACES)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t for _, t, _, _ in own if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = repair.cheapest(turns)
        lines, at, last = [], 0, ""
        for edit in audit:
            if edit == "I":
                role, text = ("assistant" if last == "u" else "user"), ""
            else:
                _, _, role, text = own[at]
                at += 1
                if edit == "D":
                    continue
                role = ("assistant" if last == "u" else "user") if edit == "R" else role
            lines.append(f"{role}:{text}")
            last = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return Counter(out)


def repaired_query(df):
    rows = repair.damaged(df)
    return repair.repair_digests(rows, repair.audited(rows))


def test_repair(odd, table):
    for rows in (odd, table):
        assert Counter(map(tuple, repaired_query(rows).collect())) == plain_repair(plain(rows))


def test_repaired_turns(spark, odd):
    rows = odd.drop("key")
    reports = repair.audited(rows)
    turns = repair.repaired(rows, reports).collect()
    by_conv = defaultdict(list)
    for r in turns:
        by_conv[r.conv_id].append(r)
    for r in reports.collect():
        own = sorted(by_conv[r.conv_id], key=lambda t: t.place)
        assert [t.place for t in own] == list(range(len(own))) and "".join(t.edit for t in own) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own)) and all(t.text == "" for t in own if t.edit == "I")


def test_repair_where_nothing_is_left(spark):
    assert repaired_query(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = repaired_query(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_queries_run_on_their_table(spark):
    rows = plain(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert Counter(map(tuple, queries.op12_prefix_trie(spark, SF).collect())) == plain_nodes(rows)
    assert Counter(map(tuple, queries.op13_structure_repair(spark, SF).collect())) == plain_repair(rows)
    assert all(kind == "bigint" for name, kind in queries.op12_prefix_trie(spark, SF).dtypes if name != "ends_sha256")
