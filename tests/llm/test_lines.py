"""Line classes against all pairs; the banded distance against the full table."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrank.llm import lines


def distance(a, b, limit=1 << 30):
    """Edit distance; beyond the limit some number above it."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return limit + 1
    return row[-1]


def may_match(a, b, tau):
    """An edit changes the counts of two characters at most."""
    counts = dict.fromkeys(a, 0)
    for x in a:
        counts[x] += 1
    for x in b:
        counts[x] = counts.get(x, 0) - 1
    return sum(map(abs, counts.values())) <= 2 * tau


def edited(rng, s, n):
    for _ in range(n):
        at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        s = s[:at] + rng.choice("abcé ") + s[at:] if kind == 0 or at == len(s) else s[:at] + (rng.choice("abcé ") if kind == 1 else "") + s[at + 1 :]
    return s


@pytest.mark.parametrize("tau", [0, 1, 2, 5])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("é😀x", "é😀y")]
    for _ in range(150):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40)))
        pairs.append((a, edited(rng, a, rng.randint(0, 8))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", lines.edit_distance(F.col("a"), F.col("b"), tau).alias("d")).collect():
        want = distance(r.a, r.b)
        assert (r.d == want) if want <= tau else (r.d > tau), (r, want)


def plain_dedup(rows, tau=2, min_chars=50, exact_chars=20):
    """What stays of each row's text, by all pairs of lines of like length."""
    places = sorted(
        {(i is not None, i or 0, t, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if len(x) >= exact_chars}, key=lambda p: p[:2]
    )
    by_length = {}
    for x in sorted({p[4] for p in places}):
        by_length.setdefault(len(x), []).append(x)
    parent = {x: x for xs in by_length.values() for x in xs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n in sorted(by_length):
        for a in by_length[n] if n >= min_chars else []:
            for m in range(n, n + tau + 1):
                for b in by_length.get(m, []):
                    if (m > n or a < b) and may_match(a, b, tau) and distance(a, b, tau) <= tau:
                        parent[root(a)] = root(b)
    groups = {}
    for p in places:
        groups.setdefault(root(p[4]), set()).add(p[:4])
    gone = {p for g in groups.values() for p in g if p != min(g, key=lambda q: (q[:2], q[3]))}
    out = []
    for i, t in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if (i is not None, i or 0, t, n) not in gone]
        out.append((i, t if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def check(docs, rows):
    table = docs(rows)
    cleaned = lines.dedup_lines(table)
    assert cleaned.columns == table.columns
    assert sorted([(r.doc_id, r.text) for r in cleaned.collect()], key=repr) == plain_dedup(rows)


def test_planted_edits(docs):
    """Copies with up to three edits, chains of edits, a hot line and a dense group."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefé  ") for _ in range(rng.randint(45, 90))) for _ in range(25)]
    rows = []
    for i in range(60):
        body = [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(4)] + ["short line", base[0]]
        rows.append((i, "\n".join(body)))
    chain = base[1]
    for i in range(60, 75):
        chain = edited(rng, chain, 2)
        rows.append((i, chain + "\nand a short one"))
    check(docs, rows)


def test_odd_texts(docs):
    line = "the same long line of more than fifty characters, repeated in places"
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (5, f"{line}\n{line}\nshort\nshort"), (None, f"x\n{line}!"), (6, "a" * 2000),
        (7, "a" * 2001 + "\nend"), (8, "\n".join(f"{line} {i}" for i in range(120))), (9, "é" * 50 + "\r\n" + "é" * 51),
    ]
    check(docs, rows)


def test_empty_table(docs):
    assert lines.dedup_lines(docs([])).collect() == []


def test_dense_group_makes_few_pairs(spark):
    """Many near-equal lines under common keys are joined to one line each, not pair by pair."""
    line = "a line of sixty characters or so whose very end is numbered "
    table = spark.createDataFrame([(i, line + f"{i:02d}") for i in range(100)], "doc_id long, text string")
    labels = lines.alike_lines(table, "doc_id", "text", 2, 50).collect()
    assert len(labels) == 99 and len({r.label for r in labels}) == 1


def test_short_lines_go_when_equal(docs):
    notice, other = "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.1."
    rows = [(1, f"{notice}\nten chars.\n{'x' * 20}"), (2, f"a\n{notice}\nten chars.\n{'y' * 19}"), (3, f"{other}\n{'x' * 20}\n{'y' * 19}\n{notice}")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: f"a\nten chars.\n{'y' * 19}", 3: f"{other}\n{'y' * 19}"}


def test_very_long_texts_and_lines(docs):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500))
    many = [f"line number {k} of a text of very many lines, none of them like another {k * k}" for k in range(600)]
    rows = [(1, long), (2, f"x\n{edited(rng, long, 2)}"), (3, edited(rng, long, 9)), (4, "\n".join(many)), (5, "\n".join(many[::-1]))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(rows)).collect()}
    assert got[1] == long and got[2] == "x" and got[3] == rows[2][1] and got[5] == ""
    assert set(many) >= set(got[4].split("\n"))


def test_bit_filter(spark):
    """Five million hashes let few others pass, and none is lost."""
    from lumenrank.llm.bits import filter_bits, passing
    from lumenrank.session import materialise

    held = materialise(spark.range(5_000_000).select(F.xxhash64("id").alias("h")), "held")
    others = spark.range(1 << 33, (1 << 33) + 1_000_000).select(F.xxhash64("id").alias("h"))
    assert passing(others, held, "h").count() < 50_000
    some = held.filter(F.pmod("h", F.lit(50)) == 0)  # not limit(), below which the planner would put the table
    assert passing(some, held, "h").count() == some.count() and filter_bits(0) == 16 and filter_bits(10**12) == 26


def test_classes_join_labels_alone(docs, monkeypatch):
    """Lines of one star go on with their label: the second search for classes gets the links between labels only."""
    edges, nodes, find = {}, {}, lines.components

    def counted(table, name):
        found = find(table, name)
        edges[name], nodes[name] = table.count(), found.count()
        return found

    monkeypatch.setattr(lines, "components", counted)
    rng = random.Random(11)
    chain = ["".join(rng.choice("abcdefghij") for _ in range(90))]
    for i in range(12):  # each two edits from the one before, so no line is near all the others
        chain.append(chain[-1][: 7 * i] + "#%" + chain[-1][7 * i + 2 :])
    copies = [(100 + i, chain[0][:-1] + chr(0x41 + i)) for i in range(20)]
    check(docs, [*copies, *((200 + i, line + "\nown " + str(i)) for i, line in enumerate(chain))])
    assert nodes["line-stars"] >= 20 and edges["line-classes"] < nodes["line-stars"]
