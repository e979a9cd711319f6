"""Base spans against plain patterns; votes, estimation and further spans."""

import hashlib
import random
import re

import pytest

from lumenrank.llm import private

SF = "/root/testdata/sf0.01"


def plain_base(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(x) for x in d[::-1][::2]] + [sum(divmod(2 * int(x), 10)) for x in d[::-1][1::2]]
        if 12 <= len(d) <= 19 and sum(odd) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    order = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = private.op2_private_spans(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in private.BASE_KINDS]
        assert set(line.split(",")) <= set(r.spans.split(",")) or not base


@pytest.mark.parametrize("seed", range(4))
def test_random_strings(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice("ab@@..--01234567890%+ +()é") for _ in range(rng.randint(0, 40)))
        assert private.base_spans(text) == plain_base(text), text


ODD = [
    (1, None), (2, ""), (3, "é😀 a@b.c x@y @z.z"), (4, "1" * 150_000), (5, "a" * 150_000 + "@" + "b" * 150_000), (6, "1.2.3.4.5 256.1.1.1 01.02.03.0255"),
    (7, "4111 1111 1111 1111 and 4111-1111-1111-1112"), (7, "+1 (234) 567-8901"), (7, "+1 (234) 567-8901"), (None, "me@site.org"), (8, "+1" * 80_000), (9, "1 " * 80_000),
]


def test_odd_texts(docs):
    rows = private.find_private(docs(ODD)).collect()
    slow = {4}  # its plain pattern is quadratic
    want = [(i, ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t))) for i, t in ODD if i not in slow and i != 5]
    got = [(r.doc_id, r.base) for r in rows if r.doc_id not in slow and r.doc_id != 5]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r.base for r in rows if r.doc_id in (4, 5)] == ["", ""]


def test_empty_table(docs):
    assert private.find_private(docs([])).collect() == []


def test_further_kinds_are_added(docs):
    rows = [(i, f"please contact anna{i} [at] mail{i} [dot] org or phone 020 7946 0{i:03d} today") for i in range(100, 160)]
    rows += [(i, f"see table page 123-456-7890 total {i} and nothing else") for i in range(200, 230)]
    found = {r.doc_id: r.spans for r in private.find_private(docs(rows)).collect()}
    for i, text in rows[:60]:
        s = text.index("anna")
        e = text.index(" or phone")
        assert f"email_text:{s}:{e}" in found[i] and "phone_local" in found[i]
    assert not any(found[i] for i, _ in rows[60:])


def test_estimate_finds_the_reliable_labelers():
    rng = random.Random(5)
    right = (0.95, 0.9, 0.6, 0.55, 0.55, 0.55)
    patterns, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = "".join("ny"[y if rng.random() < p else not y] for p in right)
        patterns["card", votes] = patterns.get(("card", votes), 0) + 1
        truth.setdefault(votes, []).append(y)
    chance = private.estimate(patterns)
    wrong = sum(sum(y != (chance["card", v] > 0.5) for y in ys) for v, ys in truth.items())
    assert wrong <= 0.07 * 20_000
