"""Personal data: the rules against their plain patterns, the bootstrapping against a plain version."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from tillflow.llm import frames, pii
from tillflow.llm.registry import QUERIES, load

load()

# fixed values: the rules as the contract gives them
PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == pii.IP and any(int(p) > 255 for p in m[0].split("."))
                    or kind == pii.CARD and not (14 <= len(digits) <= 19 and plain_luhn(digits))
                    or kind == pii.PHONE and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


PARTS = ["a", "b@", "c.d", "@", ".", "1", "22", "255", "300", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111",
         "+1 (555) 123-4567", "1.2.3.4", "x@y.z", "é", "\n", "007"]


def test_rules_are_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_rules_take_linear_time():
    began = time.time()
    for text in ("a" * 10**6, "1" * 10**6, "a@" * 300_000, "a." * 400_000 + " at " + "b." * 400_000, "a at b dot " * 100_000, "ab:" * 300_000):
        pii.mentions(text, pii.base_spans(text))
    assert time.time() - began < 30


def test_query(spark, folder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_pii"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) | {""} and (r.spans.count(":") == 2 * (len(names) + r.n_found))


def corpus():
    """Contexts that tell a kind, contexts that do not, and identifiers no rule finds."""
    rng = random.Random(5)
    docs = []
    for i in range(12):
        docs.append(f"Some words here. You can call me at +1 (555) 010-{4000 + i} any day {i}.")
        docs.append(f"My mail: user{i}@mail{i}.example.com, thanks.")
        docs.append(f"Since the year {1900 + rng.randrange(100)} we sold {rng.randrange(10**8, 10**9)} pieces number {i}.")
        docs.append(f"order number {rng.randrange(10**8)} of host 10.0.0.{i}")
    # unseen spellings in telling contexts, one that then teaches a context of its own, and traps
    docs += ["You can call me at 555 010 7777 any day.", "My mail: jane [at] corp [dot] example [dot] org, thanks.",
             "You can call me at 12 any day.", "we sold 123456789 pieces", "number 555 010 7777 again", "write to user3 (at) mail3.example.com now"]
    for i in range(5):
        docs.append(f"You can call me at 555 020 {1000 + i} any day.")
        docs.append(f"new line: tel. no. 555 020 {1000 + i} / office")
    docs += ["new line: tel. no. 555 333 9999 / office", docs[0], docs[0]]
    return docs


def plain_bootstrap(docs, rounds):
    """Scores of the pattern graph by dictionaries."""
    fillers, forms, seeds = defaultdict(set), defaultdict(int), {}
    for text in docs:
        for _, _, kind, form, instance, patterns in pii.mentions(text, pii.base_spans(text)):
            if kind >= 0:
                seeds[instance] = min(kind, seeds.get(instance, kind))
            forms[instance] |= form
            for p in patterns:
                fillers[p].add(instance)
    known = {i: (k, 1.0) for i, k in seeds.items()}
    for _ in range(rounds):
        doubt = defaultdict(lambda: 1.0)
        for p, all_ in fillers.items():
            for k in range(4):
                own = [known[i][1] for i in all_ if i in known and known[i][0] == k]
                half = [i for i in all_ if i not in known and forms[i] >> k & 1]
                sure = sum(own) / (len(all_) - pii.UNLABELLED * len(half) + 1)
                if len(own) >= pii.LEAST_KNOWN and sure >= pii.PATTERN_SURE:
                    for i in all_:
                        if forms[i] >> k & 1:
                            doubt[i, k] *= 1 - sure
        best = {}
        for (i, k), d in doubt.items():
            if i not in seeds and 1 - d >= pii.INSTANCE_SURE:
                best[i] = max(best.get(i, (0, 0)), (1 - d, -k))
        new = {i: (-k, s) for i, (s, k) in best.items()}
        last = set(new) <= set(known)
        known = {i: (k, 1.0) for i, k in seeds.items()} | new
        if last:
            break
    return {i: k for i, (k, _) in known.items()}


@pytest.mark.parametrize("rounds", [1, 4])
def test_bootstrapping(spark, rounds):
    frames.settings(spark)
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.instance: r.kind for r in pii.bootstrap(pii._found(df, "doc_id", "text", ()), rounds).collect()}
    assert got == plain_bootstrap(docs, rounds)
    assert got["n:5550107777"] == pii.PHONE and "n:123456789" not in got
    # only known once its context has been learned from others that were discovered
    assert ("n:5553339999" in got) == (rounds > 1)


def test_added_spans(spark):
    frames.settings(spark)
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    added = {(r.doc_id, docs[r.doc_id][s.start:s.end], pii.KINDS[s.kind])
             for r in pii.personal_data(df).collect() for s in r.found}
    texts = {(t, k) for _, t, k in added}
    assert {("555 010 7777", "phone"), ("555 333 9999", "phone"), ("jane [at] corp [dot] example [dot] org", "email"),
            ("user3 (at) mail3.example.com", "email")} <= texts
    assert all(k in ("phone", "email") for _, k in texts) and not any(t in ("12", "123456789") for t, _ in texts)
    # the same number in a context that tells nothing
    assert (docs.index("number 555 010 7777 again"), "555 010 7777", "phone") in added
    masked = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert masked[docs.index("number 555 010 7777 again")] == "number <phone> again"
    assert masked[1] == "My mail: <email>, thanks."


def test_odd_rows(spark):
    frames.settings(spark)
    rows = [(1, "mail a@b.c"), (1, "mail a@b.c"), (None, "10.0.0.1"), (2, None), (3, ""), (None, None), (4, "x" * 100_000 + "@y.z"), (5, "😀 a@b.c")]
    docs = spark.createDataFrame([(i, t, 1, "b", "k") for i, t in rows], "doc_id long, text string, row long, base string, kind string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.found]) for r in pii.personal_data(docs).collect()), key=repr)
    one = [(5, pii.EMAIL, 10)]
    assert got == sorted([(1, one, []), (1, one, []), (None, [(0, pii.IP, 8)], []), (2, [], []), (3, [], []), (None, [], []),
                          (4, [(0, pii.EMAIL, 100_004)], []), (5, [(2, pii.EMAIL, 7)], [])], key=repr)
    assert pii.personal_data(docs.limit(0)).count() == 0
    assert {r.text for r in pii.masked(docs.where("doc_id in (2, 3)")).collect()} == {None, ""}


def test_numbers_side_by_side():
    text = "call +1 (855) 555-4208 4866351201689520 or"
    assert pii.base_spans(text) == []
    found = {(text[s:e], i, f) for s, e, _, f, i, _ in pii.mentions(text, [])}
    assert ("+1 (855) 555-4208", "n:18555554208", 1 << pii.PHONE) in found
    assert any(t == "4866351201689520" for t, _, _ in found)
