import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from molweave.llm.conversations import Weights, damaged, op11_conversations, plans, repaired

SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    """{conv: [(turn, role, text)]} in order, with every original conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        out[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for x in out.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = SHOWN.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """Least (cost, letters) by a search over whole edit lists, with the rows they leave."""
    heap, settled = [(0, "", 0, "", ())], set()
    best = None
    limit = 4 * len(rows) + 6
    while heap:
        cost, letters, at, initials, left = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, letters, left)) if best else (cost, letters, left)
            continue
        if not re.fullmatch("s?(ua)*u?", initials) or cost > limit:
            continue
        state = (at, initials[-1:], cost, letters)
        if state in settled:
            continue
        settled.add(state)
        for role in ("user", "assistant"):
            if not letters.endswith("II"):
                heapq.heappush(heap, (cost + 3, letters + "I", at, (initials + role[0])[-3:] if len(initials) > 3 else initials + role[0], (*left, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, initials, left))
            if bad[at] not in ("blank", "duplicate"):
                more = 3 * (bad[at] == "truncated")
                for way, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    heapq.heappush(heap, (cost + more + price, letters + way, at + 1, initials + (new[:1] or "?"), (*left, (new, text))))
    return best


def straight(rows, bad):
    """The same by plain tuples from the last row to the first, for whole conversations."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    after = {"": (0, "", ()), "s": (6, "II", (("user", ""), ("assistant", ""))), "u": (3, "I", (("assistant", ""),)), "a": (0, "", ())}
    for (_, role, text), fault in zip(reversed(rows), reversed(bad), strict=True):
        now = {}
        for q, nexts in step.items():
            c, letters, left = after[q]
            ways = [(c + 4, "D" + letters, left)]
            if fault not in ("blank", "duplicate"):
                for way, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if new[:1] and new[0] in nexts:
                        c, letters, left = after[new[0]]
                        ways.append((c + price + 3 * (fault == "truncated"), way + letters, ((new, text), *left)))
            now[q] = min(ways)
        for _ in range(3):
            for q, new in (("u", "assistant"), ("a", "user"), ("s", "user"), ("", "user")):
                c, letters, left = now[new[0]]
                now[q] = min(now[q], (c + 3, "I" + letters, ((new, ""), *left)))
        after = now
    return after[""]


def expected(rows):
    bad = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit, left = straight(rows, bad)
    text = "\n".join(f"{r}:{t}" for r, t in left)
    return (gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_straight_form_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", " ", "c!"])) for k in range(rng.randint(0, 4))]
        bad = faults(rows)
        assert straight(rows, bad) == cheapest(rows, bad)


def test_weights():
    rng = random.Random(5)
    for size in [0, 1, 2, 3, 5, 9, 40, 300]:
        for _ in range(60):
            rows = [(k, rng.choice(["user", "assistant", "system", "", "x"]), rng.choice([f"{k}.", f"{k}", "", "same."])) for k in range(size)]
            bad, weights = faults(rows), Weights()
            for (_, role, _), fault in zip(reversed(rows), reversed(bad), strict=True):
                if fault in ("blank", "duplicate"):
                    weights.delete(1)
                else:
                    weights.row(role[:1], fault == "truncated")
            assert weights.answer() == straight(rows, bad)[:2]


def test_deleting_many_at_once():
    one, many = Weights(), Weights()
    for w in (one, many):
        w.row("u", False)
    for _ in range(7):
        one.delete(1)
    many.delete(7)
    assert one.answer() == many.answer() == (7 * 4 + 3, "DDDDDDDKI")


CASES = [
    *((1, t, r, x) for t, r, x in [(0, "system", "be kind."), (1, "user", "hi?"), (2, "assistant", "hello."), (2, "assistant", "hello.")]),
    *((2, t, "user", "same.") for t in (None, None, 0, 5, -(2**63), 2**63 - 1)),
    *((3, None, None, None) for _ in range(3)),
    (None, 0, "user", "no id."), (None, None, "assistant", "no turn"),
    (4, 1, "", "no role."), (4, 1, "user", ""), (4, 2, "user", "\t\n"), (4, 3, "assistant", "end!  "), (4, 3, "assistant", "end! \n"),
    *((5, t, ("user", "assistant", "system")[t % 3], f"{t // 4}" + ".!"[t % 2] * (t % 5 > 0)) for t in range(400)),
    *((c, 0, "user", "one.") for c in range(100, 160)),
    (6, 0, "user", "word " * 50_000 + "."), (6, 1, "assistant", "ok."),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(*r, "x", 1, "y") for r in CASES]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string, audit int, mark string")


def test_cases(spark, cases, tmp_path):
    cases.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in op11_conversations(spark, str(tmp_path)).collect()}
    assert got == {c: expected(x) for c, x in after_damage(CASES).items()}
    assert any(not x for x in after_damage(CASES).values())


def test_repaired_rows(cases):
    rows = damaged(cases)
    out = defaultdict(list)
    for r in repaired(rows, plans(rows)).collect():
        out[r["conv"]].append((r["place"], r["role"], r["text"], r["edit"], r["turn"]))
    for conv, left in after_damage(CASES).items():
        want = straight(left, faults(left))
        assert [x[1:3] for x in sorted(out[conv])] == list(want[2])
        assert "".join(x[3] for x in sorted(out[conv])) == want[1].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1][:1] for x in sorted(out[conv])))


def test_empty_table(spark, cases, tmp_path):
    cases.limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_conversations(spark, str(tmp_path)).count() == 0


def test_whole_table(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in op11_conversations(spark, sf).collect()}
    assert got == {c: expected(x) for c, x in after_damage(rows).items()}
