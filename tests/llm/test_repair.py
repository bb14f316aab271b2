import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

from docaudit.llm import repair as R
from docaudit.llm.repair import SuffixAutomaton, conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, sign string, uid long, audit int, k int, cost string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """rows: (conv_id, turn, role, text).  {conv_id: result} by damage, faults and a plain recursion over whole audits."""
    convs = {}
    for c, t, role, text in rows:
        own = convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: mended(own) for c, own in convs.items()}


def mended(own):
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in own:
        chars = BLANK.findall(text)
        faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    cost, audit, out = best(tuple((r, x, f) for (_, r, x), f in zip(own, faults)))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def best(rows):
    """Least (cost, audit) by recursion over (place, initials so far as a grammar state, inserts in a row)."""
    nxt = {"": ("u", "s"), "s": ("u",), "u": ("a",), "a": ("u",)}

    @lru_cache(None)
    def go(i, q, inserts):
        ways = []
        if i == len(rows):
            if q in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            c, a, o = go(i + 1, q, 0)
            ways.append((c + 4, "D" + a, o))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in nxt[q]:
                    c, a, o = go(i + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                for full in ("user", "assistant"):
                    if full[0] in nxt[q]:
                        c, a, o = go(i + 1, full[0], 0)
                        ways.append((c + 3 + more, "R" + a, (f"{full}:{text}", *o)))
        if inserts < 4:
            for full in ("user", "assistant"):
                if full[0] in nxt[q]:
                    c, a, o = go(i, full[0], inserts + 1)
                    ways.append((c + 3, "I" + a, (f"{full}:", *o)))
        return min(ways) if ways else (10**9, "~", ())

    return go(0, "", 0)


def row(sign):
    role = {"s": "system", "u": "user", "a": "assistant"}.get(sign.lower(), "tool")
    return (role, "x", "blank" if sign == "d" else "truncated" if sign.isupper() else "")


def test_every_short_signature_equals_brute_force():
    words = ["".join(p) for n in range(5) for p in product(R.SIGNS, repeat=n)]
    automaton = SuffixAutomaton()
    for word in sorted(words, key=lambda w: w[::-1]):
        cost, audit, _ = best(tuple(map(row, word)))
        assert automaton.repair(word) == (cost, audit), word
    assert automaton.made == len(words) - 1  # one state for each suffix but the empty one, whatever shares it


def test_order_changes_no_result():
    rng = random.Random(12)
    words = ["".join(rng.choice(R.SIGNS) for _ in range(rng.randrange(14))) for _ in range(300)]
    mixed = SuffixAutomaton()
    got = {w: mixed.repair(w) for w in words}
    for w in words:
        assert got[w] == best(tuple(map(row, w)))[:2]


def held(df):
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = conversation_repair(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_table_equals_brute_force(spark):
    held(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_awkward_rows(spark):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "Système", "u", "superuser"]
    texts = ["", " \t\n", None, "One.", "Two!", "three", "Four?  \n", "a.b", "é。", " . ", " ", "long " * 20_000 + "end.", "long " * 20_000]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(6), 40, -3]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += rows[:60]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(200)]
    df = spark.createDataFrame([(*r, "s", 1, 2, 3, "c") for r in rows], SCHEMA).repartition(5)
    held(df)
    assert conversation_repair(df.limit(0)).count() == 0
    assert conversation_repair(df.limit(0)).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_all_rows_dropped(spark):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, t, "user", "Hi.", "s", 1, 2, 3, "c") for c, t in gone], SCHEMA)
    got = conversation_repair(df).collect()
    assert len(got) == len(gone) > 3
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)
