import hashlib
import random
import re
import zlib

import pytest

from fleetstats.llm import conversations as C
from fleetstats.llm import edit_lattice as L
from fleetstats.llm.catalog import load, table

FOLDER = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
DDL = "conv_id bigint, turn bigint, role string, text string"


def plain(codes, start=0, ends=(0, 3)):
    """Least (cost, audit) by going over all nodes row by row."""
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    put = {0: 2, 1: 2, 3: 2, 2: 3}

    def inserted(labels):
        for _ in range(3):
            for s, (cost, audit) in list(labels.items()):
                new = (cost + 2, audit + "I")
                labels[put[s]] = min(labels.get(put[s], new), new)
        return labels

    labels = inserted({start: (0, "")})
    for code in codes:
        new = {}

        def offer(s, label):
            new[s] = min(new.get(s, label), label)

        for s, (cost, audit) in labels.items():
            offer(s, (cost + 3, audit + "D"))
            if code != "-":
                extra = int(code.isupper())
                offer(put[s], (cost + 2 + extra, audit + "R"))
                to = after.get(code.lower(), {}).get(s)
                if to is not None:
                    offer(to, (cost + extra, audit + "K"))
        labels = inserted(new)
    return min([labels[s] for s in ends if s in labels], default=None)


@pytest.mark.parametrize("seed", range(4))
def test_both_heaps_find_the_least_cost_and_audit(seed):
    dice = random.Random(seed)
    for _ in range(400):
        codes = "".join(dice.choice("suaxSUAX-uaua") for _ in range(dice.randint(0, 12)))
        assert L.cheapest(codes) == plain(codes)
        start, end = dice.randrange(4), dice.randrange(4)
        assert L.cheapest(codes, start, (end,)) == plain(codes, start, (end,))


def test_pieces_chain_to_the_whole():
    dice = random.Random(9)
    for _ in range(60):
        codes = "".join(dice.choice("suaxSUAX-") for _ in range(dice.randint(0, 20)))
        paths = {0: (0, "")}
        for i in range(0, len(codes), 3):
            paths = L.chain(paths, L.crossings(codes[i : i + 3]))
        assert min(paths[s] for s in (0, 3) if s in paths) == plain(codes)


def test_a_long_conversation_is_solved():
    codes = "s" + "ua" * 500 + "uu-xA" * 20
    assert L.cheapest(codes) == plain(codes)


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        pair = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(pair.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def summary(rows):
    """Of one conversation: what the query returns after its id, and the repaired rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    counts, seen, codes, faults = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), "", []
    for _, _, role, text in rows:
        core = text.rstrip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = plain(codes)
    fixed, rest = [], iter(rows)
    for edit in audit:
        put = "assistant" if fixed and fixed[-1][0][:1] == "u" else "user"
        row = None if edit == "I" else next(rest)
        if edit != "D":
            fixed.append((row[2] if edit == "K" else put, row[3] if row else ""))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] for r in fixed))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, sha), fixed


def brute(rows):
    damaged = hurt(rows)
    out = [(c, *summary([r for r in damaged if r[0] == c])[0]) for c in {r[0] for r in rows}]
    return sorted(out, key=repr)


def drawn(seed, convs=40):
    dice = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "a.b", "Yes.", "?", "x. \t", "x. …", "ok.\u00a0", "very long. " * 3000]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "student", "User"]
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(dice.randint(1, 9)):
            rows.append((conv, dice.choice([None, *range(9)]), dice.choice(roles), dice.choice(texts)))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(60)]
    rows += [(501, 5, "user", "same.")] * 20 + [(502, -3, "assistant", "x.")]
    return rows


def query_on(spark, tmp_path, rows, ddl=DDL):
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in load()[0]["op12_conversations"](spark, str(tmp_path)).collect()), key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    rows = drawn(1)
    assert query_on(spark, tmp_path, rows) == brute(rows)


def test_query_equals_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").collect()]
    got = sorted((tuple(r) for r in load()[0]["op12_conversations"](spark, FOLDER).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark, tmp_path):
    assert query_on(spark, tmp_path, []) == []


@pytest.mark.parametrize("piece,chars", [(4, 2**20), (7, 30)])
def test_long_conversations_are_cut_into_pieces(spark, piece, chars):
    """Some conversations in pieces, others whole; clashing columns are not read."""
    rows = drawn(2)
    frame = spark.createDataFrame(rows, DDL).withColumns({"code": C.F.lit(1), "pos": C.F.lit("x"), "seen": C.F.lit(0), "fault": C.F.lit(9)})
    edits = C.repair(frame, piece=piece, piece_chars=chars)
    got = sorted((tuple(r) for r in C.summaries(edits).collect()), key=repr)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == sorted(((c, *summary([r for r in filled if r[0] == c])[0]) for c in {r[0] for r in rows}), key=repr)


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "cut"), (1, 2, "user", ""), (1, 3, "user", "Q?")]
    edits = sorted(C.repair(spark.createDataFrame(rows, DDL)).collect(), key=lambda r: r.place)
    kept = [(r.role, r.text) for r in edits if r.edit != "D"]
    assert kept == summary(rows)[1]
    assert sum(r.cost for r in edits) == summary(rows)[0][5]
    assert [(r.turn, r.was, r.fault) for r in edits if r.edit != "I"] == [
        (0, "assistant", ""), (1, "assistant", "truncated"), (2, "user", "blank"), (3, "user", "")
    ]
