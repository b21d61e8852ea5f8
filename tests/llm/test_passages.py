"""Passages of 50 words and more, wherever their lines begin and end."""

import random

from quire.llm import passages

DOC = "doc_id bigint, text string"


def plain(rows, least=50):
    """By row: numbers of the words inside a run of ``least`` words that occurred before."""
    seen, gone = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words, cut = (text or "").split(), set()
        for i in range(len(words) - least + 1):
            run = tuple(words[i : i + least])
            if run in seen:
                cut |= set(range(i, i + least))
            seen.add(run)
        gone[doc_id] = cut
    return gone


def test_passage_in_mid_line(frame):
    passage = [f"p{i}" for i in range(60)]
    rows = [
        (1, "head one " + " ".join(passage) + " tail one\nnext line"),
        (2, "other start " + " ".join(passage[:20]) + "\n" + " ".join(passage[20:25]) + "\n" + " ".join(passage[25:]) + " other end\n\nlast"),
        (3, "a b\n" + " ".join(passage) + " c\nd"),
        (4, " ".join(passage[:49]) + " short of fifty"),
        (5, "x\n" + " ".join(passage)),
    ]
    got = {r["doc_id"]: r for r in passages.dedup_passages(frame(rows, DOC)).collect()}
    assert got[1]["text"] == rows[0][1] and got[4]["text"] == rows[3][1]
    assert got[2]["text"] == "other start\nother end\n\nlast" and got[3]["text"] == "a b\nc\nd" and got[5]["text"] == "x"
    assert [got[i]["n_words_cut"] for i in range(1, 6)] == [0, 60, 60, 0, 60]
    assert (got[2]["n_lines"], got[2]["n_removed"]) == (5, 1) and got[5]["n_removed"] == 1


def test_every_repeated_run_of_words_goes(frame):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    pool = [r.choices(words, k=r.randint(26, 90)) for _ in range(12)]
    rows = []
    for i in range(150):
        said = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            said += p[r.randint(0, 12) : len(p) - r.randint(0, 12)] if r.random() < 0.7 else r.choices(words, k=r.randint(1, 40))
        rows.append((i, "".join(w + r.choice([" "] * 12 + ["\n", " \n\n"]) for w in said)))
    rows += [(150, "x " * 400), (151, "x " * 300 + "y"), (152, "a b c " * 60), (153, None), (154, ""), (155, " \n"), (None, rows[3][1])]
    gone = plain(rows)
    for x in passages.dedup_passages(frame(rows, DOC)).collect():
        text = next(t for d, t in rows if d == x["doc_id"])
        left = [w for i, w in enumerate((text or "").split()) if i not in gone[x["doc_id"]]]
        assert (x["text"] or "").split() == left and (x["text"] is None) == (text is None)
    twice = passages.dedup_passages(frame([rows[0], rows[0]], DOC)).collect()
    assert twice[0] == twice[1]


def test_places_of_a_document_meet_its_runs_as_one_row(frame):
    place = lambda r, at: (r << 31) + at
    repeats = frame([(7, place(r, at), None, place(0, 3), 3) for r in (1, 2) for at in range(0, 176, 5)], "key bigint, place bigint, before int, first bigint, times bigint")
    found = frame([(1, "a", 0, 120)], "r bigint, k string, start int, stop int")
    names = frame([(1, "a", 200), (2, "b", 200)], "r bigint, k string, n int")
    words = frame([(k, list(range(i, 200 + i))) for i, k in enumerate("ab")], "k string, hs array<bigint>")
    left = passages._unsettled(repeats, found, names, words, 50)
    spots = {}
    for row in left.collect():
        spots.setdefault(row["place"] >> 31, set()).add(row["place"] & ((1 << 31) - 1))
    assert spots == {1: set(range(71, 151)), 2: set(range(151))}
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan[plan.index("Join LeftOuter") :]
