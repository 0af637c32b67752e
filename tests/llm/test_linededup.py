import random

from tessera.llm import linededup


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(3)
    return {r["row"]["doc_id"]: (r["clean_text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(docs, **kw).collect()}


def line(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_shared_passages_stay_once(spark):
    rnd = random.Random(5)
    passages = [[line(rnd, n) for n in sizes] for sizes in ([60], [30, 30], [12] * 6, [8] * 15, [3, 55, 4])]
    common = line(rnd, 5)
    rows = []
    for i in range(40):
        own = [line(rnd, rnd.randrange(3, 70)) for _ in range(rnd.randrange(2, 9))]
        at = rnd.randrange(1, len(own))
        own[at:at] = passages[i % 5] + ([common] if i % 3 == 0 else [])
        rows.append((i, "\n".join(own), "x"))
    got = run(spark, rows)
    for p in passages:
        whole = "\n".join(p)
        assert sum(whole in (t or "") for t, _, _ in got.values()) == 1
    for i, t, _ in rows:
        unique = [x for x in t.split("\n") if sum(x in u.split("\n") for _, u, _ in rows) == 1]
        assert all(x in got[i][0].split("\n") for x in unique)
    assert sum(common in t for t, _, _ in got.values()) >= 12, "a short common line by itself stays"
    left = sum(x in got[i][0].split("\n") for i in range(40) for x in passages[i % 5])
    assert left <= 1.6 * sum(map(len, passages))


def test_common_lines_inside_a_passage(spark):
    """Paragraphs of one line parted by blank lines, and two passages with a line in common."""
    rnd = random.Random(6)
    paragraphs = [line(rnd, 30) for _ in range(3)]
    both = line(rnd, 8)
    passages = ["\n\n".join(paragraphs), "\n".join([line(rnd, 20), both, line(rnd, 20)]), "\n".join([line(rnd, 20), both, "", line(rnd, 20)])]
    copied = "\n\n".join(line(rnd, 25) for _ in range(4))
    rows = [(i, "\n".join([line(rnd, 9), passages[i % 3], line(rnd, 9)]), "x") for i in range(60)]
    rows += [(i, "\n\n".join(line(rnd, 5) for _ in range(9)), "x") for i in range(60, 120)]
    rows += [(200, copied, "x"), (201, copied, "x")]
    got = run(spark, rows)
    for p in passages:
        assert sum(x in t.split("\n") for x in p.split("\n") if len(x) > 60 for t, _, _ in got.values()) == sum(len(x) > 60 for x in p.split("\n"))
    assert got[200] == (copied, 7, 0) and got[201] == ("", 7, 7)
    assert all(got[i] == (t, 17, 0) for i, t, _ in rows[60:120])


def test_copies_and_cases(spark):
    t = "one two\nthree four\nfive"
    rows = [(3, t, "a"), (1, t, "b"), (None, t, "c"), (2, None, "d"), (4, "", "e"), (5, "alone", "f"), (6, t + "\n" + t, "g")]
    got = run(spark, rows)
    assert got[1] == (t, 3, 0) and got[3] == ("", 3, 3) and got[None] == ("", 3, 3)
    assert got[2] == (None, 1, 0) and got[4] == ("", 1, 0) and got[5] == ("alone", 1, 0)
    assert sum(x[2] for x in got.values()) >= 6
    twice = spark.createDataFrame([(1, t), (1, t), (2, "x")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in linededup.dedup_lines(twice).collect()) == [0, 0, 0]
    assert linededup.dedup_lines(twice.limit(0)).count() == 0


def test_same_hash_of_other_bytes_is_kept(spark):
    """Chunks are equal only if their bytes are: groups are made of the text, not of its hash."""
    rows = [(i, f"{i} x\ny {i}", "z") for i in range(5)]
    assert all(x[2] == 0 for x in run(spark, rows).values())
