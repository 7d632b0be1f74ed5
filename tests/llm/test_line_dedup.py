import random

from logquarry.llm.line_dedup import dedup_lines


def brute(rows, least):
    """By the definition: every repeated run of enough words, at every length."""
    docs = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    lines = {i: rows[i][1].split("\n") for i in docs if rows[i][1] is not None}
    seen, gone = set(), {i: set() for i in docs}
    for i in docs:
        for a in range(len(lines.get(i, ()))):
            words = 0
            for b in range(a, len(lines[i])):
                words += len(lines[i][b].split())
                run = tuple(lines[i][a : b + 1])
                if words >= least and run in seen:
                    gone[i] |= set(range(a, b + 1))
                seen.add(run)
    out = []
    for i in docs:
        text = None if i not in lines else "\n".join(x for n, x in enumerate(lines[i]) if n not in gone[i])
        out.append((rows[i][0], text, len(lines.get(i, ())), len(gone[i])))
    return sorted(out, key=str)


def run(spark, rows, least):
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, runs string")
    got = dedup_lines(df.coalesce(1), "doc_id", "text", least).collect()
    assert all(r.row.runs == "k" for r in got)
    return sorted(((r.row.doc_id, r.text, r.n_lines, sum(x.end - x.start for x in r.runs or [])) for r in got), key=str)


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        r = random.Random(seed)
        lines = ["", "a b c", "d e", "f", "", "g h i j k", "l m n o p q r s", " t  u "]
        rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.8 else f"own {i} {j}" for j in range(r.randrange(0, 25)))) for i in range(60)]
        rows += [(70, None), (71, ""), (72, rows[5][1]), (73, rows[5][1]), (None, rows[6][1]), (74, "\n\n\n")]
        assert run(spark, rows, 7) == brute(rows, 7)


def test_long_single_lines_a_hot_line_and_repeats_inside_a_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"head {i}\n{long}\ncommon line\ntail {i}") for i in range(100)]
    rows += [(200, "\n".join([long] * 5)), (201, "common line\n" * 300), (201, "x " * 100_000)]
    got = run(spark, rows, 50)
    assert got == brute(rows, 50)
    assert [x for x in got if x[0] == 0] == [(0, rows[0][1], 4, 0)]
    assert [x for x in got if x[0] == 200] == [(200, "", 5, 5)]


def test_empty_table_and_nothing_repeated(spark):
    assert run(spark, [], 50) == []
    assert run(spark, [(1, "a\nb"), (2, "c")], 1) == [(1, "a\nb", 2, 0), (2, "c", 1, 0)]
