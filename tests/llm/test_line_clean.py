from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm.line_clean import clean_lines

SF = "/root/testdata/sf0.001"


def test_counts_equal_plain_python(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_line_first_cleaning"](spark, SF).collect()}
    docs = queries.read(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        for k, v in brute.line_counts(d.text).items():
            assert got[d.doc_id][k] == v, (d.doc_id, k)


def test_edge_cases(spark):
    body = " ".join(f"word{i}" for i in range(30)) + "."
    rows = [
        (1, None), (2, ""), (3, " \n\t\n"), (4, body), (5, body + "\nHome | About | Help | More\n" + body),
        (6, " ".join(["same"] * 40) + "."), (7, "\n".join(f"a{i}$$$ b{i}%%% c{i}&&& d{i}***" for i in range(10))),
        (8, (body + "\n") * 3), (9, "a b c\x1fd" + " x" * 30 + "."), (10, "é" * 50_000 + " ü"),
    ]
    df = spark.createDataFrame([(i, t, "keep me") for i, t in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r for r in clean_lines(df).collect()}
    for i, t in rows:
        for k, v in brute.line_counts(t).items():
            assert got[i][k] == v, (i, k)
    assert {i: got[i].kept for i, _ in rows} == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: False, 9: False, 10: False}
    assert got[5].clean_text == body and got[4].clean_text == body and got[8].clean_text == body + "\n" and got[4].line == "keep me"
    assert clean_lines(df.limit(0)).count() == 0


def test_window_edges(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60)))) for i in range(200)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i].n_repeat_words == brute.line_counts(t)["n_repeat_words"]


def test_verdict_equals_plain_python(spark):
    import random

    rnd = random.Random(6)
    lines = ["", " ", "Home | About | Help", "A line of more than ten words that ends in no sign at all here", "Short one.", "no end", "a $$ b %% c", "WOW!! NOW!! YES!!", "All rights reserved.", "---", "x » y » z", "日本語。"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(12)))) for i in range(200)]
    rows += [(1000 + d.doc_id, d.text) for d in queries.read(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=3).collect()}
    for i, t in rows:
        text, left, _ = brute.cleaned(t)
        assert (got[i].clean_text, got[i].n_kept_words) == (text, left), i
        assert got[i].kept == (not got[i].base_failed and 2 * left >= got[i].n_words)
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op9_line_first_cleaning"](spark, SF).collect()}
    assert all(kept[i - 1000] == brute.cleaned(t)[2] for i, t in rows if i >= 1000)


def test_many_lines_of_which_one_repeats(spark):
    """The time grows with the number of lines: 120,000 lines would not end in a square of it."""
    lines = [f"This is line {i}, and it is long enough to stay in the text of the page." for i in range(120_000)]
    lines[60_000] = lines[5]
    got = clean_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert got.n_dup_lines == 1 and got.clean_text == "\n".join(lines[:60_000] + lines[60_001:])
