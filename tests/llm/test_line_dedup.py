import random

from pyspark.sql import functions as F

from metricloom.llm import line_dedup as ld


def brute(rows, window=3, long_words=50):
    """Rows of (doc_id, text) without equal rows, in the order of first occurrences; texts without repeated runs."""
    out, first = {}, {}
    for key, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        body = [lines[i].strip(" \t\n\x0b\f\r") for i in full]
        gone = set()
        runs = [(s, window) for s in range(len(body) - window + 1)]
        runs += [(s, 1) for s, x in enumerate(body) if len(x.split()) >= long_words]
        for start, size in runs:
            run = (size, *body[start : start + size])
            at = first.setdefault(run, (key, start))
            if at[0] != key or at[1] + size <= start:
                gone |= set(range(start, start + size))
        drop = {full[i] for i in gone}
        text = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out[key] = (len(full), len(drop), text)
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = [f"line {i}" for i in range(25)] + ["", "  ", "same", " same\t", " ".join(f"w{i}" for i in range(60))]
    block = [f"block {i}" for i in range(6)]
    rows = []
    for i in range(80):
        text = rng.choices(lines, k=rng.randrange(0, 14))
        if i % 3 == 0:
            a = rng.randrange(4)
            text[3:3] = block[a : a + rng.randrange(2, 6)]
        rows.append((i, "\n".join(text)))
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(["echo"] * 9)), (204, "\n".join(["w " * 70] * 3))]


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, lines string, n_removed int")
        got = ld.drop_repeats(docs)
        assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == brute(sorted(rows))
        assert got.columns == ["doc_id", "text", "lines", "n_removed", "n_lines"]


def test_echo_keeps_its_first_run(spark):
    docs = spark.createDataFrame([(1, "\n".join(["echo"] * 9))], "doc_id long, text string")
    assert ld.drop_repeats(docs).first().text == "echo\necho\necho"


def test_repeated_rows_and_missing_ids(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text), (1, text), (None, text), (2, text + "\ne"), (2, None)]
    got = ld.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", ""), ("1", ""), ("2", "None"), ("2", "e"), ("None", text)]
    assert ld.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_runs_share_a_fingerprint(spark):
    """What winnowing promises: every window has a fingerprint, and equal windows have the same one."""
    docs = spark.createDataFrame([r for r in corpus(3) if r[1]], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    rows = ld.seeds(docs, 3, 50).filter("size = 3").collect()
    by_window = {}
    for r in rows:
        by_window.setdefault(r.hash, set()).add(r.mark)
    assert all(len(marks) == 1 for marks in by_window.values())
    assert sum(r.new for r in rows) < len(rows)


def brute_words(rows, run_words, window=3):
    """As ``brute``, where runs of fewer lines count from ``run_words`` words on."""
    out, first = {}, {}
    for key, text in rows:
        body, gone = text.split("\n"), set()
        runs = [(s, size) for size in range(1, window + 1) for s in range(len(body) - size + 1)]
        for start, size in runs:
            run = tuple(body[start : start + size])
            if size == window or sum(len(x.split()) for x in run) >= run_words:
                at = first.setdefault(run, (key, start))
                if at[0] != key or at[1] + size <= start:
                    gone |= set(range(start, start + size))
        out[key] = (len(body), len(gone), "\n".join(x for i, x in enumerate(body) if i not in gone))
    return out


def test_short_runs_count_by_words(spark):
    """Passages of one and two lines: 30 + 30 words, a copied two-line document, a line before a long one, boilerplate."""
    rng = random.Random(5)

    def line(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    a, b, boiler, long = line("a", 30), line("b", 30), line("boiler", 12), line("long", 60)
    rows = [(i, f"{line(f'x{i}_', 9)}\n{a}\n{b}\n{line(f'y{i}_', 9)}") for i in range(4)]
    rows += [(10 + i, f"{line('c', 26)}\n{line('d', 25)}") for i in range(5)]
    rows += [(20 + i, f"{line('e', 3)}\n{long}\n{boiler}") for i in range(3)] + [(30, boiler), (31, f"{boiler}\n{line('z', 8)}")]
    pool = [line(f"p{i}_", rng.randrange(1, 40)) for i in range(12)]
    rows += [(40 + i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for run_words in (50, 5):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in ld.drop_repeats(docs, run_words=run_words).collect()}
        assert got == brute_words(rows, run_words)
        assert [got[i][1] for i in (0, 1, 2, 3)] == [0, 2, 2, 2] and [got[i][1] for i in (10, 11, 14)] == [0, 2, 2]
    assert got[30][2] == "" and got[31][2] == line("z", 8)
