import random

from tidemark.llm.linededup import dedup_lines, line_anchors, line_chunks

PASSAGE = [f"line {i} of the passage that many documents share with each other" for i in range(8)]
LONG = " ".join(f"word{i}" for i in range(60))


def run(spark, rows):
    return {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_chunks_cover_every_line_once_and_resist_shifts():
    lines = [f"alpha {i} beta gamma" for i in range(200)]
    a = line_chunks("\n".join(lines).encode())
    assert [s for s, n, _ in a for s in range(s, s + n)] == list(range(200))
    b = line_chunks("\n".join(["inserted line here", *lines]).encode())
    ends = {s + n for s, n, _ in a}
    assert len(ends & {s + n - 1 for s, n, _ in b}) >= len(ends) - 2


def test_passages_go_from_all_but_the_first(spark):
    own = lambda k: [f"own {k} {i} line with its very own words" for i in range(3)]
    rows = [(k, "\n".join([*own(k), *PASSAGE, *own(k + 100), LONG, f"end {k}"])) for k in range(1, 9)]
    got = run(spark, rows)
    assert got[1].text == rows[0][1] and got[1].n_removed_lines == 0 and got[1].kept_in == []
    for k in range(2, 9):
        assert got[k].text.split("\n") == [*own(k), *own(k + 100), f"end {k}"]
        assert got[k].n_removed_lines == 9 and 1 in got[k].kept_in


def test_edges(spark):
    copy = "\n".join(PASSAGE)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, copy), (4, copy), (5, copy + "\n"), (None, "short\nlines\nhere"), (7, "short\nlines\nhere"), (8, LONG + "\n" + LONG)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept_in string, th int")
    got = dedup_lines(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[3].text == "\n\n"
    assert [r.text for r in got if r.doc_id == 4] == [copy, copy] and by[5].text == ""
    assert by[7].text == "short\nlines\nhere"  # under twelve words
    assert by[8].text == LONG
    assert dedup_lines(df.limit(0)).count() == 0


def test_clean_documents_keep_their_bytes(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    before = {r[0]: r[1] for r in df.collect()}
    for r in dedup_lines(df).collect():
        if r.n_removed_lines == 0:
            assert r.text == before[r.doc_id]
        else:
            left = iter(before[r.doc_id].split("\n"))
            assert all(line in left for line in (r.text.split("\n") if r.text else []))


def test_short_passages_go_whole_in_any_surroundings(spark):
    rnd = random.Random(3)
    for n_lines, n_words in [(2, 28), (2, 6), (3, 9), (4, 13), (6, 9), (1, 30)]:
        rows, passages = [], {}
        for k in range(0, 80, 2):
            passages[k] = [" ".join(f"p{n_lines}x{k}x{i}x{j}" for j in range(n_words)) for i in range(n_lines)]
            if n_lines > 2:
                passages[k][-1] = f"end {k}"
            for d in (k, k + 1):
                around = [[" ".join(f"o{rnd.random()}" for _ in range(rnd.randint(1, 20))) for _ in range(rnd.randint(0, 5))] for _ in range(2)]
                rows.append((d, "\n".join([*around[0], *passages[k], *around[1]]), around[0] + around[1]))
        got = run(spark, [r[:2] for r in rows])
        for d, text, around in rows:
            assert got[d].text == ("\n".join(around) if d % 2 else text), (n_lines, n_words, d)
            assert got[d].kept_in == ([d - 1] if d % 2 else [])


def test_every_line_of_a_passage_has_an_anchor_inside_it():
    rnd = random.Random(4)
    for _ in range(300):
        counts = [rnd.choice([0, 1, 2, 3, 6, 11, 12, 29, 30, 40]) for _ in range(rnd.randint(1, 9))]
        got = set(line_anchors("\n".join(" ".join(["w"] * n) for n in counts).encode()))
        full = [i for i, n in enumerate(counts) if n]
        good = lambda a, b: sum(1 for n in counts[a : b + 1] if n) > 1 and sum(counts[a : b + 1]) >= 12 or max(counts[a : b + 1]) >= 30
        for a in full:
            for b in full:
                if a <= b and sum(1 for n in counts[a : b + 1] if n) > 1 and good(a, b):
                    inside = {x for s, n in got if a <= s and s + n - 1 <= b for x in range(s, s + n)}
                    assert inside >= {i for i in range(a, b + 1) if counts[i]}, (counts, a, b)


def test_overlapping_repeats_keep_one(spark):
    line = "six words stand in this line"
    got = run(spark, [(1, "\n".join([line] * 10)), (2, "\n".join(["first", line, "", line, line, "last"]))])
    assert got[1].text == "\n".join([line] * 2) and got[2].text == "first\nlast"


def brute_dedup(rows):
    """Lines that stay, by trying every passage that starts or ends at each line, and the chunks."""
    spans = {}
    for d, text in rows:
        lines = [x.strip() for x in (text or "").encode().split(b"\n")]
        words, own = [len(x.split()) for x in lines], set()
        full = [i for i, x in enumerate(lines) if x]
        passage = lambda a, b: sum(1 for i in full if a <= i <= b) > 1 and sum(words[a : b + 1]) >= 12 or a == b and words[a] >= 30
        for k, i in enumerate(full):
            own |= {(i, j) for j in [next((j for j in full[k:] if passage(i, j)), None)] if j is not None}
            own |= {(j, i) for j in [next((j for j in reversed(full[: k + 1]) if passage(j, i)), None)] if j is not None}
        for s, n, w in line_chunks((text or "").encode()):
            inside = [i for i in full if s <= i < s + n]
            if w >= 12:
                own.add((inside[0], inside[-1]))
        for a, b in own:
            spans.setdefault(b"\n".join(x for x in lines[a : b + 1] if x), []).append((d, a, b))
    gone = {d: set() for d, _ in rows}
    for places in spans.values():
        first = min(places)
        for d, a, b in places:
            if (d, a, b) != first:
                gone[d] |= set(range(max(a, first[2] + 1) if d == first[0] else a, b + 1))
    return {d: [x.strip() for i, x in enumerate((text or "").split("\n")) if x.strip() and i not in gone[d]] for d, text in rows}


def test_equals_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(12)
    lines = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([1, 3, 6, 14, 31]))) for _ in range(30)] + ["", "  "]
    rows += [(5000 + i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14)))) for i in range(120)]
    got = {r.doc_id: [x.strip() for x in (r.text or "").split("\n") if x.strip()] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_dedup(rows)
