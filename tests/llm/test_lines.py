import random
import re

from gaugeline.llm import line_templates as lt

from .cases import documents, prose, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def masked(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))


def brute(rows, documents=3, depth=3, least=3, similar=0.8, leaders=None):
    """Line numbers to drop for each row, one line after another."""
    leaders = leaders or {}
    found = {}
    for doc, text in rows:
        for line in {masked(x) for x in (text or "").split("\n")} if doc not in leaders else ():
            if len(line) >= least and 2 * line.count("<*>") <= len(line):
                found.setdefault(line, []).append(doc)
    leaves = {}
    for line, docs in found.items():
        leaves.setdefault((len(line), line[:depth]), []).append((line, docs))
    first = {}
    for members in leaves.values():
        groups = []  # [fixed places, lines, documents]
        members.sort(key=lambda m: -len(m[1]))
        for line, docs in members:
            best = max(groups, key=lambda g: sum(line[i] == w for i, w in g[0].items()), default=None)
            if best and sum(line[i] == w for i, w in best[0].items()) >= similar * len(line):
                best[0] = {i: w for i, w in best[0].items() if line[i] == w}
                best[1].append(line)
                best[2].extend(docs)
            else:
                groups.append([dict(enumerate(line)), [line], list(docs)])
        for _, lines, docs in groups:
            if len(docs) >= (documents if len(lines[0]) < 50 else 2) and any(d is not None for d in docs):
                for line in lines:
                    first[line] = min(d for d in docs if d is not None)
    return [(doc, [i for i, x in enumerate((text or "").split("\n")) if masked(x) in first and first[masked(x)] != leaders.get(doc, doc)]) for doc, text in rows]


def test_recurring_lines_go_from_all_but_the_first_document(spark, tmp_path):
    shared = prose(901, 60).replace("1", "i")
    extra = []
    for i in range(40):
        lines = [prose(2000 + i, 25), f"user {i} logged in from host {i * 7}", prose(3000 + i, 12)]
        if i % 2:
            lines.insert(1, shared)
        if i % 5 == 0:
            lines += ["Subscribe to our letter now", "", "Subscribe to our letter now"]
        if i % 4 == 0:
            lines.append(f"Posted by {['ann', 'bob', 'cy', 'dee'][i % 16 // 4]} under general news in this site today yes")
        extra.append((5000 + i, "\n".join(lines)))
    extra += [(7000, "a b c d\r\n1 2 3 4\n5 6 7 x"), (7001, "a b c d\n1 2 3 4\n5 6 7 x"), (7002, "a b c d\r\n9 9 9 9\n7 6 7 x"), (7003, "")]
    docs = documents(spark, extra)
    path = saved(docs, tmp_path)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for (doc, text), (_, gone) in zip(rows, brute(rows)):
        lines = (text or "").split("\n")
        want.append((doc, sum(bool(WORD.search(x)) for x in lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text))
    got = [tuple(r) for r in lt.query(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 60
    read = spark.read.parquet(f"{path}/documents.parquet")
    assert lt.cleaned(read).columns == read.columns
    assert lt.drop_recurring(read.limit(0)).count() == 0


def test_verdicts_do_not_depend_on_what_else_is_in_the_leaf(spark):
    """Six lines of which 14 of 15 tokens are equal, among as many others of their leaf."""
    r = random.Random(9)
    alike = [(i, f"alpha beta gamma one two three four five {w} six seven eight nine ten eleven") for i, w in enumerate("uvwxyz")]
    for others in (50, 2500):
        rest = [(100 + i, "alpha beta gamma " + " ".join(r.choice("abcdefghijklmnopqrst") * 2 for _ in range(12))) for i in range(others)]
        docs = spark.createDataFrame(alike + rest, "doc_id long, text string")
        got = [(x["doc_id"], x["n_dropped"]) for x in lt.drop_recurring(docs).collect()]
        assert sorted(d for d, n in got if n) == [1, 2, 3, 4, 5]
        want = [d for d, gone in brute(alike + rest) if gone]
        assert want == [1, 2, 3, 4, 5]


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    often = "this line stands in many documents"
    nine = [(9, f"{often}\nalpha beta gamma delta\n{often}"), (9, f"keep this line always please\n{often}\nother words stand here now"), (9, "nothing of this recurs anywhere")]
    docs = [(i, often) for i in range(3)] + [(None, f"no id has this\n{often}"), (None, "no id has that")]
    got = sorted((x["doc_id"] or 0, x["row"]["text"]) for x in lt.drop_recurring(spark.createDataFrame(nine + docs, "doc_id long, text string")).collect())
    assert got == sorted([(9, "alpha beta gamma delta"), (9, "keep this line always please\nother words stand here now"), (9, nine[2][1]), (0, often), (1, ""), (2, ""), (0, "no id has this"), (0, "no id has that")])


def test_two_documents_make_long_lines_recurring(spark):
    word = lambda i: f"{'abcdefghij'[i % 10]}{'klmnopq'[i // 10 % 7]}"
    long_, edited = [word(i) for i in range(60)], [word(i) if i % 12 else f"x{word(i)}" for i in range(60)]
    short = "a short line stays in two"
    rows = [(i, f"its own {i}\n{' '.join([*long_[:3], *t[3:]])}\n{short}") for i, t in enumerate([long_, edited])]
    got = {x["doc_id"]: x["row"]["text"] for x in lt.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: f"its own 1\n{short}"}


def test_copies_of_a_document_are_left_whole(spark):
    shared = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopq'[i // 10]}" for i in range(60))
    own = [prose(i, 150).replace("1", "i") for i in range(3)]
    rows = [(1, f"{own[0]}\n{shared}"), (2, f"{own[1]} {shared}"), (3, f"{own[1]} {shared} end"), (4, f"{own[1]} {shared}"), (5, own[2]), (6, own[2] + " changed"), (7, own[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["row"]["text"] for x in lt.drop_recurring(docs, copies=80).collect()}
    assert got == dict(rows) | {2: own[1], 3: f"{own[1]} end", 4: own[1]}
    every = {x["doc_id"]: x["row"]["text"] for x in lt.drop_recurring(docs).collect()}
    assert every == dict(rows) | {2: own[1], 3: "end", 4: "", 6: "changed", 7: ""}


def test_templates_do_not_depend_on_how_leaves_are_dealt(spark):
    r = random.Random(5)
    rows = [(i, f"alpha beta gamma {w} one two three four five six") for i, w in enumerate("abcdefghijklmnop")]
    rows += [(100 + i, "alpha beta gamma " + " ".join(r.choice("uvw") for _ in range(7))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = lt.materialize(lt.parsed(docs))
    whole, dealt = ({(x["signature"], x["first_doc"]) for x in lt.recurring(lines, crowd=crowd).collect()} for crowd in (10**9, 4))
    assert whole == dealt
    got = {x["doc_id"]: x["n_dropped"] for x in lt.drop_recurring(docs, crowd=4).collect()}
    assert [got[i] for i in range(16)] == [0] + [1] * 15


def test_long_lines_share_templates(spark):
    shared = [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(45)]
    # 46 words are too few for a passage
    rows = [(i, " ".join([*shared[:30], name, *shared[30:]]) + f"\n{name} alone") for i, name in enumerate(["ann", "bob", "cy", "dee"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_dropped"], x["row"]["text"]) for x in lt.drop_recurring(docs).collect()}
    assert got == {0: (0, rows[0][1]), 1: (1, "bob alone"), 2: (1, "cy alone"), 3: (1, "dee alone")}


def test_passages_inside_lines_go(spark):
    names = [a + b for a in "abcdefghij" for b in "klmnop"]
    shared, short = " ".join(names), " ".join(names[:48][::-1])
    rows = [(i, f"{'pqrs'[i]}x begins {shared} ends {'pqrs'[i]}y\nsecond {'pqrs'[i]} {short} line {'pqrs'[i]}z") for i in range(3)]
    rows.append((9, "\n".join([f"its own {names[7]}", " ".join(names[:30]), " ".join(["of", *names[30:], "more"])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["row"]["text"] for x in lt.drop_recurring(docs).collect()}
    want = {i: t.replace(f"{shared} ", "") if i in (1, 2) else t for i, t in rows}
    assert {i: got[i] for i in (0, 9)} == {i: want[i] for i in (0, 9)}
    assert [got[i].split("\n")[0] for i in (1, 2)] == ["qx qy", "rx ry"]
    assert [short in got[i] for i in range(3)] == [True] * 3


def test_passages_equal_brute_force(spark):
    """Windows of 50 words, by comparing all texts: runs, edges of passages, repeats within a text."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (55, 90, 140)]
    rows = []
    for i in range(30):
        text = [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 50)
            text += p[a : r.randint(a + 45, len(p))] + [word() for _ in range(r.randint(0, 8))]
        rows.append((i, " ".join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1])]
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] != i:
                gone |= set(range(k, k + 50))
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    got = {x["doc_id"]: x["row"]["text"] for x in lt.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: " ".join(t.split()) for i, t in got.items()} == want
    assert sum(want[i] != t for i, t in rows) > 10
