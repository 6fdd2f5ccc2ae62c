"""The hunk and file rules against a plain statement of them, on random patches."""

import random
import re

from pyspark.sql import functions as F

from hunkmill.functions import files, identity, pytext
from hunkmill.operators import hunks

CODE = re.compile(r"[A-Za-z_{}();=\[\].]")

CASES = {
    "@@ -1 +1 @@\n+x = 1\n+y = 2": ["x = 1\ny = 2"],
    "+a()\n ctx\n+b()": ["a()", "b()"],
    "+a()\n+++ b/f\n+b()": ["a()\nb()"],
    "+++i;\n+j": ["j"],
    "+\n+   ": [],
    "+\n+z\n+": ["z"],
    "+日本語": [],
    "-old\n\\ No newline at end of file\n+new": ["new"],
    "": [],
    "+a\r\n+b\x0b+c -d\n+e": ["a\nb\nc", "e"],
}


def runs(patch):
    """Maximal runs of added lines, by grouping neighbouring lines of one kind."""
    kinds = [(line[:1] == "+", line[1:]) for line in patch.splitlines()
             if not line.startswith("+++")]
    groups, last = [], False
    for added, text in kinds:
        if added and last:
            groups[-1].append(text)
        elif added:
            groups.append([text])
        last = added
    snippets = ["\n".join(group).strip("\n") for group in groups if CODE.search("".join(group))]
    return [(s, sum(bool(x.strip()) for x in s.split("\n")), len(s)) for s in snippets]


def spark_hunks(spark, patches):
    rows = spark.createDataFrame(list(enumerate(patches)), "id long, patch string")
    found = {i: [] for i in range(len(patches))}
    for row in hunks.explode_hunks(rows).orderBy("id", "hunk_index").collect():
        assert row.hunk_index == len(found[row.id])
        found[row.id].append((row.snippet, row.line_count, row.char_count))
    return [found[i] for i in range(len(patches))]


def test_hunk_cases(spark):
    got = spark_hunks(spark, list(CASES))
    assert [[h[0] for h in found] for found in got] == list(CASES.values())


def test_null_patch(spark):
    rows = spark.createDataFrame([(1, None)], "id long, patch string")
    assert hunks.explode_hunks(rows).count() == 0


def test_random_patches(spark):
    rng = random.Random(7)
    pieces = ["+", "+", "+x", "+ y = 1", "+++", "+++ b/f.py", "-z", " c", "@@ -1 @@", "", "+\t",
              "+(", "+é", "+9", "+\x1f", "+ "]
    ends = ["\n"] * 12 + ["\r\n", "\r", "\x0b", "\x1c", "\x85", " "]
    patches = ["".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randrange(15)))
               for _ in range(1500)]
    assert spark_hunks(spark, patches) == [runs(p) for p in patches]


def file_sections(text):
    """(name, patch) of every section with a usable header."""
    lines = text.splitlines()
    heads = [i for i, line in enumerate(lines) if line.startswith("diff --git ")]
    for start, stop in zip(heads, [*heads[1:], len(lines)]):
        words = lines[start].split()
        if len(words) < 4 or not words[3].startswith("b/"):
            continue
        later = [line[6:] for line in lines[start + 1:stop] if line.startswith("+++ b/")]
        name = (later or [words[3][2:]])[-1]
        if name:
            yield name, "\n".join(lines[start:stop])


def test_random_file_sections(spark):
    rng = random.Random(11)
    pieces = ["diff --git a/x b/x", "diff --git a/x  b/y.py extra", "diff --git a/x y b/z",
              "diff --git a/x", "diff --git a/x b/", "+++ b/new.py", "+++ b/", "+++ /dev/null",
              "+x", "", " c", "From: me", " diff --git a/q b/q"]
    texts = ["".join(rng.choice(pieces) + "\n" * rng.choice([1, 1, 1, 2])
                     for _ in range(rng.randrange(12))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, patch_text string")
    found = {i: [] for i in range(len(texts))}
    for row in hunks.split_files(rows).orderBy("id", "file_index").collect():
        found[row.id].append((row.filename, row.patch))
    assert [found[i] for i in range(len(texts))] == [list(file_sections(x)) for x in texts]


def test_file_categories(spark):
    expected = {
        "latest_release.py": "test", "test/foo.py": "source", "x/docs/i.py": "docs",
        "docs/index.py": "source", "LICENSEService.java": "docs", ".github/x.py": "config",
        "yarn.lock": "lockfile", ".gitignore": "source", "a\\Tests\\b.py": "test",
        "x/spec/y.rb": "test", "a.tar.gz": "source", "b.JSON": "config", "pkg/README": "docs",
    }
    rows = spark.createDataFrame([(k,) for k in expected], "f string")
    got = rows.select("f", files.category(F.col("f")).alias("c")).collect()
    assert {r.f: r.c for r in got} == expected


def test_languages_and_exclusion(spark):
    rows = spark.createDataFrame(
        [("A.JAVA", "Go"), ("x", "Go"), ("x", ""), ("x", None), ("d.h", None), ("..py", None),
         (".py", None), ("a/node_modules/b.ts", None)], "f string, l string")
    got = rows.select(files.language(F.col("f"), F.col("l")), files.is_excluded(F.col("f")))
    assert [tuple(r) for r in got.collect()] == [
        ("Java", False), ("Go", False), ("Unknown", False), ("Unknown", False),
        ("C/C++ Header", False), ("Python", False), ("Unknown", False), ("TypeScript", True),
    ]


def test_repo_urls(spark):
    given = [None, "", " https://api.github.com/repos/a/b.git ", "https://github.com/a/b.git.git",
             "https://x.org/a", "http://github.com/a/github.com/b"]
    rows = spark.createDataFrame([(x,) for x in given], "u string")
    got = rows.select(identity.repo_url(F.col("u")), identity.repo_full_name(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [
        (None, None), (None, None), ("https://github.com/a/b", "a/b"),
        ("https://github.com/a/b.git", "a/b.git"), ("https://x.org/a", None),
        ("http://github.com/a/github.com/b", "a/github.com/b"),
    ]


def test_bots(spark):
    rows = spark.createDataFrame(
        [("Ann", None), (None, None), ("", "x[BOT]"), ("GitHub", "Actions"), ("Claudette", "")],
        "a string, b string")
    got = rows.select(identity.is_bot(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [False, False, True, False, True]


def test_python_text_rules(spark):
    texts = ["  a  b\n\tc\x1f ", "", "   ", "x", " y　z\x85"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    x = F.col("x")
    got = rows.orderBy("i").select(
        pytext.strip(x), pytext.words(x), pytext.word_count(x), pytext.one_space(x)).collect()
    assert [tuple(r) for r in got] == [
        (t.strip(), t.split(), len(t.split()), " ".join(t.split())) for t in texts]


def test_trim_and_cut(spark):
    pairs = [("a b  c", "x y"), ("", "q w"), ("one", "two three")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    left, right = pytext.trim_to_shorter(F.col("a"), F.col("b"))
    for (a, b), row in zip(pairs, rows.select(left, right).collect()):
        n = min(len(a.split(" ")), len(b.split(" ")))
        assert tuple(row) == (" ".join(a.split(" ")[:n]), " ".join(b.split(" ")[:n]))
    cut = rows.select(pytext.cut_at_occurrence(F.lit("Q: a Q: b Q: c"), "Q:", 2)).first()[0]
    assert cut == "Q: a "
