"""Copies of libraries planted among thousands of files that share words and forms but no code."""

import random
import re

from loomfacts.llm import handwritten as H

WORDS = [a + b for a in ("load", "merge", "walk", "bind", "rank", "split", "emit", "fold") for b in ("Span", "Queue", "Label", "Edge", "Shard", "Token", "Guard", "Fact")]


def body(rng, n):
    out = []
    for _ in range(n):
        a, b, c = (rng.choice(WORDS) for _ in range(3))
        out.append(rng.choice([f"const {a} = {b}.{c}({rng.randrange(99)}, '{a}');", f"if ({a} < {b}) {{ return {c}; }}", f"for (const {a} of {b}) {{ {c}.push({a}); }}", f"while ({a}({b})) {{ {c}++; }}", f"{a} = {b} || {c};", f"throw new {a}('{b} {c}');"]))
    return [f"function {rng.choice(WORDS)}{rng.randrange(999)}({rng.choice(WORDS)}) {{", *out, "}"]


def text(rng, functions=4):
    return "\n".join(line for _ in range(functions) for line in body(rng, rng.randint(6, 14)))


def renamed(source, rng):
    words = sorted(set(re.findall(r"(?<!\.)\b[a-z]+[A-Z]\w*", source)))
    new = dict(zip(words, (f"own{i}Name" for i in rng.sample(range(9999), len(words)))))
    return re.sub(r"(?<!\.)\b[a-z]+[A-Z]\w*", lambda m: new[m.group()], source)


def test_planted_copies(spark):
    rng = random.Random(4)
    repos = [(f"r{i}", f"owner{i // 2}") for i in range(20)]
    files = [(i, f"r{i % 20}", f"src/a{i}.js", text(rng)) for i in range(3000)]
    library = [text(rng, 8) for _ in range(6)]
    planted = {}
    for k, source in enumerate(library):
        for j in range(5):
            i = 10_000 + k * 10 + j
            lines = source.split("\n")
            if k < 2:
                copy = source
            elif k < 4:
                copy = "// own head\n" + renamed(source, rng)
            else:  # one statement changed, one put in
                at = rng.randrange(2, len(lines) // 4)
                lines[1] = f"const own{j} = 1;"
                copy = "\n".join(lines[:at] + [f"mine{j}(2);"] + lines[at:])
            planted[i] = k
            files.append((i, f"r{j * 3}", f"src/b{i}.js", copy))
    same_owner = text(rng, 6)
    files += [(20_000 + j, f"r{j}", f"src/c{j}.js", same_owner) for j in range(2)] + [(30_000, "r1", "x.js", None), (30_001, "r1", "y.js", ""), (30_002, "r2", "z.js", "/* open")]
    d = spark.createDataFrame(files, "id long, repo_id string, relative_path string, source string")
    got = H.not_handwritten(d, spark.createDataFrame(repos, "repo_id string, owner string")).collect()
    copied = {r["id"] for r in got if r["copied"]}
    assert copied == set(planted)
    assert all(r["third_party"] and r["copied_share"] >= H.MIN_SHARE for r in got if r["copied"])


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(5)
    streams = [H.code_tokens(text(rng, k)) for k in (0, 1, 3, 1, 6)] + [["a"] * 13, ["a", "b"] * 40]
    together = [sorted(p.tolist()) for p in H.fingerprints(streams)]
    assert together == [sorted(H.fingerprints([s])[0].tolist()) for s in streams]
    assert H.fingerprints([[], ["x"] * 3])[1].tolist() == []


def test_open_comments_and_strings_are_code():
    assert H.code_tokens("a /* b */ c // d\n`e` /* f") == ["a", "c", "`e`", "/", "*", "f"]
    assert H.code_tokens("x `y z") == ["x", "`", "y", "z"]
    assert H.code_tokens("x // a */ /* q\n b") == ["x", "b"]
