"""Hand-written detection, encoding, mixing and residue."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomfacts.llm import encode as E
from loomfacts.llm import handwritten as H
from loomfacts.llm import residue as R
from loomfacts.llm.mix import mix, quotas, split_blocks

SPECIAL = ["", None, "a", " ", "\n\n x", "<|endoftext|>", "don't we'LL", "日本語 テキスト", "é" * 50, "=" * 5000, "ab" * 4000, "\r\n \t x", "\u3000x\u2028y", "12 345 ½ ²", "👍🏽 ok\u200d", "a\u0301b", "x" * 20 + " " * 300 + "y"]


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=E.load_ranks(E.VOCABULARY), special_tokens={})


def test_encoding_equals_library(spark):
    rng = random.Random(1)
    words = ["the", "theory", "them", "re", "report", "reporting", "ünder", "x1", "==", "\n", "ー", "{}", "snake_case", "CamelCase"]
    texts = SPECIAL + ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    lib = reference()
    want = [lib.encode_ordinary(t) if t else [] for t in texts]
    assert E.encode_texts(texts) == want
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in E.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert E.encode(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in E.token_counts(df).collect()} == {i: len(w) for i, w in enumerate(want)}


def test_shared_prefixes_are_kept():
    e = E.PrefixEncoder(E.load_ranks(E.VOCABULARY))
    words = sorted({w.encode() for w in ["report", "reports", "reporting", "reporter", "rep", "zz"]})
    assert list(e.encode_sorted(words)) == [e.merge(w) for w in words]


def test_quotas():
    sizes, targets = {"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.25, 4), "gone": (0.25, 2), "zero": (0.0, 1)}
    q = quotas(sizes, targets)
    assert (q["b"].tokens, q["b"].passes, q["b"].rest) == (40, 4, 0) and q["a"].tokens == 80 and set(q) == {"a", "b"}
    big = quotas(sizes, targets, total=3000)
    assert big["b"].tokens == 40 and big["a"].tokens == 1000
    assert quotas({}, targets) == {}


def test_split_blocks():
    have = {"a": 100, "b": 7, "c": 1}
    parts = split_blocks(have, 13, 5)
    assert {s: sum(p[s] for p in parts) for s in have} == have
    whole = [sum(p.values()) for p in parts]
    assert max(whole) - min(whole) <= 1
    assert split_blocks(have, 13, 5) == parts
    # The first of two shards draws 20 of 40 blocks without replacement: mean 15 and variance 75 / 39 of a.
    drawn = [split_blocks({"a": 30, "b": 10}, 2, seed)[0]["a"] for seed in range(3000)]
    mean = sum(drawn) / len(drawn)
    assert abs(mean - 15) < 0.1 and abs(sum((x - mean) ** 2 for x in drawn) / len(drawn) - 75 / 39) < 0.2


def docs(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["small", "mid", None, "other"])
        text = rng.choice(["same text again", None, ""]) if rng.random() < 0.05 else " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(999)) for _ in range(rng.randint(3, 12)))
        rows.append((i, text, source, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")


def test_mix(spark):
    d = docs(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(d, targets, shards=5)
    got = mixed.collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    most = {"big": 1, "small": 3, "mid": 2}
    uses = Counter(text[r["doc_id"]] for r in got)
    for r in got:
        assert r["source"] == source[r["doc_id"]] and uses[text[r["doc_id"]]] <= most[r["source"]]
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    whole = sum(r["n_tokens"] for r in got)
    longest = max(r["n_tokens"] for r in got)
    for r in report.collect():
        mine = sum(x["n_tokens"] for x in got if x["source"] == r["source"])
        assert r["mixed_tokens"] == mine and abs(mine - r["target_share"] * whole) <= 4 * longest
    shards = Counter(r["shard"] for r in got)
    assert len(shards) == 5 and max(shards.values()) < 2 * min(shards.values())
    empty, shares = mix(d.limit(0), targets)
    assert empty.count() == 0 and all(r["reached_share"] == 0 for r in shares.collect())


GENERATED = ["// Code generated by x; DO NOT EDIT.\npackage a\n", "/*\n * This file was automatically generated by y.\n */\nlet a\n", "let a\n\n// @generated by z from q.schema\n", "// Diese Datei wurde automatisch erzeugt (x). Nicht bearbeiten.\nlet a\n", "".join(f"export const A_{i} = {i};\n" for i in range(40, 60))]
PLAIN = [
    "// f skips files marked @generated and anything below vendor/.\nconst m = [\"@generated\"];\n", "// This file is maintained by hand; the generated twin lives elsewhere.\nlet a\n", "/* Ids are generated once per run, then edited. */\nlet a\n", 'out.push("// Code generated by " + tool + ". DO NOT EDIT.");\n',
    "// Copyright 2022 Own Co. All rights reserved.\nlet a\n", "// Adapter around lib; the library itself (MIT) is fetched at install time.\nlet a\n", "const weights = [1, 2, 3, 4];\nfunction f(a) {\n  return a + 1;\n}\n", 'const help = "' + "some words of a long help text " * 40 + '";\nexport function f() {\n  return help;\n}\n', "",
]
FOREIGN = ["// Copyright 2015 Other Project. All rights reserved.\nlet a\n", "/*!\n * lib v1.2.3\n * (c) The Others\n */\nlet a\n", "// Copied from lib 1.2.3, do not change locally.\nlet a\n", "/**\n * @license lib 2.0.1\n * SPDX-License-Identifier: MIT\n */\nlet a\n"]
MINIFIED = ["!function(e,n){" + "n.a=function(t,r){for(var i=0;i<r.length;i++)t.push(r[i]);return t};" * 20 + "}({});"]
DATA = ["const x = [\n" + "\n".join(", ".join(f"{(i * j) % 97}.{j}" for j in range(12)) + "," for i in range(20)) + "\n];\n", '{\n "rows": [\n' + ",\n".join(f'  {{"k": {i}, "t": "v"}}' for i in range(60)) + "\n ]\n}\n", 'module.exports = "' + "aGVsbG8gd29ybGQ0Nz" * 60 + '";\n']


def test_handwritten(spark):
    groups = {"generated": GENERATED, "third_party": FOREIGN, "minified": MINIFIED, "data": DATA, "": PLAIN}
    rows = [(g, s) for g, v in groups.items() for s in v]
    paths = [("generated", "a/x.pb.go"), ("generated", "a/__generated__/x.ts"), ("third_party", "vendor/x/y.css"), ("", "src/vendors/y.ts"), ("minified", "p/a.min.js"), ("", "external_api/a.ts")]
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = "\n".join(f"function {word()}({word()}) {{\n  return {word()}({word()}.{word()}, {word()}) + {word()};\n}}" for _ in range(25))
    data = [(i, "r1", f"src/f{i}.ts", s, 9) for i, (_, s) in enumerate(rows)]
    data += [(100 + i, "r1", p, None, 9) for i, (_, p) in enumerate(paths)]
    data += [(200 + i, f"r{i % 3 + 1}", f"src/c{i}.ts", f"// own {i}\n" + shared.replace("function", "async function", i), 9) for i in range(4)]
    data += data[:3]
    files = spark.createDataFrame(data, "id long, repo_id string, relative_path string, source string, prints int")
    repos = spark.createDataFrame([("r1", "Own Co"), ("r2", "Else Co"), ("r3", None), ("r1", "Own Co")], "repo_id string, owner string")
    repos = repos.withColumn("owner", F.coalesce("owner", F.lit("Third Co")))
    got = {r["id"]: {f for f in ("generated", "minified", "third_party", "data") if r[f]} for r in H.not_handwritten(files, repos).collect()}
    for i, (g, s) in enumerate(rows):
        assert (g in got.get(i, ())) if g else i not in got, (g, s[:80], got.get(i))
    for i, (g, p) in enumerate(paths):
        assert (g in got.get(100 + i, ())) if g else 100 + i not in got, p
    assert all(got.get(200 + i) == {"third_party"} for i in range(4))  # copies in three repositories of three owners
    assert H.not_handwritten(files.limit(0), repos).count() == 0


RESIDUE = [
    "Thanks for contacting {{name}}. Your request $(id) has been logged.", "# [TEAM NAME]\n\n## Summary\n\nTBD", "Limit: [object Object].", "Version %VERSION% of it", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "Item 1: your text here", "xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx",
    "ここにダミーテキストが入ります。", "HTTP 500 – Internal Server Error", "Error 404: not found\nBack", '{"status": 429, "detail": "Too much"}', "Seite nicht gefunden", "# Gone\n", "<html><head><title>404 Page not found</title></head></html>", "Please enable JavaScript to view this page.",
    "This app requires scripting.", "このページを表示するには JavaScript を有効にしてください。", "Good text.\n\nThe page you asked for does not exist or has moved.\n\nMore text.", "PLEASE TURN ON CLIENT-SIDE SCRIPTS IN YOUR BROWSER.", "Pl\u200bease enable Java<|endoftext|>Script.", "Page owned by @@owner@@ here", "We are down for maintenance.", "Error 401: unauthorized they’re we'll", '{"error": {"code": 502}} हिन्दी',
]
CLEAN = [
    None, "", "  ", "word", "A null value is kept as null, an empty one is counted.", 'The test expects the "Please enable JavaScript" notice to be present.', "When the registry answers 404 Not Found, `f` retries.", "We keep one `access denied` fixture.", "Rule x flags strings such as 'Lorem ipsum dolor sit amet' in labels.",
    'The writer leaves "{{ x }}" alone and expands "${X}" at load time.', "```yaml\nname: ${{ env.X }}\nlabel: <%= y %>\n```\nText.", "Usage: decode <PATH> [OPTIONS] --limit <N>", "12:00:01 WARN registry answered 404 for x, attempt 1", "// replace __X__ during the build", "cut <|endoftext|> token", "cut [PAD] and <pad><unk> or </s> token [MASK]", "A 503 Service Unavailable from the mirror is counted as a failure.",
    "const a = `x ${b.c} of {${d + 1}}`;", "The JavaScript rule reports a cursor when load is called.",
]


def test_residue(spark):
    data = [(i, t, 1) for i, t in enumerate(RESIDUE + CLEAN)] + [(0, RESIDUE[0], 1)]
    d = spark.createDataFrame(data, "doc_id long, text string, kind int")
    found = {r["doc_id"] for r in R.residue_documents(d).collect()}
    assert sorted(found) == list(range(len(RESIDUE)))
    assert R.residue_documents(d.limit(0)).count() == 0


def test_failed_values_need_an_open_slot(spark):
    texts = ["Owner of it: {{owner}} today", "Owner of it: undefined today", "Owner of it: null today", "The value null is kept, undefined too."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in R.residue_documents(d).collect()) == [0, 1, 2]
    pages = spark.createDataFrame([(i, "Error 404: not found") for i in range(3)], "doc_id long, text string")
    assert [(r["kind"], r["documents"]) for r in R.repeated_pages(pages).collect()] == [("error_page", 3)]


def test_long_text(spark):
    d = spark.createDataFrame([(1, "fine words " * 50_000 + "\nError 404: not found\n"), (2, "a" * 300_000)], "doc_id long, text string")
    assert [r["doc_id"] for r in R.residue_documents(d).collect()] == [1]


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p6_ids", "p7_mix", "p8_found"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
