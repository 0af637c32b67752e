"""Clones against a comparison of all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from tessera.functions import python_source
from tessera.operators import code
from tessera.operators.components import components


def sources(seed, n):
    """Files of one function each, many of them edited copies of few."""
    rnd = random.Random(seed)
    names = "load save read user file table row price tax total left right".split()

    def line(letters):
        a, b, c = (rnd.choice(names) for _ in range(3))
        word = "".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 30)))
        return rnd.choice([f"    {a} = {b} + {c} * {rnd.randrange(9999)}", f"    if {a} > {rnd.randrange(99)}:\n        {b} = {word!r}", f"    {a}.{word}({b}[{c}])", f"    print({word!r}, {b})"])

    alphabets = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 4)) for _ in range(n // 4)]
    kinds = [(x, [line(x) for _ in range(rnd.randrange(3, 9))]) for x in alphabets]
    for i in range(n):
        letters, body = rnd.choice(kinds)
        body = list(body)
        for _ in range(rnd.randrange(5)):
            body[rnd.randrange(len(body))] = line(letters)
        yield f"f{i}.py", f"def work_{i}(load, save):\n" + "\n".join(body) + "\n    return total\n"


def plain_groups(found, threshold):
    """Components of type 3 over all pairs of codes."""
    texts = {}
    for r in sorted(found, key=lambda r: r.id):
        texts.setdefault(r.hash_renamed, (r.id, r.renamed))
    nodes = sorted(texts.values())
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, (a, s) in enumerate(nodes):
        for b, t in nodes[i + 1 :]:
            matcher = SequenceMatcher(None, s, t)
            # `quick_ratio` is never less than `ratio`.
            if matcher.quick_ratio() >= threshold - 0.001 and round(matcher.ratio(), 4) >= threshold:
                linked += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in nodes}, linked


@pytest.mark.parametrize("threshold", [0.7, 0.85])
def test_type_three_groups_equal_all_pairs(spark, threshold):
    files = spark.createDataFrame(list(sources(5, 300)), "path string, text string")
    found = code.materialize(code.fragments(python_source.parse(files), min_lines=3, min_tokens=8), "fragments")
    links = code.materialize(code.clones(found, threshold).filter("type = 'type3'"), "links")
    want, linked = plain_groups(found.collect(), threshold)
    got = {r.node: r.component for r in components(links).collect()}
    assert linked > 20 and len(set(want.values())) > 20
    assert {i: got.get(i, i) for i in want} == want


def test_code_inside_other_code_is_no_clone_of_it(spark):
    method = "    def run(self, a):\n        b = a + 1\n        c = b * 2\n        d = c - a\n        return [a, b, c, d]\n"
    one = [("a.py", "class A:\n" + method)]
    entities = python_source.parse(spark.createDataFrame(one, "path string, text string"))
    assert code.clones(code.materialize(code.fragments(entities, 3, 8), "fragments")).count() == 0
    entities = python_source.parse(spark.createDataFrame([*one, ("b.py", "class B:\n" + method)], "path string, text string"))
    assert {r.type for r in code.clones(code.materialize(code.fragments(entities, 3, 8), "fragments")).collect()} >= {"type1"}
    assert code.clones(code.materialize(code.fragments(entities.limit(0), 3, 8), "fragments")).count() == 0
