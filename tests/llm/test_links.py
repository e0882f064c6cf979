"""Link counts of the Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from proofmill.llm import jaccard


def _shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_links(rows: list[tuple]) -> tuple[list[int], list[int]]:
    """(number of links, smallest reachable place) of each row, from all pairs."""
    sets = [_shingles(r[1]) for r in rows]
    links = [0] * len(rows)
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return links, [root(i) for i in range(len(rows))]


def _family(rng: random.Random, size: int, edits: int, words: int) -> list[str]:
    """Texts made of one text by edits, and of each other, so that similarities lie on both sides of the limit."""
    texts = [[f"w{rng.randrange(4000)}" for _ in range(words)]]
    while len(texts) < size:
        t = list(rng.choice(texts[: max(1, len(texts) // 3)]))
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = [f"w{rng.randrange(4000)}"] if rng.random() < 0.8 else []
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("seed", "side"), [(1, 1024), (2, 16), (3, 7)])
def test_links_are_those_of_all_pairs(frame, monkeypatch, seed, side):
    monkeypatch.setattr(jaccard, "SIDE", side)
    rng = random.Random(seed)
    texts = _family(rng, 90, 5, 60) + _family(rng, 60, 3, 40) + _family(rng, 40, 9, 120) + _family(rng, 30, 1, 9) + _family(rng, 25, 2, 4)
    texts += [rng.choice(texts) for _ in range(60)] + [" ".join(f"s{rng.randrange(99)}" for _ in range(30)) for _ in range(40)] + ["", " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    links, component = plain_links(rows)
    assert sum(links) > 500
    got = {r.doc_id: r for r in jaccard.jaccard_classes(frame(rows)).collect()}
    assert [got[i].n_links for i, _ in rows] == links
    assert [got[i].component_id for i, _ in rows] == component
    first = {}
    for i, t in rows:
        first.setdefault(_shingles(t) or i, i)
    assert [got[i].class_id for i, _ in rows] == [first[_shingles(t) or i] for i, t in rows]
    without = {r.doc_id: r for r in jaccard.jaccard_classes(frame(rows), count_links=False).collect()}
    assert [without[i].component_id for i, _ in rows] == component and {r.n_links for r in without.values()} == {None}


def test_answers_follow_from_the_home_and_no_pair_is_emitted(spark):
    """Sets near one home are counted by sums of sizes alone: none is active."""
    rows = [(b"r" * 16, bytes([i]) * 16, 700, 1, 10, b"".join((1000 * i + k).to_bytes(8, "little") for k in range(10))) for i in range(200)]
    members = spark.createDataFrame([(r, s, n, w, d, bytearray(x)) for r, s, n, w, d, x in rows], "root binary, set_id binary, n long, w long, d long, delta binary")
    got = jaccard._links_within(members).groupBy("set_id").sum("times").collect()
    assert len(got) == 200 and {r[1] for r in got} == {199}
