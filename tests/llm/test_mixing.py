import random
import re
from collections import defaultdict

import pytest
from llm_rows import prose, row

from tallyloom.llm import mixing


def fill(sizes, weights, most):
    """Targets by repeated sharing out."""
    target, free, left = {}, dict(sizes), float(sum(sizes.values()))
    while free:
        w = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / w > most * sizes[k]]
        if not over:
            return target | {k: left * weights[k] / w for k in free}
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(most * sizes[k] for k in over)
        free = {k: v for k, v in free.items() if k not in over}
    return target


def test_targets_and_taken(frame):
    rows = [row(i, prose(i, 5 + i % 40), "en", s) for i, s in enumerate(["a"] * 30 + ["b"] * 400 + ["c"] * 300 + [None] * 200 + ["d"] * 4)]
    out = mixing.mix_sources(frame(rows)).collect()
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in out:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[source[r.doc_id]] += r.taken
    largest = defaultdict(int)
    for r in out:
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) < 2 * largest[s] for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix_sources(frame(rows[::-1])).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in out)


def test_edges(frame, edge_rows):
    out = mixing.mix_sources(frame(edge_rows)).collect()
    assert len(out) == len(edge_rows) and all(r.size == 0 or r.source_size > 0 for r in out)
    assert mixing.mix_sources(frame([])).count() == 0
    rows = [row(1, "a b"), row(2, "c d e", "en", "b")]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(frame(rows)).collect()}
    got = mixing.mix_documents(frame(rows)).collect()
    assert {i: sum(r.doc_id == i for r in got) for i in copies} == copies


def test_null_and_repeated_ids(frame):
    rows = [row(None, prose(i, 20)) for i in range(6)] + [row(5, prose(40 + i, 20)) for i in range(6)]
    docs = frame(rows)
    copies = sum(r.copies for r in mixing.mix_sources(docs).collect())
    got = mixing.mix_documents(docs).collect()
    assert copies == len(got) == 12 and sorted(r.text for r in got) == sorted(r[1] for r in rows)


def test_taken_is_within_two_documents_of_the_target(frame):
    r = random.Random(4)
    rows = [row(i, prose(i, r.choice([3, 20, 20, 60, 400, 900])), "en", f"s{r.randrange(9)}") for i in range(400)]
    out = mixing.mix_sources(frame(rows)).collect()
    source = {x[0]: x[3] for x in rows}
    for s in set(source.values()):
        mine = [x for x in out if source[x.doc_id] == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) < 2 * max(x.size for x in mine)
