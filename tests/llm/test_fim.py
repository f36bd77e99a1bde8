import hashlib
import re

import numpy as np
import pytest
from llm_rows import prose, row

from tallyloom.llm import fim


def by_hand(i, text, rate=100, spm=50, marks=fim.MARKS):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(fim.LINES, text)
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    return (n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid) if h[3] % 100 < spm else (n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid)


@pytest.fixture
def rows(edge_rows):
    texts = ["a\nb\nc", "\n", "\n\n\n", "x\r\ny\r\n", "été \U0001f389\n\U0001f389", "holds <M>\nlines", "<<S", "<\n<P\nS>", "a<S\n>", "\0\nz", " a\x0bb\n"]
    return edge_rows + [row(20 + i, t) for i, t in enumerate(texts)] + [row(60 + i, "\n".join(prose(i, 9) for _ in range(i % 7))) for i in range(60)]


@pytest.mark.parametrize(("rate", "spm", "marks"), [(100, 50, fim.MARKS), (60, 0, ("|p|", "|suffix|", "|m|"))])
def test_forms_and_round_trip(frame, rows, rate, spm, marks):
    made = fim.fill_in_middle(frame(rows), fim_rate=rate, spm_rate=spm, marks=marks)
    got = made.select("*", fim.restored(made.output, made.form, marks).alias("back")).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(r[0], *by_hand(r[0], r[1], rate, spm, marks), r[1] or "") for r in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})
    assert fim.fill_in_middle(frame([])).count() == 0


def test_pieces_of_long_texts():
    text = "".join(f"{'é' * (i % 11)}\n" for i in range(500)) + "x" * 300 + "\nend"
    want = np.cumsum([len(u) for u in re.findall(fim.LINES, text)])
    for piece in (1, 7, 64, 10**6):
        assert (fim.line_ends(text, piece) == want).all()
    assert len(fim.line_ends("")) == 0
