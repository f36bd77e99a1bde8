import hashlib
import json
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tallyloom.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    r = random.Random(3)
    alphabet = [*"ab 's\n\t'tre llvd dm019!#é漢  \x1c\x85́ß🎉"] + ["'s", "'re", "'ll", "<|endoftext|>", "   ", "aaaa", "'S"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "the" * 300 + "x", "x" * 70 + " y", "<|endoftext|><|endoftext|>a's", "'", "Is'n't've 'll"]
    texts += ["".join(chr(c) for c in range(i, i + 211) if not 0xD800 <= c < 0xE000) for i in range(0, 0x11000, 211)]
    ids = bpe.encode_texts(texts, PATH)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode_ids(i, PATH) for i in ids[:300]] == [library.decode(i, skip_special_tokens=False) for i in ids[:300]]


def test_a_mark_does_not_reach_over_two_texts(library):
    assert bpe.encode_texts(["a<|endof", "text|>b"], PATH) == [library.encode(t, add_special_tokens=False).ids for t in ("a<|endof", "text|>b")]


def test_table(frame, edge_rows, library):
    out = bpe.bpe_encode(frame(edge_rows), PATH).collect()
    assert len(out) == len(edge_rows)
    want = sorted((str(r[0]), hashlib.sha256(",".join(map(str, library.encode(r[1] or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in edge_rows)
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert bpe.bpe_encode(frame([]), PATH).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for name, change in (("pattern", {"pre_tokenizer": {"type": "Whitespace"}}), ("space", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}), ("norm", {"normalizer": {"type": "NFC"}}), ("ids", {"added_tokens": [{"id": 1 << 17, "content": "<x>"}]})):
        (tmp_path / name).write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match=name if name == "ids" else "byte-level"):
            bpe.Vocabulary(str(tmp_path / name))
