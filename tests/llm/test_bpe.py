import random

import pytest

from lexquarry.llm import bpe

SIGNS = [" ", "\n", "\t", "a", "b", "é", "é", "Σ", "ς", "İ", "ß", "1", "½", ".", ",", "!", "'", "'s", "<|endoftext|>", "中", "́", "　", "\xa0", "🙂", "\x00", "Ω", "K", "ﬁ", "‍", "क़"]


def expected(t, x):
    ids = t.encode(x, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_library_on_odd_texts(seed):
    rng, t = random.Random(seed), bpe.load(None)
    encoder = bpe.ChunkEncoder(t)
    for _ in range(120):
        texts = ["".join(rng.choice(SIGNS) for _ in range(rng.choice([0, 1, 2, 4, 9, 60, 3000]))) for _ in range(4)]
        texts += [texts[3] * 3, "x" + texts[3], "a" * 5000, "́" * 3]
        assert encoder.encode(texts) == [expected(t, x) for x in texts]


def test_shared_passages_are_encoded_once():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    encoder = bpe.ChunkEncoder(bpe.load(None))
    encoder.encode([passage])
    once = encoder.encoded
    encoder.encode(["other words before it " + passage, passage[777:]])
    assert once > 5 and encoder.encoded <= once + 6


def test_empty_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_CHARS", 10)
    t = bpe.load(None)
    encoder = bpe.ChunkEncoder(t)
    for x in ["one two, three. four five", "one six seven", "", " ", "eight." * 50]:
        assert encoder.encode([x]) == [expected(t, x)]


def test_frames(spark):
    docs = spark.createDataFrame([(1, "The cat, the dog.", 5), (2, None, 6), (3, "", 7), (3, "", 7), (4, "x " * 5000, 8)], "doc_id long, text string, n_tokens long")
    t = bpe.load(None)
    rows = bpe.encode(docs).collect()
    assert [(r.n_tokens, r.ids) for r in rows] == [(len(i), i) for i in (t.encode(r.text or "", add_special_tokens=False).ids for r in rows)]
    assert [r.decoded for r in bpe.decode(bpe.encode(docs)).collect()] == [t.decode(t.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in rows]
    assert bpe.digests(docs.limit(0)).count() == 0


def test_other_layouts_are_refused(tmp_path):
    import json
    import os

    spec = json.load(open(bpe.default_path()))
    bpe.check_layout(spec)
    for change in ({"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": None}, {"added_tokens": [{"content": "a b"}]}):
        with pytest.raises(bpe.UnknownLayout):
            bpe.check_layout(spec | change)
    with pytest.raises(bpe.UnknownLayout):
        bpe.load(os.path.join(os.path.dirname(bpe.default_path()), "byte_bpe_50k.json"))
