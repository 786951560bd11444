import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import bpe

WHOLE = Tokenizer.from_file(bpe.VOCABULARY)


def truth(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_every_piece_encodes_to_itself_in_id_order():
    """With this, merging by rank and merging by listed pairs are the same function."""
    own = bpe.codec(bpe.VOCABULARY)
    names = [WHOLE.id_to_token(i) for i in range(50256)]
    for i, name in enumerate(names):
        assert [t.id for t in WHOLE.model.tokenize(name)] == [i]
        assert own.fast._encode_single_piece(own.pieces[i]) == [i]


def test_tree_equals_library_on_random_texts():
    rng = random.Random(1)
    own = bpe.Codec(bpe.VOCABULARY, leaf_chars=24)
    alphabets = ["ab", "abc  ", "aeiou tnr\n", "é à x", "019 ", "!?-. ", "a'st re ll", "日本 x", " \n\t", "aA1 .é"]
    for trial in range(1500):
        letters = alphabets[trial % len(alphabets)]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 600)))
        if trial % 7 == 0:
            text = text[:50] + "<|endoftext|>" + text[50:]
        ids = own.encode(text)
        assert ids.tolist() == truth(text), repr(text)
        assert own.decode(ids) == WHOLE.decode(truth(text), skip_special_tokens=False) == text


def test_long_unsplit_run():
    rng = random.Random(2)
    own = bpe.Codec(bpe.VOCABULARY, leaf_chars=512)
    for letters in ("abcdefgh", "theinra", "0123456789", "#-=*"):
        text = "x " + "".join(rng.choice(letters) for _ in range(20_000)) + " y"
        assert own.encode(text).tolist() == truth(text)


ALPHABETS = {
    "russian": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё" + " " * 6 + ",.",
    "chinese": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实" + "，。",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "hex": "0123456789abcdef",
    "code": "abcxyz(){};=+.,'\"09_",
    "mixed": "aб1中 é'\n\t!٣ⅷ²𝒳🙂́\u200d\u3000ß",
}


def long_text(name, n, seed=4):
    rng = random.Random(seed)
    return "".join(rng.choices(ALPHABETS[name], k=n))


def test_unsplit_texts_of_any_script():
    own = bpe.Codec(bpe.VOCABULARY, leaf_chars=64)
    for name in ALPHABETS:
        for seed in range(12):
            text = long_text(name, 700, seed)
            assert own.encode(text).tolist() == truth(text), (name, seed)
    own = bpe.Codec(bpe.VOCABULARY, leaf_chars=512)
    for letters in ("中", "абв", "ⅷ٣", "…。", "é", "𝒳"):  # no boundary at all
        text = "".join(random.Random(1).choices(letters, k=20_000))
        assert own.encode(text).tolist() == truth(text), letters


def test_seams_stay_short(monkeypatch):
    """What joins encode again is a small part of the text, whatever its script."""
    own = bpe.Codec(bpe.VOCABULARY)
    for name in ALPHABETS:
        text, again = long_text(name, 60_000), []
        leaf = own.leaf
        monkeypatch.setattr(own, "leaf", lambda t: again.append(len(t)) or leaf(t))
        assert own.encode(text).tolist() == truth(text)
        monkeypatch.undo()
        assert sum(again) < 1.1 * len(text), (name, sum(again))


def test_a_million_characters_of_mixed_classes():
    text = "".join(long_text(name, 180_000) for name in ALPHABETS)
    assert bpe.Codec(bpe.VOCABULARY).encode(text).tolist() == truth(text)


def test_very_long_texts(spark):
    """More than a million characters: prose, an unsplit run, special tokens at and across the cuts, other letters."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9)))
    prose = " ".join(word() for _ in range(250_000))
    texts = [prose, prose[:700_000] + "<|endoftext|>" + prose[700_000:] + "日本" * 50, "ab" * 100_000, ("<|endoftext|>" * 9000), prose]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, decode=True).collect()}
    for k, text in enumerate(texts):
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == truth(text)
        assert got[k]["decoded"] == text


def test_query_and_spread_path(spark):
    for spread in (bpe.SPREAD_CHARS, 1000):
        got = bpe.encode(hard_docs(spark), spread_chars=spread, leaf_chars=256, decode=True).collect()
        have = sorted(((r["doc_id"] is None, r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got)
        want = sorted(((r[0] is None, r[0]), truth(r[1]), r[1] or "") for r in hard_rows())
        assert have == want
    rows = bpe.query(hard_docs(spark)).where("doc_id = 3").collect()
    text = hard_rows()[3][1]
    assert {r["decoded_sha256"] for r in rows} == {hashlib.sha256(text.encode()).hexdigest()}
    assert rows[0]["ids_sha256"] == hashlib.sha256(np.array(truth(text), "<u4").tobytes()).hexdigest()
    assert bpe.query(no_docs(spark)).count() == 0
