import random
import re

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import license_scan as scan
from tieout.llm.license_texts import NOTICES, PHRASES


def base_by_hand(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def scanner():
    return scan.scanner(tuple(NOTICES), tuple(PHRASES.items()), scan.LEAST_RUN, scan.MOST_GAP, scan.LEAST_COVER)


def longest_run_by_hand(words, sequences):
    grams = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    return [next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in grams), 0) for i in range(len(words))]


def test_matching_statistics_against_all_substrings():
    rng = random.Random(4)
    for _ in range(200):
        sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 8))] for _ in range(3)]
        own = scan.Scanner(tuple(("x", b" ".join(s).decode()) for s in sequences[:2]), ((b" ".join(sequences[2]).decode(), "p"),), 1, 3, 0.5)
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        runs, found = own.runs(words)
        for k in range(2):
            want = longest_run_by_hand(words, [sequences[k]])
            assert [(i, want[i]) for i in range(30) if want[i] and (i == 29 or want[i + 1] <= want[i])] == [(i, n) for i, n, notice, _ in runs if notice == k]
        p = sequences[2]
        assert sorted(i for i, _ in found) == [i for i in range(30) if words[i : i + len(p)] == p]


def chains_by_hand(words, notices, least_run, most_gap, least_cover):
    """Spans from maximal runs that are found by comparing all places of the text with all places of each notice."""
    spans = []
    for k, notice in enumerate(notices):
        longest = longest_run_by_hand(words, [notice])
        ends = [i for i, n in enumerate(longest) if n and (i == len(words) - 1 or longest[i + 1] <= n)]
        chain = None
        for i in ends:
            n = longest[i]
            places = [p for p in range(n - 1, len(notice)) if notice[p - n + 1 : p + 1] == words[i - n + 1 : i + 1]]
            if not places or n < min(least_run, len(notice)):
                continue
            later = [p for p in places if chain and p > chain["at"]]
            new = min(n, later[0] - chain["at"], i - chain["last"]) if later else 0
            if new > 0 and i - n - chain["last"] <= most_gap:
                chain |= {"last": i, "at": later[0], "covered": chain["covered"] + new}
            else:
                spans.append((k, chain))
                chain = {"first": i - n + 1, "last": i, "at": places[0], "covered": n}
        spans.append((k, chain))
    return sorted((f"n{k}", c["first"], c["last"], c["covered"] / len(notices[k])) for k, c in spans if c and c["covered"] >= least_cover * len(notices[k]))


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_chains_against_brute_force():
    rng = random.Random(16)
    found = 0
    for trial in range(300):
        letters = [b"a", b"b", b"c", b"d", b"e", b"f"][: 3 + trial % 4]
        notices = [[rng.choice(letters) for _ in range(rng.randint(4, 12))] for _ in range(3)]
        own = scan.Scanner(tuple((f"n{k}", b" ".join(x).decode()) for k, x in enumerate(notices)), (), 2, 2, 0.6)
        words = [rng.choice([*letters, b"z"]) for _ in range(10)]
        for x in notices:  # each notice with a few words gone, changed or put in
            words += [w for w in x if rng.random() > 0.1] + [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 5))]
        spans = own.spans(own.runs(words)[0])
        assert sorted(spans) == chains_by_hand(words, notices, 2, 2, 0.6)
        for label, first, last, cover in spans:
            notice = notices[int(label[1:])]
            assert common_subsequence(words[first : last + 1], notice) >= round(cover * len(notice))
        found += len(spans)
    assert found > 300


def test_a_stretch_of_one_notice_inside_a_run_of_another():
    """Six of b's nine words stand in a; a run of a that goes over them does not hide them."""
    b = "one two three four five six seven eight nine"
    a = "zero one two three four five six ten eleven twelve thirteen fourteen"
    own = scan.Scanner((("a", a), ("b", b)), (), 4, 8, 0.6)
    for text, want in (("one two three four five six", {"b"}), ("zero one two three four five six ten", {"a", "b"}), (a, {"a", "b"}), ("x zero one two three x", set())):
        words = scan.words_of(text)
        assert {s[0] for s in own.spans(own.runs(words)[0])} == want, text


def test_spans_and_labels():
    own = scanner()
    mit = NOTICES[2][1]
    found = own.scan("intro words here " + mit + " closing")
    assert found["labels"] == "mit" and found["score"] == 1.0 and found["spans"][0]["first"] == 3
    broken = mit.split()
    broken[10] = "unexpected"
    assert own.scan(" ".join(broken))["labels"] == "mit"
    assert 0.9 < own.scan(" ".join(broken))["score"] < 1
    assert own.scan("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by,cc-by-nc-4.0"
    assert own.scan("All Rights  reserved. ALL rights\nreserved")["n_base"] == 2
    assert own.scan("nothing of the kind in this text")["labels"] == ""
    assert own.scan(None) | {"spans": 0} == own.scan("") | {"spans": 0}
    assert own.scan("") ["first_word"] is None


def test_query_base_columns(spark):
    extra = ["cc by cc by", "GENERAL PUBLIC LICENSE all rights reserved", "cc  by-sa", "ÉCC by", "cc\x00by"]
    rng = random.Random(5)
    bag = "cc by general public license all rights reserved x".split()
    extra += [" ".join(rng.choice(bag) for _ in range(60)) for _ in range(20)]
    rows = hard_rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, hard_docs(spark).schema)
    got = sorted((tuple(r)[:6] for r in scan.query(docs).collect()), key=str)
    want = []
    for r in rows:
        n, places = base_by_hand(r[1])
        starts = [i for i, _ in places]
        want.append((r[0], n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=str)
    assert scan.query(no_docs(spark)).count() == 0
