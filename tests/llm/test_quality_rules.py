import random
import re
from collections import Counter

import regex

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import quality_rules as rules


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(covered), failed


def test_counts_against_brute_force(spark):
    rng = random.Random(6)
    extra = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    extra += ["\n".join(rng.choice(["x y", "x  y", " ", "", "##|"]) for _ in range(9)) for _ in range(20)]
    rows = hard_rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(extra)]
    got = rules.query(spark.createDataFrame(rows, hard_docs(spark).schema)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((r[0], *by_hand(r[1])) for r in rows), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert rules.query(no_docs(spark)).count() == 0


def em_by_hand(patterns, rounds):
    import math

    n = len(rules.rules())
    prior, good, bad = rules.START["prior"], [rules.START["on_good"]] * n, [rules.START["on_bad"]] * n

    def post(v):
        odds = math.log(prior / (1 - prior))
        for x, g, b in zip(v, good, bad):
            odds += {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0.0}[x]
        return 1 / (1 + math.exp(-odds))

    weight = rules.HELD_SHARE * sum(patterns.values())
    for _ in range(rounds):
        p = {v: post(v) for v in patterns}
        cast = lambda r, w: weight + sum(c * w(v) * abs(v[r]) for v, c in patterns.items())
        right = lambda r, w, side, held: weight * held + sum(c * w(v) for v, c in patterns.items() if v[r] == side)
        is_good, is_bad = (lambda v: p[v]), (lambda v: 1 - p[v])
        good = [right(r, is_good, 1, rules.HELD["on_good"]) / cast(r, is_good) for r in range(n)]
        bad = [right(r, is_bad, -1, rules.HELD["on_bad"]) / cast(r, is_bad) for r in range(n)]
        prior = (1 + sum(c * p[v] for v, c in patterns.items())) / (2 + sum(patterns.values()))
    return {v: post(v) for v in patterns}


def test_expectation_maximisation_against_plain_python(spark):
    rng = random.Random(8)
    n = len(rules.rules())
    votes = [tuple(rng.choices((1, 0, -1), (6, 2, 1 + 3 * (k % 5 == 0)))[0] for _ in range(n)) for k in range(300)]
    code = {v: sum((x + 1) * 3**k for k, x in enumerate(v)) for v in votes}
    got = {r["pattern"]: r["posterior"] for r in rules.posteriors(rules.fit(spark.createDataFrame([(code[v],) for v in votes], "pattern int"), 5)).collect()}
    want = em_by_hand(Counter(votes), 5)
    assert set(got) == {code[v] for v in want}
    assert all(abs(got[code[v]] - p) < 1e-9 for v, p in want.items())


def votes_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = by_hand(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    inside = lambda pattern: sum(map(len, regex.findall(pattern, text)))
    space = r"\x20\t\n\x0b\f\r"
    chars, many = max(word_chars, 1), max(n_words, 1)
    symbols, repeats, doubles = n_symbols / chars, n_repeat / many, n_dup / max(len(lines), 1)
    capitals, letters = inside(r"\p{Lu}") / chars, inside(r"\p{L}") / chars
    runs = len(regex.findall(rf"[^\p{{L}}\p{{N}}{space}]{{2,}}", text)) / many
    bare = len(regex.findall(rf"(?<=[{space}])[^\p{{L}}\p{{N}}{space}]+(?=[{space}])", text)) / many
    mean, distinct = word_chars / many, len(set(words)) / many
    pairs = [
        (n_words >= 80, n_words < 50),
        (symbols < 0.02, symbols > 0.06),
        (letters > 0.85, letters < 0.75),
        (runs < 0.05, runs > 0.2),
        (bare < 0.05, bare > 0.2),
        (doubles < 0.2, doubles > 0.6),
        (repeats < 0.1, repeats > 0.3),
        (capitals < 0.25, capitals > 0.5),
        (3 <= mean <= 11, mean < 2 or mean > 15),
        (distinct > 0.2, distinct < 0.05 and n_words > 50),
    ]
    return tuple(-1 if bad else 1 if good else 0 for good, bad in pairs)


def test_kept_against_brute_force(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghiü") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    junk = ["##|", "-- !!", "$$$", "A", "LOUD", "x\nx\nx", "1234567890"]
    texts = [" ".join(rng.choice(vocabulary) if rng.random() > dirt else rng.choice(junk) for _ in range(rng.randint(20, 200))) for dirt in [0, 0, 0, 0.1, 0.4, 0.8] * 30]
    rows = hard_rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(texts)]
    votes = [votes_by_hand(r[1]) for r in rows]
    posterior = em_by_hand(Counter(votes), rules.ROUNDS)
    want = [(r[0], posterior[v] >= rules.LEAST_POSTERIOR and not by_hand(r[1])[-1]) for r, v in zip(rows, votes)]
    got = rules.query(spark.createDataFrame(rows, hard_docs(spark).schema)).select("doc_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < sum(k for _, k in want) < len(want)


def test_accuracies_are_estimated(spark):
    rng = random.Random(13)
    n = len(rules.rules())
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = [rng.choices((1, -1), (95, 5) if good else (40, 60))[0] for _ in range(n)]
        rows.append((sum((x + 1) * 3**k for k, x in enumerate(votes)),))
    found = rules.accuracies(rules.fit(spark.createDataFrame(rows, "pattern int"))).collect()
    assert [r["rule"] for r in found] == list(rules.rules())
    assert all(abs(r["on_good"] - 0.95) < 0.03 and abs(r["on_bad"] - 0.6) < 0.08 for r in found)


def test_good_kept_and_junk_rejected(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(150))
    rows = [(i, prose()) for i in range(60)] + [(100 + i, " ".join(w + "###" for w in prose().upper().split())) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in rules.keep_good(docs).collect()}
    assert kept == set(range(60))
